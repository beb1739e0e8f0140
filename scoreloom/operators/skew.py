"""Joins whose key may hold any share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has more than a HOT_PARTS-th of all rows and at least HOT_ROWS; a hot key is dealt over SALTS tasks.
HOT_PARTS, HOT_ROWS, SALTS = 500, 1000, 32


def hot_values(counts: DataFrame, key: str, count: str = "count", parts: int = HOT_PARTS, least: int = HOT_ROWS) -> list:
    """The hot values of a key, given the number of rows of each value; fewer than ``parts`` by their definition, so they may be
    collected. Null joins nothing and is never hot."""
    whole = counts.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    return [r[0] for r in counts.where(F.col(key).isNotNull() & (F.col(count) > max(whole / parts, least))).select(key).collect()]


def salted_join(rows: DataFrame, table: DataFrame, key: str, hot: list, spread: list[Column], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``rows`` joined with ``table`` on ``key``: rows of hot keys are dealt by ``spread``, and the table's rows of hot keys, which
    should be few, are copied to all these parts. ``how`` may be inner, left, left_semi or left_anti."""
    if not hot:
        return rows.join(table, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    dealt = rows.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(*spread), F.lit(salts))).otherwise(F.lit(0)).cast("int"))
    copied = table.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(copied, [key, "_salt"], how).drop("_salt")
