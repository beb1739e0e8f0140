"""Integrity checks as DataFrames of violations; an audit passes when they are empty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def failed_rules(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks, in order; a rule that is null counts as broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def first_failed(rules: dict[str, Column]) -> Column:
    """The first broken rule, or null."""
    return reduce(lambda chain, item: chain.when(~F.coalesce(item[1], F.lit(False)), F.lit(item[0])), rules.items(), F.when(F.lit(False), F.lit("")))


def violations(rows: DataFrame, rules: dict[str, Column], keys: list[str]) -> DataFrame:
    return rows.select(*keys, F.array_join(failed_rules(rules), ";").alias("failed")).where("failed <> ''")


def not_blank(c: str) -> Column:
    return F.trim(F.col(c)) != ""


def finite(c: str) -> Column:
    x = F.col(c).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def spanning(items: DataFrame, families: dict[str, list[Column]], split: str = "split") -> DataFrame:
    """(family, key, splits): key values that occur in more than one split."""
    out = None
    for name, parts in families.items():
        key = F.concat_ws("\x1f", *parts)
        blank = reduce(lambda a, p: a | p.isNull() | (p.cast("string") == ""), parts, F.lit(False))
        found = items.where(~blank).groupBy(key.alias("key")).agg(F.count_distinct(split).alias("splits")).where("splits > 1").select(F.lit(name).alias("family"), "key", "splits")
        out = found if out is None else out.union(found)
    return out


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def reconcile(expected: DataFrame, actual: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows that are missing from, stale in, or different in ``actual``."""
    a = expected.select(*keys, F.struct(*values).alias("want"), F.lit(1).alias("l"))
    b = actual.select(*keys, F.struct(*values).alias("have"), F.lit(1).alias("r"))
    kind = F.when(F.col("r").isNull(), "missing").when(F.col("l").isNull(), "stale").when(~F.col("want").eqNullSafe(F.col("have")), "mismatch")
    return a.join(b, keys, "full_outer").select(*keys, kind.alias("fault")).where("fault is not null")


def accounting(used: DataFrame, left: DataFrame, every: DataFrame, key: str) -> DataFrame:
    """One row of counters: used and left-over must be disjoint and together everything."""
    marked = used.select(key, F.lit(1).alias("u"), F.lit(0).alias("l"), F.lit(0).alias("e")).union(left.select(key, F.lit(0), F.lit(1), F.lit(0))).union(every.select(key, F.lit(0), F.lit(0), F.lit(1)))
    per = marked.groupBy(key).agg(*[F.max(c).alias(c) for c in "ule"])
    return per.agg(
        F.sum("u").alias("used"), F.sum("l").alias("left_over"), F.sum("e").alias("total"), F.count_if((F.col("u") == 1) & (F.col("l") == 1)).alias("in_both"),
        F.count_if((F.col("e") == 1) & (F.col("u") + F.col("l") == 0)).alias("missing"), F.count_if((F.col("e") == 0)).alias("unknown"),
    )


def same_sets(a: DataFrame, b: DataFrame, group: str, member: str) -> DataFrame:
    """(group, equal): whether both sides have the same members per group."""
    marked = a.select(group, member, F.lit(1).alias("x"), F.lit(0).alias("y")).union(b.select(group, member, F.lit(0), F.lit(1)))
    per = marked.groupBy(group, member).agg(F.max("x").alias("x"), F.max("y").alias("y"))
    return per.groupBy(group).agg(F.bool_and((F.col("x") == 1) & (F.col("y") == 1)).alias("equal"))


def raise_if_any(found: DataFrame, what: str) -> None:
    """Fail before anything is written; shows at most a few of the violations."""
    some = found.limit(5).collect()
    if some:
        raise ValueError(f"{what}: {[r.asDict() for r in some]}")
