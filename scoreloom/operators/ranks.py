"""Ranks and quantiles of whole groups without putting a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_ranks(rows: DataFrame, group: str, digest: str, ties: list[str]) -> DataFrame:
    """Add ``rank`` (from 1, in the order of a hexadecimal digest and ``ties``) and ``total`` (rows of the group).

    The digest's first three digits deal every group into 4,096 buckets; rows are numbered inside a bucket, and the sizes of the
    buckets below, at most 4,096 a group, are added.
    """
    keyed = rows.withColumn("_bucket", F.substring(digest, 1, 3))
    sizes = keyed.groupBy(group, "_bucket").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(group)
    below = sizes.select(group, "_bucket", (F.sum("_n").over(whole.orderBy("_bucket")) - F.col("_n")).alias("_below"), F.sum("_n").over(whole).alias("total"))
    inside = Window.partitionBy(group, "_bucket").orderBy(digest, *ties)
    return keyed.withColumn("_r", F.row_number().over(inside)).join(below, [group, "_bucket"]).withColumn("rank", F.col("_r") + F.col("_below")).drop("_bucket", "_r", "_below")


def quantiles(rows: DataFrame, value: str, shares: list[float], buckets: int = 4096) -> DataFrame:
    """One row with the array ``q`` of the linearly interpolated quantiles of a whole-number column (nulls don't count; null entries
    without rows).

    Values are counted, the counts summed in ranges of values, and only the ranges that hold a wanted rank are numbered.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("long").alias("v")).agg(F.count("*").alias("n"))
    span = counts.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("all"))
    ranged = counts.crossJoin(F.broadcast(span)).withColumn("b", F.expr(f"cast((v - lo) div greatest(1, (hi - lo) div {buckets} + 1) as int)"))  # one row of bounds
    sums = ranged.groupBy("b").agg(F.sum("n").alias("n"))
    below = sums.select("b", (F.sum("n").over(Window.orderBy("b")) - F.col("n")).alias("below"), F.col("n").alias("held"))  # one row per range
    wanted = span.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), ((F.col("all") - 1) * F.lit(s)).alias("at")) for i, s in enumerate(shares)])).alias("w")).select("w.i", F.col("w.at"), F.explode(F.array_distinct(F.array(F.floor("w.at"), F.ceil("w.at")))).alias("place"))
    hit = below.join(F.broadcast(wanted), (F.col("place") >= F.col("below")) & (F.col("place") < F.col("below") + F.col("held"))).select("b", "below", "i", "at", "place")
    upto = F.sum("n").over(Window.partitionBy("b").orderBy("v"))
    numbered = ranged.join(F.broadcast(hit.select("b", "below").distinct()), "b").withColumn("upto", upto + F.col("below"))
    found = numbered.drop("below").join(F.broadcast(hit), "b").where((F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("n")))
    share = F.col("at") - F.floor("at")
    one = found.groupBy("i").agg(F.min("v").cast("double").alias("a"), F.max("v").cast("double").alias("z"), F.first(share).alias("f"))
    return one.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", (F.col("a") * (1 - F.col("f")) + F.col("z") * F.col("f")).alias("q")))), lambda x: x["q"]).alias("q"))


def label_of(value: Column, cuts: Column, names: list[str]) -> Column:
    """The first name whose cut is not below the value, else the last."""
    out = F.when(value <= cuts[0], names[0])
    for k, name in enumerate(names[1:-1], 1):
        out = out.when(value <= cuts[k], name)
    return out.otherwise(names[-1])
