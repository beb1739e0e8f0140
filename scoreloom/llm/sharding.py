"""Sharding by proportional stratified interleaving, in DataFrame functions only.

Rows are ordered inside their source by a seeded hash, which shuffles them. Row r of the n rows of a source has the
fractional rank (r - u) / n, where u, between 0 and 1, is a seeded hash of the source: so sources of one or a few rows are spread
over all ranks instead of meeting in their middle. In the order of the fractional ranks every stretch holds the sources in their overall
proportions, so equal cuts of it give shards whose sizes differ by one row at most and whose mixtures match the whole.

Neither rank is computed in one task. A source is dealt into buckets of its hash order and the fractional ranks into buckets
of theirs; a window numbers the rows inside a bucket, and the running sums of the bucket sizes are added. The sums are over
``BUCKETS`` rows for a source, and over ``BUCKETS`` rows in all for the second rank, whatever the input. A source with any
share of all rows is thus spread over all tasks. Rows that are equal in all columns are counted first and numbered, and the
seeded hash looks at all columns and this number, so that neither one id nor one repeated row fills a bucket. Only narrow rows
are shuffled.

Defined cases: a null source is a stratum of its own; null and repeated ids are shuffled like any others; rows that are equal in
all columns share their places in any order; texts travel only if they are handed in; an empty table gives no rows; fewer rows than shards leave shards empty; columns that clash with the added ones are refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKET_BITS = 12
BUCKETS = 1 << BUCKET_BITS
SEED = 20260101


def _ranked(rows: DataFrame, ties: list[str]) -> DataFrame:
    """Add _f, the fractional rank inside the source, and _fb, its bucket."""
    sizes = rows.groupBy("_stratum", "_kb").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy("_stratum")
    offsets = sizes.select("_stratum", "_kb", (F.sum("_n").over(whole.orderBy("_kb")) - F.col("_n")).alias("_before"), F.sum("_n").over(whole).alias("_total"))
    inside = Window.partitionBy("_stratum", "_kb").orderBy("_key", *ties)
    placed = rows.withColumn("_r", F.row_number().over(inside)).join(offsets, ["_stratum", "_kb"])
    f = (F.col("_r") + F.col("_before") - F.col("_u")) / F.col("_total")
    return placed.withColumn("_f", f).withColumn("_fb", F.least(F.floor(F.col("_f") * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))


def interleave(rows: DataFrame, shards: int, *, id_col: str = "doc_id", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """Add ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard). Hand in narrow rows: all columns travel."""
    taken = {"shard", "slot", "_stratum", "_kb", "_key", "_n", "_before", "_total", "_r", "_f", "_fb", "_u", "_copy"} & set(rows.columns)
    if shards < 1 or taken:
        raise ValueError(f"shards must be positive and columns {sorted(taken)} absent")
    columns = rows.columns
    stratum = F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string")))
    key = F.xxhash64(F.lit(seed), F.col(id_col), *columns, "_copy")
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "_stratum"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    numbered = rows.groupBy(*columns).agg(F.count("*").alias("_n")).select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), "_n")).alias("_copy"))
    keyed = numbered.withColumn("_stratum", stratum).withColumn("_u", unit).withColumn("_key", key).withColumn("_kb", F.shiftrightunsigned("_key", 64 - BUCKET_BITS).cast("int"))
    counts = _ranked(keyed.select("_stratum", "_kb", "_key", "_u"), []).groupBy("_fb").agg(F.count("*").alias("_n"))
    ahead = Window.orderBy("_fb")  # over BUCKETS rows at most
    offsets = counts.select("_fb", (F.sum("_n").over(ahead) - F.col("_n")).alias("_ahead"), F.sum("_n").over(ahead.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"))
    order = Window.partitionBy("_fb").orderBy("_f", "_stratum", "_key", *columns)
    placed = _ranked(keyed, columns).withColumn("_g", F.row_number().over(order)).join(F.broadcast(offsets), "_fb")
    at = F.col("_g") + F.col("_ahead") - 1
    shard = F.expr(f"cast((_g + _ahead - 1) * {shards} div _all as int)")
    return placed.withColumn("shard", shard).withColumn("slot", (at - F.expr(f"(shard * _all + {shards - 1}) div {shards}")).cast("long")).select(*columns, "shard", "slot")


def op4_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return interleave(narrow, 16).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
