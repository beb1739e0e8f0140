"""A journal that is read as it grows: the latest row of every key, kept by Structured Streaming (an extension; the batch form is
``assemble.latest`` and ``assemble.recover``).

The state of the stream is one row per key, in the state store that its checkpoint folder restores. Every micro-batch writes the keys
that changed to a folder of its own, named by its number: a batch that runs again after a loss writes the same folder again, so
nothing is there twice. A snapshot is the latest of what the folders say of a key, existing rows first if there are any.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scoreloom.operators.assemble import recover


def latest_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of every key that is last by ``order`` (then by its other columns, which must be comparable); batch or stream."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    return rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("r")).select(*keys, "r.*").select(*rows.columns)


def follow(journal: DataFrame, folder: str, checkpoint: str, keys: list[str], order: list[str], *, after: Callable[[int], None] | None = None) -> StreamingQuery:
    """Start reading ``journal``, a streaming DataFrame, to its present end; changed keys of batch n go to ``folder``/batch=n.
    ``after`` is called with the number of every batch once it is written."""

    def write(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        if after:
            after(number)

    updates = latest_by(journal, keys, order)
    return updates.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot(spark: SparkSession, folder: str, keys: list[str], order: list[str], existing: DataFrame | None = None) -> DataFrame:
    """The latest row of every key that the stream has seen; of keys that ``existing`` has, its rows."""
    seen = spark.read.parquet(folder).drop("batch")
    return latest_by(seen, keys, order) if existing is None else recover(existing, seen, keys, [F.col(c) for c in order])
