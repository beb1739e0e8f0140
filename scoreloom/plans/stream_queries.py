"""The journal of events followed as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from scoreloom.plans.proxy import table
from scoreloom.session import reliable_checkpoints
from scoreloom.streaming import journal

KEYS, ORDER = ["user_id", "event_type"], ["ts", "event_id"]


def journal_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value per user and type, as ``latest_wins`` has it, from a stream over the table's files."""
    reliable_checkpoints(spark)
    folder = f"{spark._jsc.sc().getCheckpointDir().get()}/journal-{uuid.uuid4().hex}"
    columns = [*KEYS, *ORDER, "value"]
    # A pattern, as the table may be one file and a stream's plain path must be a folder.
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]").select(*columns)
    journal.follow(source, f"{folder}/updates", f"{folder}/state", KEYS, ORDER).awaitTermination()
    return journal.snapshot(spark, f"{folder}/updates", KEYS, ORDER).select("user_id", "event_type", "event_id", "value")


QUERIES = {"journal_stream": journal_stream}
ORACLES = {"journal_stream": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1"}
