"""Every query of the library by name, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scoreloom.plans import decision_queries, item_queries, json_queries, model_queries, policy_queries, quality_queries, source_queries, stream_queries, strict_queries

_PARTS = [quality_queries, item_queries, decision_queries, source_queries, strict_queries, json_queries, model_queries, policy_queries, stream_queries]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for part in _PARTS for k, v in part.ORACLES.items()}
