"""Tool-call linking for chat data, in DataFrame functions only.

Calls and results are hash-joined by (conversation, identifier). Every call may name the call that it builds on; its depth
in that forest is found by pointer jumping (each round doubles the distance that is known), so the number of rounds is the
logarithm of the longest chain, and (depth, call) is a topological order: what a call builds on always stands before it.
Arguments are parsed as JSON and checked against the tool's schema. A call and its result become one canonical JSON text: keys
in order, no spaces, null for what is missing.

One row is returned per call and per result without a call; conversations are never gathered, so one of any length is no
hot spot. Keys of all joins and aggregations are single calls, so every hash table of a shuffled hash join holds a partition's
share of distinct calls, however the conversations are distributed.

Defined cases: of calls (or results) that repeat an identifier in a conversation the smallest (arguments or content; null
first) counts, and ``copies`` tells how many there were; a result without a call is an ``orphan``, a call without a result
``unanswered``; a parent that does not exist is no parent; calls on a cycle, or that build on one, have no depth and the error
``cycle``; arguments that are null or no JSON object have the error ``arguments``; rows without conversation or identifier
link with nothing and are returned as they are; texts of any length are carried whole; other columns are not looked at,
whatever their names; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoreloom.session import reliable_checkpoints


@dataclass(frozen=True)
class Field:
    """What a schema says of one argument: its JSON kind (string, integer, number or boolean) and bounds."""

    kind: str
    required: bool = True
    low: int | None = None
    high: int | None = None


_TYPES = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "FLOAT"], "boolean": ["BOOLEAN"]}


def argument_errors(name: Column, arguments: Column, schemas: Mapping[str, Mapping[str, Field]]) -> Column:
    """Sorted errors of a call: tool, arguments, or missing:, type:, range: and unknown: with the argument's name."""
    value = F.try_parse_json(arguments)
    keys = F.json_object_keys(arguments)
    per_tool = F.when(name.isNull() | ~name.isin(list(schemas)), F.array(F.lit("tool")))
    for tool, fields in schemas.items():
        found: list[Column] = []
        for field, rule in fields.items():
            there = F.array_contains(keys, field)
            part = F.try_variant_get(value, f"$.{field}", "variant")
            kind = F.schema_of_variant(part)
            fits = F.coalesce(kind.isin(_TYPES[rule.kind]) | (F.lit(rule.kind == "number") & kind.startswith("DECIMAL")), F.lit(False))
            size = F.length(F.try_variant_get(value, f"$.{field}", "string")) if rule.kind == "string" else F.try_variant_get(value, f"$.{field}", "double")
            outside = F.coalesce((size < (rule.low if rule.low is not None else -math.inf)) | (size > (rule.high if rule.high is not None else math.inf)), F.lit(False))
            found.append(F.when(~there, F.lit(f"missing:{field}") if rule.required else F.lit(None)).when(~fits, F.lit(f"type:{field}")).when(outside, F.lit(f"range:{field}")))
        unknown = F.transform(F.array_except(keys, F.array(*[F.lit(f) for f in fields]).cast("array<string>")), lambda k: F.concat(F.lit("unknown:"), k))
        errors = F.array_sort(F.array_compact(F.concat(F.array(*found).cast("array<string>"), unknown)))
        per_tool = per_tool.when(name == tool, F.when(keys.isNull(), F.array(F.lit("arguments"))).otherwise(errors))
    return per_tool


def call_depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth) for distinct calls (conv_id, call_id, parent_id); null depth on and above cycles."""
    reliable_checkpoints(calls.sparkSession)
    ids = calls.select("conv_id", F.col("call_id").alias("parent_id"), F.lit(True).alias("there"))
    state = calls.join(ids.hint("shuffle_hash"), ["conv_id", "parent_id"], "left").select("conv_id", "call_id", F.when(F.col("there"), F.col("parent_id")).alias("up"))
    state = state.withColumn("depth", F.when(F.col("up").isNotNull(), 1).otherwise(0).cast("long")).checkpoint()
    rounds = math.ceil(math.log2(max(2, state.count()))) + 1
    for _ in range(rounds):
        if state.where("up is not null").isEmpty():
            break
        above = state.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"))
        state = state.join(above.hint("shuffle_hash"), ["conv_id", "up"], "left").select("conv_id", "call_id", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")).checkpoint()
    return state.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping[str, Field]]) -> DataFrame:
    """calls: conv_id, call_id, parent_id, name, arguments; results: conv_id, call_id, content. Returns conv_id, call_id,
    status (linked, unanswered, orphan), copies, depth, errors (array) and message (canonical JSON)."""
    known = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    one = calls.where(known).groupBy("conv_id", "call_id").agg(F.min(F.struct("arguments", "name", "parent_id")).alias("x"), F.count("*").alias("copies"))
    one = one.select("conv_id", "call_id", "copies", "x.arguments", "x.name", "x.parent_id", F.lit(True).alias("called"))
    loose = calls.where(~known).select("conv_id", "call_id", F.lit(1).cast("long").alias("copies"), "arguments", "name", "parent_id", F.lit(True).alias("called"))
    got = results.where(known).groupBy("conv_id", "call_id").agg(F.min(F.struct("content")).alias("r"), F.count("*").alias("answers"))
    got = got.select("conv_id", "call_id", "answers", "r.content")
    stray = results.where(~known).select("conv_id", "call_id", F.lit(1).cast("long").alias("answers"), "content")
    depths = call_depths(one.select("conv_id", "call_id", "parent_id"))
    joined = one.join(depths.hint("shuffle_hash"), ["conv_id", "call_id"]).join(got.hint("shuffle_hash"), ["conv_id", "call_id"], "full_outer")
    joined = joined.unionByName(loose.withColumn("depth", F.lit(0).cast("long")), allowMissingColumns=True).unionByName(stray, allowMissingColumns=True)
    status = F.when(F.col("called").isNull(), "orphan").when(F.col("answers").isNull(), "unanswered").otherwise("linked")
    problems = argument_errors(F.col("name"), F.col("arguments"), schemas)
    problems = F.when(F.col("called") & F.col("depth").isNull(), F.array_sort(F.concat(problems, F.array(F.lit("cycle"))))).otherwise(problems)
    errors = F.when(F.col("called"), problems).otherwise(F.array().cast("array<string>"))
    tidy = F.coalesce(F.to_json(F.try_parse_json("arguments")), F.col("arguments"))  # keys in order, no spaces
    canonical = F.to_json(F.struct(tidy.alias("arguments"), "call_id", "conv_id", "depth", "name", F.col("content").alias("result")), {"ignoreNullFields": "false"})
    return joined.select("conv_id", "call_id", status.alias("status"), F.coalesce("copies", "answers").alias("copies"), "depth", errors.alias("errors"), canonical.alias("message"))


#: How the conversations table is read: a user's turn calls the tool ``reply``, the assistant's next turn is the result.
REPLY = {"reply": {"prompt": Field("string", low=1, high=280), "turn": Field("integer", low=0)}}


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a table (conv_id, turn, role, text): turn t is call t, builds on call t - 2, and is answered by t + 1."""
    call = turns.where(F.col("role") == "user")
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), F.col("turn").cast("long").alias("turn")))
    calls = call.select("conv_id", F.col("turn").cast("long").alias("call_id"), (F.col("turn").cast("long") - 2).alias("parent_id"), F.lit("reply").alias("name"), arguments.alias("arguments"))
    results = turns.where(F.col("role") == "assistant").select("conv_id", (F.col("turn").cast("long") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def op5_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = conversation_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return link_tool_calls(calls, results, REPLY).withColumn("errors", F.array_join("errors", ";"))


def _repeats(rows: DataFrame, content: list[str]) -> DataFrame:
    """Of rows that share an identifier and differ in content all but the smallest, which link_tool_calls keeps: copies and copy number."""
    known = rows.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())
    counted = known.groupBy("conv_id", "call_id", *content).agg(F.count("*").alias("copies"))
    number = F.row_number().over(Window.partitionBy("conv_id", "call_id").orderBy(*content))
    return counted.withColumn("copy", number.cast("long")).where("copy > 1")


def every_turn(turns: DataFrame, schemas: Mapping[str, Mapping[str, Field]]) -> DataFrame:
    """link_tool_calls over a table (conv_id, turn, role, text), and every turn whose text stands in none of its messages: other
    contents of a repeated call or result (status ``repeated_call`` or ``repeated_result``, copy 2 and up) and turns of any other
    role, null too (status ``turn``, one row each). Their copies count their own content."""
    calls, results = conversation_calls(turns)
    linked = link_tool_calls(calls, results, schemas).withColumn("copy", F.lit(1).cast("long"))
    none = F.array().cast("array<string>")
    as_json = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"}).alias("message")
    shape = lambda df, status, errors, message: df.select("conv_id", "call_id", F.lit(status).alias("status"), "copies", F.lit(None).cast("long").alias("depth"), errors.alias("errors"), message, "copy")
    call = _repeats(calls, ["arguments", "name", "parent_id"])
    result = _repeats(results, ["content"])
    other = turns.where(~F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False)))
    other = other.select("conv_id", F.col("turn").cast("long").alias("call_id"), "role", "text", F.lit(1).cast("long").alias("copies"), F.lit(1).cast("long").alias("copy"))
    return (
        linked.unionByName(shape(call, "repeated_call", argument_errors(F.col("name"), F.col("arguments"), schemas), as_json("arguments", "call_id", "conv_id", "name")))
        .unionByName(shape(result, "repeated_result", none, as_json("call_id", "conv_id", F.col("content").alias("result"))))
        .unionByName(shape(other, "turn", none, as_json("conv_id", "role", "text", F.col("call_id").alias("turn"))))
    )


def op5_every_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return every_turn(spark.read.parquet(f"{sf_dir}/conversations.parquet"), REPLY).withColumn("errors", F.array_join("errors", ";"))


OP5_SQL = """
WITH RECURSIVE c AS (
  SELECT conv_id, turn AS call_id, count(*) AS copies,
         min('{"prompt":' || to_json(text)::VARCHAR || ',"turn":' || turn || '}') AS arguments, min(text) AS prompt
  FROM conversations WHERE role = 'user' GROUP BY ALL
), r AS (
  SELECT conv_id, turn - 1 AS call_id, count(*) AS answers, min(text) AS content FROM conversations WHERE role = 'assistant' GROUP BY ALL
), d AS (
  SELECT conv_id, call_id, CAST(0 AS BIGINT) AS depth FROM c
  WHERE NOT EXISTS (SELECT 1 FROM c p WHERE p.conv_id = c.conv_id AND p.call_id = c.call_id - 2)
  UNION ALL
  SELECT c.conv_id, c.call_id, d.depth + 1 FROM c JOIN d ON c.conv_id = d.conv_id AND c.call_id = d.call_id + 2
), j AS (
  SELECT coalesce(k.conv_id, r.conv_id) AS conv_id, coalesce(k.call_id, r.call_id) AS call_id, copies, answers, arguments, prompt, content, depth
  FROM (SELECT c.*, d.depth FROM c JOIN d USING (conv_id, call_id)) k FULL JOIN r ON k.conv_id = r.conv_id AND k.call_id = r.call_id
)
SELECT conv_id, call_id, CASE WHEN copies IS NULL THEN 'orphan' WHEN answers IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
       coalesce(copies, answers) AS copies, depth,
       concat_ws(';', CASE WHEN copies IS NOT NULL AND (length(prompt) < 1 OR length(prompt) > 280) THEN 'range:prompt' END,
                      CASE WHEN copies IS NOT NULL AND call_id < 0 THEN 'range:turn' END) AS errors,
       '{"arguments":' || coalesce(to_json(arguments)::VARCHAR, 'null') || ',"call_id":' || call_id || ',"conv_id":' || conv_id || ',"depth":'
       || coalesce(depth::VARCHAR, 'null') || ',"name":' || CASE WHEN copies IS NULL THEN 'null' ELSE '"reply"' END
       || ',"result":' || coalesce(to_json(content)::VARCHAR, 'null') || '}' AS message
FROM j
"""
