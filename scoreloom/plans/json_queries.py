"""Nested records as JSON, banned keys in them, and manifests of tables with what was tampered with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.functions.json_walk import HIDDEN_KEYS, json_walk
from scoreloom.operators import manifest
from scoreloom.plans.proxy import table
from scoreloom.session import reliable_checkpoints

#: What a model may see of an order's record.
VISIBLE = ["item_id", "dataset", "prompt", "lines"]


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order, record): an order with its lines as nested JSON, with scores and labels at several depths and a comment that quotes one."""
    o = table(spark, sf_dir, "orders")
    line = table(spark, sf_dir, "lineitem")
    member = F.struct(F.col("l_linenumber").alias("step"), F.col("l_partkey").alias("answer"), F.struct(F.col("l_suppkey").alias("Score1"), F.lit("ok").alias("note")).alias("evidence"))
    lines = line.groupBy(F.col("l_orderkey").alias("key")).agg(F.array_sort(F.collect_list(member)).alias("lines"))
    both = o.select(F.col("o_orderkey").alias("key"), "o_orderstatus", "o_orderpriority", "o_custkey").join(lines, "key")
    metadata = F.struct(F.col("o_custkey").alias("gold_score"), F.struct(F.lit(None).cast("int").alias("raw_total"), F.lit("score2").alias("kind")).alias("inner"))
    record = F.struct(F.col("key").alias("item_id"), F.col("o_orderstatus").alias("dataset"), F.concat(F.lit('say "gold_score": 1 of '), "o_orderpriority").alias("prompt"), "lines", metadata.alias("metadata"))
    return both.select("key", F.to_json(record, {"ignoreNullFields": "false"}).alias("record"))


def banned_key_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where records of orders hold keys that a model must not see, at any depth."""
    return order_records(spark, sf_dir).select("key", F.explode(json_walk(F.col("record"), HIDDEN_KEYS, ("paths",))["paths"]).alias("path"))


def visible_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records cut to what a model may see and freed of banned keys: size and digest of their canonical form."""
    cut = F.from_json("record", "item_id long, dataset string, prompt string, lines array<struct<step:long,answer:long,evidence:struct<Score1:long,note:string>>>")
    kept = order_records(spark, sf_dir).withColumn("r", cut).select("key", F.to_json(F.struct(*[F.col("r")[c].alias(c) for c in VISIBLE]), {"ignoreNullFields": "false"}).alias("seen"))
    clean = kept.select("key", json_walk(F.col("seen"), HIDDEN_KEYS, ("stripped",))["stripped"].alias("clean"))
    return clean.select("key", F.length("clean").cast("long").alias("n_chars"), F.sha2("clean", 256).alias("sha256"))


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


def manifest_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest tree of the customers, 4,096 buckets below the root."""
    reliable_checkpoints(spark)
    return manifest.digest_tree(_customers(spark, sf_dir), ["c_custkey"], 3)


def tampered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers against the manifest of what they were: one nation has moved, one segment's furniture is gone, one is doubled."""
    reliable_checkpoints(spark)
    was = _customers(spark, sf_dir)
    moved = was.withColumn("c_nationkey", F.when(F.col("c_nationkey") == 7, 8).otherwise(F.col("c_nationkey")).cast(was.schema["c_nationkey"].dataType))
    now = moved.where("NOT (c_mktsegment = 'FURNITURE' AND c_nationkey = 3)")
    now = now.union(now.where("c_mktsegment = 'BUILDING' AND c_nationkey = 5"))
    return manifest.tampered(now, manifest.row_digests(was, ["c_custkey"]), ["c_custkey"], manifest.digest_tree(was, ["c_custkey"], 3), 3)


def _split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as items, orders as components, with what their manifest declares: sizes, digests and names as they should be, but
    for some returned or heavy ones."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus")
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("item_id"), "l_returnflag", "l_quantity", "l_partkey")
    ids = line.groupBy("k").agg(F.array_sort(F.collect_list("item_id")).alias("ids"), F.max("l_quantity").alias("q"))
    digest = F.sha2(F.array_join(F.concat(F.array(F.lit(manifest.COMPONENT_VERSION)), "ids"), "\x1f"), 256)
    declared = ids.select("k", digest.alias("stable_hash"), F.when(F.col("q") == 50, F.size("ids") + 1).otherwise(F.size("ids")).cast("long").alias("component_size"), "q")
    named = F.when(F.col("q") == 49, F.lit("ic_other")).otherwise(F.concat(F.lit(manifest.COMPONENT_PREFIX), F.substring("stable_hash", 1, 20)))
    r = line.join(declared, "k").join(o, "k")
    return r.select(
        "item_id", F.when(F.col("q") == 48, F.col("l_returnflag")).otherwise(F.col("o_orderstatus")).alias("dataset"), F.concat(F.lit("g"), F.col("l_partkey").cast("string")).alias("prompt_group"), named.alias("component_id"),
        F.when(F.col("l_quantity") == 1, "dev").otherwise("train").alias("source_split"), F.when(F.col("o_orderstatus") == "O", "train_fit").when(F.col("l_returnflag") == "A", "train_calibration").otherwise("train_fit").alias("internal_split"),
        F.when(F.col("l_quantity") == 2, " ").otherwise("v1").alias("rule_version"), "stable_hash", F.when(F.col("l_quantity") == 3, "paper").otherwise("item_component").alias("assignment_unit"), "component_size",
    )


def split_record_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.record_faults(_split_rows(spark, sf_dir), manifest.split_record_rules(), ["item_id"])


def split_manifest_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.split_manifest_faults(_split_rows(spark, sf_dir))


QUERIES = {f.__name__: f for f in (banned_key_paths, visible_records, manifest_digests, tampered_rows, split_record_faults, split_manifest_faults)}

_LEAVES = """leaf AS (SELECT sha256('{"c_custkey":' || c_custkey || '}') AS key, sha256(concat('{"c_mktsegment":', to_json(c_mktsegment), ',"c_name":', to_json(c_name), ',"c_nationkey":', c_nationkey, '}')) AS digest FROM %s)"""
_SPLIT = """line AS (SELECT l_orderkey AS k, concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS item_id, l_returnflag, l_quantity, l_partkey FROM lineitem),
  declared AS (SELECT k, max(l_quantity) AS q, count(*) AS n, sha256(concat('internal_component_v1.4', chr(31), string_agg(item_id, chr(31) ORDER BY item_id))) AS stable_hash FROM line GROUP BY k),
  r AS (SELECT item_id, CASE WHEN q = 48 THEN l_returnflag ELSE o_orderstatus END AS dataset, concat('g', l_partkey) AS prompt_group, CASE WHEN q = 49 THEN 'ic_other' ELSE concat('ic_', substr(stable_hash, 1, 20)) END AS component_id,
    l_quantity, CASE WHEN o_orderstatus = 'O' THEN 'train_fit' WHEN l_returnflag = 'A' THEN 'train_calibration' ELSE 'train_fit' END AS internal_split, stable_hash, CASE WHEN q = 50 THEN n + 1 ELSE n END AS component_size
    FROM line JOIN declared USING (k) JOIN orders ON o_orderkey = k)"""
ORACLES = {
    "banned_key_paths": """SELECT o_orderkey AS key, unnest(list_concat(list(concat('$.lines[', i, '].evidence.Score1') ORDER BY i), ['$.metadata.gold_score', '$.metadata.inner.raw_total'])) AS path
        FROM orders JOIN (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i FROM lineitem) ON o_orderkey = l_orderkey GROUP BY o_orderkey""",
    "visible_records": """SELECT key, length(clean) AS n_chars, sha256(clean) AS sha256 FROM (
        SELECT o_orderkey AS key, concat('{"dataset":"', o_orderstatus, '","item_id":', o_orderkey, ',"lines":[', string_agg(concat('{"answer":', l_partkey, ',"evidence":{"note":"ok"},"step":', l_linenumber, '}'), ',' ORDER BY l_linenumber, l_partkey, l_suppkey),
          '],"prompt":"say \\"gold_score\\": 1 of ', o_orderpriority, '"}') AS clean FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderstatus, o_orderpriority)""",
    "manifest_digests": f"""WITH {_LEAVES % "customer"}, low AS (SELECT substr(key, 1, 3) AS bucket, count(*) AS rows, sha256(string_agg(key || ':' || digest, chr(10) ORDER BY key, digest)) AS digest FROM leaf GROUP BY ALL)
        SELECT 3 AS digits, bucket, rows, digest FROM low UNION ALL SELECT 0, '', sum(rows)::BIGINT, sha256(string_agg(bucket || ':' || digest, chr(10) ORDER BY bucket)) FROM low""",
    "tampered_rows": f"""WITH {_LEAVES % "customer"}, moved AS (SELECT * REPLACE (CASE WHEN c_nationkey = 7 THEN 8 ELSE c_nationkey END AS c_nationkey) FROM customer), cut AS (FROM moved WHERE NOT (c_mktsegment = 'FURNITURE' AND c_nationkey = 3)),
        now AS (FROM cut UNION ALL FROM cut WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 5), {(_LEAVES % "now").replace("leaf AS", "leaf2 AS")},
        a AS (SELECT key, count(*) AS n, min(digest) AS d, max(digest) AS e FROM leaf2 GROUP BY key), b AS (SELECT key, count(*) AS n, min(digest) AS d, max(digest) AS e FROM leaf GROUP BY key)
        SELECT key, fault FROM (SELECT key, CASE WHEN a.n IS NULL THEN 'missing' WHEN b.n IS NULL THEN 'added' WHEN a.n <> b.n THEN 'repeated' WHEN a.d <> b.d OR a.e <> b.e THEN 'changed' END AS fault FROM a FULL JOIN b USING (key)) WHERE fault IS NOT NULL""",
    "split_record_faults": f"""WITH {_SPLIT} SELECT item_id, unnest(list_filter([CASE WHEN l_quantity = 2 THEN 'text:rule_version' END, CASE WHEN l_quantity = 1 THEN 'source_split' END, CASE WHEN l_quantity = 3 THEN 'assignment_unit' END], lambda x: x IS NOT NULL)) AS rule FROM r""",
    "split_manifest_faults": f"""WITH {_SPLIT}, c AS (SELECT component_id, count(*) AS n, min(component_size) AS s0, max(component_size) AS s1, min(stable_hash) AS h0, max(stable_hash) AS h1, min(dataset) AS d0, max(dataset) AS d1,
          min(internal_split) AS p0, max(internal_split) AS p1, sha256(concat('internal_component_v1.4', chr(31), string_agg(item_id, chr(31) ORDER BY item_id))) AS expected FROM r GROUP BY component_id),
        f AS (SELECT component_id, unnest([CASE WHEN s0 <> n OR s1 <> n THEN 'size' END, CASE WHEN d0 <> d1 THEN 'dataset' END, CASE WHEN h0 <> expected OR h1 <> expected THEN 'digest' END,
          CASE WHEN component_id <> concat('ic_', substr(expected, 1, 20)) THEN 'name' END, CASE WHEN p0 <> p1 THEN 'leak' END]) AS fault FROM c)
        SELECT 'item' AS kind, item_id AS name, 'repeated' AS fault FROM r GROUP BY item_id HAVING count(*) > 1 UNION ALL SELECT 'component', component_id, fault FROM f WHERE fault IS NOT NULL
        UNION ALL SELECT 'prompt', concat(dataset, '|', prompt_group), 'leak' FROM r GROUP BY dataset, prompt_group HAVING min(internal_split) <> max(internal_split)""",
}
