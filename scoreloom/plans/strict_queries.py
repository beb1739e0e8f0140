"""Strict joins, equal sets and scopes over the test tables, with their violations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.operators import strict
from scoreloom.plans.proxy import AGENTS_SQL, RECORDS_SQL, agent_outputs, table


def strict_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order with its customer's segment and nation, N:1; the job fails if a customer is missing or there twice."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("key"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_mktsegment", "c_nationkey")
    return strict.strict_join(o, c, ["key"], name="orders to customers").withColumnRenamed("key", "o_custkey")


def lookup_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines against the orders that are open or finished, of which urgent finished ones are there twice: faults by line."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), "l_linenumber", "l_partkey", "l_suppkey")
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("key"), "o_orderstatus", "o_orderpriority")
    o = o.union(o.where("o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'"))
    found = strict.strict_join(line, o, ["key"], cover=True, fault="keep").where("fault IS NOT NULL")
    return found.groupBy("key", "fault").agg(F.count("l_linenumber").alias("lines"))


def pairing_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and customers of one number, as if one to one with equal nations: every number that breaks that."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"))
    c = c.union(c.where("nation = 3"))
    return strict.strict_join(s, c, ["key"], one_to_one=True, cover=True, agree=["nation"], fault="keep").where("fault IS NOT NULL").select("key", "fault")


def unequal_agent_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that not every agent has scored with success exactly once; the strong agent leaves out prices above its limit."""
    o = agent_outputs(spark, sf_dir).where("status = 'success' AND NOT (agent = 'strong' AND cost > 150000)")
    return strict.unequal_sets(o, "agent", "item_id", ["cheap", "mid", "strong"])


def scope_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events outside the scope of a profile (clicks and views of at most ten kinds of values), counted by what is wrong."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("value") < 50, "low").when(F.col("value") < 100, "mid").alias("band"))
    found = e.withColumn("fault", strict.out_of_scope({"event_type": ["click", "view"], "band": ["low"]})).where("fault IS NOT NULL")
    return found.groupBy("fault", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


def policy_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as checkpoints, supplied lines as their calibrations: promoted, failed and faulty ones."""
    digest = lambda c: F.sha2(F.col(c).cast("string"), 256)
    points = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("checkpoint_id"), digest("p_partkey").alias("checkpoint_hash"))
    line = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").groupBy("l_partkey").agg(F.max("l_quantity").alias("q"), F.count("*").alias("n"))
    stale = F.when(F.col("q") == 50, F.lit("stale")).otherwise(F.col("l_partkey").cast("string"))
    made = line.select(
        F.col("l_partkey").alias("checkpoint_id"), F.sha2(stale, 256).alias("checkpoint_hash"), F.when(F.col("q") < 30, "failure").when(F.col("q") < 49, "success").otherwise("running").alias("status"),
        (F.col("q") / 50).alias("stop_boundary"), (F.col("n") / 64).alias("coverage"), F.when(F.col("q") < 10, "no_safe_stop_boundary").alias("failure_reason"),
    )
    return strict.policy_packages(points, made)


QUERIES = {f.__name__: f for f in (strict_lookup, lookup_violations, pairing_violations, unequal_agent_items, scope_violations, policy_packages)}
ORACLES = {
    "strict_lookup": "SELECT o_orderkey, o_custkey, c_mktsegment, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey",
    "lookup_violations": """WITH o AS (SELECT o_orderkey AS key, o_orderstatus AS s, o_orderpriority AS p FROM orders WHERE o_orderstatus <> 'P'),
        r AS (SELECT key, count(*) AS n FROM (SELECT * FROM o UNION ALL SELECT * FROM o WHERE s = 'F' AND p = '1-URGENT') GROUP BY key),
        f AS (SELECT coalesce(l.l_orderkey, r.key) AS key, l.l_linenumber, CASE WHEN l.l_orderkey IS NULL THEN 'unused' WHEN r.n IS NULL THEN 'missing' WHEN r.n > 1 THEN 'repeated' END AS fault
          FROM lineitem l FULL JOIN r ON l.l_orderkey = r.key) SELECT key, fault, count(l_linenumber) AS lines FROM f WHERE fault IS NOT NULL GROUP BY ALL""",
    "pairing_violations": """WITH c AS (SELECT c_custkey AS key, min(c_nationkey) AS nation, count(*) AS n FROM (FROM customer UNION ALL FROM customer WHERE c_nationkey = 3) GROUP BY ALL)
        SELECT key, fault FROM (SELECT coalesce(s_suppkey, key) AS key, CASE WHEN s_suppkey IS NULL THEN 'unused' WHEN c.n IS NULL THEN 'missing' WHEN c.n > 1 THEN 'repeated' WHEN nation <> s_nationkey THEN 'changed' END AS fault
        FROM supplier FULL JOIN c ON s_suppkey = key) WHERE fault IS NOT NULL""",
    "unequal_agent_items": f"""WITH {RECORDS_SQL}, {AGENTS_SQL}, o AS (SELECT item_id, agent, count(*) AS n FROM agents WHERE status = 'success' AND NOT (agent = 'strong' AND cost > 150000) GROUP BY ALL),
        h AS (SELECT i.item_id, coalesce(string_agg(a, ';' ORDER BY a) FILTER (o.agent IS NULL), '') AS lacking, coalesce(string_agg(a, ';' ORDER BY a) FILTER (n > 1), '') AS repeated
          FROM (SELECT DISTINCT item_id FROM o) i CROSS JOIN (VALUES ('cheap'), ('mid'), ('strong')) v(a) LEFT JOIN o ON o.item_id = i.item_id AND o.agent = a GROUP BY i.item_id)
        SELECT item_id, lacking, repeated, '' AS "foreign" FROM h WHERE lacking <> '' OR repeated <> ''""",
    "scope_violations": """SELECT fault, event_type, count(*) AS n, min(event_id) AS first FROM (SELECT *, concat_ws(';', CASE WHEN event_type NOT IN ('click', 'view') OR event_type IS NULL THEN 'event_type' END,
        CASE WHEN value >= 50 OR value IS NULL THEN 'band' END) AS fault FROM events) WHERE fault <> '' GROUP BY ALL""",
    "policy_packages": """WITH l AS (SELECT l_partkey AS id, max(l_quantity) AS q, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL),
        j AS (SELECT coalesce(p_partkey, id) AS id, q, n, CASE WHEN p_partkey IS NULL THEN 'unused' WHEN id IS NULL THEN 'missing' WHEN q = 50 THEN 'changed' WHEN q >= 49 THEN 'illegal_status' END AS fault FROM part FULL JOIN l ON p_partkey = id)
        SELECT id AS checkpoint_id, CASE WHEN fault IS NULL THEN concat('pkg_', id) END AS package_id, CASE WHEN fault IS NULL THEN sha256(id::VARCHAR) END AS checkpoint_hash,
          fault, CASE WHEN fault IS NULL THEN q >= 30 END AS promoted, CASE WHEN fault IS NULL AND q >= 30 THEN q / 50 END AS stop_boundary,
          CASE WHEN fault IS NULL THEN n / 64 END AS coverage, CASE WHEN fault IS NULL THEN CASE WHEN q >= 30 THEN '' WHEN q < 10 THEN 'no_safe_stop_boundary' ELSE 'unknown_calibration_failure' END END AS failure_reason FROM j""",
}
