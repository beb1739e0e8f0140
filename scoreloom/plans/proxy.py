"""The relations of the scoring domain, read off the driver's tables; every amount is an integer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.functions.score import TOP
from scoreloom.operators.quality import judged

__all__ = ["AGENTS_SQL", "RECORDS_SQL", "TOP", "agent_columns", "agent_outputs", "judged", "score_records", "table"]

#: Lines to a task, about.
LINES = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def score_records(spark: SparkSession, sf_dir: str, *, by_paper: bool = False) -> DataFrame:
    """One scored item per line: paper, dataset (three of them), gold, pred, status, stop.

    With ``by_paper`` rows come partitioned by paper, and an item's id begins with its paper: what groups by paper and item needs no
    further shuffle. Ids are put together after the join. Larger tables are dealt into more tasks, of about LINES lines each.
    """
    line = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("paper_id"),
        "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_returnflag").alias("dataset"),
        F.round(F.col("l_quantity") * 100).cast("long").alias("gold"),
        F.round(F.col("l_discount") * 100).cast("long").alias("d"),
        F.round(F.col("l_tax") * 100).cast("long").alias("x"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cost"),
        (F.col("l_linestatus") == "F").alias("stop"),
    )
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper_id"), F.when(F.col("o_orderstatus") == "O", "deferred").otherwise("success").alias("status"))
    tasks = -(-line.count() // LINES)  # of the footers alone
    if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")):
        line, orders = line.repartition(tasks, "paper_id"), orders.repartition(tasks, "paper_id")
    item = F.concat_ws("-", "paper_id", "l_linenumber", "l_partkey", "l_suppkey").alias("item_id")
    return line.join(orders.hint("merge") if by_paper else orders, "paper_id").select("paper_id", item, "dataset", "gold", "d", "x", "cost", "stop", "status", (F.col("gold") + (F.col("d") - 5) * 400).alias("pred"))


RECORDS_SQL = f"""records AS (
  SELECT l_orderkey AS paper_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS item_id, l_returnflag AS dataset,
         CAST(round(l_quantity * 100) AS BIGINT) AS gold, CAST(round(l_discount * 100) AS BIGINT) AS d, CAST(round(l_tax * 100) AS BIGINT) AS x,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS cost, l_linestatus = 'F' AS stop,
         CASE WHEN o_orderstatus = 'O' THEN 'deferred' ELSE 'success' END AS status,
         CAST(round(l_quantity * 100) AS BIGINT) + (CAST(round(l_discount * 100) AS BIGINT) - 5) * 400 AS pred
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), judged AS (
  SELECT *, legal AS completed, CASE WHEN legal THEN abs(pred - gold) ELSE {TOP} END AS units,
         CASE WHEN legal THEN (20 * gold + {TOP}) // {2 * TOP} END AS gb, CASE WHEN legal THEN (20 * pred + {TOP}) // {2 * TOP} END AS pb
  FROM (SELECT *, status = 'success' AND pred BETWEEN 0 AND {TOP} AS legal FROM records)
)"""


def agents_of(records: DataFrame) -> DataFrame:
    """Three scorers for every item, from cheap to strong: pred moves towards gold, confidence and cost rise. Other columns than d, x and
    cost stay."""
    one = lambda name, off, conf, share: F.struct(F.lit(name).alias("agent"), (F.col("gold") + off).alias("p"), conf.alias("conf"), F.expr(share).cast("long").alias("price"))
    d, x = F.col("d"), F.col("x")
    agents = F.array(one("cheap", (d - 5) * 300, 50 + d, "cost div 1000"), one("mid", (x - 4) * 200, 60 + x, "cost div 200"), one("strong", (d - x) * 50, 70 + d + x, "cost div 50"))
    kept = [c for c in records.columns if c not in ("d", "x", "cost", "pred")]
    return records.select(*kept, F.explode(agents).alias("a")).select(*kept, "a.agent", F.col("a.p").alias("pred"), F.col("a.conf").alias("confidence"), F.col("a.price").alias("cost"))


def agent_outputs(spark: SparkSession, sf_dir: str, *, by_paper: bool = False) -> DataFrame:
    return agents_of(score_records(spark, sf_dir, by_paper=by_paper).select("paper_id", "item_id", "dataset", "gold", "status", "stop", "d", "x", "cost"))


def agent_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same outputs with the agents side by side, for items that occur once, and what these are made from: no shuffle but that of
    the records, no explosion."""
    r = score_records(spark, sf_dir, by_paper=True)
    one = r.groupBy("paper_id", "item_id").agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in ("dataset", "gold", "status", "stop", "d", "x", "cost")]).where("n = 1")
    d, x, gold = F.col("d"), F.col("x"), F.col("gold")
    values = {"cheap_pred": gold + (d - 5) * 300, "cheap_conf": 50 + d, "mid_pred": gold + (x - 4) * 200, "mid_conf": 60 + x, "strong_pred": gold + (d - x) * 50, "strong_conf": 70 + d + x}
    return one.select("paper_id", "item_id", "dataset", "gold", "status", "stop", "d", "x", "cost", *[v.alias(k) for k, v in values.items()])


AGENTS_SQL = """agents AS (
  SELECT paper_id, item_id, dataset, gold, status, stop, 'cheap' AS agent, gold + (d - 5) * 300 AS pred, 50 + d AS confidence, cost // 1000 AS cost FROM records
  UNION ALL SELECT paper_id, item_id, dataset, gold, status, stop, 'mid', gold + (x - 4) * 200, 60 + x, cost // 200 FROM records
  UNION ALL SELECT paper_id, item_id, dataset, gold, status, stop, 'strong', gold + (d - x) * 50, 70 + d + x, cost // 50 FROM records
)"""
