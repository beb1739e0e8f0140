"""Groups of records that must never be separated: connected components over shared keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.operators.skew import hot_values, salted_join
from scoreloom.session import reliable_checkpoints


#: Nodes (16 bytes each, if they are numbers) whose labels may be broadcast.
BROADCAST_NODES = 300_000


def connected_components(edges: DataFrame, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node reachable. No edges give no rows.

    Each round gives a node the smallest label among its neighbours and itself, and the label of that label, so long chains need
    about the logarithm of their length. Labels are combined before they are shuffled. Up to ``broadcast_nodes`` nodes, counted
    first, all labels are broadcast and a round has one shuffle. Beyond, labels are joined by shuffling: a node with many
    neighbours, or a label that many nodes share, is dealt over several tasks. Rounds are checkpointed.
    """
    reliable_checkpoints(edges.sparkSession)
    pair = lambda x, y: F.struct(F.col(x).alias("a"), F.col(y).alias("b"))
    # Each node is a neighbour of itself as well, and no union adds its partitions: rounds have as many tasks as the edges.
    around = edges.select(F.inline(F.array(pair("a", "b"), pair("b", "a"), pair("a", "a"), pair("b", "b")))).checkpoint()
    labels = around.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).checkpoint()
    small = labels.count() <= broadcast_nodes
    both = around.where("a <> b")
    hubs = [] if small else hot_values(both.groupBy("b").count(), "b")
    while True:
        stepped = (_step_by_broadcast(around, labels) if small else _step_by_shuffle(both, labels, hubs)).checkpoint()
        labels = stepped.select("node", "label")
        if stepped.where("label < was").isEmpty():
            return labels.withColumnRenamed("label", "component")


def _step_by_broadcast(around: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, label, was) after one round; ``around`` has each node as a neighbour of itself as well."""
    labels = labels.dropna()  # both uses now have the same filter, so Spark broadcasts them once
    low = F.broadcast(labels.select(F.col("node").alias("b"), F.col("label").alias("low")))
    top = F.broadcast(labels.select(F.col("node").alias("low"), F.col("label").alias("top")))
    own = F.min(F.when(F.col("a") == F.col("b"), F.col("low")))
    return around.join(low, "b").join(top, "low").groupBy(F.col("a").alias("node")).agg(F.min("top").alias("label"), own.alias("was"))


def _step_by_shuffle(both: DataFrame, labels: DataFrame, hubs: list) -> DataFrame:
    """(node, label, was) after one round."""
    near = salted_join(both, labels.withColumnRenamed("node", "b"), "b", hubs, [F.col("a")]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
    lower = labels.join(near, "node", "left").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label")).checkpoint()
    used = lower.groupBy("label").count()
    moved = lower.where("label < node").select(F.col("node").alias("label"), F.col("label").alias("top")).join(used.select("label"), "label", "left_semi")
    jumped = salted_join(lower, moved, "label", hot_values(used, "label"), [F.col("node")], "left")
    return jumped.select("node", F.coalesce("top", "label").alias("label"), "was")


def leakage_components(items: DataFrame, keys: list[list[str]], id_col: str = "item_id") -> DataFrame:
    """(item, component): items that agree in any of the key sets belong together; a key with a null or empty part is none.

    Every key value gives a star around its smallest item, so there are at most as many edges as items and key sets. Items are read
    once, whatever the number of key sets; from there on a key is 128 bits of the SHA-256 of its parts.
    """
    reliable_checkpoints(items.sparkSession)

    def key(k: int, columns: list[str]) -> Column:
        there = reduce(lambda x, y: x & y, [F.col(c).isNotNull() & (F.col(c).cast("string") != "") for c in columns])
        return F.when(there, F.substring(F.sha2(F.concat_ws("\x1f", F.lit(str(k)), *columns).cast("binary"), 256), 1, 32))

    keyed = items.select(id_col, F.explode(F.array(*[key(k, columns) for k, columns in enumerate(keys)])).alias("_key")).where("_key IS NOT NULL").checkpoint()
    hub = keyed.groupBy("_key").agg(F.min(id_col).alias("a"), F.count("*").alias("count")).where("count > 1").checkpoint()
    star = salted_join(keyed, hub.select("_key", "a"), "_key", hot_values(hub, "_key"), [F.col(id_col)])
    edges = star.select("a", F.col(id_col).alias("b")).where("a <> b").distinct()
    labels = connected_components(edges)
    return items.select(id_col).distinct().join(labels.withColumnRenamed("node", id_col), id_col, "left").select(id_col, F.coalesce("component", F.col(id_col)).alias("component"))


def component_names(labels: DataFrame, id_col: str = "item_id", prefix: str = "leakage_", salt: str = "") -> DataFrame:
    """(component, component_id, size): a name from the members' ids.

    Ids are dealt into buckets by the first three hexadecimal digits of their SHA-256; a bucket's digest is that of its sorted
    ids, one a line, and the name that of the buckets' digests in order. So no task ever holds all members of a large component.
    """
    id_ = F.col(id_col).cast("string")
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    bucket = F.substring(sha(id_), 1, 3).alias("_bucket")
    parts = labels.select("component", id_.alias("_id"), bucket).groupBy("component", "_bucket").agg(sha(F.array_join(F.array_sort(F.collect_list("_id")), "\n")).alias("_d"), F.count("*").alias("_n"))
    named = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_bucket", "_d"))), lambda x: x["_d"]), "\n")
    return parts.groupBy("component").agg(F.concat(F.lit(prefix), F.substring(sha(F.concat(F.lit(salt), named)), 1, 20)).alias("component_id"), F.sum("_n").alias("size"))
