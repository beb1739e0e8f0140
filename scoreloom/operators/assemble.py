"""Order-dependent assembly as ranks and intervals: samples, chunks, quotas, partitions, latest-wins."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions.text import stable_hash
from scoreloom.operators.ranks import hash_ranks


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of every key; one aggregation, without ordering a key's rows."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("r")).select(*keys, "r.*")


def recover(existing: DataFrame, journal: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Existing rows win; of the journal the latest row per key fills in what is missing."""
    return existing.unionByName(latest(journal, keys, order).join(existing, keys, "left_anti"))


def round_robin(rows: DataFrame, stratum: str, order: Column, size: int) -> DataFrame:
    """``size`` rows, one of every stratum in turn, each stratum in hash order; at most ``size`` of a stratum are ranked."""
    w = Window.partitionBy(stratum).orderBy(order)
    ranked = rows.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= size)
    return ranked.orderBy("turn", stratum).limit(size)


def chunks(rows: DataFrame, group: str, digest: str, ties: list[str], size: int, relaxed: bool = True) -> DataFrame:
    """Whole chunks of ``size`` rows of each group in the order of a digest, numbered; the remainder is dropped, or a fault if not
    ``relaxed``: then a row of it keeps its place with a null chunk."""
    ranked = hash_ranks(rows, group, digest, ties).withColumn("r", F.col("rank") - 1)
    whole = F.col("r") < F.floor(F.col("total") / size) * size
    kept = ranked.where(whole) if relaxed else ranked
    return kept.withColumn("chunk", F.when(whole, F.floor(F.col("r") / size))).withColumn("position", (F.col("r") % size + 1).cast("long")).drop("r", "rank", "total")


def fill_quotas(items: DataFrame, quotas: DataFrame, seed: str) -> DataFrame:
    """items (item_id, dataset) into papers (paper, dataset, want): item k of a dataset goes to the paper whose cumulative
    demand covers k. Returns paper, dataset, item_id and the position (from 0) in the paper by hash order."""
    digest = stable_hash(F.lit(seed), F.col("dataset"), F.col("item_id"))
    ranked = hash_ranks(items.withColumn("_h", digest), "dataset", "_h", ["item_id"]).select("item_id", "dataset", F.col("rank").alias("k"))
    block = Window.partitionBy("dataset", "_block")
    dealt = quotas.withColumn("_block", F.floor(F.col("paper") / 4096))
    sums = dealt.groupBy("dataset", "_block").agg(F.sum("want").alias("_sum"))
    below = sums.select("dataset", "_block", (F.sum("_sum").over(Window.partitionBy("dataset").orderBy("_block")) - F.col("_sum")).alias("_below"))  # a row for 4,096 papers
    ranges = dealt.withColumn("hi", F.sum("want").over(block.orderBy("paper"))).join(below, ["dataset", "_block"]).withColumn("hi", F.col("hi") + F.col("_below")).withColumn("lo", F.col("hi") - F.col("want"))
    slots = ranges.select("paper", "dataset", F.explode(F.sequence(F.col("lo") + 1, F.col("hi"))).alias("k"))  # one row per place, so the join is by equality
    placed = slots.join(ranked, ["dataset", "k"])
    inside = Window.partitionBy("paper").orderBy(stable_hash(F.lit(seed), F.col("paper"), F.col("item_id")), "item_id")
    return placed.select("paper", "dataset", "item_id", (F.row_number().over(inside) - 1).cast("long").alias("position"))


def best_quota_counts(counts: dict[str, int], quotas: list[dict[str, int]]) -> tuple[int, ...]:
    """How often to use each of up to two quotas: most papers, then least left over, then least left of any dataset, then order."""
    most = [min((counts.get(d, 0) // q for d, q in quota.items() if q), default=0) for quota in quotas]
    best, best_key = (0,) * len(quotas), None
    for first in product(*[range(m + 1) for m in most[:-1]]):
        room = {d: c - sum(n * q.get(d, 0) for n, q in zip(first, quotas, strict=False)) for d, c in counts.items()}
        if min(room.values(), default=0) < 0:
            continue
        last = min((room.get(d, 0) // q for d, q in quotas[-1].items() if q), default=0)
        left = [room[d] - last * quotas[-1].get(d, 0) for d in counts]
        key = (-(sum(first) + last), sum(left), max(left, default=0), (*first, last))
        if best_key is None or key < best_key:
            best, best_key = (*first, last), key
    return best
