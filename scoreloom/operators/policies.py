"""What a policy that names one agent per item is worth, and the confidence threshold that is worth most.

Scores have their own range per row: everything is measured on (score - low) / (high - low).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions.score import bankers_bin, clip, ratio
from scoreloom.operators.quality import kappa
from scoreloom.operators.strict import refuse

_SUMS = ["n", "error", "cost", "latency", "upgrades", "st", "sp", "stt", "spp", "stp"]


def normalized(c: Column, low: Column, high: Column) -> Column:
    return ratio(c - low, high - low)


def measured(rows: DataFrame, pred: str, cost: str, latency: str, upgraded: Column) -> list[Column]:
    """The sums of ``rows`` (gold, low, high and the named columns) that a policy's metrics follow from, over all rows of a group."""
    gold = normalized(F.col("gold"), F.col("low"), F.col("high"))
    seen = clip(normalized(F.col(pred), F.col("low"), F.col("high")), 0.0, 1.0)
    t, p = bankers_bin(gold).cast("long"), bankers_bin(seen).cast("long")
    parts = [F.lit(1), F.abs(gold - seen), F.col(cost), F.col(latency), upgraded.cast("long"), t, p, t * t, p * p, t * p]
    return [F.sum(x).alias(name) for name, x in zip(_SUMS, parts, strict=True)]


def metrics(sums: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sample_count, nmae, qwk, total_cost, mean_cost, mean_latency, upgrade_rate) from these sums; qwk is null where all
    labels agree by chance."""
    n = F.col("n")
    return sums.select(
        *keys, n.cast("long").alias("sample_count"), ratio(F.col("error"), n).alias("nmae"), kappa(*[F.col(c) for c in ("n", "st", "sp", "stt", "spp", "stp")]).alias("qwk"), F.col("cost").alias("total_cost"),
        ratio(F.col("cost"), n).alias("mean_cost"), ratio(F.col("latency"), n).alias("mean_latency"), ratio(F.col("upgrades"), n).alias("upgrade_rate"),
    )


def sound_ranges(rows: DataFrame) -> DataFrame:
    """The rows; the job fails at one whose range is empty or unknown."""
    return refuse(rows, ~F.coalesce(F.col("high") > F.col("low"), F.lit(False)), F.concat_ws(" ", F.lit("illegal range:"), F.col("low").cast("string"), F.col("high").cast("string")))


def evaluate_selections(outputs: DataFrame, methods: list[str], cheapest: str) -> DataFrame:
    """Metrics of each method over ``outputs`` (item_id, agent, gold, low, high, pred, cost, latency and, by method, the chosen agent):
    the row of the chosen agent counts, and every other than the ``cheapest`` is an upgrade. One aggregation for all methods."""
    chosen = sound_ranges(outputs).select("*", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), (F.col(m) == F.col("agent")).alias("is")) for m in methods])).alias("_m")).where("_m.is")
    return metrics(chosen.groupBy(F.col("_m.method").alias("method")).agg(*measured(chosen, "pred", "cost", "latency", F.col("agent") != cheapest)), ["method"])


def threshold_trials(items: DataFrame, thresholds: list[float], cost_weight: float) -> DataFrame:
    """Metrics and objective (nmae + weight * mean cost) of every threshold: an item whose cheap answer is at least that sure keeps
    it, any other is sent to the fallback agent.

    ``items``: gold, low, high, confidence, and pred, cost, latency of both (cheap_*, other_*). Items are summed once by the interval of
    thresholds that their confidence lies in; a threshold adds the cheap sums above it to the other's below, so items never meet
    thresholds.
    """
    cuts = sorted(set(thresholds))
    spark = items.sparkSession
    rank = sum((F.coalesce(F.col("confidence") >= c, F.lit(False)).cast("int") for c in cuts), F.lit(0))  # thresholds that the item passes
    held = sound_ranges(items).withColumn("rank", rank)
    both = [(side, [e.alias(f"{side}_{c}") for c, e in zip(_SUMS, measured(held, f"{side}_pred", f"{side}_cost", f"{side}_latency", F.lit(side == "other")), strict=True)]) for side in ("cheap", "other")]
    once = held.groupBy("rank").agg(*[e for _, sums in both for e in sums])  # a row per interval
    sums = once.select("rank", F.explode(F.array(*[F.struct(F.lit(side).alias("side"), *[F.col(f"{side}_{c}").alias(c) for c in _SUMS]) for side, _ in both])).alias("s")).select("rank", "s.*")
    grid = spark.createDataFrame([(k, float(c)) for k, c in enumerate(cuts, 1)], "k int, threshold double")
    counts = grid.join(F.broadcast(sums), F.when(F.col("side") == "cheap", F.col("rank") >= F.col("k")).otherwise(F.col("rank") < F.col("k")))  # thresholds by their intervals
    trials = metrics(counts.groupBy("threshold").agg(*[F.sum(c).alias(c) for c in _SUMS]), ["threshold"])
    return trials.withColumn("objective", F.col("nmae") + cost_weight * F.col("mean_cost"))


def select_threshold(items: DataFrame, thresholds: list[float], cost_weight: float) -> DataFrame:
    """The trial of the least (objective, mean cost, threshold), one row; none without items."""
    trials = threshold_trials(items, thresholds, cost_weight)
    first = F.row_number().over(Window.orderBy("objective", "mean_cost", "threshold"))  # one row per threshold
    return trials.withColumn("_r", first).where("_r = 1").drop("_r")
