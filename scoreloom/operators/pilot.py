"""Which groups of scorers an arbitrator should hear: its answers against what the same scorers say without it.

Arbitrations name the agents they heard in an array. The agents' own outputs are put into one row per item, a map by agent, which
arbitrations are joined with N:1 by item, in a hash join that sorts neither side; members are looked up in place, so an arbitration is
never taken apart and regrouped. No context, of however many items, is ever in one task; contexts are summed by partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions.score import EXTREME, SEVERE, ratio
from scoreloom.operators.skyline import skyline
from scoreloom.operators.strict import refuse

#: Scorers from weak to strong, the agent that only adds evidence, the least weight of a confidence.
ROLES, EVIDENCE, LEAST_CONFIDENCE = ["cheap", "mid", "strong"], "evidence", 0.01


def _error(pred: Column) -> Column:
    return F.abs(pred - F.col("gold")) / F.greatest(F.lit(1e-12), F.col("high") - F.col("low"))


def _total(values: Column, kind: str) -> Column:
    """SUM of an array: nulls are left out, and without any other value the sum is null."""
    return F.when(F.size(F.array_compact(values)) > 0, F.aggregate(values, F.lit(0).cast(kind), lambda a, v: (a + F.coalesce(v.cast(kind), F.lit(0).cast(kind))).cast(kind)))


def _sum_type(kind: str) -> str:
    return "bigint" if kind in ("tinyint", "smallint", "int", "bigint") else kind if kind.startswith("decimal") else "double"


def heard(arbitrations: DataFrame, outputs: DataFrame, *, distinct: bool = False) -> DataFrame:
    """Every arbitration (item_id, agents, gold, low, high, pred, cost, latency) with what its agents say: strongest (by role), mean and
    weighted (by confidence) predictions, and the cost of all. Equal arbitrations are one row with ``copies``. An agent that did not
    answer, or answered twice, makes the job fail, as does a context without a scorer. ``distinct``: no two arbitrations are equal, so
    they need not be counted."""
    once = (arbitrations.withColumn("copies", F.lit(1).cast("long")) if distinct else arbitrations.groupBy(*arbitrations.columns).agg(F.count("*").alias("copies"))).where(F.size("agents") > 0)
    kinds = {c: _sum_type(k) for c, k in outputs.dtypes}
    weight, order = F.greatest(F.lit(LEAST_CONFIDENCE), F.col("confidence")).cast("double"), F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col("agent"))
    value = F.struct(F.col("pred").alias("p"), weight.alias("w"), (F.col("pred") * weight).alias("pw"), F.col("cost").alias("c"), F.when(order > 0, F.struct(order.alias("o"), F.col("pred").alias("p"))).alias("top"))
    per = outputs.where("agent IS NOT NULL").groupBy("item_id", "agent").agg(F.count("*").alias("n"), F.any_value(value).alias("v"))
    entry = F.collect_list(F.struct("agent", "v"))  # a row per item, an entry per agent
    said = per.groupBy("item_id").agg(F.map_from_entries(entry).alias("_said"), F.collect_list(F.when(F.col("n") > 1, F.col("agent"))).alias("_again"))
    met = once.join(said.hint("shuffle_hash"), "item_id", "left")
    name = F.to_json(F.struct("item_id", "agents"))
    silent = F.col("_said").isNull() | (F.size(F.array_except("agents", F.map_keys("_said"))) > 0)
    met = refuse(met, F.coalesce(silent, F.lit(True)), F.concat_ws(" ", F.lit("context members: missing"), name))
    met = refuse(met, F.coalesce(F.arrays_overlap("agents", "_again"), F.lit(False)), F.concat_ws(" ", F.lit("context members: repeated"), name))
    met = refuse(met, ~F.coalesce(F.arrays_overlap("agents", F.array(*[F.lit(r) for r in ROLES])), F.lit(False)), F.concat_ws("+", F.lit("no scorer in context "), "agents"))
    met = met.select(*once.columns, F.transform("agents", lambda a: F.element_at("_said", a)).alias("_v"))
    return met.select(
        *once.columns, (_total(F.col("_v.p"), kinds["pred"]) / F.size("agents")).alias("mean_pred"), (_total(F.col("_v.pw"), "double") / _total(F.col("_v.w"), "double")).alias("weighted_pred"),
        _total(F.col("_v.c"), kinds["cost"]).alias("own_cost"), F.array_max(F.col("_v.top"))["p"].alias("strongest_pred"),
    )


def context_report(arbitrations: DataFrame, outputs: DataFrame, *, distinct: bool = False) -> DataFrame:
    """Per context its errors, cost and latency, differences from the strongest, mean and weighted opinion of the same agents, whether a
    context of its group (pairs, all scorers, with evidence) is as good in error, severe rate and cost and better in one, and the
    recommendation: keep what is not beaten, improves on any of the three, and is no more often severe than the strongest."""
    told = heard(arbitrations, outputs, distinct=distinct)
    n = F.col("copies")
    rates = lambda pred, name: [F.sum(_error(F.col(pred)) * n).alias(f"{name}_error"), F.sum((_error(F.col(pred)) > SEVERE).cast("long") * n).alias(f"{name}_severe")]
    sums = told.groupBy("agents").agg(
        F.sum(n).alias("n"), *rates("pred", "own"), F.sum((_error(F.col("pred")) >= EXTREME).cast("long") * n).alias("extreme"), F.sum(F.col("cost") * n).alias("cost"), F.sum(F.col("latency") * n).alias("latency"),
        F.sum((F.col("own_cost") + F.col("cost")) * n).alias("cumulative"), *rates("strongest_pred", "top"), *rates("mean_pred", "mean"), *rates("weighted_pred", "weighted"),
    )
    per = lambda c: ratio(F.col(c), F.col("n"))
    group = F.when(F.array_contains("agents", EVIDENCE), "evidence").when(F.size("agents") == 2, "pair").otherwise("scorer_full")
    rows = sums.select(
        F.array_join("agents", "+").alias("context"), group.alias("group"), "n", per("own_error").alias("nmae"), per("own_severe").alias("severe_rate"), per("extreme").alias("extreme_rate"), per("cost").alias("mean_cost"),
        per("latency").alias("mean_latency"), per("cumulative").alias("cumulative_cost"), (per("own_error") - per("top_error")).alias("against_strongest"), (per("own_severe") - per("top_severe")).alias("severe_against_strongest"),
        (per("own_error") - per("mean_error")).alias("against_mean"), (per("own_error") - per("weighted_error")).alias("against_weighted"),
    ).checkpoint()
    best = skyline(rows, ["group"], ["nmae", "severe_rate", "cumulative_cost"]).select("context", F.lit(False).alias("beaten"))
    marked = rows.join(best, "context", "left").withColumn("beaten", F.coalesce("beaten", F.lit(True)))
    improves = (F.col("against_strongest") < 0) | (F.col("against_mean") < 0) | (F.col("against_weighted") < 0)
    keep = ~F.col("beaten") & improves & (F.col("severe_against_strongest") <= 0)
    return marked.withColumn("recommendation", F.when(keep, "retain_candidate").otherwise("review_or_reject"))
