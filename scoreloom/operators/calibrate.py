"""Difficulty labels, capability profiles, budget tiers and stop boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions.score import TOP, ratio, wilson_upper
from scoreloom.operators.quality import kappa_of_moments, moments
from scoreloom.operators.ranks import label_of, quantiles
from scoreloom.operators.strict import refuse


def pivot_agents(outputs: DataFrame, agents: list[str], within: list[str] | None = None) -> DataFrame:
    """One row per item with each agent's prediction and confidence; items that lack an agent or have one twice are dropped. ``within``:
    columns that an item's id determines; rows that come partitioned by these are not shuffled again, and the result keeps them."""
    per = outputs.groupBy(*(within or []), "item_id", "dataset", "gold").pivot("agent", agents).agg(F.min("pred").alias("pred"), F.min("confidence").alias("conf"), F.count("agent").alias("n"))
    whole = F.lit(True)
    for a in agents:
        whole = whole & (F.coalesce(F.col(f"{a}_n"), F.lit(0)) == 1)
    return per.where(whole).drop(*[f"{a}_n" for a in agents])


def pivot_faults(outputs: DataFrame, agents: list[str]) -> DataFrame:
    """(item_id, agent, fault): successful outputs that are missing or repeated for an item; empty if every item has one of each."""
    held = outputs.where(F.col("agent").isin(agents)).groupBy("item_id").agg(*[F.count_if((F.col("agent") == a) & (F.col("status") == "success")).alias(a) for a in agents])
    return held.unpivot("item_id", agents, "agent", "n").where("n <> 1").select("item_id", "agent", F.when(F.col("n") == 0, "missing").otherwise("duplicate").alias("fault"))


def difficulty_scores(rows: DataFrame, complexity: Column) -> DataFrame:
    """Add the five signals and ``score``, 0.30 err_cheap + 0.30 err_mid + 0.25 disagreement + 0.15 complexity, in units of 1e-9.

    Errors are over the score range, disagreement is the population deviation of the three predictions over it, at most 1; the
    variance of the confidences is a signal only. Deviations are taken from whole numbers, 3 * sum of squares - square of the sum.
    """
    err = lambda a: F.abs(F.col(f"{a}_pred") - F.col("gold")) / float(TOP)
    spread = lambda c: 3 * sum((F.col(f"{a}_{c}") * F.col(f"{a}_{c}") for a in ("mid", "strong")), F.col(f"cheap_{c}") * F.col(f"cheap_{c}")) - (F.col(f"cheap_{c}") + F.col(f"mid_{c}") + F.col(f"strong_{c}")) * (F.col(f"cheap_{c}") + F.col(f"mid_{c}") + F.col(f"strong_{c}"))
    signals = rows.withColumns({
        "err_cheap": err("cheap"), "err_mid": err("mid"), "disagreement": F.least(F.lit(1.0), F.sqrt(spread("pred").cast("double")) / 3.0 / float(TOP)),
        "complexity": complexity, "confidence_variance": spread("conf").cast("double") / 90000.0,
    })
    score = 0.30 * F.col("err_cheap") + 0.30 * F.col("err_mid") + 0.25 * F.col("disagreement") + 0.15 * F.col("complexity")
    return signals.withColumn("score", F.floor(score * 1e9 + 0.5))


def label_by_thresholds(scored: DataFrame, shares: list[float]) -> DataFrame:
    """Easy up to the first interpolated quantile, Medium up to the second, else Hard."""
    cuts = quantiles(scored.select("score"), "score", shares)
    return scored.crossJoin(F.broadcast(cuts)).withColumn("label", label_of(F.col("score"), F.col("q"), ["Easy", "Medium", "Hard"])).drop("q")  # one row of cuts


def capability_profiles(outputs: DataFrame, group: list[str], least: int) -> DataFrame:
    """Quality, cost, calibration, failure and load of every agent in every group. Means are over successes only; a group without
    any has kappa 0, errors 1 and zeros."""
    right = F.greatest(F.lit(0), TOP - F.col("units"))
    of = lambda x: F.coalesce(F.sum(F.when(F.col("legal"), x)), F.lit(0))
    sums = outputs.groupBy("agent", *group).agg(
        F.count("*").alias("n"), F.count_if("legal").alias("ok"), of(F.col("units")).alias("units"), of(F.col("cost")).alias("s_cost"), of(F.col("latency")).alias("s_latency"),
        of(F.col("tokens")).alias("s_tokens"), of(100 * TOP - F.abs(F.col("confidence") * TOP - 100 * right)).alias("fit"), *moments(),
    )
    total = F.sum("n").over(Window.partitionBy("agent"))  # groups of an agent
    mean = lambda x, whole=1: ratio(F.col(x), F.col("ok") * whole)
    nmae, zero = F.coalesce(mean("units", TOP), F.lit(1.0)), F.lit(0.0)
    return sums.select(
        "agent", *group, "n", "ok", F.coalesce(kappa_of_moments(), zero).alias("qwk"), kappa_of_moments().isNotNull().alias("qwk_defined"), F.coalesce(mean("units", 100), F.lit(1.0)).alias("mae"),
        nmae.alias("nmae"), F.greatest(zero, 1 - nmae).alias("accuracy"), *[F.coalesce(mean(f"s_{c}"), zero).alias(c) for c in ("cost", "latency", "tokens")],
        F.coalesce(mean("fit", 100 * TOP), zero).alias("calibration"), ratio(F.col("n") - F.col("ok"), F.col("n")).alias("failure_rate"), (F.col("n") < least).alias("low_support"), ratio(F.col("n"), total).alias("load"),
    )


def nearest_rank(column: str, share: float) -> Column:
    """The smallest value with at least ``share`` of the rows at or below it."""
    return F.expr(f"percentile_disc({share}) within group (order by {column})")


def support_boundary(counts: DataFrame, share: float = 0.1) -> DataFrame:
    """The nearest-rank group size, and 1 / sqrt of it."""
    return counts.agg(nearest_rank("n", share).cast("long").alias("boundary"), F.count("*").alias("groups")).withColumn("uncertainty", 1.0 / F.sqrt(F.col("boundary").cast("double")))


def budget_tiers(traces: DataFrame, resources: list[str], tiers: dict[str, float]) -> DataFrame:
    """Per tier the nearest-rank quantile of every resource."""
    out = None
    for name, share in tiers.items():
        one = traces.agg(*[nearest_rank(r, share).alias(r) for r in resources]).select(F.lit(name).alias("budget"), *resources)
        out = one if out is None else out.unionByName(one)
    return out


def stop_curve(rows: DataFrame, buckets: int = 1000, datasets: list[str] | None = None) -> DataFrame:
    """For every distinct risk and dataset: stops and unsafe stops at or below it.

    ``risk`` lies in 0..1. Running sums are taken inside buckets of risk and added to the sums of the buckets below, so no
    task sees all thresholds; every dataset gets a row at every threshold: those of the rows, or of the protocol's ``datasets``.
    A risk outside 0..1 or a dataset outside the protocol makes the job fail.
    """
    known = F.col("dataset").isin(datasets) if datasets else F.col("dataset").isNotNull()
    rows = refuse(rows, ~F.coalesce(F.col("risk").between(0.0, 1.0) & ~F.isnan("risk") & known, F.lit(False)), F.concat_ws(" ", F.lit("illegal risk or dataset:"), F.col("risk").cast("string"), "dataset"))
    per = rows.groupBy("risk", "dataset").agg(F.count("*").alias("s"), F.count_if("unsafe").alias("u")).withColumn("bucket", F.least(F.floor(F.col("risk") * buckets), F.lit(buckets - 1)).cast("int"))
    names = rows.sparkSession.createDataFrame([(d,) for d in datasets], "dataset string") if datasets else rows.select("dataset").distinct()
    grid = per.select("risk", "bucket").distinct().crossJoin(F.broadcast(names))  # the protocol's few datasets
    full = grid.join(per.drop("bucket"), ["risk", "dataset"], "left").na.fill(0, ["s", "u"])
    base = per.groupBy("bucket", "dataset").agg(F.sum("s").alias("s"), F.sum("u").alias("u"))
    whole = per.select("bucket").distinct().crossJoin(F.broadcast(names)).join(base, ["bucket", "dataset"], "left").na.fill(0, ["s", "u"])
    below = Window.partitionBy("dataset").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = whole.select("bucket", "dataset", F.coalesce(F.sum("s").over(below), F.lit(0)).alias("s0"), F.coalesce(F.sum("u").over(below), F.lit(0)).alias("u0"))
    inside = Window.partitionBy("bucket", "dataset").orderBy("risk")
    return full.withColumns({"s": F.sum("s").over(inside), "u": F.sum("u").over(inside)}).join(before, ["bucket", "dataset"]).select("risk", "dataset", (F.col("s") + F.col("s0")).alias("stops"), (F.col("u") + F.col("u0")).alias("unsafe"))


def stop_boundary(rows: DataFrame, least: int, limit: float, datasets: list[str] | None = None) -> DataFrame:
    """The threshold that stops most items while every dataset (of the protocol, also one without rows) has ``least`` stops and a Wilson bound within ``limit``; ties go
    to the lower worst bound, then to the lower threshold; one row, with a null boundary if there is none."""
    curve = stop_curve(rows, datasets=datasets).withColumn("ucb", wilson_upper(F.col("unsafe"), F.col("stops")))
    per = curve.groupBy("risk").agg(F.sum("stops").alias("stops"), F.max("ucb").alias("worst"), F.bool_and((F.col("stops") >= least) & (F.col("ucb") <= limit)).alias("ok"))
    best = per.where("ok").agg(F.min_by(F.struct("risk", "stops", "worst"), F.struct(-F.col("stops"), "worst", "risk")).alias("b"))
    return best.select(F.col("b.risk").alias("boundary"), F.col("b.stops").alias("stops"), F.floor(F.col("b.worst") * 1e9 + 0.5).alias("worst_ucb_e9"), F.when(F.col("b").isNull(), "no_safe_stop_boundary").otherwise("success").alias("status"))


def slopes(rows: DataFrame, features: list[str], target: str) -> DataFrame:
    """Per feature the slope covariance / variance / number of features, with the means: one aggregation. Products of sums, which a
    long cannot hold from some tens of millions of rows on, are taken as decimals of 38 digits."""
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    sums = rows.agg(F.count("*").alias("n"), F.sum(target).cast("long").alias("sy"), *[e for f in features for e in (F.sum(f).cast("long").alias(f"s_{f}"), F.sum(F.col(f) * F.col(f)).cast("long").alias(f"ss_{f}"), F.sum(F.col(f) * F.col(target)).cast("long").alias(f"sy_{f}"))])
    out = None
    for f in features:
        cov = wide("n") * wide(f"sy_{f}") - wide(f"s_{f}") * wide("sy")
        var = wide("n") * wide(f"ss_{f}") - wide(f"s_{f}") * wide(f"s_{f}")
        one = sums.select(F.lit(f).alias("feature"), ratio(F.col(f"s_{f}"), F.col("n")).alias("mean"), F.coalesce(ratio(cov, var) / len(features), F.lit(0.0)).alias("slope"), ratio(F.col("sy"), F.col("n")).alias("target_mean"))
        out = one if out is None else out.unionByName(one)
    return out
