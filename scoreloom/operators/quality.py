"""Quality, safety and agreement metrics of scored records, per dataset and overall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions.score import TOP, fixed_bin, is_legal, normalized_error, ratio


def judged(records: DataFrame, low: Column | None = None, high: Column | None = None) -> DataFrame:
    """Legality, error in units of 1/TOP of the range (all of them where illegal) and the bins of gold and pred.

    Without ``low`` and ``high``, scores are whole numbers from 0 to TOP; with them each row has its own range of any numbers, errors
    are rounded to the nearest unit, and a row without a proper range is illegal.
    """
    if low is None or high is None:
        legal = (F.col("status") == "success") & F.col("pred").between(0, TOP)
        bin_of = lambda c: F.when(F.col("legal"), F.expr(f"(20 * {c} + {TOP}) div {2 * TOP}"))
        units = F.abs(F.col("pred") - F.col("gold"))
    else:
        legal = F.coalesce((F.col("status") == "success") & (high > low) & F.col("gold").between(low, high), F.lit(False)) & is_legal(F.col("status"), F.col("pred"), low, high)
        bin_of = lambda c: F.when(F.col("legal"), fixed_bin(F.col(c), low, high))
        units = F.round(normalized_error(F.col("pred"), F.col("gold"), low, high) * TOP)
    return records.withColumn("legal", legal).withColumns({"units": F.when(F.col("legal"), units).otherwise(F.lit(TOP)).cast("long"), "gb": bin_of("gold"), "pb": bin_of("pred")})


def kappa(n: Column, t: Column, p: Column, tt: Column, pp: Column, tp: Column) -> Column:
    """Quadratic weighted kappa over fixed labels from sums: 1 - observed / expected; null if nothing can disagree.

    Observed is (tt - 2 tp + pp) / n and expected tt / n + pp / n - 2 t p / n^2, so both are taken times n^2, in integers of up
    to 37 digits.
    """
    wide = lambda x: x.cast("decimal(18,0)")
    observed = wide(tt + pp - 2 * tp) * wide(n)
    expected = wide(tt + pp) * wide(n) - wide(2 * t) * wide(p)
    return F.when(expected > 0, 1.0 - observed.cast("double") / expected.cast("double"))


def moments() -> list[Column]:
    """Sums over legal predictions that kappa needs."""
    g, p = F.col("gb"), F.col("pb")
    sums = {"n_valid": F.count_if("legal"), "st": F.sum(g), "sp": F.sum(p), "stt": F.sum(g * g), "spp": F.sum(p * p), "stp": F.sum(g * p)}
    return [F.coalesce(e, F.lit(0)).cast("long").alias(k) for k, e in sums.items()]


def kappa_of_moments() -> Column:
    return kappa(*[F.col(c) for c in ("n_valid", "st", "sp", "stt", "spp", "stp")])


def quality_by_dataset(judged: DataFrame, datasets: DataFrame) -> DataFrame:
    """All metrics per dataset; a protocol dataset without records gets a row too. Rates without a denominator are null,
    except stop coverage, which is 0."""
    severe, extreme = F.col("units") * 4 > TOP, F.col("units") * 2 >= TOP
    sums = judged.groupBy("dataset").agg(
        F.count("*").alias("n"), F.sum("units").alias("units"), F.count_if(severe).alias("severe"), F.count_if(extreme).alias("extreme"), F.count_if("stop").alias("stops"),
        F.count_if(F.col("stop") & severe).alias("unsafe_stops"), F.count_if(F.col("status") == "deferred").alias("deferred"), F.count_distinct("gb").alias("gold_bins"), *moments(),
    )
    full = datasets.select("dataset").join(sums, "dataset", "left").na.fill(0)
    n = F.col("n")
    return full.select(
        "dataset", "n", "n_valid", "severe", "extreme", "stops", "unsafe_stops", "deferred",
        ratio(F.col("units"), n * TOP).alias("nmae"), ratio(F.col("severe"), n).alias("severe_rate"), ratio(F.col("extreme"), n).alias("extreme_rate"),
        ratio(F.col("deferred"), n).alias("deferral_rate"), ratio(F.col("unsafe_stops"), F.col("stops")).alias("unsafe_stop_rate"),
        F.coalesce(ratio(F.col("stops"), n), F.lit(0.0)).alias("stop_coverage"), kappa_of_moments().alias("qwk"), F.col("gold_bins"),
    )


def readiness(by_dataset: DataFrame, least: int = 100, bins: int = 2) -> DataFrame:
    """Whether kappa may be used, and every reason why not."""
    reasons = F.concat_ws(";", F.when(F.col("n_valid") < least, "insufficient_valid_completed"), F.when(F.col("gold_bins") < bins, "insufficient_gold_bins"), F.when(F.col("qwk").isNull(), "zero_expected_disagreement"))
    return by_dataset.select("dataset", "n_valid", "gold_bins", (reasons == "").alias("ready"), reasons.alias("reasons"))


def macro(by_dataset: DataFrame) -> DataFrame:
    """Unweighted means over datasets (null unless every dataset has the metric), worst datasets and overall rates."""
    every = lambda c: F.count(c) == F.count(F.lit(1))
    mean = lambda c: F.when(every(c), F.sum(c) / F.count(F.lit(1)))
    total = F.sum("n")
    return by_dataset.agg(
        F.max("severe_rate").alias("worst_severe"), F.when(every("unsafe_stop_rate"), F.max("unsafe_stop_rate")).alias("worst_unsafe"), F.max("nmae").alias("worst_nmae"),
        F.min("qwk").alias("worst_qwk"), F.bool_and(F.col("stops") > 0).alias("stop_ready"), F.coalesce(ratio(F.sum("deferred"), total), F.lit(0.0)).alias("deferral_rate"),
        F.coalesce(ratio(F.sum("stops"), total), F.lit(0.0)).alias("stop_coverage"), F.round(mean("nmae"), 9).alias("macro_nmae"), F.round(mean("qwk"), 9).alias("macro_qwk"),
    )


def confusion(judged: DataFrame) -> DataFrame:
    return judged.where("legal").groupBy("dataset", F.col("gb").alias("gold_bin"), F.col("pb").alias("pred_bin")).agg(F.count("*").alias("n"))


def plain_errors(judged: DataFrame) -> DataFrame:
    """Mean absolute and root mean square error and agreement within one bin, over legal predictions."""
    d = F.col("gb") - F.col("pb")
    n = F.count("*")
    return judged.where("legal").groupBy("dataset").agg(n.alias("n"), ratio(F.sum(F.abs(d)), n).alias("mae"), F.sqrt(ratio(F.sum(d * d), n)).alias("rmse"), ratio(F.count_if(F.abs(d) <= 1), n).alias("within_1"))


#: Counts of legal predictions by bin of the gold score.
GOLD_BINS = [f"g{b}" for b in range(11)]


def paper_statistics(judged: DataFrame, *more: str) -> DataFrame:
    """Mergeable sums per paper and dataset (and ``more`` columns): all that a resampling of papers needs, readiness of kappa included."""
    severe = F.col("units") * 4 > TOP
    gold = [F.count_if(F.col("legal") & (F.col("gb") == b)).alias(name) for b, name in enumerate(GOLD_BINS)]
    return judged.groupBy("paper_id", *more, "dataset").agg(
        F.count("*").alias("n"), F.sum("units").alias("units"), F.count_if(severe).alias("severe"), F.count_if("stop").alias("stops"), F.count_if(F.col("stop") & severe).alias("unsafe"), *moments(), *gold
    )
