"""Models fitted from a few aggregations: ridge regression from moments, and a logistic head from counts of distinct values.

What leaves the executors does not grow with the rows: moments of features for ridge; for the head the table of distinct feature values
with counts, as long as it is within a stated bound, and otherwise one gradient an epoch.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions.score import stop_risk
from scoreloom.session import reliable_checkpoints

#: Distinct (feature values, target) whose counts may come to the driver, 8 bytes for each of their numbers.
COUNTED_ROWS = 200_000


def _sound(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows, as doubles; the job fails at a null, NaN or infinite value."""
    good = F.lit(True)
    for c in columns:
        good = good & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    return rows.select(*[F.col(c).cast("double").alias(c) for c in columns]).where(F.when(~good, F.raise_error(F.lit("a feature or target is missing or not finite"))).isNull())


def ridge(rows: DataFrame, features: list[str], target: str, alpha: float = 1.0) -> dict:
    """Least squares with ``alpha`` times the squared weights, intercept free: the normal equations of centred moments, which one
    aggregation gives. A feature without variance gets no weight. No rows are an error."""
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(features))]
    held = _sound(rows, [*features, target])
    aggregates = [F.count("*").alias("n"), F.avg(target).alias("y"), *[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)]]
    aggregates += [F.covar_pop(features[i], features[j]).alias(f"c{i}_{j}") for i, j in pairs] + [F.covar_pop(f, target).alias(f"y{i}") for i, f in enumerate(features)]
    m = held.agg(*aggregates).first()
    if not m["n"]:
        raise ValueError("ridge needs rows")
    k = len(features)
    a, b = np.zeros((k, k)), np.array([m[f"y{i}"] * m["n"] for i in range(k)])
    for i, j in pairs:
        a[i, j] = a[j, i] = m[f"c{i}_{j}"] * m["n"]
    weights = np.linalg.lstsq(a + alpha * np.eye(k), b, rcond=None)[0]
    means = [m[f"m{i}"] for i in range(k)]
    return {"features": list(features), "weights": weights.tolist(), "intercept": float(m["y"] - np.dot(weights, means)), "rows": m["n"], "alpha": alpha}


def linear(model: dict) -> Column:
    """The prediction of ``ridge``."""
    return sum((F.col(f).cast("double") * w for f, w in zip(model["features"], model["weights"], strict=True)), F.lit(model["intercept"]))


def clipped(slopes: DataFrame, rows: DataFrame, features: list[str], bounds: tuple[float, float]) -> DataFrame:
    """``rows`` with ``predicted``: target mean plus slope times distance from the feature's mean, summed, within ``bounds`` (the least
    and largest target that was fitted). ``slopes``: one row per feature (feature, mean, slope, target_mean), joined as one."""
    one = slopes.groupBy().agg(F.max("target_mean").alias("_t"), *[F.max(F.when(F.col("feature") == f, F.struct("mean", "slope"))).alias(f"_{f}") for f in features])
    value = sum((F.col(f"_{f}.slope") * (F.col(f).cast("double") - F.col(f"_{f}.mean")) for f in features), F.col("_t"))
    low, high = bounds
    return rows.crossJoin(F.broadcast(one)).withColumn("predicted", F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))).drop("_t", *[f"_{f}" for f in features])  # one row


def fit_stop_risk(rows: DataFrame, features: list[str], target: str, epochs: int = 200, rate: float = 0.1, l2: float = 1e-4, counted_rows: int = COUNTED_ROWS) -> dict:
    """Full-batch logistic descent on standardised features, begun at the log odds of the smoothed share of positives.

    Rows are reduced to counts of distinct (feature values, target), from which means, scales and every gradient follow exactly. Up to
    ``counted_rows`` of them (counted first) are fitted in the driver, one aggregation in all; beyond, each epoch sums its
    gradient over the counts. ``target`` is boolean; no rows are an error.
    """
    reliable_checkpoints(rows.sparkSession)
    held = _sound(rows.withColumn(target, F.col(target).cast("double")), [*features, target])
    counts = held.groupBy(*features, target).agg(F.count("*").alias("c")).checkpoint()
    few = counts.limit(counted_rows + 1).count() <= counted_rows
    n_ = F.sum("c")
    first = counts.agg(n_.alias("n"), F.sum(F.col("c") * F.col(target)).alias("p"), *[(F.sum(F.col("c") * F.col(f)) / n_).alias(f"m{i}") for i, f in enumerate(features)]).first()
    if not first["n"]:
        raise ValueError("the head needs rows")
    n, means = first["n"], [first[f"m{i}"] for i in range(len(features))]
    spread = counts.agg(*[(F.sum(F.col("c") * (F.col(f) - m) * (F.col(f) - m)) / n).alias(f"v{i}") for i, (f, m) in enumerate(zip(features, means, strict=True))]).first()
    scales = [math.sqrt(v) if v > 1e-12 else 1.0 for v in spread]
    share = min(1 - 1e-6, max(1e-6, (first["p"] + 0.5) / (n + 1)))
    bias, weights = math.log(share / (1 - share)), np.zeros(len(features))

    if few:
        table = counts.toPandas()
        x = (table[features].to_numpy(float) - means) / scales
        y, c = table[target].to_numpy(float), table["c"].to_numpy(float)

    def gradient() -> tuple[np.ndarray, float]:
        if few:
            z = bias + x @ weights
            e = np.exp(-np.abs(z))
            gap = (np.where(z >= 0, 1 / (1 + e), e / (1 + e)) - y) * c
            return gap @ x, float(gap.sum())
        gap = (stop_risk([F.col(f) for f in features], means, scales, weights.tolist(), bias) - F.col(target)) * F.col("c")
        g = counts.agg(F.sum(gap), *[F.sum(gap * (F.col(f) - m) / s) for f, m, s in zip(features, means, scales, strict=True)]).first()
        return np.array(g[1:]), g[0]

    for _ in range(epochs):
        by_weight, by_bias = gradient()
        bias -= rate * by_bias / n
        weights = weights - rate * (by_weight / n + l2 * weights)
    return {"features": list(features), "means": means, "scales": scales, "weights": weights.tolist(), "bias": bias, "rows": n, "positives": int(first["p"])}
