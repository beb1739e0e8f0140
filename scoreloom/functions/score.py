"""Column expressions over scores: errors, bins, legality, budgets, costs and bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Statuses under which a prediction does not count as completed.
INVALID_STATUSES = ["failed", "skipped", "invalid", "timeout", "parse_failed", "missing_output", "deferred", "error", "incomplete"]
STOP_ACTIONS = ["STOP", "STOP_ITEM"]
SEVERE, EXTREME = 0.25, 0.50
#: Units that a range of scores is measured in where sums have to be exact.
TOP = 5000
#: 0.95 quantile of the standard normal distribution.
Z95 = 1.6448536269514722


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def normalized_error(pred: Column, gold: Column, low: Column, high: Column) -> Column:
    """|pred - gold| over the width of the range."""
    return ratio(F.abs(pred - gold), high - low)


def fixed_bin(value: Column, low: Column, high: Column) -> Column:
    """One of the labels 0..10 by half-up rounding of ten times the normalised value; exact in decimals; null out of range."""
    v, a, b = (F.when(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), x.cast("string").cast("decimal(18,9)")) for x in (value, low, high))
    inside = (v >= a) & (v <= b) & (b > a)
    return F.when(inside, F.floor((20 * (v - a) + (b - a)) / (2 * (b - a)))).cast("int")


def bankers_bin(normalized: Column) -> Column:
    """Ten times the normalised value, halves to even."""
    return F.bround(normalized * 10, 0).cast("int")


def is_legal(status: Column, pred: Column, low: Column, high: Column, completed: Column | None = None, cache_valid: Column | None = None) -> Column:
    """A completed, finite prediction in range, from a valid cache entry."""
    p = pred.cast("double")
    ok = ~F.coalesce(status, F.lit("")).isin(INVALID_STATUSES) & pred.isNotNull() & ~F.isnan(p) & (F.abs(p) < float("inf")) & (pred >= low) & (pred <= high)
    for flag in (completed, cache_valid):
        if flag is not None:
            ok = ok & F.coalesce(flag, F.lit(True))
    return F.coalesce(ok, F.lit(False))


def gate_error(legal: Column, error: Column) -> Column:
    """The error of a legal prediction, 1 for any other."""
    return F.when(legal, error).otherwise(F.lit(1.0))


def is_severe(error: Column) -> Column:
    return error > SEVERE


def is_extreme(error: Column) -> Column:
    return error >= EXTREME


def is_stop(*actions: Column) -> Column:
    """Whether the first action that is present is one that stops."""
    return F.coalesce(F.coalesce(*actions).isin(STOP_ACTIONS), F.lit(False))


def exhausted(used: list[Column], limits: list[Column]) -> Column:
    """Any resource at or above its limit."""
    out = F.lit(False)
    for u, m in zip(used, limits, strict=True):
        out = out | (u >= m)
    return out


def within(used: list[Column], limits: list[Column]) -> Column:
    """Every resource at or below its limit (so a resource at its limit is within and exhausted at once)."""
    out = F.lit(True)
    for u, m in zip(used, limits, strict=True):
        out = out & (u <= m + 1e-12)
    return out


def sigmoid(z: Column) -> Column:
    return F.when(z >= 0, 1.0 / (1.0 + F.exp(-z))).otherwise(F.exp(z) / (1.0 + F.exp(z)))


def stop_risk(features: list[Column], means: list[float], scales: list[float], weights: list[float], bias: float) -> Column:
    """Logistic risk of standardised features."""
    z = F.lit(float(bias))
    for x, m, s, w in zip(features, means, scales, weights, strict=True):
        z = z + (x - m) / s * w
    return sigmoid(z)


def wilson_upper(k: Column, n: Column, z: float = Z95) -> Column:
    """Upper one-sided Wilson bound of k events in n trials; 1 for no trials."""
    k, n = k.cast("double"), n.cast("double")
    p = k / F.when(n > 0, n)
    z2 = z * z
    bound = (p + z2 / (2 * n) + z * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n)) / (1 + z2 / n)
    return F.when(n > 0, F.least(F.lit(1.0), bound)).otherwise(F.lit(1.0))


def api_cost(inputs: Column, cached: Column, written: Column, outputs: Column, rates: dict[str, Column], threshold: int = 272_000, in_factor: float = 2.0, out_factor: float = 1.5) -> Column:
    """Cost of one call from token counts and rates per million; longer contexts than ``threshold`` cost more."""
    long = inputs > threshold
    m_in, m_out = F.when(long, in_factor).otherwise(1.0), F.when(long, out_factor).otherwise(1.0)
    uncached = inputs - cached - written
    return (m_in * (uncached * rates["input"] + cached * rates["cached"] + written * rates["write"]) + m_out * outputs * rates["output"]) / 1e6
