"""Ridge against the closed form, the logistic head against its 200 epochs row by row, clipped slopes."""

import math
import random

import numpy as np
import pytest

from scoreloom.operators import calibrate, fitting


def test_ridge_equals_the_normal_equations(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(9), rng.gauss(5, 2), 3.0, rng.gauss(0, 1)) for _ in range(200)]
    frame = spark.createDataFrame([(a, b, c, 2 * a - b + e) for a, b, c, e in rows], "a int, b double, c double, y double").repartition(3)
    model = fitting.ridge(frame, ["a", "b", "c"], "y", alpha=2.5)
    x = np.array([r[:3] for r in rows], float)
    y = np.array([2 * r[0] - r[1] + r[3] for r in rows])
    centred = x - x.mean(0)
    w = np.linalg.solve(centred.T @ centred + 2.5 * np.eye(3), centred.T @ (y - y.mean()))
    assert model["weights"] == pytest.approx(w.tolist(), abs=1e-9) and model["intercept"] == pytest.approx(y.mean() - x.mean(0) @ w, abs=1e-9) and model["weights"][2] == pytest.approx(0)
    got = [r.p for r in frame.coalesce(1).select("a", fitting.linear(model).alias("p")).orderBy("p").collect()]
    assert got == pytest.approx(sorted((x @ w + model["intercept"]).tolist()))
    with pytest.raises(Exception, match="not finite"):
        fitting.ridge(spark.createDataFrame([(1.0, float("nan"))], "a double, y double"), ["a"], "y")
    with pytest.raises(ValueError):
        fitting.ridge(frame.limit(0), ["a"], "y")


def descent(rows, epochs=200, rate=0.1, l2=1e-4):
    """The head, row by row, with 2 features."""
    n = len(rows)
    means = [sum(r[i] for r in rows) / n for i in range(2)]
    scales = [math.sqrt(v) if (v := sum((r[i] - means[i]) ** 2 for r in rows) / n) > 1e-12 else 1.0 for i in range(2)]
    x = [[(r[i] - means[i]) / scales[i] for i in range(2)] for r in rows]
    share = min(1 - 1e-6, max(1e-6, (sum(r[2] for r in rows) + 0.5) / (n + 1)))
    b, w = math.log(share / (1 - share)), [0.0, 0.0]
    for _ in range(epochs):
        gaps = [1 / (1 + math.exp(-(b + sum(p * q for p, q in zip(w, v, strict=True))))) - r[2] for v, r in zip(x, rows, strict=True)]
        b -= rate * sum(gaps) / n
        w = [w[i] - rate * (sum(g * v[i] for g, v in zip(gaps, x, strict=True)) / n + l2 * w[i]) for i in range(2)]
    return means, scales, w, b


def test_head_equals_descent_row_by_row(spark):
    rng = random.Random(2)
    rows = [(float(a := rng.randrange(6)), float(rng.randrange(4)), rng.random() < a / 8) for _ in range(400)]
    frame = spark.createDataFrame(rows, "a double, b double, bad boolean").repartition(4)
    means, scales, w, b = descent(rows)
    model = fitting.fit_stop_risk(frame, ["a", "b"], "bad")
    assert model["means"] == pytest.approx(means) and model["scales"] == pytest.approx(scales) and model["weights"] == pytest.approx(w, abs=1e-9) and model["bias"] == pytest.approx(b, abs=1e-9)
    assert (model["rows"], model["positives"]) == (400, sum(r[2] for r in rows))
    few = fitting.fit_stop_risk(frame, ["a", "b"], "bad", epochs=3, counted_rows=0)  # by aggregations
    assert few["weights"] == pytest.approx(descent(rows, 3)[2], abs=1e-9) and few["bias"] == pytest.approx(descent(rows, 3)[3], abs=1e-9)
    flat = fitting.fit_stop_risk(spark.createDataFrame([(1.0, 2.0, True)] * 5, "a double, b double, bad boolean"), ["a", "b"], "bad", epochs=1)
    assert flat["scales"] == [1.0, 1.0] and flat["weights"] == [0.0, 0.0]


def test_predictions_of_slopes_stay_within_the_fitted_targets(spark):
    rows = [(i, i % 3, 10 * i) for i in range(10)]
    frame = spark.createDataFrame(rows, "a long, b long, y long")
    done = fitting.clipped(calibrate.slopes(frame, ["a", "b"], "y"), spark.createDataFrame([(4, 1), (1000, 0), (-1000, 0)], "a long, b long"), ["a", "b"], (0, 90))
    got = [r.predicted for r in done.orderBy("a").collect()]
    mean = lambda c: sum(r[c] for r in rows) / 10
    slope = lambda c: sum((r[c] - mean(c)) * (r[2] - mean(2)) for r in rows) / sum((r[c] - mean(c)) ** 2 for r in rows) / 2
    assert got[0] == 0 and got[2] == 90 and got[1] == pytest.approx(45 + slope(0) * (4 - 4.5) + slope(1) * (1 - mean(1)))
