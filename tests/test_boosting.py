"""Splits against brute force over rows, jobs against sums in the driver, held-out rows that end the fitting."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.operators import boosting


def best_by_rows(x, g, least, l2):
    """(gain, feature, threshold) over all rows and all cuts between neighbouring values."""
    found = []
    whole = g.sum() ** 2 / (len(g) + l2)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for a, b in zip(values[:-1], values[1:], strict=True):
            left = x[:, f] <= a
            if least <= left.sum() <= len(g) - least:
                found.append((-(g[left].sum() ** 2 / (left.sum() + l2) + g[~left].sum() ** 2 / ((~left).sum() + l2) - whole), f, (a + b) / 2))
    return min(found, key=lambda z: (round(z[0], 9), z[1], z[2]), default=None)


def data(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = [(float(a := rng.randrange(12)), float(b := rng.randrange(5)), rng.choice([0.5, 2.5]), 3.0 * (a > 6) + b * (a < 3) + rng.gauss(0, 0.2)) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "a double, b double, c double, y double").repartition(3)


def test_every_split_is_the_best_over_all_rows(spark):
    rows, frame = data(spark)
    model = boosting.fit(frame, ["a", "b", "c"], "y", trees=3, rate=0.5, depth=3, least=7, l2=0.3)
    x, y = np.array([r[:3] for r in rows]), np.array([r[3] for r in rows])
    pred = np.full(len(y), y.mean())
    for tree in model.trees:
        todo = [(0, np.ones(len(y), bool))]
        leaf = np.zeros(len(y))
        while todo:
            node, mine = todo.pop()
            best = best_by_rows(x[mine], (pred - y)[mine], 7, 0.3)
            if tree.feature[node] < 0:
                value = -0.5 * (pred - y)[mine].sum() / (mine.sum() + 0.3)
                assert tree.value[node] == pytest.approx(value)
                leaf[mine] = value
                continue
            assert (tree.feature[node], model.edges[tree.feature[node]][tree.cut[node]]) == (best[1], best[2])
            left = x[:, best[1]] <= best[2]
            todo += [(tree.left[node], mine & left), (tree.right[node], mine & ~left)]
        pred = pred + leaf
    got = [r.predicted for r in boosting.predict(model, spark.createDataFrame(rows, "a double, b double, c double, y double").coalesce(1)).collect()]
    assert got == pytest.approx(pred.tolist()) and ((pred - y) ** 2).mean() < 0.2 * y.var()


def test_jobs_and_driver_sums_give_the_same_trees(spark):
    _, frame = data(spark)
    a = boosting.fit(frame, ["a", "b"], "y", trees=2, depth=2, leaves=3)
    b = boosting.fit(frame, ["a", "b"], "y", trees=2, depth=2, leaves=3, counted_rows=0)
    assert [(t.feature, t.cut) for t in a.trees] == [(t.feature, t.cut) for t in b.trees] and [t.value for t in b.trees] == [pytest.approx(t.value) for t in a.trees]
    assert all(sum(f < 0 for f in t.feature) <= 3 for t in a.trees)


def test_held_out_rows_end_the_fitting(spark):
    rng = random.Random(4)
    frame = spark.createDataFrame([(float(rng.randrange(30)), rng.gauss(0, 1), i % 4 == 0) for i in range(300)], "a double, y double, held boolean")
    model = boosting.fit(frame, ["a"], "y", trees=60, rate=0.5, least=2, held_out="held", patience=4)
    assert len(model.trees) < 60 and len(model.losses) == len(model.trees) + 1
    pred = np.array([r.predicted for r in boosting.predict(boosting.Model(model.features, model.edges, model.base), frame.where("held")).collect()])
    y = np.array([r.y for r in frame.where("held").collect()])
    assert model.losses[0] == pytest.approx(((pred - y) ** 2).mean())


def test_odd_inputs(spark):
    flat = boosting.fit(spark.createDataFrame([(1.0, 2.0)] * 50, "a double, y double"), ["a"], "y", trees=2)
    assert flat.edges == [[]] and all(t.feature == [-1] for t in flat.trees) and flat.base == 2.0
    many = spark.range(2000).select(F.col("id").cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("y"))
    assert 200 < len(boosting.bin_edges(many, ["a"])[0]) <= 254
    with pytest.raises(ValueError):
        boosting.fit(many.limit(0), ["a"], "y")
    with pytest.raises(Exception, match="not finite"):
        boosting.fit(many.withColumn("y", F.lit(float("nan"))), ["a"], "y")
