"""Skylines against all pairs: three goods, hot groups over several tasks, ties, copies and odd values."""

import random

import numpy as np
import pytest

from scoreloom.operators import skyline

KIND = "k long, g string, a double, b double, c double"


def by_pairs(rows):
    beats = lambda x, y: all(p <= q for p, q in zip(x, y, strict=True)) and x != y
    sound = [r for r in rows if all(v is not None and v == v for v in r[2:])]
    return sorted(r[0] for r in sound if not any(s[1] == r[1] and beats(s[2:], r[2:]) for s in sound))


@pytest.mark.parametrize(("splits", "most"), [(8, 20_000), (2, 7), (1, 5)])
def test_skyline_equals_all_pairs(spark, splits, most):
    rng = random.Random(splits)
    rows = [(i, "hot" if rng.random() < 0.8 else rng.choice(["x", "y", None]), *(float(rng.randrange(12)) for _ in range(3))) for i in range(500)]
    rows += [(600 + i, "hot", *(float(v) for v in p)) for i, p in enumerate([(20 - j, j, 10) for j in range(21)])]  # no row of a slope beats another
    rows += [(700, "hot", None, 0.0, 0.0), (701, "x", float("nan"), 0.0, 0.0), (702, "one", 1.0, 2.0, 3.0), (703, "one", 1.0, 2.0, 3.0)]
    got = skyline.skyline(spark.createDataFrame(rows, KIND), ["g"], ["a", "b", "c"], splits=splits, most=most)
    assert sorted(r.k for r in got.collect()) == by_pairs(rows)


def test_two_goods_without_a_group_and_an_empty_table(spark):
    rows = [(i, "g", float(i % 17), float((i * 7) % 23), 0.0) for i in range(200)]
    frame = spark.createDataFrame(rows, KIND)
    got = skyline.skyline(frame, [], ["a", "b"], most=10)
    assert sorted(r.k for r in got.collect()) == by_pairs([(*r[:4],) for r in rows])
    assert skyline.skyline(frame.limit(0), ["g"], ["a", "b"]).count() == 0


def test_cells_behind_others_are_left_out():
    rng = np.random.default_rng(1)
    cells = rng.choice(512, 200, replace=False)
    first, second = skyline.cell_pairs(cells, 8, 3)
    at = lambda c: np.array([c // 8**i % 8 for i in range(3)])
    alive = {c for c in cells.tolist() if not any((at(d) < at(c)).all() for d in cells.tolist())}
    assert set(first.tolist()) == alive and set(zip(first.tolist(), second.tolist(), strict=True)) == {(c, d) for c in alive for d in alive if (at(d) <= at(c)).all() and (at(d) == at(c)).any()}


def test_front_equals_all_pairs():
    x = np.random.default_rng(2).integers(0, 9, (3000, 4)).astype(float)
    x = np.unique(x, axis=0)
    assert (skyline.front(x) == ~skyline.dominated(x, x)).all()
