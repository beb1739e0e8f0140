"""Components against a union of sets, on both ways of joining labels."""

import random

import pytest
from pyspark.sql import functions as F

from scoreloom.operators import components


def by_hand(edges):
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {(x, top(x)) for x in parent}


@pytest.mark.parametrize("bound", [0, 10_000])
def test_components_of_chains_stars_and_repeated_edges(spark, bound):
    rng = random.Random(5)
    chain = [(k, k + 1) for k in range(1000, 1040)]
    star = [(2000, 2000 + k) for k in range(1, 60)]
    loose = [(rng.randrange(3000, 3200), rng.randrange(3000, 3200)) for _ in range(90)]
    edges = [(b, a) if rng.random() < 0.5 else (a, b) for a, b in chain + star + loose + chain + [(7, 7)]]
    rng.shuffle(edges)
    found = components.connected_components(spark.createDataFrame(edges, "a long, b long"), bound).collect()
    assert len(found) == len({r.node for r in found}) and {(r.node, r.component) for r in found} == by_hand(edges)


@pytest.mark.parametrize("bound", [0, 10_000])
def test_no_edges_give_no_components(spark, bound):
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), bound).count() == 0


def test_rounds_have_as_many_tasks_as_the_edges_have_partitions(spark):
    sc = spark.sparkContext
    edges = spark.range(1, 400).selectExpr("id a", "id + 1 b").repartition(24).checkpoint()
    sc.setJobGroup("rounds", "components")
    try:
        found = components.connected_components(edges).collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)
    jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup("rounds")]
    stages = [sc.statusTracker().getStageInfo(s) for j in jobs if j for s in j.stageIds]
    assert {r.component for r in found} == {1} and len(found) == 400
    assert max(s.numTasks for s in stages if s) == 24  # before, twice as many and those of the labels


def test_leakage_reads_items_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(g):
        seen.add(1)
        return g

    rows = [(f"i{k:03}", f"g{k // 3}", f"h{k // 50}" if k % 2 else None) for k in range(200)]
    items = spark.createDataFrame(rows, "item_id string, g string, h string").withColumn("g", counted("g"))
    got = {r.item_id: r.component for r in components.leakage_components(items, [["g"], ["h"], ["g", "h"]]).collect()}
    assert seen.value == 200  # before, items were read twice for every key set
    edges = [(a[0], b[0]) for a in rows for b in rows if a[1] == b[1] or (a[2] and a[2] == b[2])]
    assert set(got.items()) == by_hand(edges)
