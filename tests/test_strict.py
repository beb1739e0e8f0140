"""Strict joins: faults by kind, failing jobs, one shuffle a side, counts in passing, scopes and equal sets."""

import pytest
from pyspark.sql import functions as F

from scoreloom.operators import strict

L = "k long, a string"
R = "k long, b string"


def frames(spark, left, right):
    return spark.createDataFrame(left, L), spark.createDataFrame(right, R)


def faults(df):
    return sorted(((r.k, r.fault) for r in df.collect()), key=str)


def test_faults_of_many_to_one(spark):
    left, right = frames(spark, [(1, "x"), (1, "y"), (2, "z"), (3, "w"), (None, "n")], [(1, "p"), (2, "q"), (2, "q"), (4, "r"), (None, "s")])
    assert faults(strict.strict_join(left, right, ["k"], fault="keep")) == [(1, None), (1, None), (2, "repeated"), (3, "missing"), (None, "missing")]
    whole = strict.strict_join(left, right, ["k"], cover=True, fault="keep")
    assert faults(whole) == [(1, None), (1, None), (2, "repeated"), (3, "missing"), (4, "unused"), (None, "missing"), (None, "unused")]
    assert {r.b for r in whole.where("fault IS NOT NULL AND k = 2").collect()} == {None}
    salted = strict.strict_join(left, right, ["k"], cover=True, fault="keep", hot=F.col("k") == 1)
    assert faults(salted) == faults(whole)


def test_faults_of_one_to_one_and_agreement(spark):
    left = spark.createDataFrame([(1, "h1", 1), (2, "h2", 2), (3, None, 3), (4, "h4", 4), (4, "h4", 5)], "k long, h string, a int")
    right = spark.createDataFrame([(1, "h1", "p"), (2, "hx", "q"), (3, None, "r"), (4, "h4", "s"), (9, "h9", "t")], "k long, h string, b string")
    found = strict.strict_join(left, right, ["k"], one_to_one=True, cover=True, agree=["h"], fault="keep")
    assert faults(found) == [(1, None), (2, "changed"), (3, None), (4, "repeated"), (9, "unused")]
    assert [tuple(r) for r in found.where("fault IS NULL").orderBy("k").collect()] == [(1, "h1", 1, "p", None), (3, None, 3, "r", None)]
    assert faults(strict.strict_join(left, right, ["k"], one_to_one=True, agree=["h"], fault="keep"))[-1] == (4, "repeated")


def test_composite_keys(spark):
    left = spark.createDataFrame([("p", "b1", 1), ("p", None, 2)], "package string, budget string, v int")
    right = spark.createDataFrame([("p", "b1", 7), ("p", "b2", 8)], "package string, budget string, w int")
    found = strict.strict_join(left, right, ["package", "budget"], fault="keep")
    assert sorted((r.v, r.w, r.fault) for r in found.collect()) == [(1, 7, None), (2, None, "missing")]


def test_a_faulty_row_fails_the_job_that_reads_it_even_if_no_column_is_used(spark):
    left, right = frames(spark, [(1, "x"), (3, "w")], [(1, "p"), (2, "q")])
    joined = strict.strict_join(left, right, ["k"], name="lookup")
    for job in (lambda: joined.collect(), lambda: joined.count(), lambda: joined.select("a").groupBy("a").count().collect()):
        with pytest.raises(Exception, match="lookup: missing"):
            job()
    assert sorted(tuple(r) for r in strict.strict_join(left.where("k = 1"), right, ["k"]).collect()) == [(1, "x", "p")]
    with pytest.raises(Exception, match="unused"):
        strict.strict_join(left.where("k = 1"), right, ["k"], cover=True).count()


def test_one_shuffle_a_side(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for options in ({}, {"cover": True}, {"one_to_one": True, "cover": True}):
            left, right = frames(spark, [(1, "x")], [(1, "p")])
            plan = strict.strict_join(left, right, ["k"], **options)._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 2 and plan.count("Scan") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_names_that_clash_are_refused(spark):
    left, right = frames(spark, [(1, "x")], [(1, "p")])
    with pytest.raises(ValueError, match="both sides"):
        strict.strict_join(left, right.withColumn("a", F.lit(1)), ["k"])
    with pytest.raises(ValueError, match="not on both sides"):
        strict.strict_join(left, right, ["k"], agree=["a"])


def test_watch_counts_in_the_same_job(spark):
    left, right = frames(spark, [(1, "x"), (2, "z"), (3, "w")], [(1, "p"), (2, "q"), (2, "q")])
    watch = strict.Watch("profiles", single=["a"])
    watch.over(strict.strict_join(left, right, ["k"], fault="keep")).collect()
    assert watch.counts() == {"rows": 3, "missing": 1, "unused": 0, "repeated": 1, "changed": 0}
    with pytest.raises(ValueError, match="mixed a, 1 missing, 1 repeated"):
        watch.settle()
    calm = strict.Watch("calm", single=["run"])
    calm.over(left.withColumn("run", F.lit("r1"))).collect()
    assert calm.settle() == {"rows": 3}


def test_scope(spark):
    rows = spark.createDataFrame([(1, "train", "formal"), (2, "dev", "formal"), (3, None, "smoke")], "k long, split string, mode string")
    scope = {"split": ["train"], "mode": ["formal"]}
    assert [r.f for r in rows.orderBy("k").select(strict.out_of_scope(scope).alias("f")).collect()] == [None, "split", "split;mode"]
    assert strict.in_scope(rows.where("k = 1"), scope, "profiles").count() == 1
    with pytest.raises(Exception, match="profiles: out of scope in split"):
        strict.in_scope(rows.where("k < 3"), scope, "profiles").count()


def test_unequal_sets(spark):
    rows = [("x", 1), ("y", 1), ("x", 2), ("x", 3), ("y", 3), ("y", 3), ("z", 1)]
    found = strict.unequal_sets(spark.createDataFrame(rows, "agent string, item long"), "agent", "item", ["x", "y"])
    assert sorted(tuple(r) for r in found.collect()) == [(1, "", "", "z"), (2, "y", "", ""), (3, "", "y", "")]


def test_policy_packages(spark):
    points = spark.createDataFrame([("c1", "h1"), ("c2", "h2"), ("c3", "h3"), ("c4", "h4"), ("c5", "h5")], "checkpoint_id string, checkpoint_hash string")
    made = [("c1", "h1", "success", 0.4, 0.7, None), ("c2", "h2", "failure", 0.9, None, ""), ("c3", "other", "success", 0.1, 0.1, None), ("c4", "h4", "odd", 0.1, 0.1, None), ("c9", "h9", "success", 0.1, 0.1, None)]
    done = {r.checkpoint_id: r for r in strict.policy_packages(points, spark.createDataFrame(made, "checkpoint_id string, checkpoint_hash string, status string, stop_boundary double, coverage double, failure_reason string")).collect()}
    assert (done["c1"].package_id, done["c1"].promoted, done["c1"].stop_boundary, done["c1"].failure_reason) == ("pkg_c1", True, 0.4, "")
    assert (done["c2"].promoted, done["c2"].stop_boundary, done["c2"].coverage, done["c2"].failure_reason) == (False, None, 0.0, "unknown_calibration_failure")
    assert {k: r.fault for k, r in done.items()} == {"c1": None, "c2": None, "c3": "changed", "c4": "illegal_status", "c5": "missing", "c9": "unused"}
