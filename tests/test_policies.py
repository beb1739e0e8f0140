"""Policies, thresholds and contexts against plain Python; boundaries with datasets that have no rows; keys of references."""

import random

import pytest
from pyspark.sql import functions as F

from scoreloom.operators import calibrate, pilot, policies, quality, select


def kappa(pairs):
    n = len(pairs)
    observed = sum((g - p) ** 2 for g, p in pairs) / n
    expected = sum((g - q) ** 2 for g, _ in pairs for _, q in pairs) / n / n
    return 1 - observed / expected if expected else None


def worth(rows):
    """(n, nmae, qwk, cost, latency, upgrades) of (gold, pred, low, high, cost, latency, upgraded)."""
    norm = [((g - lo) / (hi - lo), min(1.0, max(0.0, (p - lo) / (hi - lo)))) for g, p, lo, hi, *_ in rows]
    n = len(rows)
    return n, sum(abs(a - b) for a, b in norm) / n, kappa([(round(a * 10), round(b * 10)) for a, b in norm]), sum(r[4] for r in rows), sum(r[5] for r in rows) / n, sum(r[6] for r in rows) / n


def test_selections_equal_plain_python(spark):
    rng = random.Random(1)
    rows = [(f"i{i}", agent, float(rng.randrange(11)), float(-rng.randrange(3)), 10.0 + rng.randrange(3), float(rng.randrange(-4, 16)), rng.randrange(9), rng.randrange(5), "cheap", rng.choice(["cheap", "mid"])) for i in range(60) for agent in ("cheap", "mid")]
    rows = [r if r[1] == "cheap" else (*r[:9], next(q[9] for q in rows if q[0] == r[0])) for r in rows]
    frame = spark.createDataFrame(rows, "item_id string, agent string, gold double, low double, high double, pred double, cost long, latency long, always string, mixed string")
    got = {r.method: r for r in policies.evaluate_selections(frame, ["always", "mixed"], "cheap").collect()}
    for method, column in (("always", 8), ("mixed", 9)):
        n, nmae, qwk, cost, latency, ups = worth([(g, p, lo, hi, c, t, a != "cheap") for _, a, g, lo, hi, p, c, t, *m in rows if m[column - 8] == a])
        r = got[method]
        assert (r.sample_count, r.total_cost) == (n, cost) and (r.nmae, r.qwk, r.mean_latency, r.upgrade_rate, r.mean_cost) == pytest.approx((nmae, qwk, latency, ups, cost / n))
    with pytest.raises(Exception, match="illegal range"):
        policies.evaluate_selections(frame.withColumn("high", frame.low), ["always"], "cheap").collect()


def test_thresholds_equal_plain_python(spark):
    rng = random.Random(2)
    rows = [(float(rng.randrange(11)), 0.0, 10.0, rng.choice([0.1, 0.35, 0.5, 0.9, None]), float(rng.randrange(11)), rng.randrange(5), 1, float(rng.randrange(11)), 10 + rng.randrange(9), 2) for _ in range(80)]
    frame = spark.createDataFrame(rows, "gold double, low double, high double, confidence double, cheap_pred double, cheap_cost long, cheap_latency long, other_pred double, other_cost long, other_latency long").repartition(3)
    cuts = [0.35, 0.5, 0.6, 0.95]
    expected = {}
    for t in cuts:
        picked = [(g, *((p, lo, hi, c, s, False) if conf is not None and conf >= t else (q, lo, hi, d, u, True))) for g, lo, hi, conf, p, c, s, q, d, u in rows]
        n, nmae, qwk, cost, _, ups = worth(picked)
        expected[t] = (nmae, qwk, cost / n, ups, nmae + 0.01 * cost / n)
    got = {r.threshold: (r.nmae, r.qwk, r.mean_cost, r.upgrade_rate, r.objective) for r in policies.threshold_trials(frame, cuts, 0.01).collect()}
    assert got.keys() == expected.keys() and all(got[t] == pytest.approx(expected[t]) for t in cuts)
    best = policies.select_threshold(frame, cuts, 0.01).collect()
    assert [r.threshold for r in best] == [min(cuts, key=lambda t: (expected[t][4], expected[t][2], t))]
    tied = policies.select_threshold(frame.withColumn("confidence", frame.low), cuts, 0.01).first()
    assert tied.threshold == 0.35  # all thresholds are worth the same
    assert policies.select_threshold(frame.limit(0), cuts, 0.01).count() == 0


ARBITRATIONS = "item_id string, agents array<string>, gold double, low double, high double, pred double, cost double, latency double"
OUTPUTS = "item_id string, agent string, pred double, confidence double, cost double"


def test_contexts_equal_plain_python(spark):
    rng = random.Random(3)
    agents = ["cheap", "mid", "strong", "evidence"]
    said = {(f"i{i}", a): (float(rng.randrange(11)), rng.choice([0.0, 0.5, 0.9]), rng.randrange(1, 9) / 4) for i in range(40) for a in agents}
    contexts = [["cheap", "mid"], ["cheap", "strong"], ["mid", "strong"], ["cheap", "mid", "strong"], ["strong", "evidence"]]
    rows = [(f"i{i}", c, float(i % 11), 0.0, 10.0, float(rng.randrange(11)), 1.5, 2.0) for i in range(40) for c in contexts]
    rows.append(rows[0])  # an equal arbitration counts again
    told = pilot.context_report(spark.createDataFrame(rows, ARBITRATIONS), spark.createDataFrame([(*k, *v) for k, v in said.items()], OUTPUTS))
    got = {r.context: r for r in told.collect()}
    report = {}
    for c in contexts:
        mine = [r for r in rows if r[1] == c]
        err = lambda preds: [abs(p - r[2]) / 10 for p, r in zip(preds, mine, strict=True)]  # noqa: B023, E731
        mean = lambda x: sum(x) / len(x)
        heard = [[said[r[0], a] for a in c] for r in mine]
        top = err([said[r[0], max((a for a in c if a != "evidence"), key=agents.index)][0] for r in mine])
        own, plain = err([r[5] for r in mine]), err([mean([h[0] for h in x]) for x in heard])
        weighted = err([sum(h[0] * max(0.01, h[1]) for h in x) / sum(max(0.01, h[1]) for h in x) for x in heard])
        severe = lambda x: mean([e > 0.25 for e in x])
        report["+".join(c)] = ("evidence" if "evidence" in c else "pair" if len(c) == 2 else "scorer_full", mean(own), severe(own), mean([sum(h[2] for h in x) + 1.5 for x in heard]), mean(own) - mean(top), severe(own) - severe(top), mean(own) - mean(plain), mean(own) - mean(weighted))
    for name, (group, *numbers) in report.items():
        r = got[name]
        assert r.group == group and (r.nmae, r.severe_rate, r.cumulative_cost, r.against_strongest, r.severe_against_strongest, r.against_mean, r.against_weighted) == pytest.approx(tuple(numbers), abs=1e-12)
        peers = [p for q, p in report.items() if q != name and p[0] == group]
        beaten = any(all(x <= y for x, y in zip(p[1:4], numbers[:3], strict=True)) and p[1:4] != tuple(numbers[:3]) for p in peers)
        keep = not beaten and (numbers[3] < 0 or numbers[5] < 0 or numbers[6] < 0) and numbers[4] <= 0
        assert (r.beaten, r.recommendation) == (beaten, "retain_candidate" if keep else "review_or_reject")
    assert got["cheap+mid"].n == 41


def test_a_silent_or_missing_scorer_fails_the_job(spark):
    one = spark.createDataFrame([("i", ["cheap", "evidence"], 1.0, 0.0, 2.0, 1.0, 0.0, 0.0)], ARBITRATIONS)
    with pytest.raises(Exception, match="context members: missing"):
        pilot.heard(one, spark.createDataFrame([("i", "cheap", 1.0, 1.0, 0.0)], OUTPUTS)).collect()
    alone = one.selectExpr("item_id", "array('evidence') AS agents", "gold", "low", "high", "pred", "cost", "latency")
    with pytest.raises(Exception, match="no scorer in context"):
        pilot.heard(alone, spark.createDataFrame([("i", "evidence", 1.0, 1.0, 0.0)], OUTPUTS)).collect()


def test_a_dataset_of_the_protocol_without_rows_has_no_safe_boundary(spark):
    rows = spark.createDataFrame([("a", i / 1000, False) for i in range(100)], "dataset string, risk double, unsafe boolean")
    assert calibrate.stop_boundary(rows, 50, 0.05, ["a"]).first().status == "success"
    assert calibrate.stop_boundary(rows, 50, 0.05, ["a", "b"]).first().status == "no_safe_stop_boundary"
    with pytest.raises(Exception, match="illegal risk or dataset"):
        calibrate.stop_boundary(rows, 50, 0.05, ["b"]).collect()
    with pytest.raises(Exception, match="illegal risk or dataset"):
        calibrate.stop_boundary(rows.withColumn("risk", rows.risk + 1), 50, 0.05).collect()


def test_references_break_ties_by_elapsed_time_and_exchanges(spark):
    kind = "budget string, policy string, ready boolean, feasible boolean, worst_severe double, worst_unsafe double, nmae double, qwk double, cost long, elapsed long, calls long, exchanges long"
    rows = [("T", "a", True, True, 0.1, 0.1, 0.1, 0.5, 5, 9, 1, 0), ("T", "b", True, True, 0.1, 0.1, 0.1, 0.5, 5, 7, 2, 3), ("T", "c", True, True, 0.1, 0.1, 0.1, 0.5, 5, 7, 2, 1)]
    got = {r.budget: (r.policy, r.eligible) for r in select.reference_policies(spark.createDataFrame(rows, kind), ["T", "L"]).collect()}
    assert got == {"T": ("c", 3), "L": (None, 0)}


def test_errors_and_bins_follow_the_range_of_each_row(spark):
    rows = [(0.0, 4.0, 1.0, 2.0, "success"), (-10.0, 10.0, -10.0, 10.0, "success"), (0.0, 4.0, 1.0, 5.0, "success"), (3.0, 3.0, 3.0, 3.0, "success"), (0.0, 4.0, None, 1.0, "success"), (0.0, 3.0, 1.0, 1.2, "failed"), (0.0, 3.0, 1.0, 1.2, "success")]
    frame = spark.createDataFrame(rows, "low double, high double, gold double, pred double, status string").coalesce(1)
    got = [(r.legal, r.units, r.gb, r.pb) for r in quality.judged(frame, F.col("low"), F.col("high")).collect()]
    assert got == [(True, 1250, 3, 5), (True, 5000, 0, 10), (False, 5000, None, None), (False, 5000, None, None), (False, 5000, None, None), (False, 5000, None, None), (True, 333, 3, 4)]
    whole = spark.createDataFrame([(1000, 1600, "success"), (1000, 5001, "success")], "gold long, pred long, status string").coalesce(1)
    plain = quality.judged(whole).select("legal", "units", "gb", "pb").collect()
    ranged = quality.judged(whole, F.lit(0), F.lit(5000)).select("legal", "units", "gb", "pb").collect()
    assert [tuple(r) for r in plain] == [tuple(r) for r in ranged] == [(True, 600, 2, 3), (False, 5000, None, None)]
