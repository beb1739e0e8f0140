"""Exact values of score expressions, aggregates and gates."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.functions import score, text
from scoreloom.operators import assemble, audit, bootstrap, calibrate, components, fitting, quality, select
from scoreloom.plans.proxy import judged


def column(spark, kind, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, x {kind}")
    return [r.y for r in rows.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_fixed_bins(spark):
    got = column(spark, "double", [0.049, 0.05, 0.95, 1.0, 0.0, float("nan"), float("inf"), 1.2, None], lambda x: score.fixed_bin(x, F.lit(0.0), F.lit(1.0)))
    assert got == [0, 1, 10, 10, 0, None, None, None, None]


def test_bankers_bins_differ(spark):
    assert column(spark, "double", [0.25, 0.35, 0.45], score.bankers_bin) == [2, 4, 4]


def test_severe_and_extreme_boundaries(spark):
    assert column(spark, "double", [0.25, 0.2501, 0.5], score.is_severe) == [False, True, True]
    assert column(spark, "double", [0.4999, 0.5], score.is_extreme) == [False, True]


def test_wilson(spark):
    got = column(spark, "int", [0, 10], lambda k: score.wilson_upper(k, F.lit(100)))
    assert got[0] == pytest.approx(0.02634, abs=1e-5) and got[1] > 0.05
    assert column(spark, "int", [0], lambda k: score.wilson_upper(k, F.lit(0))) == [1.0]


def test_limit_is_feasible_and_exhausted(spark):
    assert column(spark, "double", [1.0], lambda x: score.within([x], [F.lit(1.0)]) & score.exhausted([x], [F.lit(1.0)])) == [True]


def test_legality(spark):
    rows = spark.createDataFrame([("success", 2.0), ("deferred", 2.0), ("success", None), ("success", float("nan")), ("success", 5.0)], "s string, p double")
    assert [r[0] for r in rows.select(score.is_legal(F.col("s"), F.col("p"), F.lit(0.0), F.lit(4.0))).collect()] == [True, False, False, False, False]


def test_api_cost_long_context(spark):
    rates = {k: F.lit(v) for k, v in (("input", 2.0), ("cached", 1.0), ("write", 3.0), ("output", 4.0))}
    got = column(spark, "long", [272_000, 272_001], lambda n: score.api_cost(n, F.lit(0), F.lit(0), F.lit(10), rates))
    assert got == [pytest.approx((544_000 + 40) / 1e6), pytest.approx((2 * 544_002 + 60) / 1e6)]


def test_text(spark):
    assert column(spark, "string", ["  A  b ", ""], text.normalize_text) == ["a b", ""]
    assert column(spark, "string", ["x"], lambda x: text.mix_label(F.array(F.lit("b"), F.lit("a"), F.lit("b")))) == ["a:1;b:2"]


def test_quality_empty_dataset_and_null_rules(spark):
    rows = spark.createDataFrame([(1, "i1", "A", 100, 200, "success", False), (1, "i2", "A", 100, 9999, "success", False)], "paper_id long, item_id string, dataset string, gold long, pred long, status string, stop boolean")
    got = {r.dataset: r for r in quality.quality_by_dataset(judged(rows), spark.createDataFrame([("A",), ("N",)], "dataset string")).collect()}
    assert got["A"].nmae == pytest.approx((100 + 5000) / 10000) and got["A"].unsafe_stop_rate is None and got["A"].stop_coverage == 0.0
    assert got["N"].n == 0 and got["N"].nmae is None and got["N"].stop_coverage == 0.0


def test_kappa_by_moments_is_kappa_by_confusion(spark):
    t, p = [0, 1, 2, 10, 5, 5], [0, 2, 2, 9, 5, 1]
    n = len(t)
    observed = sum((a - b) ** 2 for a, b in zip(t, p)) * n
    expected = sum((a - b) ** 2 for a in t for b in p)
    sums = [n, sum(t), sum(p), sum(a * a for a in t), sum(a * a for a in p), sum(a * b for a, b in zip(t, p))]
    got = spark.range(1).select(quality.kappa(*[F.lit(s) for s in sums])).first()[0]
    assert got == pytest.approx(1 - observed / expected)


def test_budget_tiers_nearest_rank(spark):
    rows = spark.createDataFrame([(c, 10 * c) for c in (1, 2, 3, 4)], "cost long, elapsed long")
    got = {r.budget: (r.cost, r.elapsed) for r in calibrate.budget_tiers(rows, ["cost", "elapsed"], {"Tight": 0.25, "Medium": 0.5, "Loose": 0.75}).collect()}
    assert got == {"Tight": (1, 10), "Medium": (2, 20), "Loose": (3, 30)}


def test_stop_boundary(spark):
    rows = [(d, i / 1000, False) for d in "ab" for i in range(100)]
    ok = calibrate.stop_boundary(spark.createDataFrame(rows, "dataset string, risk double, unsafe boolean"), 100, 0.05).first()
    assert ok.status == "success" and ok.stops == 200 and ok.boundary == 0.099
    bad = calibrate.stop_boundary(spark.createDataFrame([(d, r, i % 10 == 0) for i, (d, r, _) in enumerate(rows)], "dataset string, risk double, unsafe boolean"), 100, 0.05).first()
    assert bad.status == "no_safe_stop_boundary" and bad.boundary is None


def test_stop_risk_separates(spark):
    rows = spark.createDataFrame([(float(i), float(i % 3), int(i >= 50)) for i in range(60)], "a double, b double, y int")
    m = fitting.fit_stop_risk(rows, ["a", "b"], "y", epochs=5)
    assert m["weights"][0] > abs(m["weights"][1])


def test_component_transitivity_and_order_independence(spark):
    rows = [("a0", "p", "x"), ("a1", "p", "y"), ("a2", "q", "y"), ("a3", "", "z"), ("a4", None, None)]
    for r in (rows, rows[::-1]):
        labels = components.leakage_components(spark.createDataFrame(r, "item_id string, g string, k string"), [["g"], ["k"]])
        assert {x.item_id: x.component for x in labels.collect()} == {"a0": "a0", "a1": "a0", "a2": "a0", "a3": "a3", "a4": "a4"}


def test_paired_faults_raise(spark):
    a = spark.createDataFrame([("i", 1), ("j", 2)], "item_id string, gold long")
    b = spark.createDataFrame([("i", 1), ("j", 3), ("k", 1)], "item_id string, gold long")
    faults = bootstrap.unpaired(a, b, ["item_id"], ["gold"])
    assert {(r.item_id, r.fault) for r in faults.collect()} == {("j", "changed"), ("k", "missing")}
    with pytest.raises(ValueError):
        audit.raise_if_any(faults, "pairing")


def test_identical_arms_pass(spark):
    rows = [(p, f"{p}-{d}", d, 100 + 500 * p, 100 + 510 * p, "success", True) for p in range(6) for d in "ANR"]
    arm = judged(spark.createDataFrame(rows, "paper_id long, item_id string, dataset string, gold long, pred long, status string, stop boolean"))
    assert {r.status for r in bootstrap.gate(arm, arm, 20, ["A", "N", "R"], least=1, bins=1).collect()} == {"pass"}
    assert {(r.status, r.undefined) for r in bootstrap.gate(arm, arm, 20, ["A", "N", "R"]).collect()} == {("inconclusive", 20)}


def draws_by_hand(replicate, size, block=1024, seed=20260729):
    """The picks of a replicate in plain integers: a block for each draw, then papers inside each block."""
    whole = 1 << 64

    def mix(x):
        x = (x + 0x9E3779B97F4A7C15) % whole
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % whole
        x = (x ^ x >> 27) * 0x94D049BB133111EB % whole
        return x ^ x >> 31

    key = mix(mix(replicate + seed))
    blocks = Counter(mix((key + i) % whole) % size // block for i in range(size))
    inner = {b: mix((key + mix(b) + 1) % whole) for b in blocks}
    return [b * block + mix((inner[b] + j) % whole) % min(block, size - b * block) for b, c in blocks.items() for j in range(c)]


def test_gate_over_all_papers_equals_brute_force(spark, tmp_path):
    from scoreloom.plans import quality_queries

    papers = [3 * p + 1 for p in range(40)]
    lines = [(p, k, p, k, "ANR"[(p + k) % 3], 1.0 + (p * 7 + k) % 50, 0.01 * ((p + k) % 11), 0.02, 100.0, "F" if k < 3 else "O") for p in papers for k in range(4)]
    names = "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_returnflag string, l_quantity double, l_discount double, l_tax double, l_extendedprice double, l_linestatus string"
    spark.createDataFrame(lines, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(p, "F") for p in papers], "o_orderkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")

    def scored(pos, factor):
        for _, k, _, _, dataset, quantity, discount, *_ in lines[4 * pos : 4 * pos + 4]:
            gold, d = round(quantity * 100), round(discount * 100)
            pred = gold + (d - 5) * factor
            legal = 0 <= pred <= 5000
            units = abs(pred - gold) if legal else 5000
            yield dataset, units, units * 4 > 5000, k < 3, ((20 * gold + 5000) // 10000, (20 * pred + 5000) // 10000) if legal else None

    def kappa(pairs):
        n = len(pairs)
        observed = sum((g - p) ** 2 for g, p in pairs) / n
        expected = sum((g - q) ** 2 for g, _ in pairs for _, q in pairs) / n / n
        return 1 - observed / expected if expected else None

    def change(picks):
        rates = []
        for factor in (200, 400):
            seen = {}
            for pos in picks:
                for row in scored(pos, factor):
                    seen.setdefault(row[0], []).append(row)
            rates.append({d: (sum(r[2] for r in s) / len(s), sum(r[2] and r[3] for r in s) / sum(r[3] for r in s), sum(r[1] for r in s) / len(s) / 5000, kappa([r[4] for r in s if r[4]])) for d, s in seen.items()})
        a, b = rates
        assert len(a) == len(b) == 3
        return [max(a[d][0] - b[d][0] for d in a), max(a[d][1] - b[d][1] for d in a), sum(x[2] for x in a.values()) / 3 - sum(x[2] for x in b.values()) / 3, sum(x[3] for x in a.values()) / 3 - sum(x[3] for x in b.values()) / 3]

    size = len(papers)
    papers.sort(key=lambda p: hashlib.sha256(str(p).encode()).digest())
    lines.sort(key=lambda r: (papers.index(r[0]), r[1]))
    drawn = [change(draws_by_hand(r, size)) for r in range(300)]
    point = change(range(size))
    e9 = lambda x: pytest.approx(x * 1e9, abs=1.5)
    got = {r.metric: r for r in bootstrap.gate(*quality_queries._arms(spark, str(tmp_path)), 300, ["A", "N", "R"], least=1).collect()}
    for i, m in enumerate(bootstrap.METRICS):
        samples = sorted(x[i] for x in drawn)
        assert got[m].point_e9 == e9(point[i]) and got[m].bound_e9 == e9(samples[14] if m == "qwk" else samples[284]) and got[m].undefined == 0
    passed = all(r.passed for r in got.values())
    assert {r.status for r in got.values()} == ({"pass"} if passed else {"inferior"} if max(min(x[i] for x in drawn) for i in range(3)) > 0 or max(x[3] for x in drawn) < 0 else {"inconclusive"})
    whole = {r.metric: r for r in quality_queries.bootstrap_gate(spark, str(tmp_path)).collect()}  # too few legal predictions
    assert {(r.status, r.bound_e9, r.point_e9, r.undefined) for r in whole.values()} == {("inconclusive", None, None, 5000)}
    assert sum(r.n for r in quality_queries.paired_delta(spark, str(tmp_path)).collect()) == len(lines)


def test_papers_are_numbered_by_digest_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "BUCKET", 3)
    for kind, ids in (("long", {(i * i) % 997 - 50 for i in range(60)}), ("string", {f"paper {i}é" for i in range(60)})):
        order = sorted(ids, key=lambda i: hashlib.sha256(str(i).encode()).hexdigest())
        numbered, size = bootstrap.positions(spark.createDataFrame([(i,) for i in order * 2], f"paper_id {kind}"))
        assert size == len(ids) and sorted((r.pos, r.paper_id) for r in numbered.collect()) == list(enumerate(order))


def test_replicates_equal_draws_by_hand_whatever_is_drawn_together(spark, monkeypatch):
    sums = [(f"p{p}", arm, "AN"[p % 2], p + 1, 5 * p, p % 4, 3, 1) for p in range(90) for arm in "ab"]
    frame = spark.createDataFrame(sums, "paper_id string, arm string, dataset string, n long, units long, severe long, stops long, unsafe long")
    whole = sorted(map(tuple, bootstrap.resampled(frame, 50, block=16).collect()))  # six blocks, the last of ten papers
    order = sorted({r[0] for r in sums}, key=lambda i: hashlib.sha256(i.encode()).hexdigest())
    by_hand = Counter()
    for r in range(50):
        for pos in draws_by_hand(r, 90, 16):
            for row in sums:
                if row[0] == order[pos]:
                    for k, v in enumerate(row[3:]):
                        by_hand[r, row[1], row[2], k] += v
    assert whole == sorted((r, arm, d, *(by_hand[r, arm, d, k] for k in range(5))) for r, arm, d in {x[:3] for x in by_hand})
    monkeypatch.setattr(bootstrap, "PACK", 40)
    assert sorted(map(tuple, bootstrap.resampled(frame, 50, block=16, together=7).collect())) == whole


@pytest.mark.parametrize("size", [300, 2000, 15_000])
def test_draws_are_independent(size):
    replicates = 3000
    counts = bootstrap.block_counts(0, replicates, size)
    assert (counts.sum(1) == size).all()
    weights = np.hstack([bootstrap.block_weights(0, counts[:, b], b, min(bootstrap.BLOCK, size - b * bootstrap.BLOCK)).astype(np.int16) for b in range(counts.shape[1])])
    assert weights.shape == (replicates, size) and (weights.sum(1) == size).all()
    values = np.random.default_rng(size).normal(0, 1, size)
    means = weights @ values / size
    assert abs(means.std() / (values.std() / size**0.5) - 1) < 0.05  # 3,000 replicates: one sd of this estimate is 1.3 %
    trend = np.arange(size, dtype=float)  # of neighbours too
    assert abs((weights @ trend / size).std() / (trend.std() / size**0.5) - 1) < 0.05
    assert abs((weights > 0).mean() - (1 - (1 - 1 / size) ** size)) < 0.005 and weights.max() > 4
    assert abs(np.corrcoef(weights[:-1, :200].ravel(), weights[1:, :200].ravel())[0, 1]) < 0.01


def test_conservative_bounds(spark):
    rows = spark.range(1, 5001)
    up = rows.agg(bootstrap.conservative_bound(F.col("id"), 5000)).first()[0]
    low = rows.agg(bootstrap.conservative_bound(F.col("id"), 5000, upper=False)).first()[0]
    assert (low, up) == (250, 4750)


def test_champion_may_not_see_resources(spark):
    with pytest.raises(ValueError):
        select.champion(spark.createDataFrame([("p", 1.0)], "package string, cost double"), spark.createDataFrame([("p",)], "package string"))


def test_cheaper_package_without_the_gate_is_not_selected(spark):
    e = spark.createDataFrame([(p, b, s, 0, n, 0, c, c, c, 0, True) for p, s, n, c in (("pkg_a", 30, 30, 1), ("pkg_b", 10, 10, 5)) for b in "TML"], "package string, budget string, worst_severe long, worst_unsafe long, nmae long, qwk long, cost long, elapsed long, calls long, exchanges long, feasible boolean")
    gates = e.select("package", "budget", F.lit("pass").alias("gate"))
    protection = spark.createDataFrame([("pkg_a", "pkg_b", b, "inconclusive") for b in "TML"], "package string, comparator string, budget string, gate string")
    got = {r.package: r for r in select.select_package(e, gates, protection, ["T", "M", "L"]).collect()}
    assert got["pkg_b"].champion and got["pkg_b"].selected and not got["pkg_a"].selected and not got["pkg_a"].protected


def test_quota_plan_prefers_papers():
    assert assemble.best_quota_counts({"a": 7, "b": 5, "c": 2}, [{"a": 2, "b": 2, "c": 1}, {"a": 3, "b": 1, "c": 1}]) in [(1, 1), (2, 0)]
    assert assemble.best_quota_counts({"a": 4, "b": 1}, [{"a": 1, "b": 1}, {"a": 2}]) == (0, 2)
