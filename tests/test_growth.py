"""Queries whose cost or result once broke on larger tables: the same results, and plans that shuffle no more than they must."""

import pytest
from pyspark.sql import functions as F

from scoreloom.operators import calibrate, manifest, pilot


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def test_contexts_are_not_taken_apart_and_regrouped(spark):
    said = spark.createDataFrame([("i", a, p, c, 1) for a, p, c in (("cheap", 2, 50.0), ("mid", 4, None), ("evidence", None, 90.0))], "item_id string, agent string, pred long, confidence double, cost long")
    asked = spark.createDataFrame([("i", ["cheap", "mid"], 1), ("i", ["mid", "evidence"], 2), ("i", ["mid", "evidence"], 2)], "item_id string, agents array<string>, pred long")
    told = pilot.heard(asked, said)
    assert "agent#" not in "".join(line for line in plan_of(told).splitlines() if "Join" in line)  # joined by item alone
    got = {"+".join(r.agents): (r.copies, r.strongest_pred, r.mean_pred, round(r.weighted_pred, 6), r.own_cost) for r in told.collect()}
    assert got == {"cheap+mid": (1, 4, 3.0, round((2 * 50 + 4 * 0.01) / 50.01, 6), 2), "mid+evidence": (2, 4, 2.0, round(4 * 0.01 / 90.01, 6), 2)}
    assert pilot.heard(asked.distinct(), said, distinct=True).count() == 2
    with pytest.raises(Exception, match="context members: repeated"):
        pilot.heard(asked, said.union(said.where("agent = 'mid'"))).collect()


def test_slopes_of_sums_beyond_a_long(spark):
    rows = spark.range(1000).select((F.col("id") % 10 * 10_000_000).alias("f"), (F.col("id") % 10 * 20_000_000 + F.col("id") % 2).alias("y"))
    r = calibrate.slopes(rows, ["f"], "y").first()  # rows x sum of products is 5.7e21
    n, data = 1000, [(i % 10 * 10_000_000, i % 10 * 20_000_000 + i % 2) for i in range(1000)]
    sf, sy, sff, sfy = (sum(v) for v in zip(*((f, y, f * f, f * y) for f, y in data), strict=True))
    assert r.slope == (n * sfy - sf * sy) / (n * sff - sf * sf) and r.mean == sf / n and r.target_mean == sy / n


def test_components_of_any_size_are_verified(spark):
    import hashlib

    digest = lambda ids: hashlib.sha256("\x1f".join(["internal_component_v1.4", *sorted(ids)]).encode()).hexdigest()
    ids = [f"i{k}" for k in range(20_000)]
    good, other = digest(ids), digest(ids[:9])
    rows = [(i, f"ic_{good[:20]}", good) for i in ids] + [(f"b{i}", "ic_" + "0" * 20, good) for i in ids] + [(f"c{i}", "ic_other", good if k % 2 else other) for k, i in enumerate(ids)] + [(f"d{i}", "ic_-", digest([f"d{i}" for i in ids])) for i in ids]
    frame = spark.createDataFrame(rows, "item_id string, component_id string, stable_hash string").selectExpr("*", "'A' AS dataset", "item_id AS prompt_group", "'train_fit' AS internal_split", "20000L AS component_size")
    whole = sorted((r.name, r.fault) for r in manifest.split_manifest_faults(frame.repartition(5)).collect())
    assert whole == sorted([("ic_" + "0" * 20, "digest"), ("ic_" + "0" * 20, "name"), ("ic_other", "digest"), ("ic_other", "name"), ("ic_-", "name")])
    assert sorted((r.name, r.fault) for r in manifest.split_manifest_faults(frame.repartition(5), gathered=1000).collect()) == whole


SF = "/root/testdata/sf0.001"


def test_items_are_grouped_where_their_papers_lie(spark, monkeypatch):
    from scoreloom.plans import decision_queries, policy_queries, proxy, quality_queries

    again = lambda df: [line for line in plan_of(df).splitlines() if "hashpartitioning" in line and "item_id" in line]
    for name, part in (("agent_pivot", decision_queries), ("weighted_opinion", decision_queries), ("capability_profile", decision_queries), ("threshold_trials", policy_queries), ("select_threshold", policy_queries), ("bootstrap_deltas", quality_queries)):
        assert not again(part.QUERIES[name](spark, SF)), name
    whole = quality_queries.paper_suffstats(spark, SF)
    monkeypatch.setattr(proxy, "LINES", 100)  # many tasks
    parted = quality_queries.paper_suffstats(spark, SF)
    assert "REPARTITION_BY_NUM" in plan_of(parted) and parted.exceptAll(whole).isEmpty() and whole.exceptAll(parted).isEmpty()


def test_equal_rows_are_one_with_a_weight(spark):
    from scoreloom.operators import boosting

    rows = spark.range(3000).selectExpr("id % 7 AS a", "id % 5 AS b", "(id % 7) * (id % 5) + id % 3 AS y", "id % 9 = 0 AS held")
    few = rows.groupBy("a", "b", "y", "held").agg(F.count("*").alias("n"))
    one, other = (boosting.fit(r, ["a", "b"], "y", trees=3, held_out="held", weight=w) for r, w in ((rows, None), (few, "n")))
    assert one.losses == pytest.approx(other.losses) and [t.cut for t in one.trees] == [t.cut for t in other.trees]


def test_draws_in_pieces_are_the_draws(monkeypatch):
    import numpy as np

    from scoreloom.operators import bootstrap

    monkeypatch.setattr(bootstrap, "PIECE", 7)  # missing before: draws were made millions at a time
    keys = bootstrap.replicate_key(np.arange(3, 6))
    expected = np.zeros((3, 4), np.int64)
    for i, key in enumerate(keys):
        for pick in (int(x) % 50 // 16 for x in bootstrap.mix(key + np.arange(50, dtype=np.uint64))):
            expected[i, pick] += 1
    assert (bootstrap.block_counts(3, 6, 50, block=16) == expected).all()
    counts, inside = np.array([0, 3, 20]), np.zeros((3, 5), np.int64)
    for i, key in enumerate(bootstrap.block_key(np.arange(3, 6), 2)):
        for x in bootstrap.mix(key + np.arange(counts[i], dtype=np.uint64)):
            inside[i, int(x) % 5] += 1
    assert (bootstrap.block_weights(3, counts, 2, 5) == inside).all()


def test_strips_of_blocks_have_one_row_a_replicate(spark, monkeypatch):
    from scoreloom.operators import bootstrap

    sums = [(p, arm, "AN"[(p + k) % 2], k + 1, 5 * p, -p, 2**40 + p, 0, p % 3) for p in range(700) for k, arm in enumerate("ab")]
    frame = spark.createDataFrame(sums, "paper_id long, arm string, dataset string, n long, units long, severe long, stops long, unsafe long, st long")
    drawn = bootstrap.resampled(frame, 20, block=8)  # 88 blocks: strips of five on four cores
    assert "strip" in plan_of(drawn)  # before: a row for each replicate, arm and dataset of each block
    one = sorted(map(tuple, drawn.collect()))
    whole = {tuple(r)[:3]: tuple(r)[3:] for r in bootstrap.resampled(frame, 20, block=8, point=True).collect()}
    for arm, d in ((arm, d) for arm in "ab" for d in "AN"):  # the papers as they are come from the same pass
        assert whole.pop((-1, arm, d)) == tuple(map(sum, zip(*[r[3:] for r in sums if r[1:3] == (arm, d)], strict=True)))
    assert sorted(k + v for k, v in whole.items()) == one
    monkeypatch.setattr(bootstrap, "STRIP", 1)
    assert sorted(map(tuple, bootstrap.resampled(frame, 20, block=8, together=3).collect())) == one


def test_packed_columns_have_the_sums_of_their_own():
    import numpy as np

    from scoreloom.operators import bootstrap

    r = np.random.default_rng(5)
    side = np.stack([r.integers(0, top, 50) for top in (2, 3, 8, 5000, 2**44, 2**20, 1, 2, 9, 2**30)] + [r.integers(-9, 9, 50)], axis=1)
    weights = r.integers(0, 4, (30, 50))
    narrow, column, at, shift, mask = bootstrap.packed(side, int(weights.sum(1).max()))
    totals = np.zeros((30, side.shape[1]), np.int64)
    totals[:, column] = ((weights.astype(np.float64) @ narrow).astype(np.int64)[:, at] >> shift) & mask
    assert (totals == weights @ side).all() and narrow.shape[1] < side.shape[1] - 3 and narrow.sum(0).max() * 4 < 2**55
    assert bootstrap.packed(side[:, 6:7], 9)[0].shape == (50, 0)  # zeros


def test_gate_reads_its_records_once(spark):
    from scoreloom.plans import quality_queries

    assert plan_of(quality_queries.bootstrap_gate(spark, "/root/testdata/sf0.001")).count("FileScan parquet") <= 6  # before 16: each arm for the sums, their total and twice for ids
