"""JSON in one pass against Python's own reader, banned keys at any depth, digest trees and the rules of manifests."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from scoreloom.functions.json_walk import HIDDEN_KEYS, json_walk, read, walk
from scoreloom.operators import manifest
from scoreloom.session import reliable_checkpoints


def some_value(rng, depth):
    if depth and rng.random() < 0.6:
        if rng.random() < 0.5:
            return [some_value(rng, depth - 1) for _ in range(rng.randrange(4))]
        return {rng.choice(["a", "B", "é", "gold_score", "Score1", "", "x.y", '"q"']): some_value(rng, depth - 1) for _ in range(rng.randrange(4))}
    return rng.choice([None, True, False, 0, -7, 10**30, 1.5, -2e-9, 1e300, "", "gold_score", 'a"b\\\n 😀', "x"])


def strip(value, banned):
    if isinstance(value, dict):
        return {k: strip(v, banned) for k, v in value.items() if k.lower() not in banned}
    return [strip(v, banned) for v in value] if isinstance(value, list) else value


def paths(value, banned, at="$"):
    found = []
    for k, v in value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ():
        here = f"{at}.{k}" if isinstance(value, dict) else f"{at}[{k}]"
        found += [here] * (isinstance(value, dict) and k.lower() in banned) + paths(v, banned, here)
    return found


def plain(value):
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def test_walk_equals_python():
    rng = random.Random(1)
    banned = frozenset(HIDDEN_KEYS)
    for _ in range(1500):
        value = some_value(rng, 5)
        text = json.dumps(value, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        assert walk(text, banned) == (plain(value), plain(strip(value, banned)), paths(value, banned))


def test_walk_of_odd_texts():
    assert walk('{"a":1,"b":{"score1":2},"a":{"score2":3}}', frozenset(["score1", "score2"])) == ('{"a":{"score2":3},"b":{"score1":2}}', '{"a":{},"b":{}}', ["$.a.score2", "$.b.score1"])
    bad = ["", " ", "{", "]", "[1,]", "[,1]", '{"a"}', '{"a":}', '{"a":1,}', '{a:1}', "[1 2]", "1 2", "01", "1.", "+1", "NaN", "Infinity", "-", '"\n"', '"\\x"', "tru", "nulls", "[1]]", '{"a":1 "b":2}', "1e999", "'a'", "[}"]
    for text in bad:
        assert walk(text) is None
        with pytest.raises(ValueError):
            value = json.loads(text, parse_constant=lambda _: (_ for _ in ()).throw(ValueError()))
            if value == float("inf"):
                raise ValueError
    deep = "[" * 50_000 + '{"score1":[]}' + "]" * 50_000
    whole, kept, found = walk(deep, frozenset(["score1"]))
    assert whole == deep and kept == "[" * 50_000 + "{}" + "]" * 50_000 and found == ["$" + "[0]" * 50_000 + ".score1"]


def test_reading_equals_the_walk():
    rng = random.Random(2)
    banned = frozenset(HIDDEN_KEYS)
    odd = ["-0", "-0.0", "[1e5,1E400]", '{"a":1e999,"a":1}', "9" * 5000, '{"GOLD_SCORE":[{"score1":1}]}', '{"a":1,"b":{"score1":2},"a":{"score2":3}}', '"\\u0041"', "\ufeff1", "[" * 5000 + '{"score1":[]}' + "]" * 5000, "", "-Infinity", " [1] \n", "\xa01"]
    for text in odd + [json.dumps(some_value(rng, 5), ensure_ascii=k % 2 == 0, indent=k % 3 or None) for k in range(600)]:
        whole = walk(text, banned)
        assert read(text, banned) == whole and read(text) == walk(text)
        for i, part in enumerate(("canonical", "stripped", "paths")):
            assert read(text, banned, (part,)) == (whole and tuple(x if k == i else None for k, x in enumerate(whole)))


def test_usual_records_are_not_walked_token_by_token(monkeypatch):
    from scoreloom.functions import json_walk as module

    monkeypatch.setattr(module, "walk", None)  # before, every text went through it: about 1 ms a record
    assert module.read('{"b":[{"Score1":1.50,"é":null}],"a":-7}', frozenset(["score1"])) == ('{"a":-7,"b":[{"Score1":1.5,"é":null}]}', '{"a":-7,"b":[{"é":null}]}', ["$.b[0].Score1"])


def test_json_walk_column(spark):
    rows = spark.createDataFrame([(1, '{"B":[{"SCORE1":1,"t":"\\"score1\\": 2"}]}'), (2, None), (3, "{"), (4, "7")], "k int, j string")
    got = {r.k: r.w for r in rows.select("k", json_walk(F.col("j"), ["score1"]).alias("w")).collect()}
    assert (got[1].valid, got[1].stripped, got[1].paths) == (True, '{"B":[{"t":"\\"score1\\": 2"}]}', ["$.B[0].SCORE1"])
    assert [(got[k].valid, got[k].canonical, got[k].paths) for k in (2, 3, 4)] == [(False, None, None), (False, None, None), (True, "7", [])]
    assert rows.limit(0).select(json_walk(F.col("j"))["canonical"].alias("c")).count() == 0


def customers(spark, rows):
    return spark.createDataFrame(rows, "id long, name string, nation int")


def test_digest_tree_combines_and_finds_what_was_tampered_with(spark):
    reliable_checkpoints(spark)
    rows = [(i, f'n"{i}é', i % 5 if i % 7 else None) for i in range(300)]
    was = customers(spark, rows)
    tree = manifest.digest_tree(was, ["id"], 6)
    assert {r.digits: (r.n, r.rows) for r in tree.groupBy("digits").agg(F.count("*").alias("n"), F.sum("rows").alias("rows")).collect()}[0] == (1, 300)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    leaves = sorted((sha(plain({"id": i})), sha(plain({"name": n, "nation": x}))) for i, n, x in rows)
    level = {}
    for key, digest in leaves:
        level.setdefault(key[:6], []).append(f"{key}:{digest}")
    level = {k: sha("\n".join(v)) for k, v in level.items()}
    for digits in (3, 0):
        up = {}
        for k in sorted(level):
            up.setdefault(k[:digits], []).append(f"{k}:{level[k]}")
        level = {k: sha("\n".join(v)) for k, v in up.items()}
    assert [r.digest for r in tree.where("digits = 0").collect()] == [level[""]]
    shuffled = rows[::-1]
    assert manifest.digest_tree(customers(spark, shuffled).repartition(7), ["id"], 6).where("digits = 0").first().digest == level[""]

    now = [r for r in rows if r[0] != 3] + [(5, 'n"5é', 0), (1000, "new", 1)]
    now[10] = (now[10][0], "other", now[10][2])
    found = manifest.tampered(customers(spark, now), manifest.row_digests(was, ["id"]), ["id"], tree, 6)
    assert sorted((r.key, r.fault) for r in found.collect()) == sorted((sha(plain({"id": i})), f) for i, f in ((3, "missing"), (5, "repeated"), (1000, "added"), (now[10][0], "changed")))
    assert manifest.tampered(was, manifest.row_digests(was, ["id"]), ["id"], tree, 6).count() == 0


def test_digits_of_buckets():
    assert [manifest.bucket_digits(n) for n in (0, 2048, 2049, 8_000_000, 9_000_000, 10**10, 10**12)] == [0, 0, 3, 3, 6, 6, 9]


def test_split_manifest_faults(spark):
    def component(ids, size=None, digest=None, name=None):
        d = digest or hashlib.sha256("\x1f".join(["internal_component_v1.4", *sorted(ids)]).encode()).hexdigest()
        return [(i, "A", f"g{i}", name or f"ic_{d[:20]}", "train_fit", d, size or len(ids)) for i in ids]

    rows = component(["b", "a"]) + component(["c"], size=2) + component(["d", "e"], digest="0" * 64) + component(["f"], name="ic_x") + component(["g", "h"])
    rows[-1] = (*rows[-1][:4], "train_calibration", *rows[-1][5:])
    rows.append(("z", "A", "ga", *component(["z"])[0][3:]))
    rows[-1] = (*rows[-1][:4], "train_calibration", *rows[-1][5:])
    frame = spark.createDataFrame(rows, "item_id string, dataset string, prompt_group string, component_id string, internal_split string, stable_hash string, component_size long")
    names = {i: component(ids)[0][3] for i, ids in (("c", ["c"]), ("g", ["g", "h"]))}
    found = sorted((r.kind, r.name, r.fault) for r in manifest.split_manifest_faults(frame).collect())
    assert found == sorted([("component", names["c"], "size"), ("component", "ic_" + "0" * 20, "digest"), ("component", "ic_" + "0" * 20, "name"), ("component", "ic_x", "name"), ("component", names["g"], "leak"), ("prompt", "A|ga", "leak")])
    assert {r.fault for r in manifest.split_manifest_faults(frame, most=1).where(f"name = '{names['g']}'").collect()} == {"unverified", "leak"}
    assert ("item", "a", "repeated") in {tuple(r) for r in manifest.split_manifest_faults(frame.union(frame.where("item_id = 'a'"))).collect()}


def test_rules_of_packages(spark):
    h = "a" * 64
    base = {"package_id": "p", "checkpoint_id": "c", "checkpoint_hash": h, "calibration_split": "train_calibration", "calibration_no_gradient": True, "calibration_no_replay": True, "calibration_no_checkpoint_ranking": True,
            "coverage": 0.5, "calibration_status": "success", "stop_boundary": 0.2, "boundary_frozen": True, "calibration_failure_reason": "", **{c: h for c in manifest.PROTOCOL_HASHES}}
    changes = [({}, []), ({"checkpoint_hash": "A" * 64}, []), ({"checkpoint_hash": "xyz"}, ["sha256:checkpoint_hash"]), ({"coverage": 1.5}, ["coverage"]), ({"coverage": None}, []), ({"calibration_no_replay": None}, ["no_replay"]),
               ({"calibration_status": "failure"}, ["boundary", "frozen", "reason"]), ({"calibration_status": "failure", "stop_boundary": None, "boundary_frozen": False, "calibration_failure_reason": "none safe"}, []),
               ({"stop_boundary": float("nan")}, ["boundary"]), ({"calibration_status": "odd"}, ["status", "boundary", "frozen", "reason"]), ({"quality_protocol_hash": "b" * 64}, ["protocol"])]
    kinds = ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'double' if isinstance(v, float) else 'string'}" for k, v in base.items())
    frame = spark.createDataFrame([tuple((base | c).values()) for c, _ in changes], kinds).coalesce(1)
    got = [r.f for r in frame.select(manifest.failing(manifest.calibration_package_rules(h)).alias("f")).collect()]
    assert got == [f for _, f in changes]
