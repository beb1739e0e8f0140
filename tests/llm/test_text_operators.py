"""BPE, near duplicates, decontamination, repeats and quality against brute force, with the defined odd cases."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scoreloom.llm import bpe, decontam, minhash, quality, suffix_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, extra=None):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] if extra is None else extra
    return spark.createDataFrame(rows, DOCS)


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def some_words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# ---- BPE


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(bpe.default_path())


def test_bpe_equals_library(library):
    rng = random.Random(3)
    letters = "abeht n's'l  \n\t\x1c\x85\xa0é日😀123.,!-_​"
    texts = ["", None, "a" * 3000, "the" * 900, " " * 500, "<|endoftext|>", "x<|endoftext|>\n<|endoftext|>y", "antidisestablishmentarianism thontionererr"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 200))) for _ in range(400)]
    got = bpe._encode(pa.array(texts, pa.string()), bpe.default_path(), 50).to_pylist()
    assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_bpe_pair_checks_agree_with_merging():
    vocabulary, _ = bpe._worker_state(bpe.default_path())
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, vocabulary.size, 2000), rng.integers(0, vocabulary.size, 2000)
    ok = vocabulary.compatible(a, b)
    text = lambda t: vocabulary.pool[slice(*vocabulary.bytes_at[[vocabulary.id_of_rank[t], vocabulary.id_of_rank[t] + 1]])].tobytes()
    merged = vocabulary.merge([text(x) + text(y) for x, y in zip(a, b, strict=True)])
    assert [m == vocabulary.id_of_rank[[x, y]].tobytes() for m, x, y in zip(merged, a, b, strict=True)] == ok.tolist()


def test_bpe_query_columns_and_decode(spark):
    df = documents(spark, ["hello world", None, "", "hello world"]).withColumn("tokens_", F.lit(1))
    rows = {r.doc_id: r for r in bpe.token_digests(df, bpe.default_path()).collect()}
    assert rows[1].n_tokens == 0 and rows[1].ids_sha256 == hashlib.sha256(b"").hexdigest() == rows[2].decoded_sha256
    assert rows[0][1:] == rows[3][1:] and rows[0].decoded_sha256 == hashlib.sha256(b"hello world").hexdigest()
    assert bpe.round_trip(df.limit(0), bpe.default_path()).count() == 0
    with pytest.raises(ValueError):
        bpe._decode(pa.array([[10**6]], pa.list_(pa.int32())), bpe.default_path())
    assert bpe._decode(pa.array([[], None], pa.list_(pa.int32())), bpe.default_path()).to_pylist() == ["", ""]


# ---- near duplicates


def brute_components(rows, size, num, den):
    sets, up = {}, {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
        up[i] = i

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both) and root(a) != root(b):
                    x, y = root(a), root(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_texts():
    rng = random.Random(5)
    texts = [None, "", "one", "one", "One two", " \t\n ", "x " * 400]
    for _ in range(4):
        base = some_words(rng, 80).split()
        for edits in [0, 0, 1, 1, 2, 2, 3, 4, 5, 6, 8, 3, 3, 4]:
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize(("size", "num"), [(3, 85), (5, 80)])
def test_components_equal_brute_force(spark, size, num):
    texts = near_texts()
    found = minhash.near_duplicates(documents(spark, texts), size=size, num=num)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute_components(list(enumerate(texts)), size, num, 100)
    shuffled = minhash.near_duplicates(documents(spark, texts), size=size, num=num, broadcast_ids=0)
    assert sorted(shuffled.collect()) == sorted(found.collect())


@pytest.mark.parametrize("bound", [0, 10_000])
def test_hidden_links_are_exact(spark, bound):
    """Before, candidates came back, and each of them shipped its full set."""
    rng = random.Random(9)
    sets = {1: set(range(100)), 200: set(range(100, 130))}
    for k in range(2, 60):
        sets[k] = {x for x in sets[1] if x % 7 != k % 3 or rng.random() < 0.4} | {1000 + 50 * (k % 4) + x for x in range(rng.randrange(30))}
    num, den, members = 80, 100, [k for k in sets if k != 1]
    alike = lambda x, y: den * len(sets[x] & sets[y]) >= num * len(sets[x] | sets[y])
    links = [(1, b) for b in members if alike(1, b)]
    top = {b: 1 if (1, b) in links else b for b in members}
    expected = {(x, y) for x in members for y in members if x < y and top[x] != top[y] and alike(x, y)}
    pairs = spark.createDataFrame(links, "a long, b long").checkpoint()
    star = spark.createDataFrame([(1, len(sets[1]), b, len(sets[b])) for b in members], "a long, an long, b long, n long").checkpoint()
    labels = spark.createDataFrame([(1, 1), *[(b, 1) for _, b in links]], "node long, component long")
    whole = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "node long, shingles array<long>")
    found = minhash.hidden_links(star, pairs, labels, whole, num, den, bound).collect()
    assert len(found) == len(set(found)) and {tuple(r) for r in found} == expected
    assert 0 < len(links) < len(members) and len(expected) > 20 and any(not alike(x, y) for x in members for y in members if x < y)


def test_near_duplicates_odd_rows(spark):
    rows = [(None, "a b c d e f", "en", "s", 1), (7, "a b c d e f", "en", "s", 1), (7, "a b c d e f", "en", "s", 1), (3, "a b c d e f", None, None, None)]
    df = documents(spark, [], rows)
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in minhash.near_duplicates(df).collect())
    assert got == [(-1, -1), (3, 3), (7, 3), (7, 3)]
    kept = minhash.keep_one_of_each(df)
    assert kept.columns == df.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 3]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_signatures_have_no_empty_bins():
    one = minhash.one_permutation([np.array([5], np.uint64)], 64)
    assert (one == 5).all()


# ---- decontamination


def brute_contamination(docs, items, window=13):
    windows = {}
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    for i, t in items:
        w = find(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i) if i is not None else "")
    out = {}
    for i, t in docs:
        w, hit, ids = find(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    ids |= windows[tuple(w[k : k + n])]
        out[i] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_contamination_equals_brute_force(spark):
    rng = random.Random(8)
    items = [(1, some_words(rng, 40)), (2, some_words(rng, 13)), (3, some_words(rng, 5)), (4, "solo"), (5, None), (6, "!!"), (7, "the " * 20), (None, some_words(rng, 20)), (1, some_words(rng, 15))]
    words = lambda i: items[i][1].split()
    docs = [None, "", "solo", some_words(rng, 300), " ".join(["A"] * 5 + words(0)[10:23] + ["B"] * 200), " ".join(words(0)[10:22] + ["q"] + words(0)[22:]), "THE " * 60, items[2][1] + ", tail", "x" + " ".join(words(7)), " ".join(words(0)) + " " + " ".join(words(8))]
    docs += [" ".join(some_words(rng, 30).split() + words(rng.randrange(2))[: rng.randrange(10, 40)]) for _ in range(30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination_report(documents(spark, docs), bench)
    expected = brute_contamination(list(enumerate(docs)), items)
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == expected
    shuffled = decontam.contamination_report(documents(spark, docs), bench, broadcast_prints=0, broadcast_places=0)
    assert {r.doc_id: tuple(r)[1:] for r in shuffled.collect()} == expected
    kept = decontam.remove_contaminated(documents(spark, docs), bench)
    assert {r.doc_id for r in kept.collect()} == {i for i, e in expected.items() if not e[4]}
    assert decontam.contamination_report(documents(spark, docs), bench.limit(0)).where("n_hit > 0").count() == 0


def test_contamination_reads_each_text_once(spark, tmp_path):
    """The filter once called the function again, which took a second worker, kept for later stages, beside each task's first."""
    item = " ".join(f"b{k}" for k in range(20))
    documents(spark, [f"a {item} c", "none of it"]).write.parquet(f"{tmp_path}/documents.parquet")
    texts = spark.read.parquet(f"{tmp_path}/documents.parquet").select(F.col("text").alias("t"))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = decontam.contaminated_texts(texts, bench, item_id_col="item_id", item_text_col="text", window=13, k=7, broadcast_prints=1000)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython [<lambda>") == 1
    assert [(r.spans[0].start, r.spans[0].end, r["items"]) for r in found.collect()] == [(1, 21, ["1"])]


# ---- repeats


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        cover = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                cover[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], cover.astype(np.int8)])) == 1).sum()) if len(b) else 0
        out.append((len(b), int(cover.sum()), spans, np.frombuffer(b, np.uint8)[~cover].tobytes()))
    return out


def repeat_texts():
    rng = random.Random(2)
    shared = some_words(rng, 120)
    texts = [None, "", "short", "a" * 900, "ab" * 300, shared, shared, shared[:199], shared[:200], some_words(rng, 300)]
    texts += [some_words(rng, rng.randrange(5, 60)) + shared[k : k + rng.randrange(150, 420)] + some_words(rng, rng.randrange(5, 60)) for k in range(0, 300, 11)]
    return [*texts, "é" * 150, "xé" + "é" * 150]


@pytest.mark.parametrize("options", [{}, {"hot_contexts": 1}, {"broadcast_places": 0}])
def test_repeats_equal_brute_force(spark, options):
    texts = repeat_texts()
    got = {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.removed), len(r.removed), bytes(r.kept)) for r in suffix_dedup.remove_repeats(documents(spark, texts), **options).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, 200)


def test_repeats_odd_rows(spark):
    t = "q" + some_words(random.Random(1), 100)
    df = documents(spark, [], [(None, t, None, None, None), (1, t + "!", "en", "s", 1), (1, t + "!", "en", "s", 1)])
    rows = suffix_dedup.remove_repeats(df).collect()
    assert sorted((r.doc_id or -1, len(r.kept)) for r in rows) == [(-1, 0), (1, 0), (1, 0)]
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_repeats_with_ids_of_any_type(spark):
    text = "".join(random.Random(1).choice("abcdef") for _ in range(300))
    rows = [("doc-a", text), ("doc-b", "x" + text), (None, "short"), ("doc-a", "other")]
    got = {(r.doc_id, r.n_bytes): bytes(r.kept) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {("doc-a", 300): b"", ("doc-b", 301): b"x", (None, 5): b"short", ("doc-a", 5): b"other"}


def test_pipeline_refuses_names_of_its_result(spark):
    import corpus_pipeline

    for name in ("decoded", "tokens"):
        with pytest.raises(ValueError, match=name):
            corpus_pipeline.token_stage(spark, documents(spark, ["a"]).withColumn(name, F.lit(1)), "")


def test_suffix_array_and_prefixes_by_hand():
    text = np.frombuffer(b"banana", np.uint8).astype(np.int64)
    order = suffix_dedup.suffix_array(text)
    assert order.tolist() == [5, 3, 1, 0, 4, 2]
    assert suffix_dedup.common_prefixes(text, order, np.array([0]), np.array([6]), 10)[order].tolist() == [0, 1, 3, 0, 0, 2]


# ---- quality


def test_quality_learns_and_does_not_look_at_neighbours(spark):
    rng = random.Random(4)
    good = [some_words(rng, 60) + "." for _ in range(150)]
    bad = [" ".join(w.upper() + "!!" for w in some_words(rng, 60).split()) for _ in range(150)]
    net = quality.ByteNetwork().fit(good + bad, [1] * 150 + [0] * 150, epochs=4)
    fresh = [some_words(rng, 50) + "." for _ in range(20)] + [" ".join(w.upper() + "!!" for w in some_words(rng, 500).split()) for _ in range(20)] + ["", None]
    together = net.scores(pa.array(fresh, pa.string()))
    assert (together[:20] > 0.7).all() and (together[20:40] < 0.7).all() and together[40] == together[41]
    alone = [net.scores(pa.array([t], pa.string()))[0] for t in fresh]
    assert np.allclose(together, alone, atol=1e-5)
    late = some_words(rng, 4000) + " " + " ".join(w.upper() + "!!" for w in some_words(rng, 4000).split())
    assert net.scores(pa.array([late]))[0] < 0.7  # the whole text counts


def test_quality_odd_labels(spark):
    docs = documents(spark, ["a", "b", None])
    labels = spark.createDataFrame([(0, 1), (1, None), (2, 5)], "doc_id long, quality int")
    rows = docs.select(quality.score(F.col("text"), quality.train(docs, labels)).alias("s")).collect()
    assert {r.s for r in rows} <= {0.5, 1.0}
    assert quality.ByteNetwork().fit([], []).scores(pa.array(["x"])).tolist() == [0.5]
    got = spark.range(50).select("id", quality.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the driver's tables are not here")
def test_quality_query_ranks_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    scored = quality.op7_quality(spark, folder).where("held_out")
    rows = scored.join(spark.read.parquet(f"{folder}/labels.parquet").where("quality in (0, 1)").select("doc_id", "quality"), "doc_id").select("score", "predicted", "quality").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    above = sum((g > b) + (g == b) / 2 for g in good for b in bad)
    assert len(bad) > 5 and above >= 0.9 * len(good) * len(bad)
    assert all(r.predicted == int(r.score >= 0.7) for r in rows)


def test_contexts_get_one_row_before_they_meet_their_occurrences(spark, monkeypatch):
    tables, join = [], suffix_dedup.salted_join

    def joined(rows, table, key, *more):
        tables.extend([table] if key == "c" and "first" in table.columns else [])
        return join(rows, table, key, *more)

    monkeypatch.setattr(suffix_dedup, "salted_join", joined)
    rng = random.Random(8)
    base = "".join(rng.choice("abcdefgh ") for _ in range(700))
    near = [base[:at] + "#" + base[at + 1 :] for at in (rng.randrange(700) for _ in range(30))]
    docs = spark.createDataFrame(list(enumerate(near)), "doc_id long, text string")
    got = {r.doc_id: r.kept for r in suffix_dedup.remove_repeats(docs, hot_contexts=2).collect()}
    starts = Counter(t[i : i + 200] for t in near for i in range(len(t) - 199))
    for k, t in enumerate(near):
        gone = {j for i in range(len(t) - 199) if starts[t[i : i + 200]] > 1 for j in range(i, i + 200)}
        assert bytes(got[k]).decode() == "".join(c for j, c in enumerate(t) if j not in gone)
    assert len(tables) == 1 and tables[0].count() > 0
    assert tables[0].groupBy("h", "c").count().where("count > 1").isEmpty()  # before, one row for every repeated window
