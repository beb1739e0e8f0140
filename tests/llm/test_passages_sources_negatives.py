"""Repeated passages, divergence of sources and hard negatives against brute force, through the queries, with the defined odd cases."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from scoreloom.llm import debruijn, divergence, exact, hard_negatives
from scoreloom.llm.divergence import SIDE, SquareForest, distances

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def save(spark, folder, name, rows, kind):
    spark.createDataFrame(rows, kind).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


# ---- repeated passages


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def without_repeats(rows, k=13):
    """(doc_id, n_words, n_removed, kept) of every row, by the rule itself."""
    first = {}
    for i, text in rows:
        w = words_of(text)
        for a in range(len(w) - k + 1 if i is not None else 0):
            key = tuple(w[a : a + k])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, text in rows:
        w = words_of(text)
        gone = set()
        for a in range(len(w) - k + 1 if i is not None else 0):
            if first[tuple(w[a : a + k])] < i:
                gone |= set(range(a, a + k))
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def passages(rng, n, vocabulary=60):
    """Texts with shared passages, near and exact copies, and words that branch inside passages."""
    word = lambda: f"w{rng.randrange(vocabulary)}"
    shared = [[word() for _ in range(rng.choice([13, 14, 20, 55]))] for _ in range(8)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts += rng.choice(shared) if rng.random() < 0.6 else [word() for _ in range(rng.randint(0, 30))]
        if texts and rng.random() < 0.3:
            parts = rng.choice(texts).split()
            if rng.random() < 0.7 and parts:
                parts[rng.randrange(len(parts))] = word()
        texts.append(" ".join(parts))
    return texts


ODD_TEXTS = [None, "", " \t\r\n\x0b\x0c ", "w1 " * 40, "w1 " * 12, "w1 " * 13, "A a\x1cb \xa0 é　x " * 9, "A a\x1cb \xa0 é　x " * 9, "a A\x1cb \xa0 é　x " * 9]


@pytest.mark.parametrize(("bound", "crowd"), [(10**6, 2000), (0, 1)])
def test_passages_equal_brute_force(spark, monkeypatch, bound, crowd):
    monkeypatch.setattr(debruijn, "HOT_KINDS", crowd)
    rng = random.Random(11)
    rows = list(enumerate(passages(rng, 150) + ODD_TEXTS))
    rng.shuffle(rows)
    text = rows[3][1]
    rows += [rows[5], rows[5], (None, text), (None, text), (7, rows[8][1])]  # repeated rows, null ids, an id with two texts
    docs = spark.createDataFrame([(t, i, 1) for i, t in rows], "text string, doc_id long, spans int").repartition(4)
    got = debruijn.remove_repeated_passages(docs, broadcast_places=bound, broadcast_anchors=bound).collect()
    key = lambda x: (x[0] is None, str(x))
    found = sorted(((r.doc_id, r.n_words, sum(s.end - s.start for s in r.removed), r.kept) for r in got), key=key)
    assert found == sorted(without_repeats(rows), key=key)
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(words_of(t))
    for r in got:
        for s in r.spans:  # every span is a literal passage of its source
            size = s.end - s.start
            assert s.source < r.doc_id and size >= 13
            assert any(t[s.start : s.end] == u[s.source_start : s.source_start + size] for t in texts[r.doc_id] for u in texts[s.source])


def test_paths_are_passages_that_do_not_branch(spark):
    a, b = [f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)]
    docs = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(["x", *a, "y"])), (3, " ".join(a[:20] + b)), (4, " ".join([*b, "z"]))], "doc_id long, text string")
    paths = sorted(tuple(r) for r in debruijn.repeated_paths(docs).collect())
    assert paths == [(1, 0, 30), (3, 20, 50)]  # the window that joins a and b is in one document alone


def test_paths_hold_every_repeated_window_once_and_part_where_sources_part(spark):
    rng = random.Random(12)
    rows = list(enumerate(t for t in dict.fromkeys(passages(rng, 120)) if t))
    first, many = {}, set()
    for i, t in rows:
        w = words_of(t)
        for a in range(len(w) - 12):
            key = tuple(w[a : a + 13])
            if key in first and first[key][0] < i:
                many.add(key)
            first.setdefault(key, (i, a))
    texts = {i: words_of(t) for i, t in rows}
    paths = [tuple(r) for r in debruijn.repeated_paths(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    held = [(i, a, tuple(texts[i][a : a + 13])) for i, start, end in paths for a in range(start, end - 12)]
    assert sorted(held) == sorted((*first[key], key) for key in many) and 1 < len(paths) < len(held) / 2


def test_passages_query_and_empty_table(spark, tmp_path):
    rng = random.Random(5)
    rows = list(enumerate(passages(rng, 60) + ODD_TEXTS + ["long " + " ".join(f"v{rng.randrange(10**6)}" for _ in range(60_000))]))
    rows.append((len(rows), rows[-1][1].replace("long ", "longer ")))
    folder = save(spark, tmp_path, "documents", [(i, t, "en", "s", 1) for i, t in rows], DOCS)
    got = sorted(tuple(r) for r in debruijn.op11_debruijn_dedup(spark, folder).collect())
    assert got == sorted((i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in without_repeats(rows))
    assert got[-1][2] == 60_000
    empty = spark.createDataFrame([], DOCS)
    assert debruijn.remove_repeated_passages(empty).count() == 0 and debruijn.repeated_paths(empty).count() == 0


def test_passages_with_hot_copies_and_string_ids(spark):
    base = " ".join(f"h{i}" for i in range(40))
    rows = [(f"d{i:04d}", base) for i in range(1200)] + [(f"e{i:04d}", f"n{i} {base} m{i}") for i in range(1200)]
    got = {r.doc_id: r for r in debruijn.remove_repeated_passages(spark.createDataFrame(rows, "doc_id string, text string"), broadcast_anchors=0).collect()}
    assert got["d0000"].kept == base and all(got[i].kept == "" for i, _ in rows[1:1200])
    assert all(got[i].kept == f"n{k} m{k}" and [s.source for s in got[i].spans] == ["d0000"] for k, (i, _) in enumerate(rows[1200:]))


# ---- divergence of sources


def audit(rows, least, top):
    """The audit by the rule itself, in Python's integers."""
    clean = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in clean}:
        mine = [r for r in clean if r[0] == lang]
        df = Counter(t for _, _, words in mine for t in set(words))
        kept = [t for t, n in df.items() if n >= least]
        counts = defaultdict(Counter)
        for _, source, words in mine:
            counts[source].update(w for w in words if df[w] >= least)
        whole = sum(counts.values(), Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        shares, q = {s: p(c) for s, c in counts.items()}, p(whole)
        for s in counts:
            parts = {"pair": [(-sum(abs(shares[s][t] - shares[o][t]) for t in kept), o) for o in counts if o != s]}
            parts["term"] = [(q[t] - shares[s][t], t) for t in kept if counts[s][t] and shares[s][t] > q[t]]
            for part, found in parts.items():
                found = sorted(found, key=lambda x: (x[0], x[1].encode()))
                out += [(lang, s, part, item, -v, k) for k, (v, item) in enumerate(found, 1) if part == "pair" or k <= top]
    return sorted(out)


def prose(rng, n, sources, langs=("en", None)):
    word = lambda s: f"{'ABCdéß日'[rng.randrange(7)]}{chr(97 + min(int(rng.expovariate(0.2)), 25))}{chr(97 + s % 26)}"
    return [(rng.choice(langs), f"s{s}", " ".join(word(s) for _ in range(rng.randint(0, 40)))) for s in (rng.randrange(sources) for _ in range(n))]


def test_divergence_equals_brute_force(spark):
    rng = random.Random(2)
    rows = prose(rng, 400, 7) + [("en", None, None), ("xx", "only", "1234 ~ !"), ("xx", "other", ""), ("en", "S0", "don't [A] Ünï\x7f_x" * 400)]
    docs = spark.createDataFrame([(9, *r) for r in rows], "term int, lang string, source string, text string").repartition(5)
    for columns in (divergence.COLUMNS, 7):
        got = sorted(tuple(r) for r in divergence.source_divergence(docs, min_docs=4, top=5, columns=columns).collect())
        assert got == audit(rows, 4, 5)
    assert divergence.source_divergence(docs.limit(0)).count() == 0


def test_divergence_of_more_sources_than_a_tile_has(spark):
    rng = random.Random(3)
    rows = prose(rng, 900, 2 * SIDE + 9, ("en",))
    got = sorted(tuple(r) for r in divergence.source_divergence(spark.createDataFrame(rows, "lang string, source string, text string"), min_docs=3, top=3, columns=20).collect())
    assert got == audit(rows, 3, 3)


def test_divergence_query(spark, tmp_path):
    rng = random.Random(4)
    rows = prose(rng, 600, 4)
    folder = save(spark, tmp_path, "documents", [(i, t, lang, s, 1) for i, (lang, s, t) in enumerate(rows)], DOCS)
    assert sorted(tuple(r) for r in divergence.op12_source_divergence(spark, folder).collect()) == audit(rows, 30, 50)


def test_terms_handed_on_early_count_the_same():
    import pyarrow as pa

    rows = prose(random.Random(6), 200, 3)
    batch = lambda r: pa.RecordBatch.from_pylist([{"lang": x[0] or "", "source": x[1], "text": x[2]} for x in r])
    total = lambda most: sum((Counter({(r["lang"], r["source"], r["term"]): r["n"] for r in out.to_pylist()}) for out in divergence.count_terms(iter([batch(rows[:90]), batch(rows[90:])]), most)), Counter())
    assert total(1) == total(10**6)


@pytest.mark.parametrize("density", [0.0, 0.01, 0.5, 1.0])
def test_joint_traversal_equals_dense_matrices(density):
    rng = np.random.default_rng(int(density * 100))
    columns = 3 * SIDE
    forest, dense, empty = [], [], []
    for _ in range(2):
        zero = rng.integers(1, 50, SIDE)
        full = rng.random((SIDE, columns)) < density
        full[:, SIDE : 2 * SIDE] = False
        values = np.where(full, rng.integers(1, 10**9, full.shape), zero[:, None])
        r, c = np.nonzero(full)
        forest.append(SquareForest(r, c, values[r, c], 3))
        dense.append(values)
        empty.append(zero)
    expected = np.abs(dense[0][:, None] - dense[1][None]).sum(2)
    assert (distances(*forest, *empty, 3, False) == expected).all()
    own = np.abs(dense[0][:, None] - dense[0][None]).sum(2)
    found = distances(forest[0], forest[0], empty[0], empty[0], 3, True)
    assert (np.triu(found) == np.triu(own)).all()


# ---- hard negatives


def negatives_by_rule(rows, anchor, scale=256, k=5):
    valid = {(i, label, tuple(v)) for i, v, label in rows if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    from fractions import Fraction

    valid = [(i, label, [math.floor(Fraction(x) * scale) for x in v]) for i, label, v in valid]
    out = []
    for a, label, v in valid:
        if not anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, u, strict=True)), i, kind == label) for i, kind, u in valid if i != a and len(u) == len(v))
        for minus, p, same in [s for s in scored if s[2]][:k]:
            fits = [s for s in scored if not s[2] and 80 * -minus <= 100 * -s[0] <= 100 * -minus][:k]
            cut = lambda n: min(max(n, -(1 << 63)), (1 << 63) - 1)
            out += [(a, p, r, i, cut(-minus), cut(-m)) for r, (m, i, _) in enumerate(fits, 1)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<double>, label int"


def some_vectors(rng, n, dims=20, labels=4):
    centre = [[rng.gauss(0, 0.4) for _ in range(dims)] for _ in range(3)]
    return [(i, [float(round(c + rng.gauss(0, 0.3), rng.choice([1, 6]))) for c in rng.choice(centre)], rng.randrange(labels)) for i in range(n)]


def test_negatives_equal_brute_force(spark):
    rng = random.Random(8)
    rows = some_vectors(rng, 400)
    rows += [(400, rows[10][1], 1), (401, rows[10][1], 2), (402, None, 1), (403, [], 1), (404, [None] * 20, 1), (405, [float("nan")] * 20, 0), (406, [float("inf")] * 20, 0), (407, rows[0][1], None), (None, rows[0][1], 1)]
    rows += [(410 + i, [0.0] * 20, i % 3) for i in range(8)] + [(420, [-x for x in rows[0][1]], 9), (430, [1.0, 2.0], 1), (431, [1.0, 2.1], 1), (432, [1.0, 1.9], 2), rows[20], rows[20]]
    docs = spark.createDataFrame([(*r, 1) for r in rows], VECTORS + ", rank int").repartition(4)
    from pyspark.sql import functions as F

    for options in ({}, {"anchor_block": 7, "row_block": 50}):
        got = sorted(tuple(r) for r in hard_negatives.mine_hard_negatives(docs, F.col("vec_id") % 10 == 0, **options).collect())
        assert got == negatives_by_rule(rows, lambda i: i % 10 == 0)
    assert hard_negatives.mine_hard_negatives(docs.limit(0), F.lit(True)).count() == 0


def test_negatives_of_huge_components_are_ranked_before_anything_is_capped(spark):
    from pyspark.sql import functions as F

    rows = [(0, [1e20, 1.0], 0), (1, [1e20, 0.0], 0), (2, [2e20, 5.0], 0), (3, [1.9e20, 5.0], 1), (4, [1.8e20, 5.0], 1), (5, [9e19, 1e300], 1), (6, [1.7e20, -1e19], 2), (7, [0.5, 0.25], 2)]
    docs = spark.createDataFrame(rows, VECTORS)
    got = sorted(tuple(r) for r in hard_negatives.mine_hard_negatives(docs, F.col("vec_id") == 0).collect())
    assert got == negatives_by_rule(rows, lambda i: i == 0) and [r[3] for r in got if r[1] == 2] == [3, 4, 6]


def test_negatives_query(spark, tmp_path):
    rows = [(i, v, label % 10) for i, v, label in some_vectors(random.Random(9), 700, 16, 10)]
    folder = save(spark, tmp_path, "embeddings", rows, "vec_id long, embedding array<float>, label int")
    single = [(i, [float(np.float32(x)) for x in v], (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows]
    assert sorted(tuple(r) for r in hard_negatives.op13_hard_negatives(spark, folder).collect()) == negatives_by_rule(single, lambda i: i % 100 == 0)


def test_index_gives_all_scores_above_a_threshold_and_leaves_dimensions_out():
    rng = np.random.default_rng(1)
    weights = 100 * 0.8 ** np.arange(32)
    x, q = np.floor(rng.normal(0, 1, (500, 32)) * weights), np.floor(rng.normal(0, 1, (9, 32)) * weights)
    index = hard_negatives.SuffixIndex(x)
    scores = q @ x.T
    for t in (-np.inf, 0.0, 5000.0, 40_000.0, 10.0**9):
        j, r, s = index.at_least(q, np.full(len(q), t))
        assert sorted(zip(j.tolist(), r.tolist(), s.tolist(), strict=True)) == [(a, b, scores[a, b]) for a, b in zip(*np.nonzero(scores >= t), strict=True)]
    theta = 40_000 / np.sqrt((q * q).sum(1)).max()
    assert 0 < (index.rest[:-1] >= theta).sum() < index.rest[:-1].size


def test_bytes_of_integers_keep_their_order():
    rng = random.Random(1)
    numbers = sorted({rng.randrange(-(10**e), 10**e + 1) for e in (0, 1, 3, 20, 200, 600) for _ in range(40)} | {0, 1, -1, 255, 256, -255, -256})
    keys = exact.to_bytes(numbers)
    assert keys == sorted(keys) and exact.from_bytes(keys) == numbers
    assert exact.to_long([1 << 70, -(1 << 70), 5]) == [(1 << 63) - 1, -(1 << 63), 5]
