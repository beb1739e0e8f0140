"""Hard negatives by threshold joins of anchors with all rows.

For an anchor, the positives are its nearest other rows of the same label. A negative of a positive is a row of another label whose
score lies in the positive's window: low * positive score <= high * negative score <= high * positive score.

Anchors and rows meet in pairs of blocks, one task each (anchors are a stated set of queries against all rows; blocks are as large as
a task may hold, so copies are few). Within a task:

1. Dimensions are ordered by their weight in the block. For a threshold t, a row's trailing dimensions are left out of the inverted
   index from where the norm of all that follow, times the anchors' largest norm, stays below t: they alone cannot reach t. A row
   whose whole norm is too small is in no list.
2. Lists are read in strips of dimensions. Partial scores accumulate; a row goes as soon as partial score + norm of its rest * norm
   of the anchor's rest is below every anchor's threshold. Survivors that left dimensions out are completed.
3. Thresholds start high and are lowered until an anchor's windows are full: until a window holds as many rows as wanted, which are
   then the first ones, or the threshold has come to the window's lower end. What a task has found bounds all further rows.

The first join gives positives, merged over tasks; the second gives negatives for their windows. A window of a negative score is
empty. Components become floor(scale * x). Scores are exact: doubles where every sum stays below 2^53, Python's integers otherwise,
and order-preserving bytes between tasks, so nothing is rounded or capped before it is ranked.

Defined cases: rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part; vectors are
compared with those of their own length only; an anchor never meets rows of its own id; equal rows (id, label and vector) are one;
fewer positives or negatives give all of them; ties go to the smaller id; an empty table gives no rows; scores beyond a long are
reported as its ends (and ranked by their value); other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoreloom.llm.exact import from_bytes, quantised, to_bytes, to_long
from scoreloom.session import reliable_checkpoints

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
LOW, HIGH = 80, 100
ANCHOR_BLOCK, ROW_BLOCK = 1 << 15, 1 << 16
#: Rows in an index, anchors that read it together, and dimensions in a strip.
STEP, ANCHORS_AT_ONCE, STRIP = 8192, 64, 8
#: First thresholds, as parts of the largest score that norms allow; the last round has none but what was found before.
LEVELS = (0.6, 0.4, 0.2)
#: Rounds in which a window is walked down from its upper to its lower end.
ROUNDS = 4
_ABOVE = 1 + 1e-9


class SuffixIndex:
    """Inverted lists over strips of dimensions; trailing dimensions of a row are left out where a bound covers them."""

    def __init__(self, x: np.ndarray):
        self.exact = x.dtype == object
        if self.exact:
            self.x = x
            return
        self.dims = np.argsort(-(x * x).sum(0), kind="stable")
        self.x = x[:, self.dims]
        self.cuts = list(range(0, x.shape[1], STRIP))
        self.rest = self._norms(self.x)

    def _norms(self, x: np.ndarray) -> np.ndarray:
        """Norms of the dimensions from each strip on (none after the last), for every row; rounded up."""
        squares = np.add.reduceat(x * x, self.cuts, axis=1)[:, ::-1].cumsum(1)[:, ::-1].T
        return np.sqrt(np.vstack([squares, np.zeros(len(x))])) * _ABOVE

    def largest(self, queries: np.ndarray) -> np.ndarray:
        """What no score of a query can exceed."""
        if self.exact or not len(self.x):
            return np.zeros(len(queries))
        return np.sqrt((queries * queries).sum(1)) * _ABOVE * self.rest[0].max()

    def at_least(self, queries: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of all scores of at least the query's threshold, by query."""
        if self.exact or queries.dtype == object:
            scores = queries.astype(object) @ self.x.astype(object).T if self.exact else queries @ self.x[:, np.argsort(self.dims)].astype(np.int64).astype(object).T
            q, r = np.nonzero(scores >= t.astype(object)[:, None])
            return q, r, scores[q, r]
        q = queries[:, self.dims]
        q_rest = self._norms(q)
        with np.errstate(divide="ignore", invalid="ignore"):
            theta = float(np.nan_to_num(t / q_rest[0], nan=-np.inf, posinf=np.inf, neginf=-np.inf).min(initial=np.inf))
        indexed = (self.rest[:-1] >= theta).sum(0)  # strips of each row that have it in their list
        rows = np.argsort(-indexed, kind="stable")
        rows = rows[indexed[rows] > 0]
        got = np.zeros((len(rows), len(q)))
        for k, a in enumerate(self.cuts):
            m = int(np.searchsorted(-indexed[rows], -k))  # the list: rows with more than k strips
            if not m:
                break
            strip = slice(a, a + STRIP)
            got[:m] += self.x[rows[:m], strip] @ q[:, strip].T
            can = (got[:m] + np.multiply.outer(self.rest[k + 1, rows[:m]], q_rest[k + 1]) >= t).any(1)
            if can.sum() < 0.8 * m:
                stay = np.concatenate([np.flatnonzero(can), np.arange(m, len(rows))])
                rows, got = rows[stay], got[stay]
        done = indexed[rows]
        r, j = np.nonzero(got + self.rest[done, rows][:, None] * q_rest[done] >= t)
        scores, part = got[r, j], done[r] < len(self.cuts)
        for s in range(0, int(part.sum()), 1 << 16):
            some = np.flatnonzero(part)[s : s + (1 << 16)]
            scores[some] = np.einsum("ij,ij->i", self.x[rows[r[some]]], q[j[some]])
        fits = scores >= t[j]
        order = np.argsort(j[fits], kind="stable")
        return j[fits][order], rows[r[fits]][order], scores[fits][order]


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    return np.lexsort((ids, -scores))[:k]


class Held:
    """The first k of what one window has seen."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        kind = object if object in (self.scores.dtype, scores.dtype) else float
        every, which = np.concatenate([whole(self.scores, kind), whole(scores, kind)]), np.concatenate([self.ids, ids])
        best = _first(every, which, self.k)
        self.scores, self.ids = every[best], which[best]

    def floor(self) -> float:
        """Lower scores are of no use."""
        return self.scores[-1] if len(self.scores) == self.k else -math.inf


def whole(scores: np.ndarray, kind: type) -> np.ndarray:
    return np.array([int(s) for s in scores.tolist()], object) if kind is object and scores.dtype != object else scores


def _by_query(found: tuple[np.ndarray, ...], n: int):
    """(rows, scores) of each of n queries."""
    q, rows, scores = found
    cut = np.searchsorted(q, np.arange(n + 1))
    return [(rows[a:b], scores[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def positives_of(anchors: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> list[Held]:
    """The first k rows of each anchor among rows of its label."""
    held = [Held(k) for _ in own]
    for a in range(0, len(ids), STEP):
        index, here = SuffixIndex(x[a : a + STEP]), ids[a : a + STEP]
        for s in range(0, len(own), ANCHORS_AT_ONCE):
            wait = np.arange(s, min(s + ANCHORS_AT_ONCE, len(own)))
            for level in (*LEVELS, None):
                bound = np.array([held[i].floor() for i in wait], object if anchors.dtype == object or index.exact else float)
                t = bound if level is None or index.exact or anchors.dtype == object else np.maximum(bound, level * index.largest(anchors[wait]))
                more = []
                for i, low, least, (rows, scores) in zip(wait.tolist(), t, bound, _by_query(index.at_least(anchors[wait], t), len(wait)), strict=True):
                    other = here[rows] != own[i]
                    if low > least and other.sum() < k:
                        more.append(i)
                    else:
                        held[i].add(scores[other], here[rows[other]])
                wait = np.array(more, np.int64)
                if not len(wait):
                    break
    return held


def negatives_of(anchors: np.ndarray, own: np.ndarray, labels: np.ndarray, windows: list[list[tuple[int, int]]], x: np.ndarray, ids: np.ndarray, row_labels: np.ndarray, k: int) -> list[list[Held]]:
    """For each window [lowest, highest] of each anchor the first k rows of other labels."""
    held = [[Held(k) for _ in w] for w in windows]
    for a in range(0, len(ids), STEP):
        index, here, kinds = SuffixIndex(x[a : a + STEP]), ids[a : a + STEP], row_labels[a : a + STEP]
        plain = not index.exact and anchors.dtype != object
        for s in range(0, len(own), ANCHORS_AT_ONCE):
            wait = np.array([i for i in range(s, min(s + ANCHORS_AT_ONCE, len(own))) if any(lo <= hi for lo, hi in windows[i])], np.int64)
            for turn in range(1, ROUNDS + 1):
                if not len(wait):
                    break
                bottom = [min(max(lo, h.floor()) for (lo, hi), h in zip(windows[i], held[i], strict=True) if lo <= hi) for i in wait]
                top = [max(hi for _, hi in windows[i]) for i in wait]
                low = [b if turn == ROUNDS or not plain or b >= h else max(b, h - (h - b) * turn // ROUNDS) for b, h in zip(bottom, top, strict=True)]
                t = np.array(low, float if plain else object)
                more = []
                for i, reached, least, (rows, scores) in zip(wait.tolist(), low, bottom, _by_query(index.at_least(anchors[wait], t), len(wait)), strict=True):
                    other = (kinds[rows] != labels[i]) & (here[rows] != own[i])
                    rows, scores = rows[other], scores[other]
                    inside = [np.flatnonzero((scores >= lo) & (scores <= hi)) for lo, hi in windows[i]]
                    if reached > least and any(len(w) < k and reached > max(lo, h.floor()) for w, (lo, hi), h in zip(inside, windows[i], held[i], strict=True) if lo <= hi):
                        more.append(i)
                    else:
                        for h, w in zip(held[i], inside, strict=True):
                            if len(w):
                                h.add(scores[w], here[rows[w]])
                wait = np.array(more, np.int64)
    return held


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _together(a: pa.Table, b: pa.Table, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """The quantised vectors of both tables, both exact if either has to be."""
    n = a.num_rows
    both = quantised(np.concatenate([_matrix(a["x"]), _matrix(b["x"])]), scale)
    return both[:n], both[n:]


def meet_same_label(a: pa.Table, b: pa.Table, k: int, scale: int) -> pa.Table:
    """(anchor_id, ak, vec_id, score, key) of the first k rows of a block for every anchor of a block."""
    out: list[list] = [[], [], [], []]
    if a.num_rows and b.num_rows:
        q, x = _together(a, b, scale)
        kinds, row_kinds = a["label"].to_numpy(), b["label"].to_numpy()
        own, ids, ak = a["id"].to_numpy(), b["id"].to_numpy(), a["ak"].to_pylist()
        for label in np.unique(kinds):
            mine, rows = np.flatnonzero(kinds == label), np.flatnonzero(row_kinds == label)
            for i, h in zip(mine.tolist(), positives_of(q[mine], own[mine], x[rows], ids[rows], k), strict=True):
                for column, values in zip(out, ([int(own[i])] * len(h.ids), [ak[i]] * len(h.ids), h.ids.tolist(), [int(s) for s in h.scores.tolist()]), strict=True):
                    column += values
    names = ["anchor_id", "ak", "vec_id", "score", "key"]
    return pa.table([*(pa.array(c, pa.int64()) for c in out[:3]), pa.array(to_long(out[3]), pa.int64()), pa.array(to_bytes(out[3]), pa.binary())], names=names)


def meet_other_labels(a: pa.Table, b: pa.Table, k: int, scale: int, low: int, high: int) -> pa.Table:
    """(anchor_id, ak, place, negative_id, score, key) of the first k rows of a block for every window of every anchor of a block."""
    out: list[list] = [[], [], [], [], []]
    if a.num_rows and b.num_rows:
        q, x = _together(a, b, scale)
        tops = [from_bytes(keys) for keys in a["keys"].to_pylist()]
        windows = [[(-(-low * p // high), p) for p in row] for row in tops]
        own, ak = a["id"].to_numpy(), a["ak"].to_pylist()
        held = negatives_of(q, own, a["label"].to_numpy(), windows, x, b["id"].to_numpy(), b["label"].to_numpy(), k)
        for i, row in enumerate(held):
            for place, h in enumerate(row):
                n = len(h.ids)
                for column, values in zip(out, ([int(own[i])] * n, [ak[i]] * n, [place] * n, h.ids.tolist(), [int(s) for s in h.scores.tolist()]), strict=True):
                    column += values
    names = ["anchor_id", "ak", "place", "negative_id", "score", "key"]
    return pa.table([*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(to_long(out[4]), pa.int64()), pa.array(to_bytes(out[4]), pa.binary())], names=names)


def mine_hard_negatives(
    rows: DataFrame, is_anchor: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW, high: int = HIGH, scale: int = SCALE, anchor_block: int = ANCHOR_BLOCK, row_block: int = ROW_BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors among ``rows``; ids are integers,
    labels too."""
    reliable_checkpoints(rows.sparkSession)
    whole_rows = (
        rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.transform(F.col(vector_col), lambda v: v.cast("double")).alias("x"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
        .where("id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL AND size(x) > 0")
        .where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
        .distinct().withColumn("dim", F.size("x")).checkpoint()
    )
    anchors = whole_rows.where("anchor").withColumn("ak", F.xxhash64("id", "label", "x"))
    n_anchors, n_rows = anchors.count(), whole_rows.count()
    share = -(-n_rows // (2 * rows.sparkSession.sparkContext.defaultParallelism))  # small inputs still use all cores
    row_block = min(row_block, max(share, min(STEP // 2, row_block)))
    a_blocks, r_blocks = max(1, -(-n_anchors // anchor_block)), max(1, -(-n_rows // row_block))
    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    key = ["dim", "ab", "rb"]
    right = lambda: whole_rows.select(*(F.col(c).alias(c) for c in ("dim", "id", "label", "x")), place(r_blocks).alias("rb"), every(a_blocks).alias("ab")).groupBy(*key)

    left = anchors.select("dim", "id", "label", "x", "ak", place(a_blocks).alias("ab"), every(r_blocks).alias("rb")).groupBy(*key)
    near = left.cogroup(right()).applyInArrow(lambda a, b: meet_same_label(a, b, positives, scale), "anchor_id long, ak long, vec_id long, score long, key binary")
    first = F.row_number().over(Window.partitionBy("anchor_id", "ak").orderBy(F.desc("key"), "vec_id"))
    ranked = near.withColumn("r", first).where(F.col("r") <= positives)
    chosen = ranked.groupBy("anchor_id", "ak").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score", "key"))).alias("p")).checkpoint()

    known = anchors.join(chosen.withColumnRenamed("anchor_id", "id"), ["id", "ak"])
    left = known.select("dim", "id", "label", "x", "ak", F.col("p.key").alias("keys"), place(a_blocks).alias("ab"), every(r_blocks).alias("rb")).groupBy(*key)
    far = left.cogroup(right()).applyInArrow(lambda a, b: meet_other_labels(a, b, negatives, scale, low, high), "anchor_id long, ak long, place long, negative_id long, score long, key binary")
    first = F.row_number().over(Window.partitionBy("anchor_id", "ak", "place").orderBy(F.desc("key"), "negative_id"))
    ranked = far.withColumn("rank", first).where(F.col("rank") <= negatives).withColumn("place", F.col("place").cast("int"))
    named = ranked.join(chosen, ["anchor_id", "ak"]).withColumn("pos", F.get("p", F.col("place")))
    return named.select("anchor_id", F.col("pos.vec_id").alias("positive_id"), "rank", "negative_id", F.col("pos.score").alias("positive_score"), F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS "rank"
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
)
SELECT anchor_id, positive_id, "rank", negative_id, positive_score, negative_score FROM n WHERE "rank" <= 5
"""
