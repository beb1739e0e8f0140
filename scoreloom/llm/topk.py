"""Exact top-k inner products by aggregation without random access.

In a block of candidates every dimension is a list, sorted once for all queries; a query reads it from the end that its own sign
prefers. All lists are read in step, strip by strip, each strip as long as all before it. What a query has read of a candidate
gives it a lower bound (the list's worst value for what is unread) and an upper bound (the value where the list stands). Before
each further strip a query asks whether candidates of which it has read nothing can still qualify, and then whether any outsider
can; it stops as soon as at most ``POOL * k`` candidates can, and only their final scores are resolved. A query that never stops
has read its lists to the end. The k-th best score of the blocks that a task has behind it is carried on as a bound, so later
blocks stop earlier.

Queries and candidates meet in pairs of blocks, one task each, and a task goes through its candidates ``STEP`` at a time. An exact
search of a set of queries against all rows can't avoid pairs of blocks; blocks are as large as a task may hold (some 70 MB for
64 dimensions), which keeps copies few: candidates are copied once for each ``QUERY_BLOCK`` queries.

Components are turned into floor(64 * x) first, and all sums are of 64-bit integers (floats only where every sum is below 2^24,
doubles only where it is below 2^53, Python's integers where one could pass 2^62, order-preserving bytes between tasks), so scores are exact, nothing is capped before it is
ranked, and ties are real: the smaller id wins.

Defined cases: vectors that are null, empty, or hold null or non-finite components, and rows without an id take no part; vectors
are compared with those of their own length only; a query never meets rows of its own id; a repeated candidate row is searched
once and returned as often as it occurs, a repeated query row is one query; fewer than k candidates give all of them; an empty
table gives no rows; scores beyond a long are ranked by their value and reported as its ends; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoreloom.llm.exact import quantised, to_bytes, to_long

K = 20
QUERY_BLOCK, CANDIDATE_BLOCK = 1 << 16, 1 << 17
SCALE = 64
#: Candidates whose lists are read together, queries that read them together, and the first strip.
STEP, QUERIES_AT_ONCE, FIRST_STRIP = 4096, 64, 64
POOL = 4
_NEVER, ENDS = -(1 << 62), (-(1 << 63), (1 << 63) - 1)


class SortedLists:
    """Candidates in the order of their ids, and for every dimension their places in its list, sorted by value."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], vectors[order]
        by_value = np.argsort(self.x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.x, by_value, axis=0)
        self.low, self.high = self.sorted[0], self.sorted[-1]
        self.rank = np.empty(self.x.shape, np.int32)
        np.put_along_axis(self.rank, by_value, np.arange(len(self.x), dtype=np.int32)[:, None], axis=0)
        self.read = 0  # entries that queries have read
        self._made: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

    def _once(self, key: tuple, make) -> tuple[np.ndarray, np.ndarray]:
        if key not in self._made:  # strips are the same for all queries
            self._made[key] = tuple(m.astype(key[-1], copy=False) for m in make())
        return self._made[key]

    def whole(self, kind: type) -> np.ndarray:
        return self._once(("whole", kind), lambda: (self.x,))[0]

    def strip(self, depth: int, stop: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """What the entries ``depth`` to ``stop`` of the lists, from their upper and from their lower end, add to the worst values; 0 elsewhere."""
        n, r = len(self.x), self.rank
        return self._once((depth, stop, kind), lambda: (np.where((r >= n - stop) & (r < n - depth), self.x - self.low, 0), np.where((r >= depth) & (r < stop), self.x - self.high, 0)))

    def unread(self, depth: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """Which entries lie behind ``depth``, seen from the upper and from the lower end."""
        return self._once((depth, kind), lambda: (self.rank < len(self.x) - depth, self.rank >= depth))


def best(lists: SortedLists, queries: np.ndarray, own: np.ndarray, k: int, bound: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the positions and scores of all candidates that may be among its k best (at least those that are), best
    first. ``bound``: scores below it don't matter."""
    n, dims = lists.x.shape
    out: list = [None] * len(queries)
    largest = int(max(np.abs(lists.x).max(initial=0), 1)) * int(max(np.abs(queries).max(initial=0), 1)) * dims * 4
    if largest >= 1 << 62:  # too large for 64 bits: every sum in Python's integers
        x = lists.x.astype(object)
        for i, q in enumerate(queries.astype(object)):
            found = sorted((-s, j) for j, s in enumerate(x @ q) if lists.ids[j] != own[i])[:k]
            out[i] = (np.array([j for _, j in found], np.int64), np.array([-s for s, _ in found], object))
        lists.read += n * dims * len(queries)
        return out
    # The smallest type in which every sum of products is exact.
    kind = np.float32 if largest < 1 << 24 else np.float64 if largest < 1 << 53 else np.int64
    bound = np.full(len(queries), _NEVER) if bound is None else bound
    live = np.arange(len(queries))
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    up_, down_ = up.astype(kind), down.astype(kind)
    mine = [slice(int(np.searchsorted(lists.ids, o)), int(np.searchsorted(lists.ids, o, side="right"))) for o in own.tolist()]
    lower = np.repeat((up @ lists.low + down @ lists.high).astype(kind)[:, None], n, axis=1)
    depth, strip = 0, FIRST_STRIP
    while len(live):
        stop = n if depth * 4 >= n or strip >= n else depth + strip
        lists.read += (stop - depth) * dims * len(live)
        if stop == n:  # all the rest of all lists
            lower = queries[live].astype(kind) @ lists.whole(kind).T
        else:
            top, bottom = lists.strip(depth, stop, kind)
            lower += up_[live] @ top.T
            lower += down_[live] @ bottom.T
        depth, strip = stop, stop
        for c, q in enumerate(live):
            lower[c, mine[q]] = _NEVER
        ask = np.arange(len(live))
        if depth < n:  # could anything unseen be out of the race?
            at_top, at_bottom = lists.sorted[n - depth - 1], lists.sorted[depth]
            unseen = up[live] @ at_top + down[live] @ at_bottom
            ask = np.flatnonzero(unseen < np.maximum(lower.max(1), bound[live]))
        cut = bound[live].copy()
        for c in ask:
            size = min(k, n - (mine[live[c]].stop - mine[live[c]].start))
            cut[c] = max(cut[c], int(np.partition(lower[c], n - size)[n - size])) if size else -_NEVER
        can, done = lower, np.full(len(live), depth == n)
        if depth < n:
            ask = ask[unseen[ask] < cut[ask]]
            if len(ask):
                above, below = lists.unread(depth, kind)
                room_up, room_down = up[live[ask]] * (at_top - lists.low), down[live[ask]] * (at_bottom - lists.high)
                can = lower.copy()
                can[ask] += room_up.astype(kind) @ above.T + room_down.astype(kind) @ below.T
                done[ask] = (can[ask] >= cut[ask][:, None]).sum(1) <= POOL * k
        for c in np.flatnonzero(done):
            q = live[c]
            found = np.flatnonzero(can[c] >= cut[c])
            found = found[lower[c, found] > _NEVER // 2]
            scores = lists.x[found] @ queries[q]
            order = np.lexsort((found, -scores))[:k]
            out[q] = (found[order], scores[order])
        if not done.all():
            lower = lower[~done]
        live = live[~done]
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def meet_blocks(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, copies: np.ndarray, k: int, step: int = STEP) -> tuple[np.ndarray, ...]:
    """(query id, id, score, copies) of the k best of a block of candidates for every query of a block; scores are Python's integers
    where 64 bits may not hold them."""
    largest = lambda x: int(max(np.abs(x).max(initial=0), 1))
    exact = object in (queries.dtype, vectors.dtype) or largest(queries) * largest(vectors) * vectors.shape[1] * 4 >= 1 << 62
    held_scores = np.full((len(queries), k), _NEVER, object if exact else np.int64)
    held = np.full((len(queries), k), -1)
    for a in range(0, len(ids), step):
        lists = SortedLists(ids[a : a + step], vectors[a : a + step])
        place = a + np.argsort(ids[a : a + step], kind="stable")
        for s in range(0, len(queries), QUERIES_AT_ONCE):
            some = slice(s, s + QUERIES_AT_ONCE)
            bound = None if exact else held_scores[some, -1]
            for i, (at, scores) in enumerate(best(lists, queries[some], query_ids[some], k, bound), s):
                if not len(at):
                    continue
                every, where = np.concatenate([held_scores[i], scores]), np.concatenate([held[i], place[at]])
                every, where = every[where >= 0], where[where >= 0]
                order = np.array(sorted(range(len(every)), key=lambda z: (-every[z], ids[where[z]]))[:k], np.int64) if exact else np.lexsort((ids[where], -every))[:k]  # noqa: B023
                held_scores[i, : len(order)], held[i, : len(order)] = every[order], where[order]
    row, column = np.nonzero(held >= 0)
    found = held[row, column]
    return query_ids[row], ids[found], held_scores[row, column], copies[found]


def top_k(queries: DataFrame, candidates: DataFrame, *, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of every query."""
    whole = lambda df: (
        df.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("x"))
        .where(F.col("id").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size("x") > 0))
        .groupBy("id", F.col("x").alias("v")).agg(F.count("*").alias("copies"))
        .withColumn("dim", F.size("v"))
    )
    q, c = whole(queries), whole(candidates)
    n_queries, n_candidates = q.count(), c.count()
    share = -(-n_candidates // (2 * candidates.sparkSession.sparkContext.defaultParallelism))  # small inputs still use all cores
    candidate_block = min(candidate_block, max(share, min(STEP, candidate_block)))
    q_blocks, c_blocks = max(1, -(-n_queries // query_block)), max(1, -(-n_candidates // candidate_block))
    place = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
    left = q.withColumn("qb", place(q_blocks)).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))))
    right = c.withColumn("cb", place(c_blocks)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        found: tuple = (np.zeros(0, np.int64),) * 4
        if a.num_rows and b.num_rows:
            vectors = quantised(np.concatenate([_matrix(a["v"]), _matrix(b["v"])]), SCALE)
            vectors = vectors if vectors.dtype == object else vectors.astype(np.int64)
            found = meet_blocks(a["id"].to_numpy(), vectors[: a.num_rows], b["id"].to_numpy(), vectors[a.num_rows :], b["copies"].to_numpy(), k)
        scores, beyond = found[2], pa.nulls(len(found[2]), pa.binary())
        if scores.dtype == object:  # only scores at or beyond the ends of a long need more than it
            whole = scores.tolist()
            beyond = pa.array([key if long in ENDS else None for key, long in zip(to_bytes(whole), to_long(whole), strict=True)], pa.binary())
            scores = np.array(to_long(whole), np.int64)
        return pa.table([*(pa.array(c, pa.int64()) for c in (found[0], found[1], scores)), beyond, pa.array(found[3], pa.int64())], names=["query_id", "vec_id", "score", "key", "copies"])

    kind = "query_id long, vec_id long, score long, key binary, copies long"
    parts = left.groupBy("dim", "qb", "cb").cogroup(right.groupBy("dim", "qb", "cb")).applyInArrow(meet, kind)
    repeated = parts.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("copies"), F.lit(k).cast("long")))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("key"), "vec_id", "copy"))
    ranked = repeated.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op8_no_random_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(rows.where(F.col("vec_id") % 20 == 0), rows)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score FROM s
)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 20
"""
