"""Audit of how the sources of a language differ in the words they use.

Within each language, p(group, term) = 1 + floor(10^9 * (count + 5) / (N + 5 V)) for each of the V terms that at least ``min_docs``
documents of the language have, N being the group's occurrences of these terms. The audit lists, for every source, its distance from
each other source (sum of |p - p'| over all V terms) and the terms that it uses more than the language as a whole.

1. Terms are counted inside the tasks that read the texts, which give one row per source and term of a bounded table; these are
   summed by a shuffle of hashed keys. From there on the work depends on distinct terms and sources, not on the texts.
2. The group-term matrix of a language is cut into tiles: ``SIDE`` sources by the terms of one hash block. A task takes two tiles of
   one block of terms and stores each as a forest of K-squared trees (k = 2): squares of ``SIDE`` by ``SIDE`` cells, whose levels are bit
   strings with four bits for each nonzero quadrant above, and whose leaves hold p. Terms that many sources have come first, so
   that empty quadrants lie together.
3. Both trees are traversed together for all pairs of their sources. Where both quadrants are empty, every cell is p(count = 0) of
   its source, so the quadrant's width is noted for all pairs of its sources and priced once at the end. Elsewhere the traversal goes
   down; at leaves it adds |p - p'|, with p(count = 0) for the side that is empty.
4. Sums of the tasks are added for every pair. Terms of a language that no tile of the pair has are one more empty quadrant.

All arithmetic is in 64-bit integers, exact up to 9e15 words in a group (the quotient is taken in three steps of 10^3).

Defined cases: null text, language and source count as the empty string; every occurring group is audited, also without terms; a
language without kept terms gives distances of 0 and no terms; repeated rows count each; a single source has no pairs; an empty
table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoreloom.llm.words import small_batches
from scoreloom.session import reliable_checkpoints

MIN_DOCS = 30
TOP_TERMS = 50
#: Sources in a tile and side of its squares (a power of two), and terms in a block of columns.
SIDE, COLUMNS = 64, 8192
#: Counted terms that a task holds before it hands them on.
HELD_TERMS = 1 << 19
#: Groups whose totals may be broadcast.
BROADCAST_GROUPS = 200_000
_SQUARES_AT_ONCE = 8

_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def count_terms(batches: Iterator[pa.RecordBatch], most: int = HELD_TERMS) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> (lang, source, term, n, docs), terms summed over what a task holds; a group's first row has no term."""
    held: dict[tuple, tuple[Counter, Counter]] = {}
    size = 0

    def hand_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), (count, docs) in held.items():
            terms = [None, *count]
            columns = [[lang] * len(terms), [source] * len(terms), terms, [0, *count.values()], [0, *(docs[t] for t in count)]]
            kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["text"], strict=True):
            words = text.as_py().encode().translate(_TERM_BYTES).split()
            if (lang, source) not in held:
                held[lang, source] = (Counter(), Counter())
            count, docs = held[lang, source]
            before = len(count)
            count.update(words)
            docs.update(set(words))
            size += len(count) - before
            if size >= most:
                yield from hand_on()
                size = 0
    yield from hand_on()


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(10^9 * (count + 5) / (total + 5 * terms)) in 64-bit integers."""
    whole = f"({total} + 5 * {terms})"
    rest, parts = f"({count} + 5)", []
    for _ in range(3):
        parts.append(f"({rest} * 1000) div {whole}")
        rest = f"(({rest} * 1000) % {whole})"
    return F.expr(f"1 + ({parts[0]}) * 1000000 + ({parts[1]}) * 1000 + ({parts[2]})")


class SquareForest:
    """A K-squared tree (k = 2) for every square of ``SIDE`` columns of a sparse matrix of at most ``SIDE`` rows."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, squares: int):
        levels = SIDE.bit_length() - 1
        code = columns // SIDE << 2 * levels
        for bit in range(levels):  # rows' bits above columns' bits
            code |= (columns >> bit & 1) << 2 * bit | (rows >> bit & 1) << 2 * bit + 1
        order = np.argsort(code)
        self.values = values[order]
        full = [code[order]]
        for _ in range(levels):
            full.append(np.unique(full[-1] >> 2))
        roots = np.zeros(squares, bool)
        roots[full[-1]] = True
        self.bits = [roots]  # from the roots to the leaves; a level has four bits for each nonzero quadrant above it
        for above, here in zip(full[:0:-1], full[-2::-1], strict=True):
            bits = np.zeros(4 * len(above), bool)
            bits[4 * np.searchsorted(above, here >> 2) + (here & 3)] = True
            self.bits.append(bits)
        self.rank = [np.cumsum(b) - b for b in self.bits]

    def root(self, square: np.ndarray) -> np.ndarray:
        return np.where(self.bits[0][square], square, -1)

    def child(self, level: int, node: np.ndarray, quadrant: int) -> np.ndarray:
        """The places one level below ``level`` of a quadrant of the nodes, -1 if it or the node is empty."""
        if not len(self.values):
            return np.full(len(node), -1)
        at = 4 * self.rank[level][node] + quadrant
        return np.where((node >= 0) & self.bits[level + 1][np.where(node >= 0, at, 0)], at, -1)

    def leaf(self, node: np.ndarray, empty: np.ndarray) -> np.ndarray:
        if not len(self.values):
            return empty
        return np.where(node >= 0, self.values[np.where(node >= 0, self.rank[-1][node], 0)], empty)


def distances(a: SquareForest, b: SquareForest, a0: np.ndarray, b0: np.ndarray, squares: int, same: bool) -> np.ndarray:
    """Sums of |p - p'| over all columns of the squares for every row of ``a`` and ``b``, of which a0 and b0 are the values of empty
    cells. ``same``: both are one matrix, and only pairs with the smaller row first are wanted."""
    levels = SIDE.bit_length() - 1
    total = np.zeros((SIDE, SIDE), np.int64)
    width = np.zeros((SIDE, SIDE), np.int64)
    for s in range(0, squares, _SQUARES_AT_ONCE):
        some = np.arange(s, min(s + _SQUARES_AT_ONCE, squares))
        x, y = a.root(some), b.root(some)
        empty = (x < 0) & (y < 0)
        width += SIDE * int(empty.sum())
        x, y = x[~empty], y[~empty]
        i, j = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for level in range(levels):
            down, side = [], SIDE >> level + 1  # columns of a quadrant below
            noted = np.zeros((SIDE // side) ** 2, np.int64)
            for ri in (0, 1):
                for rj in (0, 1):
                    ii, jj = 2 * i + ri, 2 * j + rj
                    for c in (0, 1):
                        xx, yy = a.child(level, x, 2 * ri + c), b.child(level, y, 2 * rj + c)
                        wanted = ii <= jj if same else np.ones(len(ii), bool)
                        empty = wanted & (xx < 0) & (yy < 0)
                        noted += side * np.bincount(ii[empty] * (SIDE // side) + jj[empty], minlength=len(noted))
                        go = wanted & ~empty
                        down.append((xx[go], yy[go], ii[go], jj[go]))
            width += np.repeat(np.repeat(noted.reshape(SIDE // side, -1), side, 0), side, 1)
            x, y, i, j = (np.concatenate(z) for z in zip(*down, strict=True))
        apart = np.abs(a.leaf(x, a0[i]) - b.leaf(y, b0[j]))
        total += np.bincount(i * SIDE + j, weights=apart, minlength=SIDE * SIDE).astype(np.int64).reshape(SIDE, SIDE)  # below 2^53
    return total + width * np.abs(a0[:, None] - b0[None, :])


def meet_tiles(tile: pa.Table) -> pa.Table:
    """Cells (i, j, block, row, source, term, p, terms) of two tiles, with one row without a term for each source (p of an empty cell):
    (a, b, value, seen, apart, terms) for every pair of sources."""
    i, j = tile["i"][0].as_py(), tile["j"][0].as_py()
    block, row, p = (tile[c].to_numpy() for c in ("block", "row", "p"))
    head = tile["term"].is_null().to_numpy()
    coded = tile["term"].combine_chunks().dictionary_encode().indices.fill_null(0).to_numpy()
    support = np.bincount(coded[~head])
    place = np.empty(len(support), np.int64)
    place[np.argsort(-support, kind="stable")] = np.arange(len(support))
    squares = -(-len(support) // SIDE)
    sources = tile["source"].to_pylist()

    def side(k: int) -> tuple[SquareForest, np.ndarray, dict[int, str]]:
        mine, heads = (block == k) & ~head, np.flatnonzero((block == k) & head)
        empty = np.zeros(SIDE, np.int64)
        empty[row[heads]] = p[heads]
        return SquareForest(row[mine].astype(np.int64), place[coded[mine]], p[mine], squares), empty, {int(row[h]): sources[h] for h in heads}

    a, a0, names = side(i)
    b, b0, others = (a, a0, names) if i == j else side(j)
    sums = distances(a, b, a0, b0, squares, i == j)
    pairs = [(x, y) for x in names for y in others if i < j or x < y]
    x, y = (np.array(z, np.int64) for z in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
    n = len(pairs)
    out = {"lang": [tile["lang"][0].as_py()] * n, "a": [names[k] for k in x.tolist()], "b": [others[k] for k in y.tolist()]}
    numbers = {"value": sums[x, y], "seen": np.full(n, squares * SIDE), "apart": np.abs(a0[x] - b0[y]), "terms": np.full(n, tile["terms"][0].as_py())}
    return pa.table({k: pa.array(v, pa.string()) for k, v in out.items()} | {k: pa.array(v, pa.int64()) for k, v in numbers.items()})


def group_terms(docs: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """groups (lang, source, total, terms), cells (lang, source, term, n, lang_n) of kept terms, and langs (lang, lang_total, terms)."""
    counted = docs.mapInArrow(count_terms, "lang string, source string, term binary, n long, docs long")
    counted = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).checkpoint()
    kept = counted.where(F.col("term").isNotNull()).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= min_docs).drop("docs").checkpoint()
    cells = counted.where(F.col("term").isNotNull()).join(kept, ["lang", "term"]).select("lang", "source", F.col("term").cast("string").alias("term"), "n", "lang_n").checkpoint()
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count("*").alias("terms"))
    groups = counted.where(F.col("term").isNull()).select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    none = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("total", "lang_total", "terms")}
    return groups.withColumns(none).checkpoint(), cells, langs


def source_divergence(docs: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, top: int = TOP_TERMS, columns: int = COLUMNS) -> DataFrame:
    """(lang, source, part, item, value, rank): the distances from every other source (part ``pair``), and the ``top`` terms that the
    source has more of than its language (part ``term``)."""
    reliable_checkpoints(docs.sparkSession)
    small_batches(docs.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    groups, cells, _ = group_terms(docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text")), min_docs)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    tiles = F.ceil(F.col("sources") / F.lit(SIDE)).cast("int")
    sized = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    numbered = groups.withColumn("place", place).join(sized, "lang").select(
        "lang", "source", "total", "lang_total", "terms", tiles.alias("tiles"), F.floor(F.col("place") / SIDE).cast("int").alias("block"), (F.col("place") % SIDE).cast("int").alias("row"),
        F.greatest(F.lit(1), F.ceil(F.col("terms") / F.lit(columns))).cast("int").alias("blocks"),
    ).checkpoint()
    few = numbered.count() <= BROADCAST_GROUPS
    known = cells.join(F.broadcast(numbered) if few else numbered, ["lang", "source"])
    above = known.select("lang", "source", "term", (share("n", "total", "terms") - share("lang_n", "lang_total", "terms")).alias("value")).where("value > 0")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    shape = ["lang", "tiles", "block", "row", "source", "term", "p", "terms"]
    filled = known.withColumns({"p": share("n", "total", "terms"), "cb": F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")}).select(*shape, "cb")
    empty_p = F.when(F.col("terms") > 0, share("0L", "total", "greatest(terms, 1)")).otherwise(0)
    heads = numbered.withColumns({"p": empty_p, "term": F.lit(None).cast("string"), "cb": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))}).select(*shape, "cb")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    met = filled.unionByName(heads).withColumn("k", other).withColumns({"i": F.least("block", "k"), "j": F.greatest("block", "k")}).drop("k", "tiles")
    parts = met.groupBy("lang", "cb", "i", "j").applyInArrow(meet_tiles, "lang string, a string, b string, value long, seen long, apart long, terms long")
    pairs = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"), F.first("apart").alias("apart"), F.first("terms").alias("terms"))
    pairs = pairs.select("lang", "a", "b", (F.col("value") + (F.col("terms") - F.col("seen")) * F.col("apart")).alias("value")).checkpoint()
    both = pairs.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value").union(pairs.select("lang", "b", F.lit("pair"), "a", "value"))
    return both.withColumn("rank", F.row_number().over(best)).unionByName(terms)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30
), groups AS (SELECT DISTINCT lang, source FROM d
), cells AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL
), full_ AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS lang_n FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), totals AS (
  SELECT *, sum(n) OVER s AS total, sum(lang_n) OVER s AS lang_total, count(*) OVER s AS v FROM full_ WINDOW s AS (PARTITION BY lang, source)
), p AS (
  SELECT lang, source, term, n, 1 + CAST((1000000000::HUGEINT * (n + 5)) // (total + 5 * v) AS BIGINT) AS p, 1 + CAST((1000000000::HUGEINT * (lang_n + 5)) // (lang_total + 5 * v) AS BIGINT) AS q FROM totals
), pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), rows_ AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS "rank" FROM rows_)
SELECT lang, source, part, item, value, "rank" FROM ranked WHERE part = 'pair' OR "rank" <= 50
"""
