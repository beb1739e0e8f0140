"""Benchmark decontamination by winnowing.

A shared span of at least ``window`` words always holds a k-gram that winnowing selects on both sides: of every
``window - k + 1`` consecutive k-grams the smallest hash is kept, and the choice looks at nothing outside them.

1. The benchmark becomes two narrow tables: its distinct fingerprints (items shorter than a window are one fingerprint of
   their own length), and its windows with the items that own them.
2. Document fingerprints are joined with the benchmark's. Up to ``broadcast_prints`` distinct ones (a count that is looked at
   first; 8 bytes each) are sent to the workers and looked up as the texts stream past; more are joined by shuffling.
3. Around each hit the windows that can hold it extend it: they are joined with the benchmark's windows, so every reported
   window is one in full. Overlapping windows unite to spans.

Only texts with hits are ever shuffled, once for each distinct text, and only as keys, positions and hashes. What comes back
to the documents is broadcast up to ``broadcast_places`` keys, spans and item ids in all, and joined by shuffling otherwise.

Defined cases: a null text has no words and no hits; an empty benchmark hits nothing; items without words are ignored; a
null item_id counts as an item of its own and is written as the empty string; rows are judged by their text alone, so
repeated rows get the same result; an empty table gives no rows; all input columns are returned unchanged next to the new
ones, and names that clash with these are refused.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.llm.words import ALNUM, blocks, mix64, ngram_hashes, small_batches, utf8, within_rows, word_hashes
from scoreloom.session import reliable_checkpoints

WINDOW = 13
K = 7
#: Distinct fingerprints of the benchmark that may be broadcast (8 bytes each).
BROADCAST_PRINTS = 2_000_000
#: Ends of spans and item ids (and two keys) of texts with hits that may be broadcast, of at most some 40 bytes each.
BROADCAST_PLACES = 500_000

_INT, _LONG = pa.int32(), pa.int64()
_PRINT = T.ArrayType(T.StructType([T.StructField("size", T.IntegerType()), T.StructField("h", T.LongType()), T.StructField("pos", T.IntegerType())]))
_FOUND = T.ArrayType(T.StructType([T.StructField("size", T.IntegerType()), T.StructField("w", T.LongType()), T.StructField("start", T.IntegerType())]))
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def _winnow(grams: np.ndarray, ok: np.ndarray, span: int) -> np.ndarray:
    """Positions of the k-grams that are the last smallest of some ``span`` consecutive ones of one row.

    Where fewer than ``span`` follow in a row, no window starts; every full window selects one position.
    """
    m = len(grams) - span + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    best, at = grams[:m].copy(), np.zeros(m, np.int64)
    whole = ok[:m].copy()
    for j in range(1, span):
        nxt = grams[j : j + m]
        take = nxt <= best
        best[take] = nxt[take]
        at[take] = j
        whole &= ok[j : j + m]
    picked = np.zeros(len(grams), bool)
    picked[(at + np.arange(m))[whole]] = True
    return np.flatnonzero(picked)


def _prints(words: np.ndarray, offsets: np.ndarray, size: int, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of what is looked up for items of ``size`` words: winnowed k-grams, or below a window all n-grams."""
    n = k if size == window else size
    grams = ngram_hashes(words, n)
    inside = within_rows(offsets, n, len(grams))
    at = _winnow(grams, inside, window - k + 1) if size == window else np.flatnonzero(inside)
    return grams[at], at


def _extend(words: np.ndarray, offsets: np.ndarray, at: np.ndarray, size: int, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows that can hold what was looked up at the places ``at``."""
    starts = at
    if size == window:
        near = (at[:, None] - np.arange(window - k + 1)[None, :]).ravel()
        starts = np.unique(near[(near >= 0) & (near + size <= len(words))])
    starts = starts[within_rows(offsets, size, len(words) - size + 1)[starts]]
    whole = np.zeros(len(starts), np.uint64)
    for j in range(size):
        whole = mix64(whole ^ words[starts + j]) if j == 0 else mix64(whole * np.uint64(3) + words[starts + j])
    return starts, whole


def _member(keys: np.ndarray, probe: np.ndarray) -> np.ndarray:
    """Which probes are among the sorted keys."""
    if len(keys) == 0 or len(probe) == 0:
        return np.zeros(len(probe), bool)
    return keys[np.minimum(np.searchsorted(keys, probe), len(keys) - 1)] == probe


def _lists(rows: list[tuple[np.ndarray, ...]], n: int, names: tuple[str, str, str]) -> pa.Array:
    """One list of structs for each of ``n`` rows from (row, size, hash, position) arrays in any order."""
    row, size, hashes, place = (np.concatenate(x) if rows else np.zeros(0, np.int64) for x in (zip(*rows, strict=True) if rows else ((),) * 4))
    order = np.argsort(row, kind="stable")
    counts = np.concatenate([[0], np.cumsum(np.bincount(row.astype(np.int64), minlength=n))])
    flat = pa.StructArray.from_arrays([pa.array(size[order], _INT), pa.array(hashes[order].view(np.int64), _LONG), pa.array(place[order], _INT)], names=list(names))
    return pa.ListArray.from_arrays(pa.array(counts, _INT), flat)


def _each_block(texts: pa.Array):
    """(first row, words, offsets, row of a word place, place inside its row) of the texts, some at a time."""
    data, at = utf8(texts)
    for lo, hi in blocks(at):
        words, offsets = word_hashes(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], ALNUM)
        yield lo, words, offsets, lambda p, o=offsets: np.searchsorted(o, p, side="right") - 1


def _prints_of(texts: pa.Array, sizes: list[int], window: int, k: int) -> pa.Array:
    """All fingerprints of every text."""
    rows = []
    for lo, words, offsets, row_of in _each_block(texts):
        for size in sizes:
            h, at = _prints(words, offsets, size, window, k)
            row = row_of(at)
            rows.append((row + lo, np.full(len(at), size), h, at - offsets[row]))
    return _lists(rows, len(texts), ("size", "h", "pos"))


def _windows_near(texts: pa.Array, known: dict[int, np.ndarray], window: int, k: int) -> pa.Array:
    """The windows of every text around its fingerprints that are among the known ones."""
    rows = []
    for lo, words, offsets, row_of in _each_block(texts):
        for size, keys in known.items():
            h, at = _prints(words, offsets, size, window, k)
            starts, whole = _extend(words, offsets, at[_member(keys, h)], size, window, k)
            row = row_of(starts)
            rows.append((row + lo, np.full(len(starts), size), whole, starts - offsets[row]))
    return _lists(rows, len(texts), ("size", "w", "start"))


def _windows_at(texts: pa.Array, hits: pa.Array, window: int, k: int) -> pa.Array:
    """The windows of every text around the places given with it."""
    rows = []
    for lo, words, offsets, row_of in _each_block(texts):
        some = hits.slice(lo, len(offsets) - 1)
        flat = some.flatten()
        place = flat.field("pos").to_numpy(zero_copy_only=False) + np.repeat(offsets[:-1], some.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        sizes = flat.field("size").to_numpy(zero_copy_only=False)
        for size in np.unique(sizes).tolist():
            starts, whole = _extend(words, offsets, np.unique(place[sizes == size]), size, window, k)
            row = row_of(starts)
            rows.append((row + lo, np.full(len(starts), size), whole, starts - offsets[row]))
    return _lists(rows, len(texts), ("size", "w", "start"))


def _item_windows(texts: pa.Array, window: int) -> pa.Array:
    """The windows of every item: all of ``window`` words, or the whole of a shorter one."""
    rows = []
    for lo, words, offsets, _ in _each_block(texts):
        for item, n in enumerate(np.diff(offsets).tolist()):
            if n:
                size = min(n, window)
                h = ngram_hashes(words[offsets[item] : offsets[item + 1]], size)
                rows.append((np.full(len(h), item + lo), np.full(len(h), size), h, np.arange(len(h))))
    return _lists(rows, len(texts), ("size", "w", "start"))


@F.arrow_udf(T.LongType())
def count_words(texts: pa.Array) -> pa.Array:
    """Number of words of each text."""
    counts = []
    data, at = utf8(texts)
    for lo, hi in blocks(at):
        # Lower case changes no byte's being one of a word, but the table only knows lower-case letters.
        letters = np.append(False, (ALNUM | ALNUM[np.arange(256) | 32] & (np.arange(256) >= 65) & (np.arange(256) <= 90))[data[at[lo] : at[hi]]])
        begins = letters[1:] & ~letters[:-1]
        first = at[lo:hi][np.diff(at[lo : hi + 1]) > 0] - at[lo]
        begins[first] = letters[1:][first]
        total = np.concatenate([[0], np.cumsum(begins)])
        counts.append(np.diff(total[at[lo : hi + 1] - at[lo]]))
    return pa.array(np.concatenate(counts) if counts else [], _LONG)


@F.arrow_udf(_SPANS)
def _unite(windows: pa.Array) -> pa.Array:
    out = []
    for row in windows:
        spans: list[dict] = []
        for x in row.as_py():
            if spans and x["start"] <= spans[-1]["end"]:
                spans[-1]["end"] = max(spans[-1]["end"], x["start"] + x["size"])
            else:
                spans.append({"start": x["start"], "end": x["start"] + x["size"]})
        out.append(spans)
    return pa.array(out, pa.list_(pa.struct([("start", _INT), ("end", _INT)])))


def _keys(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("_x"), F.xxhash64(F.lit(1), text).alias("_y")]


def contaminated_texts(texts: DataFrame, benchmark: DataFrame, *, item_id_col: str, item_text_col: str, window: int, k: int, broadcast_prints: int) -> DataFrame:
    """(_x, _y, spans, items) of the distinct texts (column ``t``) that hold a window of an item."""
    reliable_checkpoints(texts.sparkSession)
    small_batches(texts.sparkSession)
    items = benchmark.select(F.coalesce(F.col(item_id_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).alias("t")).where("t is not null")
    item_windows = F.arrow_udf(lambda t: _item_windows(t, window), _FOUND)
    windows = items.select("item", F.explode(item_windows("t")).alias("x")).select("item", "x.size", "x.w").distinct().checkpoint()
    item_prints = F.arrow_udf(lambda t: _prints_of(t, [window], window, k), _PRINT)
    long_ = items.select(F.explode(item_prints("t")).alias("x")).select("x.size", "x.h")
    prints = long_.unionByName(windows.where(F.col("size") < window).select("size", F.col("w").alias("h"))).distinct().checkpoint()
    texts = texts.select("t").where("t is not null")
    if prints.limit(broadcast_prints + 1).count() <= broadcast_prints:
        table = prints.toArrow()
        sizes, hashes = table["size"].to_numpy(), table["h"].to_numpy().view(np.uint64)
        known = texts.sparkSession.sparkContext.broadcast({s: np.sort(hashes[sizes == s]) for s in np.unique(sizes).tolist()})
        # Else the filter would be pushed below and call it again, in a second worker beside each task's first.
        near = F.arrow_udf(lambda t: _windows_near(t, known.value, window, k), _FOUND).asNondeterministic()
        found = texts.select(*_keys(F.col("t")), near("t").alias("f")).where(F.size("f") > 0)
    else:
        sizes = [r["size"] for r in prints.select("size").distinct().collect()]  # at most ``window`` numbers
        all_prints = F.arrow_udf(lambda t: _prints_of(t, sizes, window, k), _PRINT)
        own = texts.select(*_keys(F.col("t")), F.explode(all_prints("t")).alias("p")).select("_x", "_y", "p.*")
        met = own.join(prints, ["size", "h"]).groupBy("_x", "_y").agg(F.collect_set(F.struct("size", "pos")).alias("hits"))
        around = F.arrow_udf(lambda t, hits: _windows_at(t, hits, window, k), _FOUND)
        found = texts.withColumns({"_x": _keys(F.col("t"))[0], "_y": _keys(F.col("t"))[1]}).join(met, ["_x", "_y"]).select("_x", "_y", around("t", "hits").alias("f"))
    single = found.dropDuplicates(["_x", "_y"]).select("_x", "_y", F.explode("f").alias("f")).select("_x", "_y", "f.*")
    hits = single.join(windows, ["size", "w"])
    grouped = hits.groupBy("_x", "_y").agg(F.sort_array(F.collect_set(F.struct("start", "size"))).alias("s"), F.sort_array(F.collect_set("item")).alias("items"))
    return grouped.select("_x", "_y", _unite("s").alias("spans"), "items")


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, k: int = K,
    broadcast_prints: int = BROADCAST_PRINTS, broadcast_places: int = BROADCAST_PLACES, prefix: str = "contam_",
) -> DataFrame:
    """Add ``contam_n_words``, ``contam_spans`` (array of [start, end) in words) and ``contam_items`` (sorted ids) to every row."""
    added = [prefix + x for x in ("n_words", "spans", "items")]
    if not 1 <= k <= window:
        raise ValueError("k must lie between 1 and window")
    if clash := {*added, "_x", "_y"} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} clash")
    hits = contaminated_texts(docs.select(F.col(text_col).alias("t")), benchmark, item_id_col=item_id_col, item_text_col=item_text_col, window=window, k=k, broadcast_prints=broadcast_prints).checkpoint()
    few = hits.agg(F.coalesce(F.sum(2 + F.size("spans") + F.size("items")), F.lit(0))).first()[0] <= broadcast_places
    keyed = docs.withColumns(dict(zip(("_x", "_y"), _keys(F.col(text_col)), strict=True)))
    joined = keyed.join(F.broadcast(hits) if few else hits, ["_x", "_y"], "left")
    return joined.select(
        *docs.columns,
        count_words(F.col(text_col)).alias(added[0]),
        F.coalesce("spans", F.array().cast(_SPANS)).alias(added[1]),
        F.coalesce("items", F.array().cast("array<string>")).alias(added[2]),
    )


def _n_hit(spans: str = "contam_spans") -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"]).cast("long"))


def contamination_report(docs: DataFrame, benchmark: DataFrame, **options: object) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256 and contaminated (a hit, and 20 * n_hit >= n_words)."""
    found = find_contamination(docs.select("doc_id", "text"), benchmark, **options)
    return found.select(
        "doc_id",
        F.col("contam_n_words").alias("n_words"),
        _n_hit().alias("n_hit"),
        F.size("contam_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("contam_items", ",").cast("binary"), 256).alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options: object) -> DataFrame:
    """The documents that the contract's rule does not call contaminated, with their own columns only."""
    found = find_contamination(docs, benchmark, **options)
    return found.where(~((_n_hit() > 0) & (_n_hit() * 20 >= F.col("contam_n_words")))).select(*docs.columns)


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
