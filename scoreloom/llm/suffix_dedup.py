"""Removal of repeated byte strings with suffix arrays over shards.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. All such windows are judged, but no
window travels on its own:

1. In every window the smallest hash of its ``CORE``-byte substrings (the last of equal ones) names an anchor. Equal windows
   name the same anchor at the same place, so only occurrences of one anchor can hold equal windows. The windows of a text
   that name one anchor are consecutive and make up its context. One row per context is shuffled: anchor hash, context
   digest, place.
2. Anchors that occur once are done. Where all contexts of an anchor are equal, all of their windows repeat, and copies of one
   context stand for each other: both are told by the 64-bit digest of the context beside the anchor's hash, without its bytes.
   Two different contexts pass for one with a chance of 2^-64 a pair, and only pairs of one anchor count: with a million
   contexts on each of a million anchors the chance of any such error is below one in 30. The rest (edges of repeats) is dealt
   into shards by anchor, every distinct context once, and judged by its bytes.
3. A shard's contexts are joined to one string. Its suffix array is refined as Larsson and Sadakane do, doubling the depth and
   sorting again only what is still in groups; Kasai's pass gives common prefixes, for all contexts side by side. A window
   repeats if it has ``length`` bytes in common with a neighbour, or if its context occurs more than once.
4. An anchor with more than ``HOT_CONTEXTS`` contexts is dealt over several shards. Each of these gives the windows that it
   holds, sorted; windows of all shards are dealt by digest, and every shard's run is searched for in what the runs before it
   have left, by binary search.
5. What repeats goes back to the texts as intervals, joined by context, and is cut out there.

All exchanges are keyed by hashes and pre-aggregated where keys repeat; where an anchor or a context is frequent, the joins back
to its occurrences deal them over several tasks. No text is gathered with others; a shard's text is bounded by ``SHARD_BYTES``.

Defined cases: null counts as the empty text; texts shorter than ``length`` lose nothing; repeated rows are separate places,
so each of them loses everything that is long enough; ids of any type are only carried and may be null or repeat; an empty table gives no
rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.llm.words import mix64, small_batches, utf8
from scoreloom.operators.skew import hot_values, salted_join
from scoreloom.session import reliable_checkpoints

LENGTH = 200
CORE = 64
HOT_CONTEXTS = 2000
#: Places (contexts to cut out, or ends of intervals) of at most some 40 bytes each that may be broadcast; more are joined by shuffling.
BROADCAST_PLACES = 1_000_000
SHARD_BYTES = 1 << 19
_STRIP = 1 << 16
_PLACE_BITS = 17
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def _core_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the CORE bytes from each position on."""
    h, width = data.astype(np.uint64), 1
    while width < 8:  # the bytes themselves
        m = len(h) - width
        h = h[:m] | (h[width:] << np.uint64(8 * width))
        width *= 2
    while width < CORE:
        m = len(h) - width
        h, right = h[:m] * _LEFT, h[width:] * _RIGHT
        h += right
        h ^= h >> np.uint64(31)
        width *= 2
    return mix64(h)


def contexts(data: np.ndarray, at: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, anchor hash, context digest) of all texts (bytes and offsets), in order.

    Goes through the bytes strip by strip, whatever texts they belong to. A strip looks at one window before it and at all
    that the contexts that start in it can hold, so contexts are the same wherever strips begin.
    """
    n, span = len(data), length - CORE + 1
    low = np.uint64((1 << _PLACE_BITS) - 1)
    tails = np.maximum(at[1:] - length + 1, at[:-1])  # from here on a text's windows would leave it
    found: list[tuple[np.ndarray, ...]] = []
    for a in range(0, max(n - length + 1, 0), _STRIP):
        begin, stop = max(a - 1, 0), min(a + _STRIP + span, n - length + 1)
        m = stop - begin
        h = _core_hashes(data[begin : stop + length - 1])
        place = np.arange(len(h), dtype=np.uint64)
        best = (h & ~low) | (low - place)
        width = 1
        while width * 2 <= span:
            best = np.minimum(best[: len(best) - width], best[width:])
            width *= 2
        best = np.minimum(best[:m], best[span - width :][:m])
        pick = (low - (best & low)).astype(np.int64)
        near = slice(max(int(np.searchsorted(at, begin, side="right")) - 1, 0), int(np.searchsorted(at, stop)))
        change = np.bincount(np.clip(tails[near] - begin, 0, m), minlength=m + 1) - np.bincount(np.clip(at[1:][near] - begin, 0, m), minlength=m + 1)
        valid = np.cumsum(change[:m]) == 0
        turn = np.flatnonzero(np.diff(pick) | (valid[1:] != valid[:-1])) + 1  # where another context, or none, begins
        first = np.concatenate([[0], turn])
        last = np.append(turn, m) - 1
        mine = valid[first] & (first + begin >= a) & (first + begin < a + _STRIP)
        first, last = first[mine], last[mine]
        anchor, end = pick[first], last + length
        digest = ((end - first) << 16 | (anchor - first)).astype(np.uint64)
        for k in range(0, length + span - 1, CORE):
            digest = mix64(digest * np.uint64(3) + h[np.minimum(first + k, end - CORE)])
        text = np.searchsorted(at, first + begin, side="right") - 1
        found.append((text, first + begin - at[text], last + begin - at[text], h[anchor].view(np.int64), digest.view(np.int64)))
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (empty,) * 5


def suffix_array(text: np.ndarray) -> np.ndarray:
    """All suffixes in order (Kasai's bound needs the full order, so nothing is left undecided)."""
    n = len(text)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = text
    key = np.zeros(n, np.uint64)
    for j in range(7):  # seven symbols of nine bits
        key = (key << np.uint64(9)) | padded[j : j + n]
    order = np.argsort(key)
    fresh = np.flatnonzero(np.diff(key[order], prepend=key[order[:1]] + np.uint64(1)) != 0)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(fresh, np.diff(np.append(fresh, n)))  # a group's rank is its first place
    width = 7
    while True:
        size = np.bincount(rank, minlength=n)
        open_ = np.flatnonzero(size[rank[order]] > 1)  # places that are still in groups
        if not len(open_):
            break
        at = order[open_]
        after = np.where(at + width < n, rank[np.minimum(at + width, n - 1)], -1)
        both = rank[at] * (n + 1) + after + 1
        again = np.argsort(both)
        order[open_] = at[again]
        new = np.flatnonzero(np.diff(both[again], prepend=-1) != 0)
        rank[at[again]] = np.repeat(open_[new], np.diff(np.append(new, len(open_))))
        width *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``order``, up to ``most``, inside its own piece of the text.

    Kasai's pass goes through a piece from left to right and loses at most one symbol at each step; all pieces advance together.
    """
    n = len(text)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    end_of = np.zeros(n, np.int64)
    lengths = ends - starts
    end_of[np.arange(int(lengths.sum())) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths)] = np.repeat(ends, lengths)
    words = np.zeros(n + 8, np.uint64)  # eight symbols' low bytes from each place on; the pieces' ends are looked after below
    words[:n] = text & 255
    for width in (1, 2, 4):
        words[:-width] |= words[width:] << np.uint64(8 * width)
    lcp = np.zeros(n, np.int64)
    piece = np.arange(len(starts))
    have = np.zeros(len(starts), np.int64)
    step = 0
    while len(piece):
        i = starts[piece] + step
        j = before[i]
        h = np.where(j >= 0, np.maximum(have[piece] - 1, 0), 0)
        room = np.minimum(np.minimum(end_of[i] - i, np.where(j >= 0, end_of[j] - j, 0)), most)
        h = np.minimum(h, room)
        grow = np.flatnonzero(h < room)
        while len(grow):
            apart = words[i[grow] + h[grow]] ^ words[j[grow] + h[grow]]
            h[grow] = np.minimum(h[grow] + (np.bitwise_count((apart & -apart) - np.uint64(1)) >> 3), room[grow])
            grow = grow[(apart == 0) & (h[grow] < room[grow])]
        lcp[i] = h
        have[piece] = h
        step += 1
        piece = piece[starts[piece] + step < ends[piece]]
    return lcp


def repeated_windows(pieces: list[bytes], counts: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each piece, which of its windows occur more than once among all pieces (a piece may stand for several)."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    ends = starts + sizes
    text = np.zeros(int(sizes.sum()) + len(pieces), np.int64)  # 0 ends a piece
    for s, p in zip(starts.tolist(), pieces, strict=True):
        text[s : s + len(p)] = np.frombuffer(p, np.uint8).astype(np.int64) + 1
    order = suffix_array(text)
    inside = text[order] > 0
    order = order[inside]
    lcp = common_prefixes(text, order, starts, ends, length)
    hit = np.zeros(len(text), bool)
    long_ = np.flatnonzero(lcp[order] >= length)
    hit[order[long_]] = True
    hit[order[long_ - 1]] = True
    return [np.ones(n - length + 1, bool) if c > 1 else hit[s : s + n - length + 1] for s, n, c in zip(starts.tolist(), sizes.tolist(), counts, strict=True)]


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist(), strict=True))


def _judge_shard(batches, length: int):
    """Rows (anchor, digest, part, piece, copies) sorted by (anchor, part) -> (anchor, digest, first, last) of repeated windows.

    Works on whole groups of (anchor, part), as many at a time as fit SHARD_BYTES.
    """
    held: list[tuple] = []
    size, last_key = 0, None

    def flush():
        found = repeated_windows([r[3] for r in held], [r[4] for r in held], length)
        rows = [(r[0], r[1], a, b) for r, mask in zip(held, found, strict=True) for a, b in _runs(mask)]
        held.clear()
        columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32())], names=["h", "c", "first", "last"])

    for batch in batches:
        for row in zip(*[batch.column(k).to_pylist() for k in ("h", "c", "part", "piece", "copies")], strict=True):
            key = (row[0], row[2])
            if size >= SHARD_BYTES and key != last_key:
                yield flush()
                size = 0
            held.append(row)
            size += len(row[3])
            last_key = key
    if held:
        yield flush()


def _merge_runs(batches):
    """Rows (w, part) sorted by (part, w), each shard's run without repeats -> digests that more than one shard holds.

    Every run is looked up in the sorted union of the runs before it by binary search, and then merged into it.
    """
    union, repeated = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def take(run: np.ndarray) -> None:
        nonlocal union, repeated
        at = np.searchsorted(union, run)
        known = np.zeros(len(run), bool)
        inside = at < len(union)
        known[inside] = union[at[inside]] == run[inside]
        repeated = np.union1d(repeated, run[known])
        union = np.insert(union, at[~known], run[~known])

    held, part = [], None
    for batch in batches:
        w, parts = batch.column("w").to_numpy(zero_copy_only=False), batch.column("part").to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(w)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b > a:
                if part is not None and parts[a] != part:
                    take(np.concatenate(held))
                    held = []
                held.append(w[a:b])
                part = parts[a]
    if held:
        take(np.concatenate(held))
    yield pa.RecordBatch.from_arrays([pa.array(repeated, pa.int64())], names=["w"])


def repeated_intervals(docs: DataFrame, *, id_col: str, text_col: str, length: int, hot_contexts: int, broadcast_places: int) -> tuple[DataFrame, DataFrame]:
    """The texts as (_id, _d, _x, _t), and (_d, _x, cuts): sorted byte intervals [start, end) to remove from each."""
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    # What is removed depends on the text alone: rows that agree in both keys may share it. Ids that are no integers are hashed.
    whole = isinstance(docs.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    number = F.coalesce(F.col(id_col).cast("long"), F.lit(0)) if whole else F.xxhash64(F.col(id_col))
    texts = docs.select(F.col(id_col).alias("_id"), number.alias("_d"), F.xxhash64(raw).alias("_x"), raw.alias("_t"))
    place = T.ArrayType(T.StructType([T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType()), T.StructField("h", T.LongType()), T.StructField("c", T.LongType())]))

    @F.arrow_udf(place)
    def anchored(column: pa.Array) -> pa.Array:
        text, *columns = contexts(*utf8(column), length)
        counts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(column)))])
        flat = pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["lo", "hi", "h", "c"])
        return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), flat)

    rows = texts.select("_d", "_x", F.explode(anchored("_t")).alias("a")).select("_d", "_x", "a.*")
    met = rows.groupBy("h").agg(F.count("*").alias("n"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("n > 1").select("h", "n", (F.col("c0") != F.col("c1")).alias("mixed")).checkpoint()
    frequent = hot_values(met, "h", "n")
    found = salted_join(rows, met.select("h", "mixed"), "h", frequent, [F.col("_d"), F.col("_x"), F.col("lo")]).checkpoint()
    whole = found.where(~F.col("mixed")).select("_d", "_x", F.col("lo").alias("start"), (F.col("hi") + length).alias("end"))
    edges = found.where("mixed").select("_d", "_x", "lo", "hi", "h", "c")

    @F.arrow_udf(T.ArrayType(T.BinaryType()))
    def cut_out(text: pa.Array, lo: pa.Array, hi: pa.Array) -> pa.Array:
        out = []
        for t, a, b in zip(text, lo, hi, strict=True):
            t = t.as_py()
            out.append([t[x : y + length] for x, y in zip(a.as_py(), b.as_py(), strict=True)])
        return pa.array(out, pa.list_(pa.binary()))

    # One place stands for all that have the same context, so every distinct context is cut out and shuffled once.
    contexts_ = edges.groupBy("h", "c").agg(F.min(F.struct("_d", "_x", "lo", "hi")).alias("at"), F.count("*").alias("copies")).checkpoint()
    fullness = contexts_.groupBy("h").agg(F.count("*").alias("k"))
    hot_, parts = F.col("k") > hot_contexts, F.ceil(F.col("k") / F.lit(hot_contexts)).cast("int")
    counted = salted_join(contexts_, fullness, "h", hot_values(fullness, "h", "k"), [F.col("c")])
    kinds = counted.select("at.*", "h", "c", "copies", F.when(hot_, F.pmod(F.xxhash64("c"), parts)).otherwise(0).cast("int").alias("part"), hot_.alias("hot"))
    few = contexts_.limit(broadcast_places + 1).count() <= broadcast_places

    def opened(some: DataFrame) -> DataFrame:
        """Contexts with their bytes."""
        by_text = some.groupBy("_d", "_x").agg(F.collect_list(F.struct("lo", "hi", "h", "c", "copies", "part")).alias("e"))
        found = texts.join(F.broadcast(by_text) if few else by_text, ["_d", "_x"]).select("e", cut_out(F.col("_t"), F.col("e.lo"), F.col("e.hi")).alias("piece"))
        return found.select(F.explode(F.arrays_zip("e", "piece")).alias("z")).select("z.e.h", "z.e.c", "z.e.copies", "z.e.part", "z.piece")

    dealt = opened(kinds)
    shards = dealt.repartition("h", "part").sortWithinPartitions("h", "part")
    judged = shards.select("h", "c", "part", "piece", "copies").mapInArrow(lambda batches: _judge_shard(batches, length), "h long, c long, first int, last int")

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def window_digests(piece: pa.Array) -> pa.Array:
        data, at = utf8(piece)
        h = _core_hashes(data) if len(data) >= CORE else np.zeros(0, np.uint64)
        counts = np.maximum(np.diff(at) - length + 1, 0)
        place = np.concatenate([[0], np.cumsum(counts)])
        first = np.arange(place[-1]) + np.repeat(at[:-1] - place[:-1], counts)
        digest = np.full(len(first), length, np.uint64)
        for k in range(0, length, CORE):
            digest = mix64(digest * np.uint64(3) + h[first + min(k, length - CORE)])
        return pa.ListArray.from_arrays(pa.array(place, pa.int32()), pa.array(digest.view(np.int64)))

    hot = opened(kinds.where("hot")).select("h", "c", "part", F.posexplode(window_digests("piece")).alias("first", "w"))
    runs = hot.select("w", "part").distinct()
    across = runs.repartition("w").sortWithinPartitions("part", "w").mapInArrow(_merge_runs, "w long")
    merged = hot.join(across, "w").select("h", "c", "first", F.col("first").alias("last"))
    found_ = judged.unionByName(merged) if not kinds.where("hot").isEmpty() else judged
    # All windows of a context cover its anchor, so what they cover together is one interval, and a context gets one row.
    windows = found_.groupBy("h", "c").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    # It goes to all occurrences of the context; a frequent context's are dealt over several tasks.
    often = hot_values(contexts_.groupBy("c").agg(F.sum("copies").alias("n")), "c", "n")
    both = salted_join(edges.withColumnRenamed("h", "h2"), windows, "c", often, [F.col("_d"), F.col("_x"), F.col("lo")]).where("h = h2")
    some = both.select("_d", "_x", (F.col("lo") + F.col("first")).alias("start"), (F.col("lo") + F.col("last") + length).alias("end"))

    @F.arrow_udf(_SPANS)
    def united(spans: pa.Array) -> pa.Array:
        out = []
        for row in spans:
            merged_: list[dict] = []
            for x in row.as_py():
                if merged_ and x["start"] <= merged_[-1]["end"]:
                    merged_[-1]["end"] = max(merged_[-1]["end"], x["end"])
                else:
                    merged_.append(x)
            out.append(merged_)
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

    spans = whole.unionByName(some).distinct().groupBy("_d", "_x").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("s"))
    return texts, spans.select("_d", "_x", united("s").alias("cuts"))


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot_contexts: int = HOT_CONTEXTS, broadcast_places: int = BROADCAST_PLACES) -> DataFrame:
    """Per row of ``docs``: the id, n_bytes, removed (array of [start, end)) and kept (the remaining bytes)."""
    reliable_checkpoints(docs.sparkSession)
    small_batches(docs.sparkSession)
    texts, cuts = repeated_intervals(docs, id_col=id_col, text_col=text_col, length=length, hot_contexts=hot_contexts, broadcast_places=broadcast_places)
    cuts = cuts.checkpoint()
    few = cuts.agg(F.coalesce(F.sum(F.size("cuts") + 2), F.lit(0))).first()[0] <= broadcast_places
    joined = texts.join(F.broadcast(cuts) if few else cuts, ["_d", "_x"], "left").select("_id", "_t", "cuts")

    @F.arrow_udf(T.BinaryType())
    def without(text: pa.Array, cut: pa.Array) -> pa.Array:
        kept = []
        for t, c in zip(text, cut, strict=True):
            t = t.as_py()
            edges = [0, *[e for s in c.as_py() or () for e in (s["start"], s["end"])], len(t)]
            kept.append(b"".join(t[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
        return pa.array(kept, pa.binary())

    return joined.select(F.col("_id").alias(id_col), F.length("_t").cast("long").alias("n_bytes"), F.coalesce("cuts", F.array().cast(_SPANS)).alias("removed"), without("_t", "cuts").alias("kept"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]).cast("long"))
    return done.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
