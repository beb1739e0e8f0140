"""Removal of repeated word passages by compaction of a de Bruijn graph.

Nodes are runs of ``window - 1`` words, edges are windows of ``window`` words. An edge is told by the hashes of both of its nodes
(128 bits), so windows are never shuffled as text, and no edge of a window that only one document has is ever shuffled.

1. In every window the smallest hash of its ``CORE``-word runs (the last of equal ones) names an anchor, so equal windows name
   the same one. Anchors are counted by document, combined before they are shuffled; those of one document alone are done.
2. The consecutive windows of a text that name one of the other anchors are a piece: its place and the hashes of its nodes. Where
   all pieces of an anchor are equal, each of their windows has the same occurrences, and the piece is one edge of several windows.
   Other pieces, each distinct one once, are taken apart into edges of one window: those of one anchor together, or of an anchor
   with many pieces by a shuffle of edges. An edge keeps the coordinates (document, position) where it occurs first, and goes if no
   second document has it.
3. Degrees of nodes are counted and joined to the edges. Edges that follow each other in their source compact to one path, unless
   the node between them branches (nodes inside a piece are left alone: its windows have the same occurrences anyway). A path is
   thus a literal passage of its source: (document, position, length).
4. Pieces carry their edges' coordinates to all places of the texts, where a piece with frequent occurrences is dealt over several
   tasks. Places whose words and source coordinates advance together are one span. Spans are joined with the paths of their source,
   and only what lies on a path, at least ``window`` words of a source with a smaller id, is cut out.

Texts that are equal are one class: only its first document takes part, and every later one with at least ``window`` words goes as
a whole. That needs no window.

What is broadcast is counted first (``broadcast_places``, ``broadcast_anchors``); beyond, anchors and copies are joined by shuffling.

Defined cases: null counts as the empty text; texts shorter than a window lose nothing, also if they are copies; a null id is
neither smaller nor larger than any other, so its row loses nothing and is no source; rows that repeat an id are one document (a
window is not removed because of another row of the same id) and each keep their row; ids of any type that can be ordered are
compared as such; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.llm.tables import Workspace
from scoreloom.llm.words import NOT_SPACE, blocks, ngram_hashes, small_batches, utf8, within_rows, word_hashes
from scoreloom.operators.skew import hot_values, salted_join
from scoreloom.session import reliable_checkpoints

WINDOW = 13
CORE = 4
#: Classes of copies (some 24 bytes each) that may be broadcast.
BROADCAST_PLACES = 1_000_000
#: Anchors (8 bytes each) that may be broadcast.
BROADCAST_ANCHORS = 2_000_000

#: Pieces of one anchor that are judged together, pieces judged at a time, and words of a source in which spans and paths meet.
HOT_KINDS, JUDGED_ROWS, STRETCH = 2000, 50_000, 256

_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def pieces(words: np.ndarray, offsets: np.ndarray, window: int, core: int) -> tuple[np.ndarray, ...]:
    """(first window, number of windows, anchor hash) of the maximal runs of windows that name one anchor, in order."""
    m = len(words) - window + 1
    if m <= 0:
        return (np.zeros(0, np.int64),) * 3
    grams = ngram_hashes(words, core)
    best, at = grams[:m].copy(), np.arange(m)
    for j in range(1, window - core + 1):
        take = grams[j : j + m] <= best
        best[take] = grams[j : j + m][take]
        at[take] = np.flatnonzero(take) + j
    whole = within_rows(offsets, window, m)
    turn = np.flatnonzero((np.diff(at) != 0) | (whole[1:] != whole[:-1])) + 1
    first = np.concatenate([[0], turn])
    count = np.diff(np.append(first, m))
    mine = whole[first]
    return first[mine], count[mine], best[first[mine]].view(np.int64)


def _each_block(texts: pa.Array):
    """(first row, words, offsets) of the texts, some at a time."""
    data, at = utf8(texts)
    for lo, hi in blocks(at):
        yield lo, *word_hashes(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], NOT_SPACE, None)


def anchors_of(texts: pa.Array, window: int, core: int) -> pa.Array:
    """The distinct anchors of every text."""
    out = []
    for _, words, offsets in _each_block(texts):
        first, _, anchor = pieces(words, offsets, window, core)
        cut = np.searchsorted(first, offsets)
        out += [np.unique(anchor[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return pa.array(out, pa.list_(pa.int64()))


_PIECE = T.ArrayType(T.StructType([T.StructField("lo", T.IntegerType()), T.StructField("h", T.LongType()), T.StructField("nodes", T.ArrayType(T.LongType()))]))


def pieces_of(texts: pa.Array, wanted: pa.Array | None, window: int, core: int, with_nodes: bool = True) -> pa.Array:
    """The pieces of every text (place, anchor, hashes of nodes), of ``wanted`` places only if these are given."""
    row, place, anchor, sizes, nodes = [], [], [], [], []
    for start, words, offsets in _each_block(texts):
        first, count, h = pieces(words, offsets, window, core)
        text = np.searchsorted(offsets, first, side="right") - 1
        if wanted is not None:
            some = wanted.slice(start, len(offsets) - 1)
            at = some.flatten().to_numpy(zero_copy_only=False) + np.repeat(offsets[:-1], some.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            mine = np.isin(first, at)
            first, count, h, text = first[mine], count[mine], h[mine], text[mine]
        row.append(text + start)
        place.append(first - offsets[text])
        anchor.append(h)
        if with_nodes:
            size = count + 1
            ends = np.cumsum(size)
            all_nodes = ngram_hashes(words, window - 1)
            nodes.append(all_nodes[np.arange(int(size.sum())) + np.repeat(first - ends + size, size)].view(np.int64))
        else:
            size = np.zeros_like(count)
        sizes.append(size)
    row, place, anchor, sizes, nodes = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (row, place, anchor, sizes, nodes))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(nodes, pa.int64()))
    flat = pa.StructArray.from_arrays([pa.array(place, pa.int32()), pa.array(anchor, pa.int64()), lists], names=["lo", "h", "nodes"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(texts)))]), pa.int32()), flat)


def _few(df: DataFrame, bound: int) -> bool:
    return df.limit(bound + 1).count() <= bound


def _maybe_broadcast(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def first_texts(texts: DataFrame, broadcast_places: int) -> tuple[DataFrame, DataFrame]:
    """The texts (_id, _x, _y, _t) with ``_first``, the smallest id of a text that several ids have (else null); and those of them
    that are first."""
    classes = texts.where(F.col("_id").isNotNull()).groupBy("_x", "_y").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).where("_first < _last").drop("_last").checkpoint()
    known = texts.join(_maybe_broadcast(classes, _few(classes, broadcast_places)), ["_x", "_y"], "left")
    return known, known.where(F.col("_id").isNotNull() & (F.col("_first").isNull() | (F.col("_id") == F.col("_first")))).select("_id", "_x", "_t")


def shared_pieces(texts: DataFrame, window: int, core: int, broadcast_anchors: int) -> DataFrame:
    """(_id, _x, lo, h, nodes): the pieces whose anchor occurs in several documents."""
    anchors = F.arrow_udf(lambda t: anchors_of(t, window, core), T.ArrayType(T.LongType()))
    counted = texts.select("_id", F.explode(anchors("_t")).alias("h")).groupBy("h").agg(F.min("_id").alias("lo"), F.max("_id").alias("hi"), F.count("*").alias("n"))
    shared = counted.where("lo < hi").select("h", "n").checkpoint()
    if _few(shared, broadcast_anchors):
        whole = F.arrow_udf(lambda t: pieces_of(t, None, window, core), _PIECE)
        return texts.select("_id", "_x", F.explode(whole("_t")).alias("p")).select("_id", "_x", "p.*").join(F.broadcast(shared.select("h")), "h", "left_semi")
    places = F.arrow_udf(lambda t: pieces_of(t, None, window, core, with_nodes=False), _PIECE)
    rows = texts.select("_id", "_x", F.explode(places("_t")).alias("p")).select("_id", "_x", "p.h", "p.lo")
    met = salted_join(rows, shared.select("h"), "h", hot_values(shared, "h", "n"), [F.col("_id"), F.col("_x"), F.col("lo")], "left_semi")
    wanted = met.groupBy("_id", "_x").agg(F.collect_set("lo").alias("wanted"))
    some = F.arrow_udf(lambda t, w: pieces_of(t, w, window, core), _PIECE)
    return texts.join(wanted, ["_id", "_x"]).select("_id", "_x", F.explode(some("_t", "wanted")).alias("p")).select("_id", "_x", "p.*")


_EDGES = "u long, v long, n int, own array<struct<eu:long,ev:long,en:int,pos:int>>, e array<struct<first:int,en:int,sid:{0},sx:long,pos:int>>, sid {0}, sx long"


def _judge(table: pa.Table) -> pa.RecordBatch:
    """Distinct pieces of whole anchors -> their edges that several documents have: e, with the coordinates of their first occurrence,
    and own, those whose first occurrence is the piece's own."""
    number = lambda c: table[c].combine_chunks().to_numpy(zero_copy_only=False)
    h, u, v, n, sx, lo = (number(c) for c in ("h", "u", "v", "n", "sx", "lo"))
    ids = pa.chunked_array([*table["sid"].chunks, *table["last"].chunks])
    order = pc.rank(ids, sort_keys="ascending", tiebreaker="dense").to_numpy()
    sid, last = order[: len(h)].astype(np.int64), order[len(h) :].astype(np.int64)
    nodes = table["nodes"].combine_chunks()
    values, begin = nodes.flatten().to_numpy(), np.cumsum(n + 1) - (n + 1)
    alone = np.ones(len(h), bool)
    alone[1:] &= h[1:] != h[:-1]
    alone[:-1] &= h[1:] != h[:-1]
    count = np.where(alone, 1, n)  # a lone piece is one edge of n windows
    row = np.repeat(np.arange(len(h)), count)
    first = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    en = np.where(alone[row], n[row], 1)
    eu, ev, pos = values[begin[row] + first], values[begin[row] + first + en], lo[row] + first
    by = np.lexsort((pos, sx[row], sid[row], en, ev, eu))
    fresh = np.ones(len(by), bool)
    fresh[1:] = (np.diff(eu[by]) != 0) | (np.diff(ev[by]) != 0) | (np.diff(en[by]) != 0)
    start = np.flatnonzero(fresh)
    source = np.empty(len(by), np.int64)
    source[by] = np.repeat(by[start], np.diff(np.append(start, len(by))))
    several = np.empty(len(by), bool)
    several[by] = np.repeat(np.maximum.reduceat(last[row[by]], start) > sid[row[by[start]]], np.diff(np.append(start, len(by))))
    own = several & (source == np.arange(len(by)))
    lists = lambda some: pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[some], minlength=len(h)))]), pa.int32())
    i4, i8 = pa.int32(), pa.int64()
    mine, all_ = np.flatnonzero(own), np.flatnonzero(several)
    from_ = source[all_]
    flat_own = pa.StructArray.from_arrays([pa.array(eu[mine], i8), pa.array(ev[mine], i8), pa.array(en[mine], i4), pa.array(pos[mine], i4)], names=["eu", "ev", "en", "pos"])
    sids = table["sid"].combine_chunks()
    flat_all = pa.StructArray.from_arrays([pa.array(first[all_], i4), pa.array(en[all_], i4), sids.take(pa.array(row[from_])), pa.array(sx[row[from_]], i8), pa.array(pos[from_], i4)], names=["first", "en", "sid", "sx", "pos"])
    out = pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(n, i4), pa.ListArray.from_arrays(lists(mine), flat_own), pa.ListArray.from_arrays(lists(all_), flat_all), sids, pa.array(sx)], names=["u", "v", "n", "own", "e", "sid", "sx"])
    return out.filter(pc.greater(pc.list_value_length(out["e"]), 0))


def judge_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in the order of their anchors, judged some whole anchors at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= JUDGED_ROWS:
            table = pa.Table.from_batches(held)
            h = table["h"].to_numpy()
            cut = int(np.flatnonzero(h != h[-1])[-1]) + 1 if h[0] != h[-1] else 0
            if cut:
                yield _judge(table.slice(0, cut))
            held = table.slice(cut).to_batches()
    if held:
        yield _judge(pa.Table.from_batches(held))


def edges_of(kinds: DataFrame, space: Workspace) -> DataFrame:
    """Distinct pieces (h, u, v, n, nodes, sid, sx, lo, last) with their repeated edges: (u, v, n, own, e, sid, sx).

    The pieces of an anchor are judged together; anchors of more than ``HOT_KINDS`` pieces, which may have any share of all, are taken
    apart into edges, and these are counted by a shuffle of their own hashes.
    """
    kind = kinds.schema["sid"].dataType.simpleString()
    counts = kinds.groupBy("h").agg(F.count("*").alias("k")).where("k > 1")
    frequent = hot_values(counts, "h", "k", least=HOT_KINDS)
    cool = kinds.where(~F.col("h").isin(frequent)) if frequent else kinds
    counted = cool.withColumn("k", F.count("*").over(Window.partitionBy("h"))).where(F.col("k") <= HOT_KINDS).drop("k")
    out = counted.mapInArrow(judge_anchors, _EDGES.format(kind))
    crowded = counts.where(F.col("k") > HOT_KINDS).select("h")
    if crowded.isEmpty():
        return out
    apart = salted_join(kinds, crowded, "h", frequent, [F.col("u"), F.col("v")], "left_semi")
    apart = apart.select("u", "v", "n", "sid", "sx", "lo", "last", "nodes", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("first"))
    apart = space.written(apart.select("u", "v", "n", "sid", "sx", "last", "first", (F.col("lo") + F.col("first")).alias("pos"), F.get("nodes", F.col("first")).alias("eu"), F.get("nodes", F.col("first") + 1).alias("ev")), "apart")
    whose = apart.groupBy("eu", "ev").agg(F.min(F.struct("sid", "sx", "pos")).alias("s"), F.max("last").alias("most"), F.count("*").alias("m")).where("s.sid < most")
    whose = space.written(whose.select(F.xxhash64("eu", "ev").alias("edge"), F.col("eu").alias("eu2"), F.col("ev").alias("ev2"), "s", "m"), "whose")
    met = salted_join(apart.withColumn("edge", F.xxhash64("eu", "ev")), whose.drop("m"), "edge", hot_values(whose, "edge", "m"), [F.col("u"), F.col("v")]).where("eu = eu2 AND ev = ev2")
    mine = F.when((F.col("s.sid") == F.col("sid")) & (F.col("s.sx") == F.col("sx")) & (F.col("s.pos") == F.col("pos")), F.struct("eu", "ev", F.lit(1).alias("en"), "pos"))
    listed = met.groupBy("u", "v", "n", "sid", "sx").agg(F.collect_list(mine).alias("own"), F.collect_list(F.struct("first", F.lit(1).alias("en"), "s.sid", "s.sx", "s.pos")).alias("e"))
    return out.unionByName(listed)


def compact(edges: DataFrame) -> DataFrame:
    """Edges (eu, ev, en, sid, sx, pos) with ``path``, the position in the source where their nonbranching path begins."""
    ends = edges.select(F.col("eu").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("ev").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    degrees = ends.groupBy("node").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    passes = degrees.where("o = 1 AND i = 1").select(F.col("node").alias("eu"), F.lit(True).alias("single"))
    along = Window.partitionBy("sid", "sx").orderBy("pos")
    follows = F.coalesce((F.lag(F.col("pos") + F.col("en")).over(along) == F.col("pos")) & F.col("single"), F.lit(False))
    begun = edges.join(passes, "eu", "left").withColumn("begin", F.when(~follows, F.col("pos")))
    return begun.withColumn("path", F.last("begin", ignorenulls=True).over(along)).drop("begin", "single")


def _chain(rows: pa.Array, window: int) -> pa.Array:
    """Sorted places (start, source, sx, count, pos) of one document each -> spans of which words and source advance together."""
    flat, sizes = rows.flatten(), rows.value_lengths().to_numpy(zero_copy_only=False)
    start, n, pos, sx = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "n", "pos", "sx"))
    document = np.repeat(np.arange(len(sizes)), sizes)
    names = flat.field("sid").dictionary_encode()
    source = names.indices.to_numpy(zero_copy_only=False)
    line = start - pos  # the same along a span
    by = np.lexsort((start, line, sx, source, document))
    stop = (start + n)[by]  # windows, one after the other
    same = np.zeros(len(by), bool)
    for c in (document, source, sx, line):
        same[1:] |= np.diff(c[by]) != 0
    same[:1] = True
    group = np.cumsum(same)
    reach = np.maximum.accumulate(stop + group * (int(stop.max(initial=0)) + 1)) - group * (int(stop.max(initial=0)) + 1)
    fresh = same.copy()
    fresh[1:] |= start[by][1:] > reach[:-1]
    at = np.flatnonzero(fresh)
    end = np.maximum.reduceat(stop, at) + window - 1 if len(at) else stop
    head = by[at]
    counts = np.concatenate([[0], np.cumsum(np.bincount(document[head], minlength=len(sizes)))])
    flat_out = pa.StructArray.from_arrays([pa.array(start[head], pa.int32()), pa.array(end, pa.int32()), flat.field("sid").take(pa.array(head)), pa.array(sx[head]), pa.array(pos[head], pa.int32())], names=["start", "end", "source", "sx", "source_start"])
    return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), flat_out)


def repeated_spans(first: DataFrame, space: Workspace, *, window: int = WINDOW, core: int = CORE, broadcast_anchors: int = BROADCAST_ANCHORS) -> tuple[DataFrame, DataFrame]:
    """Of distinct texts (_id, _x, _t): spans (_id, _x, spans: start, end, source, source_start in words) that a document with a smaller
    id has too, as chains of windows; and paths (source, start, end), the compacted passages of the graph."""
    found = shared_pieces(first, window, core, broadcast_anchors)
    found = space.written(found.select("_id", "_x", "lo", "h", F.get("nodes", F.lit(0)).alias("u"), F.element_at("nodes", -1).alias("v"), (F.size("nodes") - 1).alias("n"), "nodes"), "pieces")
    kinds = found.groupBy("h", "u", "v", "n").agg(F.min(F.struct("_id", "_x", "lo")).alias("at"), F.max("_id").alias("last"), F.count("*").alias("m"), F.first("nodes").alias("nodes"))
    kinds = space.written(kinds.select("h", "u", "v", "n", F.col("at._id").alias("sid"), F.col("at._x").alias("sx"), "at.lo", "last", "m", "nodes"), "kinds")
    judged = space.written(edges_of(kinds.drop("m"), space), "judged")
    often = hot_values(kinds.groupBy("u").agg(F.sum("m").alias("m")), "u", "m")
    space.drop("kinds", "apart", "whose")
    paths = space.written(compact(judged.select("sid", "sx", F.explode("own").alias("x")).select("sid", "sx", "x.*")), "paths")
    by_piece = judged.select("u", "v", "n", "e")
    places = salted_join(found.select("_id", "_x", "lo", "u", F.col("v").alias("v2"), F.col("n").alias("n2")), by_piece, "u", often, [F.col("_id"), F.col("_x"), F.col("lo")])
    earlier = F.filter("e", lambda x: x["sid"] < F.col("_id"))
    moved = F.transform(earlier, lambda x: F.struct((F.col("lo") + x["first"]).alias("start"), x["sid"].alias("sid"), x["sx"].alias("sx"), x["en"].alias("n"), x["pos"].alias("pos")))
    hit = places.where("v = v2 AND n = n2").select("_id", "_x", moved.alias("z")).where(F.size("z") > 0)
    source = first.schema["_id"].dataType.simpleString()
    chained = F.arrow_udf(lambda rows: _chain(rows, window), f"array<struct<start:int,end:int,source:{source},sx:long,source_start:int>>")
    by_text = hit.groupBy("_id", "_x").agg(F.sort_array(F.flatten(F.collect_list("z"))).alias("rows")).select("_id", "_x", F.explode(chained("rows")).alias("s"))
    whole = paths.groupBy("sid", "sx", "path").agg((F.max(F.col("pos") + F.col("en")) + window - 1).alias("stop"))
    verified = on_paths(space.written(by_text.select("_id", "_x", "s.*"), "chained"), whole, window)
    return verified, whole.select(F.col("sid").alias("source"), F.col("path").alias("start"), F.col("stop").alias("end"))


def on_paths(spans: DataFrame, paths: DataFrame, window: int) -> DataFrame:
    """(_id, _x, spans): the parts of spans whose source coordinates lie on a path, at least a window each, in order.

    Spans and paths meet in stretches of ``STRETCH`` words of the source; a source with many spans is dealt over several tasks.
    """
    stretch = lambda lo, hi: F.explode(F.sequence((lo / STRETCH).cast("int"), ((hi - 1) / STRETCH).cast("int")))
    begin, size = F.col("source_start"), F.col("end") - F.col("start")
    cut = spans.select("*", stretch(begin, begin + size - window + 1).alias("part")).withColumn("key", F.xxhash64("source", "sx", "part"))
    road = paths.select(F.col("sid").alias("source2"), F.col("sx").alias("sx2"), F.col("path").alias("from"), "stop", stretch(F.col("path"), F.col("stop") - window + 1).alias("part2")).withColumn("key", F.xxhash64("source2", "sx2", "part2"))
    many = hot_values(cut.groupBy("key").agg(F.count("*").alias("n")), "key", "n")
    met = salted_join(cut, road, "key", many, [F.col("_id"), F.col("_x"), F.col("start")]).where((F.col("source") == F.col("source2")) & (F.col("sx") == F.col("sx2")) & (F.col("part") == F.col("part2")))
    lo = F.greatest(begin, F.col("from"), F.col("part") * STRETCH)  # windows that begin in this stretch
    hi = F.least(begin + size, F.col("stop"), (F.col("part") + 1) * STRETCH + window - 1)
    kept = met.select("_id", "_x", (F.col("start") + lo - begin).alias("start"), (F.col("start") + hi - begin).alias("end"), "source", lo.alias("source_start")).where(F.col("end") - F.col("start") >= window)
    return kept.groupBy("_id", "_x").agg(F.sort_array(F.collect_list(F.struct("start", "end", "source", "source_start"))).alias("spans"))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("_id"), F.xxhash64(raw).alias("_x"), F.xxhash64(F.lit(1), raw).alias("_y"), raw.alias("_t"))


def repeated_paths(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, core: int = CORE, broadcast_places: int = BROADCAST_PLACES, broadcast_anchors: int = BROADCAST_ANCHORS) -> DataFrame:
    """(source, start, end): every compacted path of the graph as a passage [start, end), in words, of the document that has it first."""
    reliable_checkpoints(docs.sparkSession)
    small_batches(docs.sparkSession)
    _, first = first_texts(_texts(docs, id_col, text_col), broadcast_places)
    return repeated_spans(first, Workspace(docs.sparkSession, "passages"), window=window, core=core, broadcast_anchors=broadcast_anchors)[1]


def remove_repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, core: int = CORE, broadcast_places: int = BROADCAST_PLACES, broadcast_anchors: int = BROADCAST_ANCHORS) -> DataFrame:
    """Per row of ``docs``: the id, n_words, spans (start, end, source, source_start, in words; a copy has one without a place in it),
    removed (the words of these as disjoint [start, end)) and kept (the other words joined by blanks)."""
    reliable_checkpoints(docs.sparkSession)
    small_batches(docs.sparkSession)
    known, first = first_texts(_texts(docs, id_col, text_col), broadcast_places)
    space = Workspace(docs.sparkSession, "passages")
    spans = space.written(repeated_spans(first, space, window=window, core=core, broadcast_anchors=broadcast_anchors)[0], "spans")
    space.drop("pieces", "judged", "paths", "chained")
    joined = known.join(spans, ["_id", "_x"], "left").withColumn("_copy", F.coalesce(F.col("_id") > F.col("_first"), F.lit(False)))

    @F.arrow_udf(T.StructType([T.StructField("n_words", T.LongType()), T.StructField("removed", _SPANS), T.StructField("kept", T.StringType())]))
    def without(text: pa.Array, starts: pa.Array, ends: pa.Array, copy: pa.Array) -> pa.Array:
        counts, gone, kept = [], [], []
        for t, a, b, c in zip(text, starts, ends, copy, strict=True):
            words = t.as_py().encode().split()  # at blanks and \t to \r
            cuts: list[dict] = []
            if c.as_py() and len(words) >= window:
                cuts = [{"start": 0, "end": len(words)}]
            else:
                for start, end in sorted(zip(a.as_py() or (), b.as_py() or (), strict=True)):
                    if cuts and start <= cuts[-1]["end"]:
                        cuts[-1]["end"] = max(cuts[-1]["end"], end)
                    else:
                        cuts.append({"start": start, "end": end})
            edges = [0, *[e for s in cuts for e in (s["start"], s["end"])], len(words)]
            counts.append(len(words))
            gone.append(cuts)
            kept.append(b" ".join([w for i in range(0, len(edges), 2) for w in words[edges[i] : edges[i + 1]]]).decode())
        span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(gone, pa.list_(span)), pa.array(kept, pa.string())], names=["n_words", "removed", "kept"])

    done = joined.withColumn("_z", without("_t", "spans.start", "spans.end", "_copy"))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("_z.n_words").cast("int").alias("end"), F.col("_first").alias("source"), F.lit(0).alias("source_start")))
    listed = F.when(F.col("_copy") & (F.col("_z.n_words") >= window), whole).otherwise(F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)))
    return done.select(F.col("_id").alias(id_col), "_z.n_words", listed.alias("spans"), "_z.removed", "_z.kept")


def op11_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]).cast("long"))
    return done.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = """
WITH w AS (
  SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS pos
  FROM (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS l FROM documents)
), g AS (
  SELECT doc_id, pos, word,
         CASE WHEN count(*) OVER f = 13 THEN list(word) OVER f END AS win
  FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)
), s AS (SELECT win, min(doc_id) AS first FROM g WHERE win IS NOT NULL GROUP BY win
), m AS (
  SELECT g.doc_id, g.pos, g.word, coalesce(max(CASE WHEN s.first < g.doc_id THEN 1 ELSE 0 END) OVER (PARTITION BY g.doc_id ORDER BY g.pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), 0) AS gone
  FROM g LEFT JOIN s ON g.win = s.win
), r AS (
  SELECT doc_id, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (gone = 0), '') AS kept FROM m GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(r.n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(r.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(r.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id
"""
