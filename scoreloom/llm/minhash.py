"""Near-duplicate detection: one-permutation MinHash with optimal densification, banded buckets and star-shaped candidates.

1. One pass over the texts gives every document the size and digest of its shingle set and its band keys; that narrow table
   is checkpointed. One permutation hashes each shingle once; an empty bin borrows from the bin that a hash of (bin, attempt)
   names, until that bin is a filled one.
2. Documents with equal sets are one class, represented by its smallest id, so copies never multiply pairs.
3. Each bucket of a band gives a star: one member, its centre, against the others, deduplicated over bands. Candidates whose
   sizes already exclude the link are dropped; the others are confirmed on the full sets, which only candidates ever ship.
4. Confirmed links give components. Two members of a star in different components may still be linked with each other. A
   bound on what they must share besides the centre's shingles (see ``hidden_links``) finds every such pair without pairing
   all members, and these are confirmed too. So no candidate link is lost to the star shape.
5. The number of bands follows from ``miss``, the bound on the chance that a pair at the threshold shares no bucket.

Defined cases: null or wordless texts have no shingles and no links; fewer words than a shingle make one shingle of all of
them; an empty table gives an empty result; a null id is no node and stays alone; rows that repeat an id are one document
for linking and each keep their row; other columns are never looked at.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.llm.words import NOT_SPACE, blocks, mix64, ngram_hashes, small_batches, utf8, within_rows, word_hashes
from scoreloom.operators.components import connected_components
from scoreloom.session import reliable_checkpoints

BAND_ROWS = 6
#: Up to so many ids of documents in candidate pairs are broadcast (8 bytes each); beyond, they are joined by shuffling.
BROADCAST_IDS = 2_000_000


def band_count(similarity: float, rows: int, miss: float = 1e-6) -> int:
    """Bands so that a pair at ``similarity`` shares none of them with a chance of at most ``miss``."""
    return math.ceil(math.log(miss) / math.log(1 - similarity**rows))


def shingle_sets(column: pa.Array, size: int):
    """The sorted distinct shingle hashes of each row, in row order."""
    data, at = utf8(column)
    for lo, hi in blocks(at):
        words, offsets = word_hashes(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], NOT_SPACE)
        grams = ngram_hashes(words, size)
        for r in range(hi - lo):
            a, b = int(offsets[r]), int(offsets[r + 1])
            if b - a >= size:
                yield np.unique(grams[a : b - size + 1])
            else:
                yield ngram_hashes(words[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def one_permutation(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """A row of ``bins`` minima for each non-empty set, densified."""
    out = np.zeros((len(sets), bins), np.uint64)
    filled = np.zeros((len(sets), bins), bool)
    for r, s in enumerate(sets):
        where = ((s >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
        first = np.flatnonzero(np.diff(where, prepend=np.uint64(bins)))  # hashes ascend, so each bin's first is its least
        out[r, where[first].astype(np.int64)] = s[first]
        filled[r, where[first].astype(np.int64)] = True
    row, empty = np.nonzero(~filled)
    attempt = 0
    while len(row):
        attempt += 1
        probe = (mix64(empty.astype(np.uint64) * np.uint64(0x10001) + np.uint64(attempt << 40)) % np.uint64(bins)).astype(np.int64)
        found = filled[row, probe]
        out[row[found], empty[found]] = out[row[found], probe[found]]
        row, empty = row[~found], empty[~found]
    return out


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each row and band."""
    n, bins = signatures.shape
    parts = signatures.reshape(n, bins // rows, rows)
    key = np.broadcast_to(np.arange(bins // rows, dtype=np.uint64), (n, bins // rows)).copy()
    for j in range(rows):
        key = mix64(key * np.uint64(3) + parts[:, :, j])
    return key.view(np.int64)


def sketches(docs: DataFrame, text_col: str, size: int, rows: int, bands: int) -> DataFrame:
    """Add n_shingles, set_key (null if empty) and bands (null if empty)."""
    kind = T.StructType([T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    @F.arrow_udf(kind)
    def sketch(texts: pa.Array) -> pa.Array:
        counts, keys, found = [], [], []
        held: list[np.ndarray] = []
        rows_of: list[int] = []

        def flush() -> None:
            for r, x in zip(rows_of, band_keys(one_permutation(held, rows * bands), rows), strict=True):
                found[r] = x
            held.clear()
            rows_of.clear()

        for s in shingle_sets(texts, size):
            counts.append(len(s))
            keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            found.append(None)
            if len(s):
                held.append(s)
                rows_of.append(len(found) - 1)
                if len(held) == 512:
                    flush()
        if held:
            flush()
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(found, pa.list_(pa.int64()))], names=["n_shingles", "set_key", "bands"])

    return docs.withColumn("_s", sketch(F.col(text_col))).select(*docs.columns, "_s.*")


def full_sets(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(node, shingles): the sorted distinct shingle hashes of every row."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def whole(texts: pa.Array) -> pa.Array:
        return pa.array([s.view(np.int64) for s in shingle_sets(texts, size)], pa.list_(pa.int64()))

    return docs.select(F.col(id_col).alias("node"), whole(F.col(text_col)).alias("shingles"))


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with their full sets sa and sb."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(right, "b").join(left, "a")


def confirm(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of the candidate pairs with den * intersection >= num * union on the full sets."""
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    linked = den * both >= num * (F.size("sa").cast("long") + F.size("sb").cast("long") - both)
    return _with_sets(pairs.select("a", "b"), sets).where(linked).select("a", "b")


def _small(table: DataFrame, bound: int) -> DataFrame:
    """The table, checkpointed and, up to ``bound`` rows, to be broadcast."""
    table = table.checkpoint()
    return F.broadcast(table) if table.limit(bound + 1).count() <= bound else table


def hidden_links(star: DataFrame, links: DataFrame, labels: DataFrame, sets: DataFrame, num: int, den: int, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """(a, b) of members of one star that are linked although they are in different components.

    Let R be the centre's set, A- = R \\ A and A+ = A \\ R, and D(A) both together. For members A, B of one star the
    intersection is |R| - |A-| - |B-| + S with S = |D(A) & D(B)|. If A is not linked with R, then A and B can only be linked if
    (num + den) * S > num * |B+| + den * |B-|. (If both are linked with R, they are in one component already.) What counts in S
    is in D of members of different components, so of each D only these shingles are kept. Of B's, put rarest first, one that is
    shared stands among the first (their number) - need + 1. Those first ones are joined with the ones kept of the members A that
    are not linked with R: what near copies have in common never meets, only what sets them apart. From the kept shingles of
    both follows S, and so the exact intersection; full sets are only shipped to meet the centre's.
    """
    named = star.join(labels.withColumnRenamed("node", "b"), "b", "left").withColumn("component", F.coalesce("component", "b"))
    open_stars = named.groupBy("a").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("a")
    named = named.join(_small(open_stars, broadcast_ids), "a").join(links.withColumn("linked", F.lit(True)), ["a", "b"], "left").select("a", "b", "n", "component", F.coalesce("linked", F.lit(False)).alias("linked"))
    apart = _with_sets(named, sets).select("a", "b", "n", "component", "linked", F.size("sa").cast("long").alias("r"), F.array_except("sa", "sb").alias("less"), F.array_except("sb", "sa").alias("more"))
    lost, need = F.size("less").cast("long"), F.floor((num * F.size("more").cast("long") + den * F.size("less").cast("long")) / F.lit(num + den)) + 1
    apart = apart.select("a", "b", "n", "component", "linked", (F.col("r") - lost).alias("own"), lost.alias("lost"), need.alias("need"), F.concat("less", "more").alias("d")).checkpoint()
    spread = apart.select("a", "component", F.explode("d").alias("t")).groupBy("a", "t").agg(F.count("*").alias("f"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    crossing = _small(spread.where("lo < hi").select("a", "t", "f"), broadcast_ids // 10)
    kept = apart.select(*[c for c in apart.columns if c != "d"], F.explode("d").alias("t")).join(crossing, ["a", "t"])
    members = kept.groupBy("a", "b", "n", "component", "linked", "own", "lost", "need").agg(F.array_sort(F.collect_list(F.struct("f", "t"))).alias("s"))
    members = members.select("a", "b", "n", "component", "linked", "own", "lost", "need", F.col("s.t").alias("ts")).checkpoint()
    first = F.slice("ts", 1, F.greatest(F.size("ts") - F.col("need") + 1, F.lit(0)).cast("int"))
    early = members.select("a", F.explode(first).alias("t"), F.col("b").alias("x"), F.col("n").alias("xn"), F.col("component").alias("xc"))
    whole = members.where(~F.col("linked")).select("a", F.explode("ts").alias("t"), "b", "n", "component")
    fits = den * F.least("n", "xn") >= num * F.greatest("n", "xn")
    met = early.join(whole, ["a", "t"]).where((F.col("xc") != F.col("component")) & fits)
    pairs = met.select("a", F.least("b", "x").alias("b"), F.greatest("b", "x").alias("x")).distinct()
    one = members.select("a", "b", "n", "own", "ts")
    other = members.select("a", F.col("b").alias("x"), F.col("n").alias("xn"), "lost", F.col("ts").alias("xts"))
    both = F.col("own") - F.col("lost") + F.size(F.array_intersect("ts", "xts"))
    linked = den * both >= num * (F.col("n") + F.col("xn") - both)
    return pairs.join(one, ["a", "b"]).join(other, ["a", "x"]).where(linked).select(F.col("b").alias("a"), F.col("x").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 80, den: int = 100, rows: int = BAND_ROWS, miss: float = 1e-6, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``docs``; documents link at den * |A & B| >= num * |A | B|."""
    reliable_checkpoints(docs.sparkSession)
    small_batches(docs.sparkSession)
    docs = docs.select(id_col, text_col)
    marked = sketches(docs, text_col, size, rows, band_count(num / den, rows, miss)).drop(text_col).checkpoint()
    known = marked.where(F.col("set_key").isNotNull() & F.col(id_col).isNotNull())
    classes = known.groupBy("set_key").agg(F.min(id_col).alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    cells = classes.select("node", "n", F.explode("bands").alias("key"))
    shared = cells.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    cells = cells.join(shared, "key").checkpoint()
    # The centre of a bucket is its member with the fullest buckets: where near copies meet, the one closest to most.
    weight = cells.groupBy("node").agg(F.sum("m").alias("w"))
    weighed = cells.join(weight, "node").select("key", "node", "n", "w")
    centres = weighed.groupBy("key").agg(F.min(F.struct((-F.col("w")).alias("w"), "node", "n")).alias("c"))
    star = weighed.join(centres, "key").where(F.col("node") != F.col("c.node")).select(F.col("c.node").alias("a"), F.col("c.n").alias("an"), F.col("node").alias("b"), "n").distinct().checkpoint()
    need = star.select(F.col("a").alias(id_col)).union(star.select(F.col("b").alias(id_col))).distinct().checkpoint()
    small = need.limit(broadcast_ids + 1).count() <= broadcast_ids
    sets = full_sets(docs.join(F.broadcast(need) if small else need, id_col, "left_semi"), id_col, text_col, size).checkpoint()
    links = confirm(star.where(den * F.least("n", "an") >= num * F.greatest("n", "an")), sets, num, den).hint("rebalance").checkpoint()
    labels = connected_components(links)
    more = hidden_links(star, links, labels, sets, num, den, broadcast_ids).checkpoint()
    if not more.isEmpty():
        labels = connected_components(links.union(more))
    named = classes.select("set_key", "node").join(labels, "node", "left").select("set_key", F.coalesce("component", "node").alias("component_id"))
    return marked.select(id_col, "n_shingles", "set_key").join(named, "set_key", "left").select(id_col, "n_shingles", F.when(F.col(id_col).isNotNull(), F.coalesce("component_id", F.col(id_col))).alias("component_id"))


def keep_one_of_each(docs: DataFrame, **options: object) -> DataFrame:
    """The rows of ``docs`` that represent their component; of rows that repeat a kept id the smallest stays."""
    found = near_duplicates(docs, **options)
    id_col = str(options.get("id_col", "doc_id"))
    kept = found.where(F.col(id_col) == F.col("component_id")).groupBy(id_col).agg(F.count("*").alias("rows")).checkpoint()
    single = docs.join(kept.where("rows = 1"), id_col, "left_semi")
    again = docs.join(kept.where("rows > 1"), id_col, "left_semi")
    least = again.groupBy(id_col).agg(F.min(F.struct(*[c for c in docs.columns if c != id_col])).alias("r")).select(id_col, "r.*")
    return single.unionByName(least.select(*docs.columns)).unionByName(docs.where(F.col(id_col).isNull())).select(*docs.columns)


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=3, num=85)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
