"""Paired comparison of two arms by resampling whole papers.

Both arms are first reduced to sums per paper and dataset. A replicate is a weight per paper: as many independent draws as there are
papers, split in two steps. First every draw picks a block of papers, in proportion to its size, and only the counts by block are kept;
then each block draws that many times among its own papers. Draws are hashes of (seed, replicate, draw), so any task can make its own,
a lost one makes the same again, and what is shuffled is one count for each of replicates x blocks. Blocks are summed in strips, so a
strip, not a block, has a row for each replicate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions.score import TOP, ratio
from scoreloom.operators.quality import GOLD_BINS, kappa_of_moments, paper_statistics

#: What is summed for every replicate, and the metrics of the gate; the last is better where it is higher.
COUNTED = ["n", "units", "severe", "stops", "unsafe", "n_valid", "st", "sp", "stt", "spp", "stp", *GOLD_BINS]
METRICS = ["severe", "unsafe", "nmae", "qwk"]
#: Papers to a bucket of digests when they are numbered, papers to a block, draws held at a time, and replicates weighed together.
BUCKET, BLOCK, PACK, TOGETHER = 4096, 1024, 4_000_000, 256
#: Draws that are hashed at a time, and blocks to a strip at most.
PIECE, STRIP = 32_768, 32
SEED = 20260729
_ONE, _GROW, _P, _Q = (np.uint64(x) for x in (1, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix_rest(x: np.ndarray, room: np.ndarray, n: int) -> None:
    """``mix`` modulo ``n`` of ``x``, which has _GROW added already, in place; ``room`` is of the same size."""
    for shift, factor in ((np.uint64(30), _P), (np.uint64(27), _Q), (np.uint64(31), None)):
        np.right_shift(x, shift, out=room)
        x ^= room
        if factor is not None:
            x *= factor
    if n & (n - 1) == 0:
        x &= np.uint64(n - 1)
        return
    np.floor_divide(x, np.uint64(n), out=room)
    room *= np.uint64(n)
    x -= room


def _picks(keys: np.ndarray, counts: np.ndarray, n: int, width: int, share: int) -> np.ndarray:
    """(row, pick // share) counts of ``counts`` draws of each row, which count up from its key: draws are hashed in place, PIECE at a
    time, so that they stay in the cache."""
    out = np.zeros((len(keys), width), np.int64)
    steps, x, other = np.arange(PIECE, dtype=np.uint64), np.empty(PIECE, np.uint64), np.empty(PIECE, np.uint64)
    for i, (key, count) in enumerate(zip(keys + _GROW, counts.tolist(), strict=True)):
        for start in range(0, count, PIECE):
            m = min(PIECE, count - start)
            draw = x[:m]
            np.add(steps[:m], key + np.uint64(start), out=draw)
            _mix_rest(draw, other[:m], n)
            if share & (share - 1) == 0:
                draw >>= np.uint64(share.bit_length() - 1)
            else:
                np.floor_divide(draw, np.uint64(share), out=draw)
            out[i] += np.bincount(draw.view(np.int64), minlength=width)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that makes neighbours unlike each other; sums and products wrap around."""
    x = x + _GROW
    x = (x ^ (x >> np.uint64(30))) * _P
    x = (x ^ (x >> np.uint64(27))) * _Q
    return x ^ (x >> np.uint64(31))


def _rest(x: np.ndarray, n: int) -> np.ndarray:
    """x mod n; the division by one number is vectorised, the remainder is not."""
    return x - x // np.uint64(n) * np.uint64(n)


def replicate_key(replicate: np.ndarray, seed: int = SEED) -> np.ndarray:
    """The key that a replicate's draws of blocks count up from."""
    return mix(mix(np.asarray(replicate, np.uint64) + np.uint64(seed)))


def block_key(replicate: np.ndarray, block: int, seed: int = SEED) -> np.ndarray:
    """The key that a replicate's draws inside a block count up from."""
    return mix(replicate_key(replicate, seed) + mix(np.array([block], np.uint64)) + _ONE)


def unpaired(candidate: DataFrame, comparator: DataFrame, keys: list[str], equal: list[str]) -> DataFrame:
    """Rows that break pairing: a key on one side only, a repeated key, or a value that must agree and does not."""
    side = lambda df, s: df.groupBy(*keys).agg(F.count("*").alias(f"{s}_n"), *[F.min(c).alias(f"{s}_{c}") for c in equal])
    both = side(candidate, "a").join(side(comparator, "b"), keys, "full_outer")
    differs = F.lit(False)
    for c in equal:
        differs = differs | ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    fault = F.when(F.col("a_n").isNull() | F.col("b_n").isNull(), "missing").when((F.col("a_n") > 1) | (F.col("b_n") > 1), "duplicate").when(differs, "changed")
    return both.select(*keys, fault.alias("fault")).where("fault is not null")


def paired_delta(candidate: DataFrame, comparator: DataFrame) -> DataFrame:
    """Differences of the sums per dataset, over items that both arms have."""
    severe = lambda c: (F.col(c) * 4 > TOP).cast("long")
    a = candidate.select("item_id", "dataset", "stop", F.col("units").alias("ua"))
    b = comparator.select("item_id", "dataset", F.col("units").alias("ub"))
    d = severe("ua") - severe("ub")
    return a.join(b, ["item_id", "dataset"]).groupBy("dataset").agg(F.count("*").alias("n"), F.sum(F.col("ua") - F.col("ub")).alias("units_delta"), F.sum(d).alias("severe_delta"), F.sum(F.when(F.col("stop"), d).otherwise(0)).alias("unsafe_delta"))


def positions(papers: DataFrame) -> tuple[DataFrame, int]:
    """(paper_id, pos), papers of any type numbered from 0 in the order of their ids' SHA-256, and how many there are: ranks in
    buckets of digests, plus what lies in the buckets below."""
    ids = papers.select("paper_id").distinct()
    size = ids.count()
    digits = max(1, min(6, round(np.log(max(size / BUCKET, 1)) / np.log(16) + 0.5)))
    keyed = ids.withColumn("digest", F.sha2(F.col("paper_id").cast("string").cast("binary"), 256)).withColumn("bucket", F.substring("digest", 1, digits))
    counts = keyed.groupBy("bucket").agg(F.count("*").alias("held"))
    below = counts.select("bucket", (F.sum("held").over(Window.orderBy("bucket")) - F.col("held")).alias("below"))  # one row per bucket
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("digest")) - 1
    return keyed.withColumn("rank", rank).join(below, "bucket").select("paper_id", (F.col("below") + F.col("rank")).alias("pos")), size


def block_counts(first: int, stop: int, size: int, seed: int = SEED, block: int = BLOCK) -> np.ndarray:
    """How many of a replicate's ``size`` draws fall on each block, for the replicates from ``first`` to before ``stop``."""
    keys = replicate_key(np.arange(first, stop), seed)
    return _picks(keys, np.full(len(keys), size), size, -(-size // block), block)


def block_weights(first: int, counts: np.ndarray, block: int, held: int, seed: int = SEED, kind: type = np.int64) -> np.ndarray:
    """(replicate, paper of the block), of type ``kind``: how often each of ``held`` papers is drawn, given how often the block is."""
    keys = block_key(np.arange(first, first + len(counts)), block, seed)
    out = np.empty((len(counts), held), kind)
    most = min(PIECE, int(counts.max(initial=0)))
    several = max(1, PIECE // max(1, most))  # rows whose draws fit in a piece
    steps, x, other = np.arange(most, dtype=np.uint64), np.empty(several * most, np.uint64), np.empty(several * most, np.uint64)
    for a in range(0, len(counts), several):
        some = counts[a : a + several]
        wide = int(some.max())
        if wide > PIECE:
            out[a : a + several] = _picks(keys[a : a + several], some, held, held, 1)
            continue
        draw, room = x[: len(some) * wide], other[: len(some) * wide]
        picks = draw.reshape(len(some), wide)  # rows of equal length, read as far as they count
        np.add(keys[a : a + several, None] + _GROW, steps[:wide], out=picks)
        _mix_rest(draw, room, held)
        for row, pick, count in zip(out[a : a + several], picks.view(np.int64), some.tolist(), strict=True):
            row[:] = np.bincount(pick[:count], minlength=held)
    return out


def packed(side: np.ndarray, draws: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Columns of whole numbers put side by side into doubles of 53 bits, as far as their sums over ``draws`` rows need, and where they
    are: column, double, shift, mask. Columns of zeros are left out; one below 0, or with sums too large, is a double of its own."""
    used, places = [], []
    need = [-1 if low < 0 else (high * draws).bit_length() for low, high in zip(side.min(axis=0).tolist(), side.max(axis=0).tolist(), strict=True)]
    for c in sorted(range(len(need)), key=lambda c: -need[c]):
        bits = need[c]
        if bits == 0:
            continue
        alone = bits < 0 or bits > 53
        at = len(used) if alone else next((k for k, taken in enumerate(used) if taken + bits <= 53), len(used))
        if at == len(used):
            used.append(0)
        places.append((c, at, used[at], -1 if alone else (1 << bits) - 1))
        used[at] += 53 if alone else bits
    out = np.zeros((len(side), len(used)), np.int64)
    for c, at, shift, _ in places:
        out[:, at] += side[:, c] << shift
    return out.astype(np.float64), *np.array(places, np.int64).reshape(-1, 4).T


def resampled(sums: DataFrame, replicates: int, seed: int = SEED, block: int = BLOCK, together: int = TOGETHER, papers: DataFrame | None = None, point: bool = False) -> DataFrame:
    """(replicate, arm, dataset, sums): every replicate draws as many papers as there are. A task makes the counts by block of some
    replicates; a strip of blocks makes the weights of one block after the other, never more than ``block`` papers, multiplies them with
    the block's sums (in doubles, exact below 2^53) and adds up, so that only replicates x blocks counts and replicates x strips sums are
    shuffled. ``papers`` has the same ids as ``sums``, if they are cheaper to get; ``point`` adds the papers as they are, as replicate -1."""
    numbered, size = positions(sums if papers is None else papers)
    counted = [c for c in COUNTED if c in sums.columns]
    blocks, cores = -(-size // block), sums.sparkSession.sparkContext.defaultParallelism
    several = max(1, min(32, PACK // max(1, blocks)))
    strip = max(1, min(STRIP, blocks // (4 * cores)))

    def split(batches):
        for unit in (u for batch in batches for u in batch.column(0).to_pylist()):
            first = unit * several
            counts = block_counts(first, min(first + several, replicates), size, seed, block)
            ends = np.minimum(np.arange(0, blocks + strip, strip), blocks) * len(counts)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(counts.T.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(lists))), pa.array(np.full(len(lists), first)), lists], names=["strip", "first", "counts"])

    def weigh(drawn: pa.Table, held: pa.Table) -> pa.Table:
        if not drawn.num_rows or not held.num_rows:
            return out.empty_table()
        base = drawn["strip"][0].as_py() * strip
        some = min(strip, blocks - base)
        counts = np.zeros((some, replicates), np.int64)
        for first, part in zip(drawn["first"].to_pylist(), drawn["counts"], strict=True):
            part = part.values.to_numpy().reshape(some, -1)
            counts[:, first : first + part.shape[1]] = part
        groups: dict[tuple, int] = {}
        group = np.array([groups.setdefault(g, len(groups)) for g in zip(held["arm"].to_pylist(), held["dataset"].to_pylist(), strict=True)])
        place = held["pos"].to_numpy() - base * block
        order = np.argsort(place, kind="stable")
        ends = np.searchsorted(place[order], np.arange(some + 1) * block)
        values = np.stack([held[c].to_numpy() for c in counted], axis=1)
        sums = np.zeros((len(groups) * len(counted), replicates + 1), np.int64)  # first come the papers as they are
        for b in range(some):
            rows, here = order[ends[b] : ends[b + 1]], min(block, size - (base + b) * block)
            side = np.zeros((here * len(groups), len(counted)), np.int64)
            np.add.at(side, (place[rows] - b * block) * len(groups) + group[rows], values[rows])
            # the sums of all arms and datasets of a paper, side by side
            side, *places = packed(side.reshape(here, -1), max(here, int(counts[b].max())))
            totals = np.empty((replicates + 1, side.shape[1]))
            totals[0] = side.sum(axis=0)
            for first in range(0, replicates, together):
                weights = block_weights(first, counts[b, first : first + together], base + b, here, seed, np.float64)
                np.matmul(weights, side, out=totals[first + 1 : first + 1 + len(weights)])
            totals = np.ascontiguousarray(np.rint(totals).astype(np.int64).T)
            for column, at, shift, mask in zip(*places, strict=True):
                sums[column] += (totals[at] >> shift) & mask
        found = []
        for k, (arm, dataset) in enumerate(groups):
            total = sums[k * len(counted) : (k + 1) * len(counted)]
            there = np.flatnonzero(total[0])
            there = there if point else there[there > 0]
            found.append(pa.table([pa.array(there - 1), pa.array([arm] * len(there), pa.string()), pa.array([dataset] * len(there), pa.string()), *[pa.array(c[there]) for c in total]], names=["replicate", "arm", "dataset", *counted]))
        return pa.concat_tables(found)

    out = pa.schema([("replicate", pa.int64()), ("arm", pa.string()), ("dataset", pa.string()), *[(c, pa.int64()) for c in counted]])
    units, tasks = -(-replicates // several), max(1, min(-(-blocks // strip), 8 * cores))
    drawn = sums.sparkSession.range(0, units, 1, max(1, min(units, 8 * cores))).mapInArrow(split, "strip long, first long, counts array<int>")
    held = sums.join(numbered, "paper_id").select(F.expr(f"pos div {block * strip}").alias("strip"), "pos", "arm", "dataset", *counted)
    kind = "replicate long, arm string, dataset string, " + ", ".join(f"{c} long" for c in counted)
    # strips are many draws in few bytes, so the number of tasks does not follow the bytes
    strips = drawn.repartition(tasks, "strip").groupBy("strip").cogroup(held.repartition(tasks, "strip").groupBy("strip")).applyInArrow(weigh, kind)
    return strips.groupBy("replicate", "arm", "dataset").agg(*[F.sum(c).alias(c) for c in counted])


def arm_sums(candidate: DataFrame, comparator: DataFrame) -> DataFrame:
    """Sums per paper, arm (a is the candidate) and dataset."""
    return paper_statistics(candidate).withColumn("arm", F.lit("a")).unionByName(paper_statistics(comparator).withColumn("arm", F.lit("b")))


def replicate_deltas(candidate: DataFrame, comparator: DataFrame, replicates: int, datasets: list[str], least: int = 100, bins: int = 2) -> DataFrame:
    """``deltas_of`` the sums of two arms."""
    return deltas_of(arm_sums(candidate, comparator), replicates, datasets, least, bins)


def deltas_of(sums: DataFrame, replicates: int, datasets: list[str], least: int = 100, bins: int = 2, papers: DataFrame | None = None) -> DataFrame:
    """Per replicate, and for the papers as they are (replicate -1): the largest change over ``datasets`` of the rates of severe
    errors and of unsafe stops, and the changes of the unweighted means over datasets of the error and of kappa. All four are null
    if any dataset of either arm has no items, no stops, fewer than ``least`` legal predictions, fewer than ``bins`` gold bins or
    no expected disagreement."""
    per = resampled(sums, replicates, papers=papers, point=True)
    held = sum(((F.col(g) > 0).cast("int") for g in GOLD_BINS), F.lit(0))
    ready = (F.col("n") > 0) & (F.col("stops") > 0) & (F.col("n_valid") >= least) & (held >= bins) & kappa_of_moments().isNotNull()
    rates = per.select(
        "replicate", "arm", "dataset", ready.alias("ready"), ratio(F.col("severe"), F.col("n")).alias("severe"), ratio(F.col("unsafe"), F.col("stops")).alias("unsafe"),
        ratio(F.col("units"), F.col("n") * TOP).alias("nmae"), kappa_of_moments().alias("qwk"),
    )
    cell = lambda m, arm, d: F.max(F.when((F.col("arm") == arm) & (F.col("dataset") == d), F.col(m))).alias(f"{m}_{arm}_{d}")
    wide = rates.groupBy("replicate").agg(F.count_if(F.col("ready") & F.col("dataset").isin(datasets)).alias("defined"), *[cell(m, arm, d) for m in METRICS for arm in "ab" for d in datasets])
    change = lambda m: [F.col(f"{m}_a_{d}") - F.col(f"{m}_b_{d}") for d in datasets]
    mean = lambda m, arm: sum((F.col(f"{m}_{arm}_{d}") for d in datasets[1:]), F.col(f"{m}_{arm}_{datasets[0]}")) / len(datasets)
    most = lambda m: F.greatest(*change(m)) if len(datasets) > 1 else change(m)[0]
    deltas = {"severe": most("severe"), "unsafe": most("unsafe"), "nmae": mean("nmae", "a") - mean("nmae", "b"), "qwk": mean("qwk", "a") - mean("qwk", "b")}
    whole = F.col("defined") == 2 * len(datasets)
    return wide.select("replicate", *[F.when(whole, d).alias(m) for m, d in deltas.items()])


def conservative_bound(delta: Column, replicates: int, confidence: float = 0.95, upper: bool = True) -> Column:
    """One-sided bound: the ceil(pn)-th smallest for an upper, the floor((1 - p)n)-th for a lower one (at least the first)."""
    at = -int(-confidence * replicates // 1) if upper else max(1, int((1 - confidence) * replicates + 1e-9))
    return F.try_element_at(F.array_sort(F.collect_list(delta)), F.lit(at))


def gate(candidate: DataFrame, comparator: DataFrame, replicates: int, datasets: list[str], confidence: float = 0.95, least: int = 100, bins: int = 2) -> DataFrame:
    """``gate_of`` the sums of two arms."""
    return gate_of(arm_sums(candidate, comparator), replicates, datasets, confidence, least, bins)


def gate_of(sums: DataFrame, replicates: int, datasets: list[str], confidence: float = 0.95, least: int = 100, bins: int = 2, papers: DataFrame | None = None) -> DataFrame:
    """One row per metric: its value for the papers as they are, its one-sided bound, whether that is no worse than 0, and the
    status of all four together: pass if all are; inconclusive if anything is undefined, one undefined replicate voiding all;
    inferior if every replicate of one metric is worse; else inconclusive. Values are in units of 1e-9."""
    deltas = deltas_of(sums, replicates, datasets, least, bins, papers)
    long = deltas.unpivot("replicate", METRICS, "metric", "delta")
    drawn = F.when(F.col("replicate") >= 0, F.col("delta"))
    higher = F.col("metric") == "qwk"
    per = long.groupBy("metric").agg(
        F.max(F.when(F.col("replicate") < 0, F.col("delta"))).alias("point"), F.count(drawn).alias("defined"), F.min(drawn).alias("lo"), F.max(drawn).alias("hi"),
        conservative_bound(drawn, replicates, confidence).alias("upper"), conservative_bound(drawn, replicates, confidence, upper=False).alias("lower"),
    )
    sound = F.col("point").isNotNull() & (F.col("defined") == replicates)
    bound = F.when(sound, F.when(higher, F.col("lower")).otherwise(F.col("upper")))
    passed = F.coalesce(F.when(higher, bound >= 0).otherwise(bound <= 0), F.lit(False))
    worse = F.when(higher, F.col("hi") < 0).otherwise(F.col("lo") > 0)
    judged = per.select("metric", "point", bound.alias("bound"), passed.alias("passed"), (replicates - F.col("defined")).alias("undefined"), sound.alias("sound"), worse.alias("worse"))
    every = Window.partitionBy(F.lit(0))  # four rows
    status = F.when(F.min("passed").over(every), "pass").when(~F.min("sound").over(every), "inconclusive").when(F.max("worse").over(every), "inferior").otherwise("inconclusive")
    e9 = lambda c: F.floor(F.col(c) * 1e9 + 0.5).alias(f"{c}_e9")
    return judged.select("metric", e9("point"), e9("bound"), "passed", "undefined", status.alias("status"))
