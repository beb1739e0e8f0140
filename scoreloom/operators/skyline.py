"""Rows that no other row of their group beats in any number of goods.

1. Rows with the same goods are one point. Every group is cut into a grid of ``splits`` ranges of each good; a cell that has an occupied
   cell before it in every good is dominated as a whole, and its points never meet another point.
2. The points of the other cells, at most k * splits^(k-1) of these in a group, are dealt into parts of ``most`` points, and each part
   keeps its own skyline.
3. A point can then only be beaten by one of a cell that is nowhere behind its own and level with it in some good, or of another
   part of its cell. These pairs of parts are compared, one task each.

So no group, and no cell of a group, of any share of all rows is gathered in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.operators.skew import hot_values, salted_join
from scoreloom.session import reliable_checkpoints

SPLITS, MOST = 8, 20_000
#: Groups, cells or points of a skyline that may be broadcast.
BROADCAST_ROWS = 100_000


def dominated(x: np.ndarray, y: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """Which rows of ``x`` have a row of ``y`` that is nowhere larger and somewhere smaller."""
    out = np.zeros(len(x), bool)
    step = max(1, block // max(1, len(y)))
    for a in range(0, len(x), step):
        some = x[a : a + step, None, :]
        out[a : a + step] = ((y[None] <= some).all(2) & (y[None] < some).any(2)).any(1)
    return out


def front(x: np.ndarray, block: int = 512) -> np.ndarray:
    """Which rows no other row beats. In the order of their columns, no row is beaten by one after it."""
    order = np.lexsort(x.T[::-1])
    kept = np.zeros(0, np.int64)
    for a in range(0, len(x), block):
        some = order[a : a + block]
        some = some[~dominated(x[some], x[kept])] if len(kept) else some
        some = some[~dominated(x[some], x[some])]
        kept = np.concatenate([kept, some])
    out = np.zeros(len(x), bool)
    out[kept] = True
    return out


def cell_pairs(cells: np.ndarray, splits: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (cell, cell that may beat some of its points) of the occupied cells that none beats as a whole, the same cell included."""
    at = np.stack([cells // splits**i % splits for i in range(k)], 1)
    grid = np.zeros((splits + 1,) * k, bool)
    grid[tuple((at + 1).T)] = True
    for axis in range(k):
        grid = np.logical_or.accumulate(grid, axis)
    alive = ~grid[tuple(at.T)]  # nothing before it in every good
    cells, at = cells[alive], at[alive]
    first, second = [], []
    for a in range(0, len(cells), 256):
        here = at[a : a + 256, None, :]
        i, j = np.nonzero((at[None] <= here).all(2) & (at[None] == here).any(2))
        first.append(cells[a + i])
        second.append(cells[j])
    return (np.concatenate(first), np.concatenate(second)) if first else (cells, cells)


def skyline(rows: DataFrame, group: list[str], goods: list[str], *, splits: int = SPLITS, most: int = MOST) -> DataFrame:
    """The rows of each group that no other row of it is at most as large in all ``goods`` and smaller in one (negate what is better
    when larger). Rows with the same goods stand or fall together; rows with a null or NaN good take no part."""
    reliable_checkpoints(rows.sparkSession)
    k = len(goods)
    value = {f"_v{i}": F.col(g).cast("double") for i, g in enumerate(goods)}
    sound = F.lit(True)
    for v in value.values():
        sound = sound & v.isNotNull() & ~F.isnan(v)
    keyed = rows.withColumn("_g", F.to_json(F.struct(*[F.col(c) for c in group]), {"ignoreNullFields": "false"}) if group else F.lit("")).withColumns(value).where(sound)
    axes = list(value)
    points = keyed.select("_g", *axes).distinct()
    spans = points.groupBy("_g").agg(F.count("*").alias("_n"), *[f(a).alias(f"{a}_{n}") for a in axes for n, f in (("lo", F.min), ("hi", F.max))]).checkpoint()
    few = spans.count() <= BROADCAST_ROWS
    located = points.join(F.broadcast(spans), "_g") if few else salted_join(points, spans, "_g", hot_values(spans, "_g", "_n"), [F.col(a) for a in axes])
    part = lambda a: F.when(F.col(f"{a}_hi") > F.col(f"{a}_lo"), F.least(F.lit(splits - 1), F.floor((F.col(a) - F.col(f"{a}_lo")) / (F.col(f"{a}_hi") - F.col(f"{a}_lo")) * splits))).otherwise(0)
    cell = sum((part(a) * splits**i for i, a in enumerate(axes[1:], 1)), part(axes[0])).cast("long")
    located = located.select("_g", *axes, cell.alias("_c"))
    cells = located.groupBy("_g", "_c").agg(F.count("*").alias("_held")).checkpoint()

    def pairs(table: pa.Table) -> pa.Table:
        first, second = cell_pairs(table["_c"].to_numpy(), splits, k)
        return pa.table({"_g": pa.array([table["_g"][0].as_py()] * len(first), pa.string()), "_c": pa.array(first, pa.int64()), "_d": pa.array(second, pa.int64())})

    near = cells.groupBy("_g").applyInArrow(pairs, "_g string, _c long, _d long").checkpoint()
    alive = cells.join(near.where("_c = _d").select("_g", "_c"), ["_g", "_c"]).withColumn("_parts", F.ceil(F.col("_held") / F.lit(most)).cast("int")).checkpoint()
    few = alive.count() <= BROADCAST_ROWS
    held = located.join(F.broadcast(alive) if few else alive, ["_g", "_c"]).withColumn("_s", F.pmod(F.xxhash64(*axes), F.col("_parts")).cast("int"))

    def own(table: pa.Table) -> pa.Table:
        return table.filter(pa.array(front(np.stack([table[a].to_numpy() for a in axes], 1))))

    kind = "_g string, _c long, _s int, " + ", ".join(f"{a} double" for a in axes)
    local = held.select("_g", "_c", "_s", *axes).groupBy("_g", "_c", "_s").applyInArrow(own, kind).checkpoint()

    parts = local.select("_g", "_c", "_s").distinct().checkpoint()
    others = parts.select("_g", F.col("_c").alias("_d"), F.col("_s").alias("_t"))
    met = near.join(parts, ["_g", "_c"]).join(others, ["_g", "_d"]).where("_c <> _d OR _s <> _t")
    left = local.join(met, ["_g", "_c", "_s"]).groupBy("_g", "_c", "_s", "_d", "_t")
    right = local.select("_g", F.col("_c").alias("_d"), F.col("_s").alias("_t"), *axes).join(met, ["_g", "_d", "_t"])
    right = right.select(*[F.col(c).alias(c) for c in ("_g", "_c", "_s", "_d", "_t", *axes)]).groupBy("_g", "_c", "_s", "_d", "_t")

    def lose(a: pa.Table, b: pa.Table) -> pa.Table:
        x, y = (np.stack([t[v].to_numpy() for v in axes], 1) if t.num_rows else np.zeros((0, k)) for t in (a, b))
        gone = dominated(x, y) if len(x) and len(y) else np.zeros(len(x), bool)
        return a.select(["_g", *axes]).filter(pa.array(gone, pa.bool_()))

    beaten = left.cogroup(right).applyInArrow(lose, "_g string, " + ", ".join(f"{a} double" for a in axes)).distinct()
    best = local.select("_g", *axes).join(beaten, ["_g", *axes], "left_anti").checkpoint()
    few = best.count() <= BROADCAST_ROWS
    return keyed.join(F.broadcast(best) if few else best, ["_g", *axes], "left_semi").select(*rows.columns)
