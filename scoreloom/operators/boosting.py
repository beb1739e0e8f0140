"""Boosted regression trees from histograms of gradients.

Features are cut into at most ``bins`` bins (between their distinct values, or at quantiles), and rows are reduced to one for each
combination of bins with its count and sums of the target: under squared error, rows of one combination always share prediction and node, so
nothing is lost. A level of a tree is one job: every task adds up count and gradient by (node, feature, bin), these are summed by
a shuffle, and the driver gets nothing but the sums, at most nodes x features x bins of them, and picks the splits.

Defined cases: a null, NaN or infinite feature or target makes the job fail; without rows there is no model; a feature of one value is
never split; of equal gains the first feature and lowest cut win.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.operators.fitting import COUNTED_ROWS, _sound
from scoreloom.session import reliable_checkpoints

BINS = 255


@dataclass
class Tree:
    """Nodes by number: the feature and last bin of the left side, the children, and the value of a leaf (feature -1)."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        self.feature[node], self.cut[node] = feature, cut
        for side in (self.left, self.right):
            side[node] = len(self.feature)
            for column, empty in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.right, 0), (self.value, 0.0)):
                column.append(empty)
        return self.left[node], self.right[node]

    def node_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row of bins."""
        at = np.zeros(len(x), np.int64)
        feature, cut, left, right = (np.array(c) for c in (self.feature, self.cut, self.left, self.right))
        while (inner := feature[at] >= 0).any():
            rows = np.flatnonzero(inner)
            here = at[rows]
            at[rows] = np.where(x[rows, feature[here]] <= cut[here], left[here], right[here])
        return at


@dataclass
class Model:
    features: list[str]
    edges: list[list[float]]
    base: float
    trees: list[Tree] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def of_bins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += np.array(t.value)[t.node_of(x)]
        return out


def _binned(values: list[np.ndarray], edges: list[list[float]]) -> np.ndarray:
    """The number of edges below each value."""
    return np.stack([np.searchsorted(np.array(e), v, side="left") for e, v in zip(edges, values, strict=True)], 1)


def bin_edges(rows: DataFrame, features: list[str], bins: int = BINS) -> list[list[float]]:
    """Cuts of every feature: half-way between its distinct values if these are at most ``bins``, else at approximate quantiles."""
    out = []
    for f in features:
        few = [r[0] for r in rows.select(F.col(f).cast("double")).distinct().limit(bins + 1).collect()]
        if len(few) <= bins:
            few.sort()
            out.append([(a + b) / 2 for a, b in zip(few[:-1], few[1:], strict=True)])
        else:
            found = rows.agg(F.percentile_approx(F.col(f).cast("double"), [k / bins for k in range(1, bins)], 10_000)).first()[0]
            out.append(sorted(set(found)))
    return out


def _sums(batches: Iterator[pa.RecordBatch], model: Model, tree: Tree, open_: list[int], bins: int) -> pa.RecordBatch:
    """(node, feature, bin, n, g) of the open nodes, and node -1 with the held-out count and squared error."""
    k = len(model.features)
    place = np.full(len(tree.feature), -1)
    place[open_] = np.arange(len(open_))
    n_, g_ = np.zeros(len(open_) * k * bins), np.zeros(len(open_) * k * bins)
    count = loss = 0.0
    for batch in batches:
        x = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(k)], 1)
        n, s, q, held = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("n", "s", "q", "held"))
        pred = model.of_bins(x)
        count += (n * held).sum()
        loss += (held * (q - 2 * pred * s + n * pred * pred)).sum()
        node = place[tree.node_of(x)]
        rows = np.flatnonzero((node >= 0) & (held == 0))
        for f in range(k):
            at = (node[rows] * k + f) * bins + x[rows, f]
            n_ += np.bincount(at, n[rows], len(n_))
            g_ += np.bincount(at, (n * pred - s)[rows], len(g_))
    at = np.flatnonzero(n_)
    columns = [np.append(np.array(open_)[at // (k * bins)], -1), np.append(at // bins % k, 0), np.append(at % bins, 0), np.append(n_[at], count), np.append(g_[at], loss)]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["node", "feature", "bin", "n", "g"])


def best_split(n: np.ndarray, g: np.ndarray, least: int, l2: float) -> tuple[float, int, int]:
    """(gain, feature, last bin of the left side) of counts and gradients by (feature, bin); no gain if nothing may be split."""
    left_n, left_g = n.cumsum(1)[:, :-1], g.cumsum(1)[:, :-1]
    whole_n, whole_g = n[0].sum(), g[0].sum()
    right_n, right_g = whole_n - left_n, whole_g - left_g
    gain = left_g**2 / (left_n + l2) + right_g**2 / (right_n + l2) - whole_g**2 / (whole_n + l2)
    gain = np.where((left_n >= max(least, 1)) & (right_n >= max(least, 1)), gain, -np.inf)
    at = int(np.argmax(gain)) if gain.size else 0
    return (float(gain.ravel()[at]), at // gain.shape[1], at % gain.shape[1]) if gain.size else (-np.inf, 0, 0)


def fit(
    rows: DataFrame, features: list[str], target: str, *, trees: int = 200, rate: float = 0.08, leaves: int = 31, depth: int = 8, least: int = 20, l2: float = 0.1, bins: int = BINS,
    held_out: str | None = None, patience: int = 10, counted_rows: int = COUNTED_ROWS, weight: str | None = None,
) -> Model:
    """Trees of at most ``leaves`` leaves, grown level by level (of a level's splits the largest gains first), each leaf with at least
    ``least`` rows. ``held_out``: a boolean column; fitting stops when its error has not fallen for ``patience`` trees. ``weight``: a column
    of how many equal rows a row stands for.

    Up to ``counted_rows`` combinations of bins (counted first) are summed in the driver, else every level is a job.
    """
    reliable_checkpoints(rows.sparkSession)
    held = F.coalesce(F.col(held_out), F.lit(False)).cast("int") if held_out else F.lit(0)
    kept = _sound(rows.withColumns({"_held": held, "_weight": F.col(weight) if weight else F.lit(1)}), [*features, target, "_held", "_weight"])
    edges = bin_edges(kept, features, bins)
    k, wide = len(features), max([len(e) for e in edges] or [0]) + 1
    names = [f"b{i}" for i in range(k)]

    def cut(batches):
        for b in batches:
            x = _binned([b.column(f).to_numpy(zero_copy_only=False) for f in features], edges)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, i], pa.int32()) for i in range(k)), b.column(target), b.column("_held").cast(pa.int32()), b.column("_weight")], names=[*names, "y", "held", "w"])

    counts = kept.mapInArrow(cut, ", ".join(f"{b} int" for b in names) + ", y double, held int, w double")
    y, w = F.col("y"), F.col("w")
    counts = counts.groupBy(*names, "held").agg(F.sum("w").cast("long").alias("n"), F.sum(w * y).alias("s"), F.sum(w * y * y).alias("q")).checkpoint()
    first = counts.where("held = 0").agg(F.sum("n"), F.sum("s")).first()
    if not first[0]:
        raise ValueError("boosting needs rows")
    model = Model(list(features), edges, first[1] / first[0])
    local = pa.Table.from_pandas(counts.toPandas(), preserve_index=False).to_batches() if counts.limit(counted_rows + 1).count() <= counted_rows else None

    def level(tree: Tree, open_: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        if local is not None:
            found = _sums(iter(local), model, tree, open_, wide).to_pylist()
        else:
            parts = counts.mapInArrow(lambda batches: iter([_sums(batches, model, tree, open_, wide)]), "node int, feature int, bin int, n double, g double")
            found = [r.asDict() for r in parts.groupBy("node", "feature", "bin").agg(F.sum("n").alias("n"), F.sum("g").alias("g")).collect()]
        out = {i: (np.zeros((k, wide)), np.zeros((k, wide))) for i in open_} | {-1: (np.zeros((k, wide)), np.zeros((k, wide)))}
        for r in found:
            out[r["node"]][0][r["feature"], r["bin"]], out[r["node"]][1][r["feature"], r["bin"]] = r["n"], r["g"]
        return out

    for _ in range(trees):
        tree, open_, used = Tree(), [0], 1
        for floor in range(depth + 1):
            sums = level(tree, open_)
            if floor == 0 and held_out:
                model.losses.append(sums[-1][1][0, 0] / max(sums[-1][0][0, 0], 1.0))
            splits = []
            for i in open_:
                n, g = sums[i]
                tree.value[i] = float(-rate * g[0].sum() / (n[0].sum() + l2))
                gain, f, c = best_split(n, g, least, l2)
                if gain > 1e-12 and floor < depth:
                    splits.append((-gain, i, f, c))
            splits = sorted(splits)[: leaves - used]
            used += len(splits)
            open_ = [child for _, i, f, c in splits for child in tree.split(i, f, c)]
            if not open_:
                break
        if held_out and len(model.losses) > patience and min(model.losses[-patience:]) >= min(model.losses[:-patience]):
            break
        model.trees.append(tree)
    return model


def predict(model: Model, rows: DataFrame, out: str = "predicted") -> DataFrame:
    """``rows`` with the model's prediction."""

    @F.arrow_udf("double")
    def value(*columns: pa.Array) -> pa.Array:
        return pa.array(model.of_bins(_binned([c.to_numpy(zero_copy_only=False) for c in columns], model.edges)))

    return rows.withColumn(out, value(*[F.col(f).cast("double") for f in model.features]))
