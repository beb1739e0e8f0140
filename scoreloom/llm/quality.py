"""Quality classifier: a byte-level convolutional network written in numpy.

The text's bytes are cut into chunks of ``2 * HALF`` bytes that overlap by half and together cover the whole document.
``FILTERS`` learned filters of ``WIDTH`` bytes run over every position; their rectified outputs are averaged in each chunk,
centred and scaled, and together with their squares go through a learned layer of ``HIDDEN`` rectified units. Every unit is
max-pooled over all chunks of the document, and one logistic output combines the pooled units into a probability.

Training takes at most ``sample`` labelled documents (those of the smallest keyed hash; a documented bound, as gathering them
on the driver must not grow with the data; of rows that repeat an id the smallest text and label count); filters and layers are learned together by stochastic gradients. Rows whose
crc32(doc_id) mod 4 is 2 are never trained on. Only bytes are inputs. Scoring is one pass without a shuffle.

Defined cases: null and empty texts are one chunk without positions and get the same constant score; invalid labels (null or
other than 0 and 1) are ignored; with no usable labels of both kinds every score is the share of label 1, or 0.5 without any;
repeated rows get equal scores; all other columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.llm.words import small_batches, utf8

WIDTH, FILTERS, HIDDEN, HALF = 4, 16, 12, 128
SAMPLE = 3000
EPOCHS = 6
THRESHOLD = 0.7
#: Bytes convolved at a time.
STRIP = 1 << 16


class ByteNetwork:
    """Weights and the forward and backward passes over packed documents."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {
            "filters": rng.normal(0, 0.5, (WIDTH, 256, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "w1": rng.normal(0, 0.3, (2 * FILTERS, HIDDEN)).astype(np.float32),
            "b1": np.full(HIDDEN, 0.1, np.float32),
            "w2": rng.normal(0, 0.3, HIDDEN).astype(np.float32),
            "b2": np.zeros(1, np.float32),
        }
        self.centre, self.scale = np.zeros(FILTERS, np.float32), np.ones(FILTERS, np.float32)
        self.constant: float | None = None

    @staticmethod
    def pack(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes padded per row to whole halves, which positions are real, first half and number of halves of each row."""
        n = np.diff(at)
        halves = np.maximum(1, -(-(n + WIDTH - 1) // HALF))
        first = np.cumsum(halves) - halves
        flat = np.zeros(int(halves.sum()) * HALF + WIDTH, np.uint8)
        real = np.zeros(len(flat) - WIDTH, bool)
        to = np.arange(len(data)) + np.repeat(first * HALF - at[:-1], n)
        flat[to] = data
        real[to] = True
        return flat, real, first, halves

    def respond(self, flat: np.ndarray, real: np.ndarray) -> np.ndarray:
        """Rectified filter outputs of every position."""
        n = len(real)
        out = np.take(self.p["filters"][0], flat[:n], axis=0)
        for j in range(1, WIDTH):
            out += np.take(self.p["filters"][j], flat[j : j + n], axis=0)
        out += self.p["bias"]
        np.maximum(out, 0, out=out)
        out *= real[:, None]
        return out

    def halves(self, flat: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the outputs and numbers of positions by half chunk, strip by strip."""
        parts = [self.respond(flat[a : a + STRIP + WIDTH], real[a : a + STRIP]).reshape(-1, HALF, FILTERS).sum(1) for a in range(0, len(real), STRIP)]
        return np.concatenate(parts), real.reshape(-1, HALF).sum(1)

    @staticmethod
    def chunks(first: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The two halves of every chunk (equal where a row has one half) and each row's first chunk."""
        count = np.maximum(halves - 1, 1)
        start = np.cumsum(count) - count
        left = np.arange(int(count.sum())) + np.repeat(first - start, count)
        return left, left + np.repeat(halves > 1, count), start

    def forward(self, sums: np.ndarray, counts: np.ndarray, first: np.ndarray, halves: np.ndarray) -> dict:
        left, right, start = self.chunks(first, halves)
        both = (left != right)[:, None]
        size = np.maximum(counts[left] + np.where(both[:, 0], counts[right], 0), 1)[:, None].astype(np.float32)
        mean = (sums[left] + np.where(both, sums[right], 0)) / size
        z = (mean - self.centre) / self.scale
        inputs = np.concatenate([z, np.minimum(z * z, 50) / 4], 1)
        hidden = np.maximum(inputs @ self.p["w1"] + self.p["b1"], 0)
        pooled = np.maximum.reduceat(hidden, start, axis=0)
        logit = pooled @ self.p["w2"] + self.p["b2"][0]
        return {"left": left, "right": right, "start": start, "size": size, "z": z, "inputs": inputs, "hidden": hidden, "pooled": pooled, "logit": logit, "mean": mean}

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        data, at = utf8(texts)
        out, row = np.zeros(len(texts)), 0
        while row < len(texts):
            stop = max(row + 1, int(np.searchsorted(at, at[row] + (1 << 20), side="right")) - 1)
            flat, real, first, halves = self.pack(data[at[row] : at[stop]], at[row : stop + 1] - at[row])
            logit = self.forward(*self.halves(flat, real), first, halves)["logit"].astype(np.float64)
            out[row:stop] = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
            row = stop
        return out

    def gradients(self, flat: np.ndarray, real: np.ndarray, first: np.ndarray, halves: np.ndarray, labels: np.ndarray) -> dict:
        """Gradients of the mean log loss; only the chunks that won a pooled unit carry any."""
        sums, counts = self.halves(flat, real)
        f = self.forward(sums, counts, first, halves)
        rows = len(labels)
        d = ((1 / (1 + np.exp(-f["logit"]))) - labels).astype(np.float32) / rows
        g = {"w2": f["pooled"].T @ d, "b2": np.array([d.sum()], np.float32)}
        owner = np.repeat(np.arange(rows), np.diff(np.append(f["start"], len(f["hidden"]))))
        won = (f["hidden"] == f["pooled"][owner]) & (f["hidden"] > 0)
        d_hidden = np.where(won, d[owner][:, None] * self.p["w2"], 0).astype(np.float32)
        g["w1"], g["b1"] = f["inputs"].T @ d_hidden, d_hidden.sum(0)
        d_in = d_hidden @ self.p["w1"].T
        square = d_in[:, FILTERS:] * (f["z"] / 2) * (f["z"] * f["z"] < 50)
        d_mean = (d_in[:, :FILTERS] + square) / self.scale / f["size"]
        by_half = np.zeros_like(sums)
        live = np.flatnonzero(np.any(d_mean != 0, axis=1))
        np.add.at(by_half, f["left"][live], d_mean[live])
        two = live[f["left"][live] != f["right"][live]]
        np.add.at(by_half, f["right"][two], d_mean[two])
        used = np.flatnonzero(np.any(by_half != 0, axis=1))
        at = (used[:, None] * HALF + np.arange(HALF)).ravel()
        at = at[real[at]]
        out = np.take(self.p["filters"][0], flat[at], axis=0)
        for j in range(1, WIDTH):
            out += np.take(self.p["filters"][j], flat[at + j], axis=0)
        d_out = by_half[at // HALF] * (out + self.p["bias"] > 0)
        g["bias"], g["filters"] = d_out.sum(0), np.zeros_like(self.p["filters"])
        for j in range(WIDTH):
            letters = flat[at + j]
            order = np.argsort(letters, kind="stable")
            kinds, begin = np.unique(letters[order], return_index=True)
            if len(kinds):
                g["filters"][j, kinds] = np.add.reduceat(d_out[order], begin, axis=0)
        return g

    def fit(self, texts: list[str | None], labels: list[int], epochs: int = EPOCHS, batch: int = 64, rate: float = 0.01, seed: int = 7) -> ByteNetwork:
        y = np.array(labels, np.float32)
        if len(y) == 0 or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step = 0
        column = pa.array(texts, pa.string())
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            if epoch < 2:  # the centre and scale of the chunk means, while the filters still move most
                some = column.take(pa.array(order[:300]))
                flat, real, first, halves = self.pack(*utf8(some))
                self.centre, self.scale = np.zeros(FILTERS, np.float32), np.ones(FILTERS, np.float32)
                mean = self.forward(*self.halves(flat, real), first, halves)["mean"]
                self.centre, self.scale = np.median(mean, 0).astype(np.float32), (np.subtract(*np.percentile(mean, [75, 25], axis=0)) / 1.35 + 1e-2).astype(np.float32)
            for a in range(0, len(y), batch):
                pick = order[a : a + batch]
                g = self.gradients(*self.pack(*utf8(column.take(pa.array(pick)))), y[pick])
                step += 1
                now = rate * (1 - 0.9 * step / (epochs * -(-len(y) // batch)))
                for k, x in g.items():
                    m[k] += 0.1 * (x - m[k])
                    v[k] += 0.01 * (x * x - v[k])
                    self.p[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
        return self


def held_out(doc_id: Column) -> Column:
    """Rows kept for evaluation: crc32 of the id as text mod 4 is 2 (a null id as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, epochs: int = EPOCHS) -> ByteNetwork:
    """Fit on at most ``sample`` labelled rows that are not held out; labels: doc_id, quality."""
    small_batches(docs.sparkSession)
    usable = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("y"))
    chosen = usable.where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = found.groupBy("doc_id").agg(F.min(F.struct("text", "y")).alias("r")).select("doc_id", "r.*").collect()  # at most ``sample``
    rows = sorted(rows, key=lambda r: r.doc_id)
    return ByteNetwork().fit([r.text for r in rows], [r.y for r in rows], epochs)


def score(text: Column, network: ByteNetwork) -> Column:
    """The probability of label 1."""
    return F.arrow_udf(lambda texts: pa.array(network.scores(texts), pa.float64()), T.DoubleType())(text)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``."""
    return docs.where(score(F.col("text"), train(docs, labels)) >= threshold)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    network = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), network).alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
