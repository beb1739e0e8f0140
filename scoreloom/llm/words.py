"""Vectorised word hashing over Arrow string columns, shared by the operators that compare word n-grams.

Texts are handled as UTF-8 bytes. A text is never cut: a block holds whole rows, at least one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

BLOCK_BYTES = 1 << 20
#: Rows of whole texts that go to a Python worker at a time.
BATCH_ROWS = 1000
_GROW = np.uint64(0x9E3779B97F4A7C15)
_P = np.uint64(0xD6E8FEB86659FD93)


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold at most BATCH_ROWS rows (the session's own smaller setting stays): texts are much longer than numbers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words."""
    x = (x + _GROW).astype(np.uint64, copy=False)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string() if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a longer row is a range of its own."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


def byte_table(pattern_bytes: bytes) -> np.ndarray:
    """True for the byte values given."""
    table = np.zeros(256, bool)
    table[np.frombuffer(pattern_bytes, np.uint8)] = True
    return table


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: White space of the shingling contract: blank and \t \n \v \f \r.
NOT_SPACE = ~byte_table(b" \t\n\x0b\x0c\r")
#: Word bytes of the decontamination contract: digits, letters and every byte of a non-ASCII character.
ALNUM = byte_table(bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100)))


def word_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, fold: np.ndarray | None = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all rows in order, and each row's offsets into them; A-Z are lower-cased, or nothing if ``fold`` is None."""
    n = len(data)
    rows = len(offsets) - 1
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    low = data if fold is None else fold[data]
    inside = table[low]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    if len(starts) == 0:
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    lengths = ends - starts
    letters = (low[inside].astype(np.uint64)) + np.uint64(1)
    first = np.cumsum(lengths) - lengths
    within = np.arange(len(letters)) - np.repeat(first, lengths)
    powers = np.multiply.accumulate(np.full(int(lengths.max()), _P, np.uint64))
    letters *= powers[within]
    return mix64(np.add.reduceat(letters, first) ^ (lengths.astype(np.uint64) << np.uint64(48))), np.searchsorted(starts, offsets)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; the last n - 1 positions have none."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out = mix64(out ^ words[j : j + m]) if j == 0 else mix64(out * np.uint64(3) + words[j : j + m])
    return out


def within_rows(offsets: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of the ``total`` n-gram positions have all their words in one row."""
    ok = np.ones(max(total, 0), bool)
    for k in range(1, n):
        cut = offsets[1:] - k
        cut = cut[(cut >= 0) & (cut < total)]
        ok[cut] = False
    return ok
