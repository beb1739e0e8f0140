"""Exact integers: components of vectors, and integers of any size as bytes whose order (unsigned, from the left) is that of the numbers."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np

_LONG = (1 << 63) - 1


def to_bytes(numbers: Iterable[int]) -> list[bytes]:
    """Two bytes for sign and length, then the magnitude, inverted for negative numbers."""
    out = []
    for n in numbers:
        size = (abs(n).bit_length() + 7) // 8
        raw = abs(n).to_bytes(size, "big")
        out.append((0x8000 + size).to_bytes(2, "big") + raw if n >= 0 else (0x8000 - size).to_bytes(2, "big") + bytes(255 - b for b in raw))
    return out


def from_bytes(keys: Iterable[bytes]) -> list[int]:
    out = []
    for k in keys:
        raw = k[2:]
        out.append(int.from_bytes(raw, "big") if k[0] >= 0x80 else -int.from_bytes(bytes(255 - b for b in raw), "big"))
    return out


def to_long(numbers: Iterable[int]) -> list[int]:
    """The numbers, those beyond a long as its ends."""
    return [min(max(n, -_LONG - 1), _LONG) for n in numbers]


def quantised(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): doubles if all products of two rows stay below 2^53, Python's integers otherwise."""
    with np.errstate(over="ignore"):
        whole = np.floor(vectors * scale)
    top = float(np.abs(whole).max(initial=0))
    if top < 2.0**26 and top * top * max(vectors.shape[1], 1) < 2.0**53:
        return whole
    exact = [[int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale) for x in row] for row in vectors.tolist()]
    return np.array(exact, object).reshape(vectors.shape)
