"""Vectors of whole numbers of any size, and their exact inner products.

Components are float64 values that are whole. A product is taken in float64 where no partial sum can reach 2^53, and in
Python's integers otherwise. Between tasks a score travels as a 64-bit number, held at its ends, and the bytes `beyond`,
which put scores past those ends in order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: The columns of a score, for schemas.
SCORE = "score long, beyond binary"


def whole_numbers(embedding: Column, scale: int) -> Column:
    """floor(scale * x) by component, as doubles; null where the vector is null or holds a null component or one that is not
    finite (after scaling)."""
    wide = F.transform(embedding, lambda x: x.cast("double") * F.lit(float(scale)))
    sound = F.forall(wide, lambda y: F.coalesce(~F.isnan(y) & (F.abs(y) < F.lit(float("inf"))), F.lit(False)))
    # from 2^53 on every double is whole, and floor() would be held at 2^63
    return F.when(sound, F.transform(wide, lambda y: F.when(F.abs(y) < F.lit(2.0**53), F.floor(y).cast("double")).otherwise(y)))


def dense(vectors: pa.Array | pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """Lists of doubles as rows of float64; shorter ones are filled with zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    n = np.diff(vectors.offsets.to_numpy()) if len(vectors) else np.zeros(0, np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    wide = max([width, *n[:1]], default=width) if len(n) and (n == n[0]).all() else max(width, int(n.max(initial=0)))
    if len(n) and n[0] == wide and (n == wide).all():
        return flat.reshape(len(n), wide)
    out = np.zeros((len(n), wide))
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x for x in (a, b))


def norms(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        largest = np.abs(x).max(axis=1, initial=0.0)
        return largest * np.sqrt(((x / np.where(largest > 0, largest, 1.0)[:, None]) ** 2).sum(axis=1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a with all rows of b: float64 if all are exact in it, else Python's integers."""
    a, b = same_width(a, b)
    with np.errstate(over="ignore", invalid="ignore"):
        large = norms(a)[:, None] * norms(b)[None, :] >= 2.0**52
        out = a @ b.T
    if not large.any():
        return out
    out = np.where(large, 0, out).astype(np.int64).astype(object)
    whole_a, whole_b = {}, {}
    for i, j in zip(*np.nonzero(large), strict=True):
        x = whole_a[i] if i in whole_a else whole_a.setdefault(i, list(map(int, a[i])))
        y = whole_b[j] if j in whole_b else whole_b.setdefault(j, list(map(int, b[j])))
        out[i, j] = sum(map(int.__mul__, x, y))
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k highest scores, in order, ties to smaller ids."""
    if len(scores) > 4 * k and scores.dtype != object:
        able = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return able[np.lexsort((ids[able], -scores[able]))[:k]]
    if scores.dtype != object:
        return np.lexsort((ids, -scores))[:k]
    return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)


def as_columns(values: list[int]) -> list[pa.Array]:
    """The two columns of SCORE."""

    def beyond(v: int) -> bytes | None:
        if LEAST < v < MOST:
            return b""
        size = (v.bit_length() + 7) // 8
        digits = abs(v).to_bytes(size, "big")
        if v > 0:
            return b"\x02" + size.to_bytes(4, "big") + digits
        return b"\x01" + ((1 << 32) - 1 - size).to_bytes(4, "big") + bytes(255 - d for d in digits)

    return [pa.array([min(max(v, LEAST), MOST) for v in values], pa.int64()), pa.array([beyond(v) for v in values], pa.binary())]


def from_columns(score: int, beyond: bytes | None) -> int:
    if not beyond:
        return score
    digits = beyond[5:]
    return int.from_bytes(digits, "big") if beyond[0] == 2 else -int.from_bytes(bytes(255 - d for d in digits), "big")
