"""Batches of texts as one array of Unicode code points, for vectorised work in Arrow batches."""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LAST = sys.maxunicode + 1


@functools.lru_cache(1)
def alnum_table() -> np.ndarray:
    """True at the code points that are letters or digits."""
    return np.fromiter((chr(i).isalnum() for i in range(LAST)), bool, LAST)


def slices(batch: pa.RecordBatch, column: int, size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about so many bytes of text, one row at least: vectorised work takes many times a text's size."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and the offset at which each text begins (one more than texts)."""
    ends = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) for x in texts], out=ends[1:])
    data = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(data, np.uint32), ends


def kept(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters and digits of each text in NFKC and lower case: code points and offsets."""
    same = unicodedata.is_normalized
    flat = [(x if same("NFKC", x) else unicodedata.normalize("NFKC", x)).lower() for x in texts]
    points, at = codes(flat)
    mask = alnum_table()[points]
    before = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return points[mask], before[at]


def grams(points: np.ndarray, width: int) -> np.ndarray:
    """A mixed 64-bit hash of every run of ``width`` code points (runs across texts included)."""
    n = max(0, len(points) - width + 1)
    h = np.zeros(n, np.uint64)
    x = points.astype(np.uint64)
    for k in range(width):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += x[k : k + n]
    return mix(h)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (in place)."""
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h
