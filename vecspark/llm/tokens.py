"""Words and word hashes of Arrow text columns, in bounded blocks.

A word is a maximal run of bytes other than space and \\x09-\\x0D. That is what bytes.split() cuts, and as
UTF-8 has no such byte inside a longer character, cutting bytes and cutting characters agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

#: Bytes of text that one block holds; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20
#: An odd multiplier for polynomial hashes modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xFF51AFD7ED558CCD)


def blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about limit bytes."""
    sizes = np.array(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
    group = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(sizes)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    return batch.column(column).cast(pa.large_binary()).to_pylist()


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit over the word."""
    h = (h ^ (h >> np.uint64(33))) * MIX
    return h ^ (h >> np.uint64(29))


def word_hashes(words: list[bytes]) -> np.ndarray:
    if not words:
        return np.zeros(0, dtype=np.uint64)
    flat = np.empty(len(words), dtype=object)
    flat[:] = words
    return pd.util.hash_array(flat, categorize=False)


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k words of one array, by start; empty if it is shorter."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= BASE
        out += h[j : j + n]
    return mixed(out)


class Words:
    """The words of a block of texts, end to end."""

    def __init__(self, raw: list[bytes | None], lower: bool = False):
        self.lists = [(t.lower() if lower else t).split() if t else [] for t in raw]
        self.lens = np.fromiter(map(len, self.lists), dtype=np.int64, count=len(self.lists))
        self.ends = np.cumsum(self.lens)
        self.starts = self.ends - self.lens
        self.hashes = word_hashes([w for words in self.lists for w in words])


def longs(values: np.ndarray) -> pa.Array:
    """Unsigned hashes as Spark's signed bigint."""
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def ragged(parts: list[np.ndarray]) -> pa.Array:
    """A list<int64> column from one array for each row."""
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int64, copy=False)))
