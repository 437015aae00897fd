"""Arrow text columns as numpy byte arrays, and the vectorised word splitting and hashing the operators share.

Everything here works on one slice of one Arrow batch inside a task; Spark partitions and moves the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from voxmere.llm.common import SLICE_BYTES

U64 = np.uint64
#: Separators of words: space and the control characters 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Bytes with A to Z mapped to a to z; all others, so also those of multi-byte characters, stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_STEP = U64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads all 64 bits (a bijection)."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(29))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(32))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (int64, one more than rows) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offs


def slices(column: pa.Array, size: int = SLICE_BYTES, most: int = 4096) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of rows of about `size` bytes; a longer text stands alone; at most `most` rows."""
    data, offs = text_buffers(column)
    row, rows = 0, len(offs) - 1
    while row < rows:
        stop = int(np.searchsorted(offs, offs[row] + size, "right")) - 1
        stop = min(rows, max(stop, row + 1), row + most)
        yield row, stop, data[offs[row] : offs[stop]], offs[row : stop + 1] - offs[row]
        row = stop


@dataclass
class Tokens:
    """Runs of bytes: where they start and end, which row they are in, and a 64-bit hash of their bytes."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray

    def per_row(self, rows: int) -> np.ndarray:
        return np.bincount(self.row, minlength=rows)


def run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of data[start:end] for each non-empty run; runs are disjoint and in order."""
    if not len(start):
        return np.zeros(0, U64)
    lens = end - start
    first = np.cumsum(lens) - lens
    total = int(lens.sum())
    pos = np.arange(total) - np.repeat(first, lens)
    at = pos + np.repeat(start, lens)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(lens.max()), _STEP, U64))
        return mix(np.add.reduceat((data[at].astype(U64) + U64(1)) * power[pos], first) ^ lens.astype(U64))


def runs(keep: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True within each row: start, end, row."""
    n = len(keep)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = keep[:-1], keep[1:]
    edge = offs[(offs > 0) & (offs < n)]
    before[edge], after[edge - 1] = False, False
    start, end = np.flatnonzero(keep & ~before), np.flatnonzero(keep & ~after) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


def words(data: np.ndarray, offs: np.ndarray) -> Tokens:
    """The words [^ \\t-\\r]+ of each row."""
    start, end, row = runs(~SPACE[data], offs)
    return Tokens(start, end, row, run_hashes(data, start, end))


def grams(tokens: Tokens, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each run of n words within a row."""
    if len(tokens.row) < n:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    inside = tokens.row[n - 1 :] == tokens.row[: len(tokens.row) - n + 1]
    with np.errstate(over="ignore"):
        h = np.zeros(len(inside), U64)
        for k in range(n):
            h = h * U64(0x9FB21C651E98DF25) + tokens.hash[k : len(tokens.hash) - n + 1 + k]
            h ^= h >> U64(31)
        return tokens.row[: len(inside)][inside], mix(h[inside] + U64(n))
