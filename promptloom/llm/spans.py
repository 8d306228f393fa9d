"""Texts of an Arrow batch as one byte buffer: words, lines and hashes of any span, without a Python loop.

A word is a run of bytes other than 0x20 and 0x09-0x0D; texts never run into each other. A null text is empty.
Hashes are 64-bit polynomials over a random value per byte, finished with a mixer.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTES = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1), as products of a coarse and a fine row."""
    fine = np.full(1024, base, np.uint64)
    fine[0] = 1
    coarse = np.full(n // 1024 + 1, pow(base, 1024, 1 << 64), np.uint64)
    coarse[0] = 1
    return np.multiply.outer(np.cumprod(coarse, dtype=np.uint64), np.cumprod(fine, dtype=np.uint64)).ravel()[:n]


class Prefix:
    """Prefix sums of a byte buffer; hashes any spans of it."""

    def __init__(self, data: np.ndarray, values: np.ndarray = _BYTES):
        self._down = _powers(pow(_BASE, -1, 1 << 64), len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * _powers(_BASE, len(data)), out=self._sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        body = (self._sums[ends] - self._sums[starts]) * self._down[starts]
        return mix(body + (ends - starts).astype(np.uint64) * _STEP)

    def windows(self, size: int) -> np.ndarray:
        """Hash of the window of ``size`` bytes at every place that has room for it."""
        n = len(self._sums) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self._sums[size:] - self._sums[:n]) * self._down[:n])


class Texts:
    """Rows of one string column as a byte buffer with row bounds and word bounds."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds, self.rows = data, bounds, len(bounds) - 1

    def bytes_of(self, row: int) -> bytes:
        return self.data[self.bounds[row]:self.bounds[row + 1]].tobytes()

    def find_words(self) -> None:
        """Sets ``starts`` and ``ends`` of all words and ``words``, the first word of each row."""
        space = SPACE[self.data]
        before, after = np.ones(len(space), bool), np.ones(len(space), bool)
        before[1:], after[:-1] = space[:-1], space[1:]
        inner = self.bounds[1:-1]
        before[inner[inner < len(space)]] = True
        after[inner[inner > 0] - 1] = True
        self.starts = np.flatnonzero(~space & before)
        self.ends = np.flatnonzero(~space & after) + 1
        self.words = np.searchsorted(self.starts, self.bounds)

    def word_hashes(self, lower: bool = False) -> np.ndarray:
        return Prefix(LOWER[self.data] if lower else self.data).spans(self.starts, self.ends)

    def find_lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the \\n-split lines and the first line of each row; an empty text is one empty line."""
        breaks = np.flatnonzero(self.data == 10)
        starts = np.concatenate([self.bounds[:-1], breaks + 1])
        ends = np.concatenate([breaks, self.bounds[1:]])
        row = np.concatenate([np.arange(self.rows), np.searchsorted(self.bounds[1:], breaks, side="right")])
        end_row = np.concatenate([np.searchsorted(self.bounds[1:], breaks, side="right"), np.arange(self.rows)])
        order, end_order = np.lexsort((starts, row)), np.lexsort((ends, end_row))
        first = np.searchsorted(row[order], np.arange(self.rows + 1))
        return starts[order], ends[end_order], first


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive values."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, size):
        out *= _STEP
        out += hashes[k:k + n]
    return mix(out)


def per_row(bounds: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of ``values`` in each row given by ``bounds``."""
    sums = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def texts_of(column: pa.Array) -> Texts:
    column = column.cast(pa.large_string())
    column = pc.fill_null(column, "") if column.null_count else column
    bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return Texts(data[bounds[0]:bounds[-1]], bounds - bounds[0])


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Batches cut so that the texts of a slice hold at most ``limit`` bytes; a longer text is a slice of its own."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column))
        lengths = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        low, total = 0, 0
        for row, size in enumerate(lengths.tolist()):
            if row > low and total + size > limit:
                yield batch.slice(low, row - low), texts_of(values.slice(low, row - low))
                low, total = row, 0
            total += size
        if low < batch.num_rows:
            yield batch.slice(low), texts_of(values.slice(low))


def emit(batch: pa.RecordBatch, keep: list[str], **columns) -> pa.RecordBatch:
    """The named columns of a batch and new ones."""
    arrays = [batch.column(batch.schema.get_field_index(c)) for c in keep]
    arrays += [v if isinstance(v, pa.Array) else pa.array(v) for v in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=[*keep, *columns])
