"""Words and word hashes of a batch of texts as numpy arrays, straight from the Arrow buffers.

Everything here runs inside Arrow tasks. Memory is bounded by the slice size (or the longest single text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

SLICE_BYTES = 1 << 19

_U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 3
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 64, 256, dtype=_U64)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), so that every bit depends on every bit."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def byte_class(excluded: list[tuple[int, int]]) -> np.ndarray:
    """Which bytes belong to words, by excluded inclusive ranges.

    UTF-8 bytes of characters beyond ASCII are 0x80 and up, so an ASCII class works on bytes unchanged.
    """
    table = np.ones(256, dtype=bool)
    for low, high in excluded:
        table[low : high + 1] = False
    return table


#: `[^\x20\x09-\x0D]+`
SPACED = byte_class([(0x20, 0x20), (0x09, 0x0D)])
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after A-Z became a-z
ALPHANUMERIC = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "base" not in _POWERS or len(_POWERS["base"]) < n:
        for name, base in (("base", _BASE), ("inverse", _BASE_INVERSE)):
            steps = np.full(max(n, SLICE_BYTES), base, dtype=_U64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=_U64)
    return _POWERS["base"], _POWERS["inverse"]


class Texts:
    """Words of consecutive texts: lower-cased bytes, word bounds, and where each text's words begin."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, table: np.ndarray):
        self.data = _LOWER[data]
        self.bounds = bounds
        inside = table[self.data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        edges = bounds[(bounds > 0) & (bounds < len(data))]
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        #: words[i]..words[i + 1] are the words of text i
        self.words = np.searchsorted(self.starts, bounds)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, the same wherever the word stands."""
        n = len(self.data)
        if not len(self.starts):
            return np.zeros(0, dtype=_U64)
        base, inverse = _powers(n)
        sums = np.zeros(n + 1, dtype=_U64)
        np.cumsum(_BYTE_VALUES[self.data] * base[:n], dtype=_U64, out=sums[1:])
        raw = (sums[self.ends] - sums[self.starts]) * inverse[self.starts]
        return mix(raw + (self.ends - self.starts).astype(_U64))

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def joined(self, low: int, high: int) -> bytes:
        """Words low..high, one blank between."""
        return b" ".join(self.word(i) for i in range(low, high))


def slices(column: pa.Array, table: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """(first row, end row, words) for runs of rows of about ``limit`` bytes; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, end, Texts(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], table)
        row = end


def pieces(batch: pa.RecordBatch, *texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows of a batch of which ``texts`` have about ``limit`` bytes together; one row at least, null has none.

    What is made of one, and given back, is then as large as a piece; a batch of 10,000 long texts is far larger.
    """
    size = np.zeros(batch.num_rows, dtype=np.int64)
    for column in texts:
        size += pa.compute.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.concatenate(([0], np.cumsum(size)))
    row = 0
    while row < batch.num_rows:
        end = max(int(np.searchsorted(ends, ends[row] + limit, side="right")) - 1, row + 1)
        yield batch.slice(row, end - row)
        row = end


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` consecutive words; of fewer words, the whole sequence is the only one."""
    n = len(words)
    if not n:
        return words
    size = min(size, n)
    total = np.zeros(n - size + 1, dtype=_U64)
    for i in range(size):
        total = total * _U64(0xD6E8FEB86659FD93) + words[i : n - size + 1 + i]
    return mix(total + _U64(size))
