"""Words and word shingles of many texts at once, as numpy arrays.

A batch of texts is looked at as the bytes of its Arrow column. A word is a
maximal run of bytes that are no separators; it gets a 64-bit hash, and a word
never reaches over the end of its text. Nothing here makes a Python object
per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of texts that are hashed in one go; a longer text goes alone.
CHUNK_BYTES = 1 << 21


def byte_table(ranges: list[tuple[int, int]]) -> np.ndarray:
    """True for the bytes in the given inclusive ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Separators of words that are runs of anything but white space.
SPACES = byte_table([(0x20, 0x20), (0x09, 0x0D)])
#: Separators of words made of digits, a to z and everything beyond ASCII,
#: applied after lower-casing.
NON_ALNUM = byte_table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_rng = np.random.default_rng(20)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) | U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_BACK = U64(pow(int(_BASE), -1, 1 << 64))
_STEP = U64(0xD1342543DE82EF95)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x + U64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (1 << 64) - 1)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power(base: U64, n: int) -> np.ndarray:
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        size = max(n, CHUNK_BYTES + 1)
        steps = np.full(size, base, U64)
        steps[0] = 1
        made = np.cumprod(steps, dtype=U64, out=steps)
        if size > CHUNK_BYTES + 1:  # for one very long text; not kept
            return made[:n]
        _powers[key] = made
    return _powers[key][:n]


class Words:
    """Words of a run of texts.

    ``hash`` per word; ``text`` the row it comes from, ascending; ``start`` and
    ``end`` its bytes; ``first`` (one longer than the rows) where each row's
    words begin.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray):
        n = len(data)
        rows = len(offsets) - 1
        low = LOWER[data]
        inside = ~separators[low]
        begins = np.zeros(n + 1, bool)
        begins[offsets] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | begins[1:n]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | begins[1:n]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        total = np.zeros(n + 1, U64)
        # in place: these are eight bytes for each of the texts
        np.take(_BYTE, low, out=total[1:])
        total[1:] *= _power(_BASE, n)
        np.cumsum(total, dtype=U64, out=total)
        self.hash = (total[self.end] - total[self.start]) * _power(_BACK, n)[self.start]
        self.hash = mix(self.hash, 1) if len(self.hash) else self.hash
        self.first = np.searchsorted(self.start, offsets).astype(np.int64)
        self.count = np.diff(self.first)
        self.text = np.repeat(np.arange(rows), self.count)

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of runs of ``size`` words, and where each text's begin.

        A text of fewer words, but not none, has one: all its words.
        """
        n, words = len(self.hash), self.hash
        counts = np.where(self.count >= size, self.count - size + 1, np.minimum(self.count, 1))
        begins = np.concatenate([[0], np.cumsum(counts)])
        if not n:
            return words, begins
        at = np.arange(begins[-1]) - np.repeat(begins[:-1] - self.first[:-1], counts)
        length = np.repeat(np.minimum(self.count, size), counts)
        made = np.zeros(len(at), U64)
        padded = np.concatenate([words, np.zeros(size, U64)])
        for k in range(size):
            made = made * _STEP + np.where(k < length, padded[at + k], U64(0))
        return mix(made + length.astype(U64), 2), begins


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data or b"", np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of at most ``limit`` bytes (or one row): first row, end row,
    bytes and offsets."""
    if not len(column):
        return
    data, offsets = text_buffers(column)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), len(column))
        cut = offsets[row : end + 1]
        yield row, end, data[cut[0] : cut[-1]], cut - cut[0]
        row = end


def sum_by(group: np.ndarray, values: np.ndarray, groups: int) -> np.ndarray:
    """64-bit sums (modulo 2^64) of values per group number."""
    low = np.bincount(group, (values & U64(0xFFFFFFFF)).astype(np.float64), groups)
    high = np.bincount(group, (values >> U64(32)).astype(np.float64), groups)
    wrap = np.float64(1 << 32)
    return low.astype(U64) + ((high % wrap).astype(U64) << U64(32))


def distinct(hashes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's hashes sorted and without repeats, and where they begin."""
    parts = [np.unique(hashes[a:b]) for a, b in zip(begins[:-1], begins[1:], strict=True)]
    sizes = np.array([len(p) for p in parts], np.int64)
    return (np.concatenate(parts) if parts else hashes[:0]), np.concatenate([[0], np.cumsum(sizes)])
