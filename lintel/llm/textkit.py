"""Hashes of words, prefixes and shingles of many texts at once, on the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random odd multiplier per byte value; the base of the polynomial and its inverse modulo 2**64.
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)
CHUNK = 1 << 19


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, base, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


def byte_class(letters_only: bool) -> np.ndarray:
    """By byte value, whether it belongs to a word: not white space, or only ASCII letters, digits and non-ASCII."""
    x = np.arange(256)
    if letters_only:
        return ((x >= 48) & (x < 58)) | ((x >= 65) & (x < 91)) | ((x >= 97) & (x < 123)) | (x >= 128)
    return ~((x == 32) | ((x >= 9) & (x <= 13)))


ASCII_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) < 91), np.arange(256) + 32, np.arange(256)).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


class Words:
    """Splits texts into words and hashes each, in pieces of about CHUNK bytes, so that no text needs much memory."""

    def __init__(self, letters_only: bool = False, prefixes: tuple[int, ...] = ()):
        self.inside, self.prefixes = byte_class(letters_only), prefixes
        self.power, self.inverse = _powers(BASE, 2), _powers(INVERSE, 2)

    def _hash(self, low: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        inside = self.inside[low]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
        start, end = edges[::2], edges[1::2]
        if len(low) > len(self.power):
            n = max(2 * CHUNK, len(low))
            self.power, self.inverse = _powers(BASE, n), _powers(INVERSE, n)
        total = np.zeros(len(low) + 1, dtype=np.uint64)
        np.cumsum(BYTE[low] * self.power[: len(low)], out=total[1:])
        first, back = total[start], self.inverse[start]
        part = lambda stop: mix((total[stop] - first) * back + (stop - start).astype(np.uint64))
        return part(end), [part(np.minimum(start + n, end)) for n in self.prefixes], start

    def of(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, list[np.ndarray], np.ndarray]]:
        """Yields (first row, word hashes, hashes of the words' prefixes, word counts' bounds by row) for runs of rows.

        A run is as many rows as fit CHUNK bytes, one at least. The words of row ``first + i`` are those from
        ``bounds[i]`` to ``bounds[i + 1]``.
        """
        data, offsets = column_bytes(column)
        row, rows = 0, len(offsets) - 1
        while row < rows:
            last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, side="right")) - 1)
            lo, hi = int(offsets[row]), int(offsets[last])
            if hi - lo <= 2 * CHUNK:
                words, pre, start = self._apart(data[lo:hi], offsets[row : last + 1] - lo)
                bounds = np.searchsorted(start, offsets[row : last + 1] - lo)
            else:  # one long text: cut it between words
                parts = []
                while lo < hi:
                    stop = min(hi, lo + CHUNK)
                    while stop < hi and self.inside[data[stop]]:
                        stop += 1
                    parts.append(self._hash(ASCII_LOWER[data[lo:stop]]))
                    lo = stop
                words = np.concatenate([p[0] for p in parts])
                pre = [np.concatenate([p[1][i] for p in parts]) for i in range(len(self.prefixes))]
                bounds = np.array([0, len(words)])
            yield row, words, pre, bounds
            row = last

    def _apart(self, part: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Hashes of a run of texts whose words must not run into each other."""
        low = ASCII_LOWER[part]
        inside = self.inside[low]
        at = offsets[1:-1]
        at = at[(at > 0) & (at < len(low))]
        joined = at[inside[at] & inside[at - 1]] if len(at) else at
        if not len(joined):
            return self._hash(low)
        cuts = np.concatenate(([0], joined, [len(low)]))
        got = [self._hash(low[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
        return (
            np.concatenate([g[0] for g in got]),
            [np.concatenate([g[1][i] for g in got]) for i in range(len(self.prefixes))],
            np.concatenate([g[2] + a for g, a in zip(got, cuts[:-1])]),
        )


_ROLE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Of each run of `k` words; of fewer words, of the whole sequence; of none, none."""
    n = len(words)
    if not n:
        return words
    size = min(n, k)
    total = np.full(n - size + 1, size, dtype=np.uint64)
    for i in range(size):
        total += words[i : n - size + 1 + i] * _ROLE[i]
    return mix(total)
