"""Words of a text column as numpy arrays: positions, documents and 64-bit hashes, a few megabytes of text at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
_P = 0x9E3779B97F4A7C15
_INVERSE = pow(_P, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that white space alone separates.
SPACED = np.ones(256, dtype=bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
#: Bytes of words of letters and digits; all bytes beyond ASCII count as letters.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P to the power i, and its inverse, modulo 2**64, for i below n."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        up, down = np.full(size, _P, np.uint64), np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        made = np.cumprod(up), np.cumprod(down)
        if size > 16 * CHUNK:
            return made
        _powers = made
    return _powers


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows, and where each begins; a null has none."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or at[0] == at[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of rows of about limit bytes (a longer text alone): the first row, the bytes, and where each row begins."""
    data, at = column_bytes(column)
    first = 0
    while first < len(at) - 1:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


class Words:
    """The words of a run of rows, in order.

    start, end: byte positions. row: the row of each word. hash: uint64, of the bytes with A-Z lowered.
    first: where each row's words begin, one more than there are rows.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, inside: np.ndarray = SPACED):
        n, rows = len(data), len(at) - 1
        word = inside[data]
        edge = at[:-1][at[:-1] < n]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        if n:
            before[1:] = word[:-1]
            before[edge] = False
            after[:-1] = word[1:]
            after[edge[edge > 0] - 1] = False
        self.start, self.end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        self.row = np.searchsorted(at, self.start, "right") - 1
        self.first = np.searchsorted(self.row, np.arange(rows + 1))
        up, down = _power_tables(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_LETTER[LOWER[data]] * up[:n], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))


def shingles(words: Words, size: int) -> Iterator[np.ndarray]:
    """Of each row, the sorted distinct int64 hashes of its runs of ``size`` words; of a shorter row, that of all its words."""
    h, n = words.hash, len(words.hash)
    if n >= size:
        made = np.zeros(n - size + 1, np.uint64)
        for i in range(size):
            made = made * np.uint64(_P) + h[i : n - size + 1 + i]
        made = mix(made + np.uint64(size)).view(np.int64)
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= size:
            yield np.unique(made[a : b - size + 1])
        elif b > a:
            one = np.zeros(1, np.uint64)
            for x in h[a:b]:
                one = one * np.uint64(_P) + x
            yield mix(one + np.uint64(b - a)).view(np.int64)
        else:
            yield np.zeros(0, np.int64)
