"""Anchors of windows, and maximal repeats from an enhanced suffix array, for the pieces of text that a task holds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from folioscope.llm.words import _P, _power_tables, chunks, mix

#: Bytes of text that are anchored at a time, which keeps the arrays in the cache.
STEP = 1 << 17
_FIRST, _SECOND = (mix(np.arange(i, i + 256, dtype=np.uint64) * np.uint64(_P)) for i in (1_000, 7_000_000))


def anchors(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The windows of ``length`` bytes of rows of text, as pieces: runs of windows with one anchor.

    A window's anchor is the ``gram`` bytes of the smallest hash in it (the last of several), so equal windows have equal anchors at equal
    places, wherever they stand. Of each piece: the hash of its anchor, a second hash of all its bytes, its row, the place of its first
    window in the row, and the number of its windows.
    """
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    wide = length - gram + 1
    up, down = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_FIRST[data] * up[:n], out=sums[1:])
    grams = mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    # Half of the hash decides, then the later place.
    low = (np.uint64(1) << np.uint64(32)) - np.uint64(1)
    least = (grams & ~low) | (low - np.arange(len(grams), dtype=np.uint64))
    size = 1
    while size * 2 <= wide:
        least, size = np.minimum(least[:-size], least[size:]), size * 2
    if size < wide:
        least = np.minimum(least[: len(least) - (wide - size)], least[wide - size :])
    anchor = (low - (least & low)).astype(np.int64)
    room = np.maximum(np.diff(at) - (length - 1), 0)
    row = np.repeat(np.arange(len(at) - 1), room)
    start = np.arange(len(row)) + np.repeat(at[:-1] - np.cumsum(room) + room, room)
    anchor = anchor[start]
    new = np.ones(len(row), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(row)))
    lo, key, row = start[first], grams[anchor[first]], row[first]
    hi = lo + count + (length - 1)
    np.cumsum(_SECOND[data] * up[:n], out=sums[1:])
    whole = mix(mix((sums[hi] - sums[lo]) * down[lo]) + (hi - lo).astype(np.uint64))
    return key.view(np.int64), whole.view(np.int64), row, lo - at[row], count


def column_anchors(column: pa.Array, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``anchors`` of a column of texts, some at a time; a text longer than STEP is cut into stretches of windows."""
    for base, data, at in chunks(column, STEP):
        if len(data) <= 2 * STEP:
            key, whole, row, start, count = anchors(data, at, length, gram)
            yield key, whole, row + base, start, count
        else:
            for cut in range(0, len(data) - length + 1, STEP):
                part = data[cut : cut + STEP + length - 1]
                key, whole, row, start, count = anchors(part, np.array([0, len(part)]), length, gram)
                yield key, whole, row + base, start + cut, count


def merged(order: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the documents ``order`` (numbers) as maximal runs: overlapping and touching ones are joined."""
    by = np.lexsort((start, order))
    order, start, end = order[by], start[by], (start + size)[by]
    if not len(order):
        return order, start, end
    # The farthest end so far in the same document, by numbers that grow from document to document.
    far = int(end.max()) + 1
    rank = np.cumsum(np.append(0, order[1:] != order[:-1])) * far
    reach = np.maximum.accumulate(rank + end)
    new = np.append(True, rank[1:] + start[1:] > reach[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(order)) - 1
    return order[first], start[first], (reach - rank)[last] - start[first]


class SuffixArray:
    """The sorted suffixes of pieces, from each window of ``length`` bytes that occurs more than once among them to its piece's end.

    pieces: their bytes, windows: how many suffixes each has. piece and place say where a suffix begins, lcp what it has in common with the one
    before it (0 where that is less than ``length``), left the byte before it (-1 at a piece's begin).
    """

    def __init__(self, pieces: list[bytes], windows: np.ndarray, length: int):
        sizes = np.array([len(p) for p in pieces], np.int64)
        at = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(pieces), np.uint8)
        piece = np.repeat(np.arange(len(pieces)), windows)
        place = np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows)
        start = at[piece] + place
        # Only a filter: a window whose hash is the only one of its kind has no equal.
        up, down = _power_tables(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_FIRST[data] * up[: len(data)], out=sums[1:])
        hashes = (sums[start + length] - sums[start]) * down[start]
        _, which, n = np.unique(hashes, return_inverse=True, return_counts=True)
        more = n[which] > 1
        piece, place, start = piece[more], place[more], start[more]
        size = at[piece] + sizes[piece] - start
        most = int(size.max(initial=length))
        rows = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(most, np.uint8)), most)[start]
        rows[np.arange(most) >= size[:, None]] = 0
        # Of suffixes that differ in their filling alone the shorter one comes first.
        order = np.lexsort((size, rows.view(f"S{most}").ravel())) if len(rows) else np.zeros(0, np.int64)
        rows, size = rows[order], size[order]
        self.piece, self.place = piece[order], place[order]
        self.lcp = np.zeros(len(order), np.int64)
        if len(order):
            differ = rows[1:] != rows[:-1]
            same = np.where(differ.any(1), differ.argmax(1), most)
            self.lcp[1:] = np.minimum(same, np.minimum(size[1:], size[:-1]))
            self.lcp[self.lcp < length] = 0
        self.left = np.where(self.place > 0, data[np.maximum(start[order] - 1, 0)].astype(np.int64), -1)

    def scan(self, position: np.ndarray) -> tuple[list[tuple[int, int, int]], np.ndarray]:
        """One scan with a stack over the tree of common-prefix intervals.

        Returns the maximal repeats (length, first and last + 1 of their suffixes, which are all their occurrences): intervals whose
        suffixes differ in the byte to the right, as intervals do, and in the byte to the left. And for each suffix the length
        of the longest repeat in which another suffix has a smaller ``position`` (0: none).

        Of an interval's children, that with the smallest position goes on to the interval above, and the others are through
        with it; so each suffix is settled once, however deep the tree.
        """
        found, beaten = [], np.zeros(len(self.lcp), np.int64)
        lcp, left, rank = self.lcp.tolist(), self.left.tolist(), position.tolist()
        stack: list[list[int]] = []  # length, first suffix, suffix of the smallest position, byte to the left (-1: several)
        for i in range(len(lcp)):
            now = lcp[i + 1] if i + 1 < len(lcp) else 0
            if not now and not stack:
                continue
            begin, best, byte = i, i, left[i]
            while stack:
                top = stack[-1]
                if top[0] < now:
                    break
                # The child, a suffix or the interval taken off last, joins the interval on top.
                loser, top[2] = (best, top[2]) if rank[top[2]] < rank[best] else (top[2], best)
                beaten[loser] = top[0]
                top[3] = byte if byte == top[3] else -1
                if top[0] == now:
                    break
                stack.pop()
                begin, best, byte = top[1], top[2], top[3]
                if byte < 0:
                    found.append((top[0], begin, i + 1))
            if now and (not stack or stack[-1][0] < now):
                stack.append([now, begin, best, byte])
        return found, beaten
