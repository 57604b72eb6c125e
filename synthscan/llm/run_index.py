"""A run-length index of many short segments: Burrows-Wheeler transform by runs, with samples at their ends.

The transform of all segments in a row, each ended by a mark of its own that sorts below all bytes and by its place, is kept
as runs of equal bytes (`heads`, `lengths`) and, at each run's beginning, three samples: the text position of its first
suffix, that of the suffix sorted before it, and how many bytes the two share. Nothing else is kept of the suffix order, so
the index is as large as the text is varied, not as it is long.

Matching statistics are streamed from the samples alone: from one sampled position to the next, the neighbour moves on with
the text and the match gets shorter by one. That is so as suffixes in a run are preceded by the same byte, and those before
them are neighbours too.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

MARK = 256


def _suffixes(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Text positions in the order of their suffixes; left: the bytes from each position to its segment's end, 0 at its mark.

    From four bytes on, each round makes known prefixes as often as long as fits: it sorts whole numbers that hold the ranks of
    three parts and the position (texts of less than 2^16 bytes, whose arrays stay in a core's cache, too), or of two parts.
    """
    n = len(text)
    bits = int(n).bit_length()
    place = np.arange(n, dtype=np.uint64)
    blocks = np.ndarray((n,), ">u4", np.concatenate((text, np.zeros(4, np.uint8))).tobytes(), strides=(1,)).astype(np.uint64)
    have = np.minimum(left, 4)
    masks = np.array([0, 0xFF000000, 0xFFFF0000, 0xFFFFFF00, 0xFFFFFFFF], np.uint64)
    first = (blocks & masks[have]) << np.uint64(3) | have.astype(np.uint64)  # four bytes and how many of them are there
    rank = np.empty(n, np.int64)

    def sorted_by(keys: np.ndarray, width: int) -> np.ndarray:
        """The order of keys of so many bits, and by place within equal ones; rank becomes theirs."""
        if width + bits <= 64:
            both = np.sort(keys << np.uint64(bits) | place)
            order, keys = (both & np.uint64((1 << bits) - 1)).astype(np.int64), both >> np.uint64(bits)
        else:
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
        rank[order] = np.cumsum(np.concatenate(([True], keys[1:] != keys[:-1])))
        return order

    order = sorted_by(first, 35)
    width, longest, parts = 4, int(left.max(initial=0)), 3 if 4 * bits <= 64 else 2
    while width < longest and rank.max() < n:
        keys = rank.copy()
        for part in range(1, parts):  # what lies behind a segment's end sorts first
            far, most = part * width, max(0, n - part * width)
            keys <<= bits
            keys[:most] |= np.where(left[:most] >= far, rank[far:], 0)
        order = sorted_by(keys.view(np.uint64), parts * bits)
        width *= parts
    return order


def _shared(text: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes the suffixes at a and b share within their segments."""
    blocks = np.ndarray((len(text),), "<u8", np.concatenate((text, np.zeros(8, np.uint8))).tobytes(), strides=(1,))
    most, out = np.minimum(left[a], left[b]), np.zeros(len(a), np.int64)
    live = np.flatnonzero(most > 0)
    while len(live):
        differ = blocks[a[live] + out[live]] ^ blocks[b[live] + out[live]]
        low = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, (np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64)) >> 3)
        out[live] = np.minimum(out[live] + same, most[live])
        live = live[(same == 8) & (out[live] < most[live])]
    return out


@dataclass
class RunIndex:
    """heads, lengths: runs of the transform; at, before, shared: the samples by text position; n: the text's length with marks."""

    heads: np.ndarray
    lengths: np.ndarray
    at: np.ndarray
    before: np.ndarray
    shared: np.ndarray
    n: int

    @classmethod
    def built(cls, text: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> RunIndex:
        """Of the segments text[begins[i]:ends[i]], each followed by one byte for its mark, without gaps."""
        n = len(text)
        left = np.repeat(ends, ends - begins + 1) - np.arange(n)
        order = _suffixes(text, left)
        starts = np.zeros(n, bool)
        starts[begins] = True
        preceding = np.where(starts[order], MARK, text[order - 1].astype(np.int16))
        new = np.concatenate(([True], (preceding[1:] != preceding[:-1]) | (preceding[1:] == MARK)))
        edge = np.flatnonzero(new)
        at, before = order[edge], order[np.maximum(edge, 1) - 1]
        shared = _shared(text, left, at, before)
        shared[edge == 0] = 0
        by_place = np.argsort(at)
        return cls(preceding[edge], np.diff(np.append(edge, n)), at[by_place], before[by_place], shared[by_place], n)

    def matches(self) -> tuple[np.ndarray, np.ndarray]:
        """For each text position, streamed in the text's order: the position sorted before it, and how many bytes they share."""
        steps = np.diff(np.append(self.at, self.n))
        moved = np.arange(self.n) - np.repeat(self.at, steps)
        return np.repeat(self.before, steps) + moved, np.repeat(self.shared, steps) - moved


def classes(index: RunIndex, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose next `window` bytes come elsewhere, and for each the first such place in the text."""
    before, shared = index.matches()
    parent = np.arange(index.n)
    long = np.flatnonzero(shared >= window)
    parent[long] = before[long]
    while True:  # up the chain of neighbours, doubling the step
        above = parent[parent]
        if (above == parent).all():
            break
        parent = above
    listed = np.zeros(index.n, bool)
    listed[long] = listed[parent[long]] = True
    several, first = np.flatnonzero(listed), np.full(index.n, index.n)
    np.minimum.at(first, parent[several], several)
    return several, first[parent[several]]
