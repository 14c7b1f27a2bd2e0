"""Signature trees over word shingle sets.

Sets are hashed to bitmaps. A node holds the OR of its children's bitmaps, the range
of their set sizes, the most elements that share bits in one of them, and the largest
size of a partner that one of them may have. Two trees are traversed together; a pair
of nodes is left out when no pair below it can overlap enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BITMAP_BITS = 2048
FANOUT = 8
_WORDS = 1 << 18  # of bitmaps that are compared at once


def bitmap(hashes: np.ndarray, size: int = BITMAP_BITS) -> np.ndarray:
    """Bit set of a hashed set, as 64-bit words; folded in half it is that of half the size."""
    bits = np.zeros(size, np.uint8)
    bits[(hashes >> np.uint64(7)) % np.uint64(size)] = 1
    return np.packbits(bits).view(np.uint64)


def bitmap_size(n: int) -> int:
    """Bits for a set of ``n``: about one for each element, at least ``BITMAP_BITS``.

    With fewer, unrelated sets would look as if they might have enough in common.
    """
    return max(BITMAP_BITS, 1 << (n - 1).bit_length())


def _count(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits).sum(axis=-1).astype(np.int64)


class Level:
    """Nodes of one level: bitmaps, smallest and largest set, spare, single label or -1, reach.

    ``spare`` is the most by which a set below exceeds its bits: so many elements may
    hide behind bits that are counted once. ``reach`` is the largest partner a set
    below may have.
    """

    def __init__(self, bits, low, high, spare, label, reach):
        self.bits, self.low, self.high, self.spare, self.label = bits, low, high, spare, label
        self.reach = reach

    def __len__(self) -> int:
        return len(self.low)

    def parents(self) -> Level:
        at = np.arange(0, len(self), FANOUT)
        first = np.minimum.reduceat(self.label, at)
        same = first == np.maximum.reduceat(self.label, at)
        return Level(
            np.bitwise_or.reduceat(self.bits, at, axis=0),
            np.minimum.reduceat(self.low, at),
            np.maximum.reduceat(self.high, at),
            np.maximum.reduceat(self.spare, at),
            np.where(same, first, -1),
            np.maximum.reduceat(self.reach, at),
        )


def build(
    bits: np.ndarray, sizes: np.ndarray, labels: np.ndarray, reach: np.ndarray | None = None
) -> list[Level]:
    """Levels from the sets up to a single root. The order of the sets is the tree's."""
    reach = np.full(len(sizes), np.iinfo(np.int64).max) if reach is None else reach
    levels = [Level(bits, sizes, sizes, sizes - _count(bits), labels, reach)]
    while len(levels[-1]) > 1:
        levels.append(levels[-1].parents())
    return levels


def folded(levels: list[Level]) -> list[Level]:
    """The same tree with bitmaps of half the size."""
    low = levels[0]
    half = low.bits.shape[1] // 2
    return build(low.bits[:, :half] | low.bits[:, half:], low.low, low.label, low.reach)


def _possible(a: Level, i: np.ndarray, b: Level, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Pairs of nodes below which a pair of sets may reach ``num / den``.

    Overlap is at most the common bits plus what hides behind them, and has to be
    ``num / (num + den)`` of both sizes together.
    """
    open_ = (a.label[i] < 0) | (a.label[i] != b.label[j])
    open_ &= (den * a.high[i] >= num * b.low[j]) & (den * b.high[j] >= num * a.low[i])
    open_ &= (a.reach[i] >= b.low[j]) & (b.reach[j] >= a.low[i])
    keep = np.flatnonzero(open_)
    i, j = i[keep], j[keep]
    most = _count(a.bits[i] & b.bits[j]) + np.minimum(a.spare[i], b.spare[j])
    most = np.minimum(most, np.minimum(a.high[i], b.high[j]))
    good = (num + den) * most >= num * (a.low[i] + b.low[j])
    return keep[good]


def dual_traversal(
    one: list[Level], two: list[Level] | None, num: int, den: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sets (by position) that may be similar and have different labels.

    ``two`` None: pairs inside ``one``, each once.
    """
    other = one if two is None else two
    pairs = max(FANOUT, _WORDS // one[0].bits.shape[1])
    stack = [(len(one) - 1, len(other) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        u, v, i, j = stack.pop()
        kept = _possible(one[u], i, other[v], j, num, den)
        i, j = i[kept], j[kept]
        if not len(i):
            continue
        if u == 0 and v == 0:
            yield i, j
            continue
        # The deeper tree's nodes are opened first, so that both end at their sets.
        down_u, down_v = u >= v and u > 0, v >= u and v > 0
        step_i = np.arange(FANOUT) if down_u else np.zeros(1, np.int64)
        step_j = np.arange(FANOUT) if down_v else np.zeros(1, np.int64)
        i = (i * FANOUT if down_u else i)[:, None, None] + step_i[None, :, None]
        j = (j * FANOUT if down_v else j)[:, None, None] + step_j[None, None, :]
        i, j = (x.ravel() for x in np.broadcast_arrays(i, j))
        u, v = u - down_u, v - down_v
        fits = (i < len(one[u])) & (j < len(other[v]))
        if two is None:
            fits &= i < j if u == 0 else i <= j
        i, j = i[fits], j[fits]
        for start in range(0, len(i), pairs):
            stack.append((u, v, i[start : start + pairs], j[start : start + pairs]))
