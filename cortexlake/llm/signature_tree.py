"""Signature trees over sets of hashes: which pairs of sets may be alike.

A set's signature is a bitmap with a bit for each member's hash. A node holds the OR of its sets' bitmaps, the range of their sizes,
and how many members its sets have at most beyond one for each bit. Two sets share no more members than the bits that both bitmaps
have and that surplus of the one with less, so a pair of nodes is left out, with all the pairs of sets below it, where even
the largest possible overlap is less than the smallest sizes ask for.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bits of a signature, children of a node, pairs of nodes looked at together.
BITS, FAN, AT_ONCE = 8192, 4, 4096


@dataclass
class Level:
    bits: np.ndarray
    least: np.ndarray
    most: np.ndarray
    spare: np.ndarray
    #: Where each node's children begin on the level below (one more: the end).
    first: np.ndarray


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(sets), BITS // 64), np.uint64)
    for lo in range(0, len(sets), 1024):
        part = sets[lo : lo + 1024]
        marks = np.zeros((len(part), BITS), bool)
        marks[np.repeat(np.arange(len(part)), [len(s) for s in part]), (np.concatenate(part) % np.uint64(BITS)).astype(np.int64)] = True
        out[lo : lo + 1024] = np.packbits(marks, axis=1).view(np.uint64)
    return out


def _levels(bits: np.ndarray, size: np.ndarray, tree: np.ndarray) -> list[Level]:
    """From the sets, in the order of ``tree``, up to one node for each tree."""
    levels = [Level(bits, size, size, size - np.bitwise_count(bits).sum(1, dtype=np.int64), np.arange(len(size) + 1))]
    while True:
        begins = np.flatnonzero(np.concatenate([[True], tree[1:] != tree[:-1]]))
        if len(begins) == len(tree):
            return levels
        place = np.arange(len(tree)) - np.repeat(begins, np.diff(np.append(begins, len(tree))))
        first = np.flatnonzero(place % FAN == 0)
        below = levels[-1]
        levels.append(Level(np.bitwise_or.reduceat(below.bits, first, axis=0), np.minimum.reduceat(below.least, first), np.maximum.reduceat(below.most, first), np.maximum.reduceat(below.spare, first), np.append(first, len(tree))))
        tree = tree[first]


def _may_link(level: Level, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    sizes = (100 * level.most[x] >= percent * level.least[y]) & (100 * level.most[y] >= percent * level.least[x])
    x, y, keep = x[sizes], y[sizes], np.flatnonzero(sizes)
    shared = np.bitwise_count(level.bits[x] & level.bits[y]).sum(1, dtype=np.int64) + np.minimum(level.spare[x], level.spare[y])
    shared = np.minimum(shared, np.minimum(level.most[x], level.most[y]))
    return keep[(100 + percent) * shared >= percent * (level.least[x] + level.least[y])]


def alike(bits: np.ndarray, size: np.ndarray, head: np.ndarray, tree: np.ndarray, meet: list[tuple[int, int]], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of places of sets that may have 100 * intersection >= ``percent`` * union, from their signatures and sizes.

    ``tree`` is each set's tree, trees numbered from 0 without a gap; ``meet`` tells which trees to traverse together, a tree with itself for
    the pairs inside. Sets with the same ``head``, such as their smallest hash, stand together in a tree. Sets aren't empty.
    """
    order = np.lexsort((size, head, tree))
    levels = _levels(bits[order], size[order], tree[order])
    pairs = np.array(meet, np.int64).reshape(-1, 2)
    x, y = pairs[:, 0], pairs[:, 1]
    for k in range(len(levels) - 1, -1, -1):
        here = levels[k]
        if k == 0:
            x, y = x[x != y], y[x != y]
        keep = [lo + _may_link(here, x[lo : lo + AT_ONCE], y[lo : lo + AT_ONCE], percent) for lo in range(0, len(x), AT_ONCE)]
        keep = np.concatenate(keep) if keep else np.zeros(0, np.int64)
        x, y = x[keep], y[keep]
        if k:
            wide = np.diff(here.first)
            many = wide[x] * wide[y]
            at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            own, across, down = np.repeat(x == y, many), at // np.repeat(wide[y], many), at % np.repeat(wide[y], many)
            x, y = np.repeat(here.first[x], many) + across, np.repeat(here.first[y], many) + down
            x, y = x[~own | (across <= down)], y[~own | (across <= down)]
    return order[x], order[y]
