"""Signature trees: hierarchical nodes with OR-combined token bitmaps and size ranges, and their dual traversal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from tidelog.llm.shingles import fold

LEAF, FANOUT = 32, 8


class Node:
    __slots__ = ("bits", "high", "kids", "low", "members", "spare")

    def __init__(self, bits, low, high, spare, kids, members):
        self.bits, self.low, self.high, self.spare, self.kids, self.members = bits, low, high, spare, kids, members


class Tree:
    """One tree over members of one bitmap width, ordered by size."""

    def __init__(self, maps: np.ndarray, sizes: np.ndarray, members: np.ndarray):
        order = np.lexsort((maps[:, 0], sizes))
        self.maps, self.sizes, self.members = maps[order], sizes[order], members[order]
        spare = self.sizes - np.bitwise_count(self.maps).sum(axis=1, dtype=np.int64)
        level = []
        for a in range(0, len(order), LEAF):
            b = min(a + LEAF, len(order))
            level.append(Node(np.bitwise_or.reduce(self.maps[a:b], axis=0), self.sizes[a], self.sizes[b - 1], spare[a:b].max(), None, (a, b)))
        while len(level) > 1:
            level = [self.above(level[i : i + FANOUT]) for i in range(0, len(level), FANOUT)]
        self.root = level[0]

    @staticmethod
    def above(kids: list[Node]) -> Node:
        return Node(np.bitwise_or.reduce([k.bits for k in kids], axis=0), min(k.low for k in kids), max(k.high for k in kids), max(k.spare for k in kids), kids, None)


def possible(a: Node, b: Node, num: int, den: int) -> bool:
    """Whether a member of a and a member of b can overlap enough.  Common tokens set common bits, and no more tokens than `spare`
    share a bit with another token of their set."""
    if num * b.low > den * a.high or num * a.low > den * b.high:
        return False
    most = min(int(np.bitwise_count(a.bits & b.bits).sum()) + min(int(a.spare), int(b.spare)), int(a.high), int(b.high))
    return most * (num + den) >= num * int(a.low + b.low)


def candidates(x: Tree, y: Tree, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Member numbers (of x, of y) of the pairs that may reach a Jaccard index of num / den; each unordered pair once if x is y."""
    todo = [(x.root, y.root)]
    while todo:
        a, b = todo.pop()
        if not possible(a, b, num, den):
            continue
        if a.kids or b.kids:
            if x is y and a is b:
                todo += [(p, q) for i, p in enumerate(a.kids) for q in a.kids[i:]]
            elif not b.kids or (a.kids and a.high - a.low >= b.high - b.low):
                todo += [(k, b) for k in a.kids]
            else:
                todo += [(a, k) for k in b.kids]
            continue
        p, q = slice(*a.members), slice(*b.members)
        apart = np.bitwise_count(x.maps[p][:, None, :] ^ y.maps[q][None, :, :]).sum(axis=2, dtype=np.int64)
        sizes = x.sizes[p][:, None] + y.sizes[q][None, :]
        fits = apart * (den + num) <= (den - num) * sizes
        fits &= np.abs(x.sizes[p][:, None] - y.sizes[q][None, :]) * (den + num) <= (den - num) * sizes
        if x is y and a is b:
            fits = np.triu(fits, 1)
        i, j = np.nonzero(fits)
        if len(i):
            yield x.members[p][i], y.members[q][j]


def group_candidates(maps: list[bytes], sizes: np.ndarray, sides: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The candidate pairs of one group, at any threshold above 0.  Members with a wider bitmap that may link by size with those of a
    width are folded to meet them.  If there are two sides, only pairs across them count."""
    words = np.array([len(m) // 8 for m in maps])
    for w in np.unique(words):
        own = words == w
        wider = (words > w) & (num * sizes <= den * sizes[own].max())
        trees = []
        for side in np.unique(sides):
            at = np.nonzero((own | wider) & (sides == side))[0]
            if len(at):
                stacked = np.stack([fold(np.frombuffer(maps[i], np.uint64)[None, :], w)[0] for i in at])
                trees.append((side, Tree(stacked, sizes[at], at)))
        if len(np.unique(sides)) == 1:
            yield from candidates(trees[0][1], trees[0][1], num, den)
        elif len(trees) == 2:
            yield from candidates(trees[0][1], trees[1][1], num, den)
