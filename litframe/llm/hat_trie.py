"""Counts of word-id sequences in a shallow trie over hash containers.

A node holds a container of the sequences that go through it, without the ids on
the way, and children for ids that were split out of it. A container is kept in
the order of a hash of its entries, by which new ones are merged in bulk; what has
the same hash is told apart by its ids. One that grows over its limit is burst:
ids with many entries get children of their own, the rest stays where it is. So the
trie is deep only under prefixes with many continuations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from litframe.llm.words import mix

#: Entries at which a container is burst, and entries that give an id its own child.
BURST, SPLIT = 1 << 16, 1 << 11

_STEP = np.uint64(0xD1342543DE82EF95)


def summed(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal rows as one, with their counts added, in the order of a hash.

    Rows of one hash that differ stay apart; if they alternate, a row may come
    out twice, which adds up later.
    """
    if len(rows) < 2 or not rows.shape[1]:
        return rows[:1], counts.sum(keepdims=True) if len(counts) else counts
    key = np.zeros(len(rows), np.uint64)
    for column in rows.T:
        key = key * _STEP + column.astype(np.uint64)
    order = np.argsort(mix(key, 7), kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)]))
    return rows[first], np.add.reduceat(counts[order], first)


class Node:
    def __init__(self, width: int):
        self.width = width
        self.burst = BURST
        self.rows, self.counts = np.zeros((0, width), np.int32), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0  # entries here, with those that wait
        self.children: dict[int, Node] = {}
        self.ids = np.zeros(0, np.int32)

    def __len__(self) -> int:
        return self.held + sum(map(len, self.children.values()))

    def add(self, rows: np.ndarray, counts: np.ndarray) -> None:
        """Add sequences, a row of ids each."""
        if self.children:
            at = np.minimum(np.searchsorted(self.ids, rows[:, 0]), len(self.ids) - 1)
            split = self.ids[at] == rows[:, 0]
            if split.any():
                order = np.flatnonzero(split)[np.argsort(at[split], kind="stable")]
                cuts = np.flatnonzero(np.diff(at[order])) + 1
                for part in np.split(order, cuts):
                    self.children[int(rows[part[0], 0])].add(rows[part, 1:], counts[part])
                rows, counts = rows[~split], counts[~split]
        if not len(rows):
            return
        self.waiting.append((rows, counts))
        self.held += len(rows)
        # merged when as many wait as are there, so each entry is moved a few times only
        if self.held > max(2 * len(self.rows), 1 << 12):
            self._merge()
            if self.held > self.burst and self.width > 1:
                self._burst()

    def _merge(self) -> None:
        if self.waiting:
            parts = [(self.rows, self.counts), *self.waiting]
            self.rows, self.counts = summed(np.concatenate([r for r, _ in parts]), np.concatenate([c for _, c in parts]))
            self.waiting, self.held = [], len(self.rows)

    def _burst(self) -> None:
        ids, of, sizes = np.unique(self.rows[:, 0], return_inverse=True, return_counts=True)
        many = sizes >= SPLIT
        if many.any():
            moved = many[of]
            rows, counts = self.rows[moved], self.counts[moved]
            self.rows, self.counts = self.rows[~moved], self.counts[~moved]
            self.held = len(self.rows)
            for first in ids[many].tolist():
                self.children[first] = Node(self.width - 1)
            self.ids = np.array(sorted(self.children), np.int32)
            self.add(rows, counts)
        # what cannot be split is not looked at again before it has doubled
        self.burst = max(self.burst, 2 * self.held)

    def entries(self, prefix: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All sequences below, whole, and their counts."""
        self._merge()
        if len(self.rows):
            head = np.broadcast_to(np.array(prefix, np.int32), (len(self.rows), len(prefix)))
            yield np.concatenate([head, self.rows], axis=1), self.counts
        for first, child in self.children.items():
            yield from child.entries((*prefix, first))


class HatTrie:
    """Counts of sequences of ``width`` ids, at most about ``limit`` at a time."""

    def __init__(self, width: int, limit: int):
        self.width, self.limit = width, limit
        self.root = Node(width)

    def add(self, rows: np.ndarray, counts: np.ndarray) -> None:
        self.root.add(rows, counts)

    def full(self) -> bool:
        return len(self.root) > self.limit

    def spill(self, down_to: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Take whole subtrees out, largest first, until ``down_to`` entries are left."""
        left = len(self.root)
        node, prefix = self.root, ()
        while len(node.children) == 1 and node.held < left // 2:  # all below one id
            ((first, child),) = node.children.items()
            if not child.children:
                break
            node, prefix = child, (*prefix, first)
        for first, child in sorted(node.children.items(), key=lambda c: -len(c[1])):
            if left <= down_to:
                break
            left -= len(child)
            yield from child.entries((*prefix, first))
            del node.children[first]
        node.ids = np.array(sorted(node.children), np.int32)
        if left > down_to:
            yield from self.root.entries(())
            self.root = Node(self.width)
