"""Minimum-cost flow on small graphs (shards, sources, membership patterns).

Nodes are groups of rows, never rows, so the graph is as large as the number of
groups, whatever the data size.
"""

from __future__ import annotations

import heapq


class Network:
    """Directed arcs with whole capacities and non-negative costs."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, capacity: int, cost: int) -> int:
        """Add an arc, with the arc back behind it; returns its number."""
        for head, tail, room, price in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out[head].append(len(self.to))
            self.to.append(tail)
            self.room.append(room)
            self.cost.append(price)
        return len(self.to) - 2

    def flow(self, number: int) -> int:
        return self.room[number ^ 1]

    def push(self, source: int, sink: int, most: int | None = None) -> tuple[int, int]:
        """Send as much as fits (or ``most``) at the least cost: amount and cost.

        Successive shortest paths; potentials keep reduced costs non-negative,
        so each path is a Dijkstra search.
        """
        n = len(self.out)
        potential = [0] * n
        sent = paid = 0
        while most is None or sent < most:
            far = [None] * n
            via = [-1] * n
            far[source] = 0
            heap = [(0, source)]
            while heap:
                d, a = heapq.heappop(heap)
                if d > far[a]:
                    continue
                for e in self.out[a]:
                    if self.room[e]:
                        b = self.to[e]
                        x = d + self.cost[e] + potential[a] - potential[b]
                        if far[b] is None or x < far[b]:
                            far[b], via[b] = x, e
                            heapq.heappush(heap, (x, b))
            if far[sink] is None:
                break
            reach = far[sink]
            potential = [p + min(f, reach) if f is not None else p + reach for p, f in zip(potential, far)]
            amount = None if most is None else most - sent
            b = sink
            while b != source:
                amount = self.room[via[b]] if amount is None else min(amount, self.room[via[b]])
                b = self.to[via[b] ^ 1]
            b = sink
            while b != source:
                e = via[b]
                self.room[e] -= amount
                self.room[e ^ 1] += amount
                paid += amount * self.cost[e]
                b = self.to[e ^ 1]
            sent += amount
        return sent, paid
