"""Fagin's threshold algorithm on one block of integer vectors.

A block keeps, for each dimension, its rows in descending order of that
component. An anchor walks all lists at once, from the top where its own
component is positive and from the bottom where it is negative. What it meets is
scored whole by random access. No row that it has not met at a depth can score
more than the threshold there, the sum of the anchor's components times those
at that depth; once the threshold lies strictly below the k-th score of every
window, nothing that is left can enter a window, nor tie with what is in it.

Thresholds need no scores, so they are computed first, at every ``STEP``-th depth,
and the walk goes at once to the first depth at which it could end.
"""

from __future__ import annotations

import numpy as np

STEP = 16
#: Above any score: the upper end of a window that has none.
OPEN = np.iinfo(np.int64).max
#: Components times 256 up to this give scores that a long holds.
LARGEST = 1 << 24
#: Sums below this are exact in doubles, which multiply faster.
_EXACT = float(1 << 53)


class Block:
    """Rows ``vectors`` (whole numbers) in the order in which ties are broken."""

    def __init__(self, vectors: np.ndarray):
        self.rows, self.dims = vectors.shape
        top = float(np.abs(vectors).max(initial=0))
        self.top = top
        self.vectors = vectors
        self.wide = vectors.astype(np.float64)
        self.order = np.argsort(-vectors, axis=0, kind="stable")
        down = np.take_along_axis(self.wide, self.order, axis=0)
        depths = np.arange(STEP, self.rows, STEP)
        # after ``depth`` rows of each list the next ones bound what is not met
        self.depths = depths
        self.high, self.low = down[depths], down[self.rows - 1 - depths]

    def _scores(self, anchor: np.ndarray, rows: np.ndarray | slice) -> np.ndarray:
        if self.top * np.abs(anchor).max(initial=0) * max(self.dims, 1) < _EXACT:
            return (self.wide[rows] @ anchor.astype(np.float64)).astype(np.int64)
        return self.vectors[rows] @ anchor

    def thresholds(self, anchor: np.ndarray) -> np.ndarray:
        """No row met at none of the first ``depths`` places scores more; a little
        is added where sums of doubles are not exact."""
        wide = anchor.astype(np.float64)
        found = self.high @ np.maximum(wide, 0) + self.low @ np.minimum(wide, 0)
        if self.top * np.abs(wide).max(initial=0) * max(self.dims, 1) >= _EXACT:
            found += np.abs(found) * 1e-9 + self.dims * self.top * np.abs(wide).max() * 1e-12
        return found

    def search(
        self, anchor: np.ndarray, windows: np.ndarray, k: int, allowed: np.ndarray | None = None
    ) -> list[tuple[np.ndarray, np.ndarray]]:
        """Rows and scores of the first ``k`` in each window (least and greatest
        score, both inside), higher scores and earlier rows first."""
        bounds = self.thresholds(anchor)
        met = np.zeros(self.rows, bool)
        rows = np.zeros(0, np.int64)
        scores = np.zeros(0, np.int64)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        # the threshold must fall below some score inside each window
        goal = np.where(windows[:, 0] <= windows[:, 1], windows[:, 1].astype(float), np.inf).min(initial=np.inf)
        step = int(np.argmax(bounds < goal)) if (bounds < goal).any() else len(bounds)
        while True:
            depth = int(self.depths[step]) if step < len(bounds) else self.rows
            if depth < self.rows and depth * (len(up) + len(down)) < self.rows:
                near = np.concatenate([self.order[:depth, up].ravel(), self.order[self.rows - depth :, down].ravel()])
                fresh = np.unique(near[~met[near]])
            else:
                seen = met.copy()
                seen[self.order[:depth, up]] = True
                seen[self.order[self.rows - depth :, down]] = True
                fresh = np.flatnonzero(seen & ~met) if depth < self.rows else np.flatnonzero(~met)
            met[fresh] = True
            if allowed is not None:
                fresh = fresh[allowed[fresh]]
            rows = np.concatenate([rows, fresh])
            scores = np.concatenate([scores, self._scores(anchor, fresh)])
            order = np.lexsort((rows, -scores))
            rows, scores = rows[order], scores[order]
            first = np.searchsorted(-scores, -windows[:, 1], side="left")
            end = np.minimum(np.searchsorted(-scores, -windows[:, 0], side="right"), first + k)
            end = np.maximum(end, first)
            if depth >= self.rows:
                break
            # a window that is not full takes any score down to its lower end
            full = end - first >= k
            kth = np.where(full, scores[np.maximum(end - 1, 0)] if len(scores) else 0, windows[:, 0])
            kth = kth[windows[:, 0] <= windows[:, 1]]
            if (bounds[step] < kth).all():
                break
            # not before the threshold is below all scores that count by now; depths double at least
            later = np.flatnonzero(bounds < kth.min())
            step = max(int(later[0]) if len(later) else len(bounds), 2 * step + 1)
        return [(rows[a:b], scores[a:b]) for a, b in zip(first.tolist(), end.tolist(), strict=True)]
