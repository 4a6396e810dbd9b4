"""Neighbour distances and counts in the maximum norm, by cells of an index.

Points are cut by medians into cells of about LEAF. A cell's points are searched together: a few
near cells bound their k-th neighbours' distances, and only cells within the largest bound are
looked at again. So the work grows less than with the square of the number of points, the more so
the fewer coordinates are indexed. Distances are differences of coordinates as a full comparison
computes them, so counts agree with one to the last tie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Points of a cell, cells that give the first bound, and points that are searched together.
LEAF, NEAR, GROUP = 48, 12, 12


def max_norm(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of each row of a to each of b."""
    out = np.subtract.outer(a[:, 0], b[:, 0])
    np.abs(out, out=out)
    more = np.empty_like(out) if a.shape[1] > 1 else None
    for j in range(1, a.shape[1]):
        np.subtract.outer(a[:, j], b[:, j], out=more)
        np.maximum(out, np.abs(more, out=more), out=out)
    return out


class Cells:
    """Rows of x, cut along the widest coordinate at the median until a cell has LEAF rows."""

    def __init__(self, x: np.ndarray):
        self.x, self.rows = x, []
        stack = [np.arange(len(x))]
        while stack:
            rows = stack.pop()
            if len(rows) <= LEAF:
                self.rows.append(rows)
                continue
            part = x[rows]
            axis = int(np.ptp(part, axis=0).argmax())
            order = np.argpartition(part[:, axis], len(rows) // 2)
            stack += [rows[order[len(rows) // 2 :]], rows[order[: len(rows) // 2]]]
        self.low = np.array([x[r].min(0) for r in self.rows])
        self.high = np.array([x[r].max(0) for r in self.rows])

    def __len__(self) -> int:
        return len(self.rows)

    def gaps(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The distance of each cell's box from another box."""
        return np.maximum(np.maximum(self.low - high, low - self.high), 0).max(1)

    def searched(self, rest: np.ndarray, k: int, cells: range) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For groups of rows: the rows, other rows, their distances in x, and each row's k-th distance in x and rest together.

        The other rows hold all that are no farther than that in x. A row is its own neighbour 0.
        Rows of a cell with similar bounds go together, so that one far from all others slows no other.
        """
        for cell in cells:
            rows = self.rows[cell]
            gaps = self.gaps(self.low[cell], self.high[cell])
            near = np.argpartition(gaps, NEAR)[:NEAR] if len(gaps) > NEAR else np.arange(len(gaps))
            some = np.concatenate([self.rows[c] for c in near])
            if len(some) <= k or len(near) == len(gaps):
                groups = [(rows, np.inf)]
            else:
                d = np.maximum(max_norm(self.x[rows], self.x[some]), max_norm(rest[rows], rest[some]))
                bound = np.partition(d, k, axis=1)[:, k]
                order = np.argsort(bound)
                groups = [(rows[part], bound[part[-1]]) for part in np.array_split(order, -(-len(rows) // GROUP))]
            for own, reach in groups:
                x = self.x[own]
                some = np.concatenate([self.rows[c] for c in np.flatnonzero(self.gaps(x.min(0), x.max(0)) <= reach)])
                d = max_norm(x, self.x[some])
                yield own, some, d, np.partition(np.maximum(d, max_norm(rest[own], rest[some])), k, axis=1)[:, k]


def within(x: np.ndarray, at: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """How many of the values x lie no farther than its radius from each of `at`, as differences round."""
    ordered = np.sort(x)
    ends = []
    for upper in (True, False):
        # the first place where the difference is beyond the radius: differences grow with the place
        low, high = np.zeros(len(at), np.int64), np.full(len(at), len(x))
        while (low < high).any():
            mid = (low + high) // 2
            value = ordered[np.minimum(mid, len(x) - 1)]
            beyond = (value - at > radius) if upper else (at - value <= radius)
            stop = low < high
            high = np.where(stop & beyond, mid, high)
            low = np.where(stop & ~beyond, mid + 1, low)
        ends.append(low)
    return ends[0] - ends[1]
