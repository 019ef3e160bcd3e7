"""Packed tree over zone boxes: which zones can be the nearest to some point of a floor cell, or contain one."""

from __future__ import annotations

import heapq

import numpy as np

FANOUT = 16


def _gap(boxes: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """Distance between rectangles (0 where they meet)."""
    dx = np.maximum(np.maximum(boxes[:, 0] - box[2], box[0] - boxes[:, 2]), 0.0)
    dy = np.maximum(np.maximum(boxes[:, 1] - box[3], box[1] - boxes[:, 3]), 0.0)
    return np.hypot(dx, dy)


class ZoneTree:
    """Zones sorted into tiles by their centres, ``FANOUT`` to a node, nodes packed likewise up to one root."""

    def __init__(self, polygons: list[list[tuple[float, float]]]) -> None:
        self.rings = [np.asarray(p, dtype=float) for p in polygons]
        boxes = np.array([[*p.min(axis=0), *p.max(axis=0)] for p in self.rings])
        centre = (boxes[:, :2] + boxes[:, 2:]) / 2
        strips = max(1, int(np.ceil(np.sqrt(len(boxes) / FANOUT))))
        rank = np.empty(len(boxes), dtype=int)
        rank[np.argsort(centre[:, 0], kind="stable")] = np.arange(len(boxes))
        order = np.lexsort((centre[:, 1], rank * strips // len(boxes)))
        self.levels, self.kids = [boxes], []
        while len(self.levels[-1]) > 1 or not self.kids:
            below = self.levels[-1]
            order = order if len(self.levels) == 1 else np.arange(len(below))
            groups = [order[i:i + FANOUT] for i in range(0, len(below), FANOUT)]
            self.kids.append(groups)
            self.levels.append(np.array([[*below[g, :2].min(axis=0), *below[g, 2:].max(axis=0)] for g in groups]))

    def _to_border(self, zone: int, x: float, y: float) -> float:
        a = self.rings[zone]
        d = np.roll(a, -1, axis=0) - a
        length2 = (d * d).sum(axis=1)
        along = ((x - a[:, 0]) * d[:, 0] + (y - a[:, 1]) * d[:, 1]) / np.where(length2 > 0, length2, 1.0)
        t = np.clip(np.where(length2 > 0, along, 0.0), 0.0, 1.0)[:, None]
        return float(np.hypot(*(np.array([x, y]) - (a + t * d)).T).min())

    def candidates(self, box: tuple[float, float, float, float]) -> tuple[list[tuple[float, int]], float]:
        """((lower bound, zone) of each zone that may be nearest to a point of the box, bound on the nearest distance).

        From the middle of the box to a zone's border, plus half the diagonal, bounds the distance of every point of the box. Nodes are
        opened nearest first and none beyond the best such bound.
        """
        x, y = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2
        half = float(np.hypot(box[2] - box[0], box[3] - box[1])) / 2
        bound, hits, heap = np.inf, [], [(0.0, len(self.levels) - 1, 0)]
        while heap:
            low, level, i = heapq.heappop(heap)
            if low > bound:
                break
            if level == 0:
                hits.append((low, i))
                bound = min(bound, (self._to_border(i, x, y) + half) * (1 + 1e-9) + 1e-9)
                continue
            kids = self.kids[level - 1][i]
            for k, gap in zip(kids, _gap(self.levels[level - 1][kids], box)):
                if gap <= bound:
                    heapq.heappush(heap, (float(gap), level - 1, int(k)))
        return [(low, i) for low, i in hits if low <= bound], bound
