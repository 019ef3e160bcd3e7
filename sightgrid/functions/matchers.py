"""Greedy one-to-one matchers over one chunk of a timeline, with the claims that other chunks lay on its alerts.

Every rule takes pairs in one global order: by truth event, or by distance. A claim is a pair that another chunk has taken; it uses
up its alert when its turn in that order comes, so a chunk never hands out what an earlier pair holds elsewhere.
"""

from __future__ import annotations

import heapq

import numpy as np

SLACK_S = 1e-5


class FreeAlerts:
    """Alerts by ascending time with what is left of each; the next one with something left is found in near constant time."""

    def __init__(self, times: np.ndarray, ords: np.ndarray, left: np.ndarray) -> None:
        self.t, self.ord, self.left = times, ords, left.copy()
        self._down, self._up = list(range(len(times) + 1)), list(range(len(times) + 1))  # shifted by one: 0 is "none below"

    @staticmethod
    def _root(link: list[int], i: int) -> int:
        while link[i] != i:
            link[i] = link[link[i]]
            i = link[i]
        return i

    def use(self, j: int) -> None:
        self.left[j] -= 1
        if self.left[j] == 0:
            self._down[j + 1] = j
            self._up[j] = j + 1

    def nearest(self, x: float, tolerance: float) -> tuple[float, int]:
        """(distance, alert) of the nearest one left within the tolerance, the first in order on ties; alert -1 if none."""
        place = int(np.searchsorted(self.t, x))
        below, above = self._root(self._down, place) - 1, self._root(self._up, place)
        found = [(abs(self.t[j] - x), self.ord[j], self.t[j], j) for j in (below, above) if 0 <= j < len(self.t)]
        if not found or min(found)[0] > tolerance:
            return np.inf, -1
        gap, _, _, j = min(found)
        return gap, j

    def first(self, x: float, tolerance: float) -> int:
        """The first in order of those left within the tolerance."""
        lo, hi = np.searchsorted(self.t, x - tolerance - SLACK_S), np.searchsorted(self.t, x + tolerance + SLACK_S, "right")
        open_ = lo + np.flatnonzero((self.left[lo:hi] > 0) & (np.abs(self.t[lo:hi] - x) <= tolerance))
        return int(open_[np.argmin(self.ord[open_])]) if open_.size else -1


def pick(rule: str, tolerance: float, chunk: int, truth: list[tuple], alerts: FreeAlerts, claims: list[tuple]) -> list[int]:
    """The alert of every truth event, -1 if none.

    ``truth`` holds (order, time); ``claims`` hold (order, time, chunk, alert) of the truth event that took the alert elsewhere.
    """
    out = [-1] * len(truth)
    if rule == "distance_order":
        line = [(abs(alerts.t[j] - x), o, x, c, alerts.ord[j], -1, j) for o, x, c, j in claims]
        for i, (o, x) in enumerate(truth):
            gap, j = alerts.nearest(x, tolerance)
            if j >= 0:
                line.append((gap, o, x, chunk, alerts.ord[j], i, j))
        heapq.heapify(line)
        while line:
            *_, i, j = heapq.heappop(line)
            if i < 0:
                alerts.use(j)
            elif alerts.left[j] > 0:
                alerts.use(j)
                out[i] = j
            else:
                o, x = truth[i]
                gap, j = alerts.nearest(x, tolerance)
                if j >= 0:
                    heapq.heappush(line, (gap, o, x, chunk, alerts.ord[j], i, j))
        return out
    line = [(o, x, c, -1, j) for o, x, c, j in claims] + [(o, x, chunk, i, -1) for i, (o, x) in enumerate(truth)]
    for _, x, _, i, j in sorted(line):
        if i >= 0:
            j = out[i] = alerts.nearest(x, tolerance)[1] if rule == "truth_order" else alerts.first(x, tolerance)
        if j >= 0:
            alerts.use(j)
    return out
