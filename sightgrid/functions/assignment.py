"""Minimum-cost one-to-one pairing for many small cost matrices at once.

Runs inside a task on the blocks Spark hands it. All blocks of a batch advance together: every numpy step works on
the whole batch, so the Python overhead is per step, not per block.
"""

from __future__ import annotations

import numpy as np


def solve_batch(costs: list[np.ndarray]) -> list[np.ndarray]:
    """For each cost matrix (rows x columns) return ``(k, 2)`` row/column pairs of a minimum-total-cost pairing
    of size ``min(rows, columns)``.
    """
    out: list[np.ndarray] = [np.empty((0, 2), dtype=np.int64)] * len(costs)
    # blocks of similar size share a padded batch
    order = sorted(range(len(costs)), key=lambda k: (max(costs[k].shape), min(costs[k].shape)))
    start = 0
    while start < len(order):
        widest = max(costs[order[start]].shape)
        stop = start
        limit = max(1, min(512, 4_000_000 // (widest * widest)))  # padded cells held at once
        while (stop < len(order) and stop - start < limit
               and max(costs[order[stop]].shape) <= widest + 3):
            stop += 1
        chunk = order[start:stop]
        for k, pairs in zip(chunk, _solve_padded([costs[k] for k in chunk])):
            out[k] = pairs
        start = stop
    return out


def _solve_padded(costs: list[np.ndarray]) -> list[np.ndarray]:
    wide = [c.T if c.shape[0] > c.shape[1] else c for c in costs]
    b = len(wide)
    rows = np.array([c.shape[0] for c in wide])
    n, m = int(rows.max()), max(c.shape[1] for c in wide)
    # the largest finite cost bounds any useful pairing, so this never wins over a real column
    far = (max(float(c.max()) for c in wide) + 1.0) * (n + 1) * 4.0
    cost = np.full((b, n, m), far)
    for k, c in enumerate(wide):
        cost[k, : c.shape[0], : c.shape[1]] = c

    u = np.zeros((b, n + 1))
    v = np.zeros((b, m + 1))
    owner = np.zeros((b, m + 1), dtype=np.int64)  # row (1-based) holding each column, 0 = free; column 0 is a stand-in
    for i in range(1, n + 1):
        live = np.flatnonzero(rows >= i)
        owner[live, 0] = i
        shortest = np.full((b, m + 1), np.inf)
        back = np.zeros((b, m + 1), dtype=np.int64)
        done = np.zeros((b, m + 1), dtype=bool)
        at = np.zeros(b, dtype=np.int64)
        active = live
        while active.size:
            j0 = at[active]
            done[active, j0] = True
            i0 = owner[active, j0]
            reduced = cost[active, i0 - 1, :] - u[active, i0][:, None] - v[active, 1:]
            open_cols = ~done[active, 1:]
            near = shortest[active, 1:]
            better = open_cols & (reduced < near)
            near = np.where(better, reduced, near)
            shortest[active, 1:] = near
            back[active, 1:] = np.where(better, j0[:, None], back[active, 1:])
            candidates = np.where(open_cols, near, np.inf)
            j1 = candidates.argmin(axis=1) + 1
            delta = candidates[np.arange(active.size), j1 - 1]
            # shift potentials of the visited part
            visited = done[active]
            r, c = np.nonzero(visited)
            u[active[r], owner[active[r], c]] += delta[r]
            v[active] = np.where(visited, v[active] - delta[:, None], v[active])
            shortest[active] = np.where(visited, shortest[active], shortest[active] - delta[:, None])
            at[active] = j1
            active = active[owner[active, j1] != 0]
        # flip the alternating path back to the stand-in column
        walk = live
        while walk.size:
            j0 = at[walk]
            j1 = back[walk, j0]
            owner[walk, j0] = owner[walk, j1]
            at[walk] = j1
            walk = walk[j1 != 0]

    results = []
    for k, c in enumerate(costs):
        cols = np.flatnonzero(owner[k, 1:] > 0)
        held = owner[k, 1:][cols] - 1
        pairs = np.stack([held, cols], axis=1)
        if c.shape[0] > c.shape[1]:
            pairs = pairs[:, ::-1]
        results.append(pairs[np.argsort(pairs[:, 0], kind="stable")])
    return results
