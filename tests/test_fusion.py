"""Fusion, sticky ids and threshold sweep against brute force and golden rows."""

import itertools
import math
import random

import numpy as np
import pytest

from sightgrid.functions.assignment import solve_batch
from sightgrid.operators.fusion import candidate_pairs, frame_components, gate, mutual_nearest_links, optimal_links
from sightgrid.operators.identity import assign_global_ids, connected_components
from sightgrid.sources.site import Site

CAMS = ["cam_02", "cam_03", "cam_05", "cam_07"]
SITE = Site([], [("room_1", a, b) for a, b in itertools.combinations(CAMS, 2)], [])
SCHEMA = ("run_id string, frame bigint, ts_s double, cam_id string, track_id bigint, class_id bigint, "
          "class_name string, confidence double, x_m double, y_m double, det_ord bigint, truth_id string")


def rows_to_df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def sequential_ids(rows, limit, window=0.5):
    """Independent oracle: one pass over the frames with a registry held in a dict."""
    held, nxt, out = {}, 1, {}
    for frame in sorted({r[1] for r in rows}):
        dets = sorted((r for r in rows if r[1] == frame), key=lambda r: r[10])
        groups = {(r[3], r[4], r[6]): {(r[3], r[4], r[6])} for r in dets}
        for a, b in itertools.combinations(CAMS, 2):
            left = [r for r in dets if r[3] == a and r[8] is not None]
            right = [r for r in dets if r[3] == b and r[8] is not None]
            if not left or not right:
                continue
            cost = np.array([[math.dist(p[8:10], q[8:10]) if p[6] == q[6] and abs(p[2] - q[2]) <= window else 1e6
                              for q in right] for p in left])
            for i, j in brute_pairing(cost):
                if cost[i, j] < limit:
                    ka, kb = left[i][3:5] + (left[i][6],), right[j][3:5] + (right[j][6],)
                    merged = groups[ka] | groups[kb]
                    for k in merged:
                        groups[k] = merged
        seen = set()
        for r in dets:
            members = groups[(r[3], r[4], r[6])]
            if id(members) in seen:
                continue
            seen.add(id(members))
            known = [held[m] for m in members if m in held]
            gid = min(known) if known else nxt
            nxt += 0 if known else 1
            for m in members:
                held[m] = gid
        for r in dets:
            out[(frame, r[3], r[4], r[6])] = held[(r[3], r[4], r[6])]
    return out


def brute_pairing(cost):
    n, m = cost.shape
    if n > m:
        return [(i, j) for j, i in brute_pairing(cost.T)]
    best = min(itertools.permutations(range(m), n), key=lambda p: sum(cost[i, j] for i, j in enumerate(p)))
    return list(enumerate(best))


def random_rows(seed, frames=12, tracks=3):
    rng = random.Random(seed)
    rows = []
    for f in range(frames):
        for ci, cam in enumerate(CAMS):
            for t in range(tracks):
                if rng.random() < 0.6:
                    pos = (None, None) if rng.random() < 0.1 else (rng.uniform(0, 3), rng.uniform(0, 3))
                    name = rng.choice(["person", "person", "bottle"])
                    rows.append(("r", f, float(f), cam, t, 0, name, 0.9, *pos, ci * 1000 + t, None))
    return rows


def test_solver_matches_brute_force():
    rng = np.random.default_rng(3)
    costs = []
    for _ in range(150):
        c = rng.random((rng.integers(1, 6), rng.integers(1, 6)))
        c[rng.random(c.shape) < 0.2] = 1e6
        costs.append(c)
    for c, pairs in zip(costs, solve_batch(costs)):
        assert len(pairs) == min(c.shape)
        assert len(set(pairs[:, 0])) == len(set(pairs[:, 1])) == len(pairs)
        want = sum(c[i, j] for i, j in brute_pairing(c))
        assert sum(c[i, j] for i, j in pairs) == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("seed,chunk", [(1, 1024), (2, 3), (5, 1)])
def test_sticky_ids_equal_sequential_registry(spark, seed, chunk):
    rows = random_rows(seed)
    dets = rows_to_df(spark, rows)
    fused = assign_global_ids(dets, gate(optimal_links(dets, SITE), 1.0), chunk_rows=chunk).collect()
    got = {(r.frame, r.cam_id, r.track_id, r.class_name): r.global_id for r in fused}
    assert got == sequential_ids(rows, 1.0)


def test_gating_comes_after_the_optimum(spark):
    # the nearest pair (0.1) is not part of the cheapest total pairing
    rows = [("r", 0, 0.0, "cam_02", 1, 0, "person", 0.9, 0.0, 0.0, 1, None),
            ("r", 0, 0.0, "cam_02", 2, 0, "person", 0.9, 0.9, 0.0, 2, None),
            ("r", 0, 0.0, "cam_03", 1, 0, "person", 0.9, 1.0, 0.0, 1001, None),
            ("r", 0, 0.0, "cam_03", 2, 0, "person", 0.9, 5.0, 0.0, 1002, None)]
    links = optimal_links(rows_to_df(spark, rows), SITE).collect()
    chosen = {(r.track_id_a, r.track_id_b) for r in links}
    total = sum(r.distance_m for r in links)
    assert total == pytest.approx(min(1.0 + 4.1, 5.0 + 0.1))
    assert chosen in ({(1, 1), (2, 2)}, {(1, 2), (2, 1)})


def test_time_gate_and_class_gate(spark):
    rows = [("r", 0, 0.0, "cam_02", 1, 0, "Personne", 0.9, 5.0, 5.0, 1, None),
            ("r", 0, 2.0, "cam_03", 1, 0, "person", 0.9, 5.0, 5.0, 1001, None),
            ("r", 0, 0.1, "cam_05", 1, 39, "bottle", 0.9, 5.0, 5.0, 2001, None)]
    dets = rows_to_df(spark, rows)
    assert gate(optimal_links(dets, SITE, window_s=0.5), 1.0).count() == 0
    linked = gate(optimal_links(dets, SITE, window_s=2.0), 1.0).collect()
    assert [(r.cam_a, r.cam_b) for r in linked] == [("cam_02", "cam_03")]
    loose = gate(optimal_links(dets, SITE, window_s=2.0, class_match=False), 1.0)
    assert loose.count() == 3


def test_candidate_grid_finds_every_near_pair(spark):
    rows = random_rows(9, frames=4, tracks=6)
    got = {(r.frame, r.det_ord_a, r.det_ord_b) for r in candidate_pairs(rows_to_df(spark, rows), SITE, 0.7).collect()}
    want = {(p[1], p[10], q[10]) for p in rows for q in rows
            if p[1] == q[1] and p[3] < q[3] and p[6] == q[6] and p[8] is not None and q[8] is not None
            and math.dist(p[8:10], q[8:10]) < 0.7}
    assert got == want


def test_components_and_mutual_nearest(spark):
    rows = random_rows(4, frames=5, tracks=5)
    links = mutual_nearest_links(candidate_pairs(rows_to_df(spark, rows), SITE, 1.0))
    comps = {(r.frame, r.cam_id, r.track_id, r.class_key): (r.comp_cam, r.comp_track, r.comp_class)
             for r in frame_components(links).collect()}
    for r in links.collect():
        a = comps[(r.frame, r.cam_a, r.track_id_a, r.class_key_a)]
        assert a == comps[(r.frame, r.cam_b, r.track_id_b, r.class_key_b)]


def test_session_components_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)], "u int, v int")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[101] == got[102] == 100
