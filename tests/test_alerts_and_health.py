"""Golden cases of alerts, geometry, run health and the threshold sweep."""

import pytest
from pyspark.sql import functions as F

from sightgrid.functions import geometry as G
from sightgrid.functions import names as N
from sightgrid.operators import alerts as A
from sightgrid.operators import health, sweep
from sightgrid.operators.ordered import frame_ordinals
from sightgrid.operators.quantiles import latency_stats
from sightgrid.sources.site import Site, Zone, site_from_config
from tests.test_fusion import SCHEMA, SITE

SQUARE = [(4, 4), (6, 4), (6, 6), (4, 6)]
FUSED = ("run_id string, frame bigint, ts_s double, cam_id string, track_id bigint, class_id bigint, class_name string, "
         "confidence double, x_m double, y_m double, det_ord bigint, global_id bigint")


def fused(spark, rows):
    """rows: (frame, cam, class name, x, y, gid[, confidence])"""
    full = [("r", f, float(f), cam, g, 0 if name == "person" else 39, name, conf[0] if conf else 0.9, float(x), float(y), i, g)
            for i, (f, cam, name, x, y, g, *conf) in enumerate(rows)]
    return spark.createDataFrame(full, FUSED)


def spine(spark, n):
    return frame_ordinals(spark.createDataFrame([("r", f) for f in range(n)], "run_id string, frame bigint"), ["run_id"])


def site(cameras):
    return Site([], [], [Zone("zone_1", "z", cameras, SQUARE)])


def raised(spark, rows, cameras, rules, frames):
    found = A.alerts(fused(spark, rows), site(cameras), rules, spine(spark, frames)).collect()
    return sorted((a.frame, a.alert_type, a.alert_level, a.global_id, "+".join(a.cameras)) for a in found)


def test_zone_entry_votes_and_ratio(spark):
    cams = ["cam_02", "cam_03", "cam_05", "cam_07"]
    one = [(0, "cam_03", "person", 5, 5, 1)]
    two = one + [(0, "cam_07", "person", 5.1, 5, 1)]
    rules = A.AlertRules(zone_min_ratio=0.5)
    assert raised(spark, one, cams, rules, 1) == []
    assert raised(spark, two, cams, rules, 1) == [(0, "zone_violation_person", "confirmed", 1, "cam_03+cam_07")]
    outside = [(0, "cam_03", "person", 7, 5, 1)]
    assert raised(spark, outside, cams, A.AlertRules(), 1) == []


def test_best_position_may_come_from_a_camera_that_does_not_vote(spark):
    rows = [(0, "cam_03", "person", 5, 5, 1, 0.6), (0, "cam_09", "person", 5.5, 5.5, 1, 0.95)]
    got = A.alerts(fused(spark, rows), site(["cam_03"]), A.AlertRules(), spine(spark, 1)).collect()
    assert [(a.x_m, a.confidence, a.cameras) for a in got] == [(5.5, 0.95, ["cam_03"])]


def test_reentry_and_exit_use_processed_frames_without_detections(spark):
    rows = [(0, "cam_03", "person", 5, 5, 1), (1, "cam_03", "person", 5, 5, 1), (3, "cam_03", "person", 5, 5, 1)]
    got = raised(spark, rows, ["cam_03"], A.AlertRules(), 4)
    assert [(g[0], g[1]) for g in got] == [(0, "zone_violation_person"), (3, "zone_violation_person")]
    voted = A.enough_votes(A.zone_presence(fused(spark, rows), site(["cam_03"])))
    assert [r.resolved_ord for r in A.zone_exits(voted, spine(spark, 4)).collect()] == [2]


def test_escalation_and_downgrade(spark):
    def frame(f, cams):
        return [(f, c, "bottle", 1, 1, 5) for c in cams]

    two, one = ["cam_03", "cam_05"], ["cam_03"]
    got = raised(spark, frame(0, one) + frame(1, two) + frame(2, two), [], A.AlertRules(), 3)
    assert [(g[0], g[2]) for g in got] == [(0, "weak"), (1, "confirmed")]
    # losing a camera is silent, but the next confirmed frame is raised again
    got = raised(spark, frame(0, two) + frame(1, one) + frame(2, two), [], A.AlertRules(), 3)
    assert [(g[0], g[2]) for g in got] == [(0, "confirmed"), (2, "confirmed")]
    assert raised(spark, frame(0, one), [], A.AlertRules(emit_weak=False), 1) == []
    assert raised(spark, [(0, "cam_03", "car", 1, 1, 5)], [], A.AlertRules(), 1) == []


def test_polygon_border_and_distance(spark):
    pts = spark.createDataFrame([(4.0, 5.0), (6.0, 6.0), (3.999, 5.0), (7.0, 5.0), (5.0, 5.0), (8.0, 8.0)], "x double, y double")
    poly = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in SQUARE])
    rows = pts.select("x", "y", G.point_in_polygon(G.edges_of(poly), F.col("x"), F.col("y")).alias("inside"),
                      G.distance_to_polygon(G.edges_of(poly), F.col("x"), F.col("y")).alias("d")).collect()
    assert [r.inside for r in rows] == [True, True, False, False, True, False]
    assert [round(r.d, 6) for r in rows] == [0.0, 0.0, 0.001, 1.0, 0.0, round(8 ** 0.5, 6)]


def test_identity_homography_and_invalid_boxes(spark):
    df = spark.createDataFrame([(10.0, 20.0, 50.0, 100.0), (float("nan"), 1.0, 2.0, 3.0), (5.0, 5.0, 5.0, 9.0)],
                               "x1 double, y1 double, x2 double, y2 double")
    ok = df.where(G.valid_detection(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], F.lit(0.5)))
    eye = F.struct(*[F.lit(1.0 if i in (0, 4, 8) else 0.0).alias(n) for i, n in enumerate(G.H_FIELDS)])
    row = ok.select(G.apply_homography(eye, (F.col("x1") + F.col("x2")) / 2, F.col("y2")).alias("p"),
                    G.apply_homography(G.invert_homography(eye), F.lit(3.0), F.lit(4.0)).alias("q")).collect()
    assert [(r.p.x, r.p.y, r.q.x, r.q.y) for r in row] == [(30.0, 100.0, 3.0, 4.0)]
    none = F.struct(*[F.lit(0.0).alias(n) for n in G.H_FIELDS])
    assert df.limit(1).select(G.invert_homography(none).alias("i")).collect()[0].i is None


def test_class_keys(spark):
    df = spark.createDataFrame([("Personne",), ("niveau_à  Bulle",), ("",), ("Œuvre ﬁn",), ("日本",)], "n string")
    got = [r.k for r in df.select(N.class_key(F.col("n"), F.lit(7)).alias("k")).collect()]
    assert got == ["person", "niveau a bulle", "7", "uvre fin", "7"]


def test_truth_flag_rejects_unknown_words(spark):
    df = spark.createDataFrame([("peut-être",)], "w string")
    with pytest.raises(Exception, match="cannot read truth value"):
        df.select(N.truth_flag([F.col("w")])).collect()


def test_threshold_sweep_golden_rows(spark):
    rows = []
    for f in range(10):
        d = f * 0.02
        for cam, track, x, y, truth in (
            ("cam_03", 1, 5.00 + d, 2.00, "A"), ("cam_05", 8, 5.42 + d, 2.03, "A"), ("cam_07", 4, 5.85 + d, 2.02, "A"),
            ("cam_03", 2, 8.00, 1.00 + d, "B"), ("cam_07", 5, 9.35, 1.05 + d, "B"), ("cam_05", 9, 2.00, 5.00 + d, "C"),
            ("cam_07", 6, 2.95, 5.05 + d, "D"),
        ):
            rows.append(("r", f, f / 25.0, cam, track, 0, "person", 0.9, x, y, len(rows), truth))
    got = {r.threshold_cm: r for r in sweep.sweep_with_truth(spark.createDataFrame(rows, SCHEMA), SITE).collect()}
    table = {t: (r.tp, r.fp, r.fn, r.tn, r.unique_global_ids, r.f1) for t, r in got.items()}
    assert table == {50: (10, 0, 30, 120, 6, 0.4), 100: (30, 10, 10, 110, 4, 0.75), 150: (40, 10, 0, 110, 3, 0.8889),
                     200: (40, 10, 0, 110, 3, 0.8889)}


def test_sync_drop_and_run_health(spark):
    sync = [("r", f, "cam_02", f * 0.1) for f in range(5)] + [("r", f, "cam_07", f * 0.1) for f in range(2)]
    df = spark.createDataFrame(sync, "run_id string, campaign_frame bigint, cam_id string, elapsed_s double")
    stats = {r.cam_id: r for r in health.camera_sync_stats(df).collect()}
    assert stats["cam_07"].dropped_early and stats["cam_07"].missing_campaign_frames == 3
    assert not stats["cam_02"].dropped_early
    absent = {r.cam_id: r for r in health.camera_sync_stats(df, ["cam_02", "cam_09"]).collect()}
    assert absent["cam_09"].frames == 0 and absent["cam_09"].dropped_early and absent["cam_09"].missing_campaign_frames == 5

    links = spark.createDataFrame([("r", 0, "cam_02", "cam_03", 0), ("r", 0, "cam_03", "cam_02", 1), ("r", 2, "cam_02", "cam_03", 2)],
                                  "run_id string, frame bigint, cam_a string, cam_b string, ord bigint")
    summary = spark.createDataFrame([("r", 5, 20, 3, 1, 1.0, 2.0, 3.0)], "run_id string, frames bigint, detections bigint, "
                                    "fusion_links bigint, alerts bigint, latency_mean_ms double, latency_p95_ms double, "
                                    "latency_max_ms double")
    row = health.run_health(summary, health.camera_sync_stats(df), health.fusion_link_stats(links, F.col("ord"))).collect()[0]
    assert (row.duration_s, row.effective_fps, row.frames_with_fusion) == (0.4, 12.5, 2)
    assert (row.fusion_frame_rate_pct, row.fusion_links_per_frame, row.fusion_links_per_1000_detections) == (40.0, 0.6, 150.0)
    assert (row.top_fusion_pair, row.top_fusion_pair_links, row.dropped_cameras) == ("cam_02+cam_03", 3, "cam_07")


def test_no_sync_rows_keep_zero_rates(spark):
    summary = spark.createDataFrame([("r", 5, 0, 0, 0, 1.0, 2.0, 3.0)], "run_id string, frames bigint, detections bigint, "
                                    "fusion_links bigint, alerts bigint, latency_mean_ms double, latency_p95_ms double, "
                                    "latency_max_ms double")
    empty = spark.createDataFrame([], "run_id string, campaign_frame bigint, cam_id string, elapsed_s double")
    links = spark.createDataFrame([], "run_id string, frame bigint, cam_a string, cam_b string, ord bigint")
    row = health.run_health(summary, health.camera_sync_stats(empty), health.fusion_link_stats(links, F.col("ord"))).collect()[0]
    assert (row.duration_s, row.effective_fps, row.fusion_links_per_1000_detections, row.camera_count) == (0.0, 0.0, 0.0, 0)


def test_compare_runs(spark):
    df = spark.createDataFrame([("a", 20.0, 20.0, 1, 4, 5), ("b", 10.0, 30.0, 0, 4, 0)],
                               "run_id string, effective_fps double, latency_p95_ms double, dropped_count bigint, "
                               "camera_count bigint, fusion_links bigint")
    row = health.compare_runs(df).collect()[0]
    assert (row.runs, row.mean_effective_fps, row.mean_latency_p95_ms, row.drop_rate, row.fusion_enabled_rate) == (
        2.0, 15.0, 25.0, 0.125, 0.5)


def test_nearest_rank_of_three(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (5.0,)], "v double")
    row = latency_stats(df, [], F.col("v"), 6, p95="nearest").collect()[0]
    assert (row.n, row.latency_median_ms, row.latency_p95_ms, row.latency_max_ms) == (3, 3.0, 5.0, 5.0)


def test_site_from_config():
    s = site_from_config({
        "rooms": {"r1": {"cameras": ["cam_02", "cam_03"]}}, "camera_overlaps": {"r1": [["cam_02", "cam_03"], ["cam_02"]], "r2": None},
        "zones_interdites": {"z": {"nom": "Z", "cameras_concernees": ["cam_02"], "coordonnees_metres": [[0, 0], [1, 0]]}},
        "homographie": {"cam_02_matrix": [[1, 0, 0], [0, 1, 0], [0, 0, 1]], "cam_02": {"mean_error_cm": 2.0, "max_error_cm": 3.0}},
    })
    assert s.overlaps == [("r1", "cam_02", "cam_03")]
    assert [(c.cam_id, c.room_id, bool(c.matrix), c.mean_error_cm) for c in s.cameras] == [
        ("cam_02", "r1", True, 2.0), ("cam_03", "r1", False, None)]


def test_long_silence_is_resampled_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(health, "TICK_STRETCH", 7)
    obs = spark.createDataFrame([("r", "c", 0.0, 0), ("r", "c", 0.9, 1), ("r", "c", 50.0, 2)],
                                "run_id string, cam_id string, ts_s double, det_ord bigint")
    got = sorted((r.tick, r.det_ord, r.duplicated) for r in health.resample_fixed_rate(obs, ["run_id", "cam_id"], 1.0).collect())
    assert got == [(0, 0, False), (1, 1, False), *[(t, 1, True) for t in range(2, 50)], (50, 2, False)]
