"""Choice of matrices, moved polygons, timing blocks, broken envelope lines, image names."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from sightgrid.operators import audit, calibration, health, labels
from sightgrid.operators import envelopes as E
from sightgrid.sources.site import Camera, Site, Zone, site_from_config

UNIT = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
DOUBLE = [2.0, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0, 0.0, 1.0]


def test_both_calibrations_are_read():
    rows = [UNIT[:3], UNIT[3:6], UNIT[6:]]
    site = site_from_config({"homographie": {"cam_01": {
        "matrix": rows, "substream_resolution": [704, 576], "matrix_hd": rows, "hd_resolution": [1920, 1080]},
        "cam_02": {"matrix": rows, "hd_resolution": [1920]}}})
    one, two = site.cameras
    assert one.matrix_hd == UNIT and one.hd_resolution == (1920.0, 1080.0) and one.resolution == (704.0, 576.0)
    assert two.matrix_hd is None and two.hd_resolution is None and two.resolution is None


@pytest.mark.parametrize("camera,size,want", [
    (Camera("c", matrix=UNIT, resolution=(700, 500), matrix_hd=DOUBLE, hd_resolution=(702, 502)), (701, 501), ("matrix_hd", True, 2.0)),
    (Camera("c", matrix=UNIT, resolution=(700, 500), matrix_hd=DOUBLE, hd_resolution=(1400, 1000)), (698, 502), ("c_matrix", False, 1.0)),
    (Camera("c", matrix=UNIT, resolution=(700, 500), matrix_hd=DOUBLE, hd_resolution=(1400, 1000)), (2800, 2000), ("matrix_hd_scaled", True, 1.0)),
    (Camera("c", matrix=UNIT, resolution=(500, 500), matrix_hd=DOUBLE, hd_resolution=(500, 500)), (1000, 1000), ("matrix_hd_scaled", True, 1.0)),
    (Camera("c", matrix=UNIT, matrix_hd=DOUBLE), (10, 10), ("c_matrix", False, 1.0)),
    (Camera("c", matrix_hd=DOUBLE), (10, 10), ("matrix_hd", True, 2.0)),
    (Camera("c"), (10, 10), (None, None, None)),
    (Camera("other", matrix=UNIT), (10, 10), (None, None, None)),
])
def test_choice_of_matrix(spark, camera, size, want):
    df = spark.createDataFrame([("c", *map(float, size))], "cam_id string, w double, hh double")
    r = calibration.choose_homography(df, Site([camera], [], []), F.col("w"), F.col("hh")).collect()[0]
    assert (r.matrix_name, r.is_hd, r.h and r.h.h00) == want


def test_polygons_move_to_all_neighbours(spark):
    site = Site([Camera("a", matrix=UNIT), Camera("b", matrix=DOUBLE), Camera("c", matrix=None)],
                [("room", "a", "b"), ("room", "a", "c")], [])
    df = spark.createDataFrame([("z", "a", [(3.0, 5.0), (-3.0, 4.0)]), ("z", "c", [(1.0, 1.0)]), ("none", "b", None)],
                               "zone_id string, cam_id string, polygon array<struct<x:double,y:double>>")
    got = {(r.zone_id, r.other_cam): r.polygon for r in calibration.transfer_polygons(df, site).collect()}
    assert {k: v and [tuple(p) for p in v] for k, v in got.items()} == {("z", "b"): [(1, 2), (-1, 2)], ("none", "a"): None}


def test_a_step_is_one_frame_at_least(spark):
    df = spark.range(10).select(F.col("id").alias("frame"))
    assert calibration.every_seconds(df, 0.01, 25.0).count() == 10 and calibration.every_nth_frame(df, 4).count() == 3


def test_timing_block_of_an_envelope(spark):
    trace = spark.createDataFrame(
        [("r", 1, "a", True, 5.0, 10.0, 40.0, 11.0, 10.5, 10.6, 10.7, 2.5, 0.5), ("r", 1, "b", None, 7.0, 10.2, 20.0, 11.0, 10.5, None, None, 2.5, 0.5)],
        "run_id string, frame bigint, cam_id string, capture_success boolean, capture_read_ms double, capture_read_end_epoch double, "
        "inference_tracking_ms double, metadata_start_epoch double, batch_ready_epoch double, inference_start_epoch double, "
        "inference_end_epoch double, fusion_ms double, alerts_ms double")
    t = health.timing_block(trace).collect()[0].timing
    assert (t.camera_count, t.capture_read_ms_mean, t.inference_tracking_ms_max, t.batch_ready_epoch) == (2, 6.0, 40.0, 10.5)
    assert (t.inference_start_epoch_min, t.inference_end_epoch_max, t.fusion_ms, t.alerts_ms) == (10.6, 10.7, 2.5, 0.5)
    assert (t.capture_to_metadata_ms_worst, t.capture_to_metadata_ms_latest) == (1000.0, 800.0)


def test_a_broken_line_is_named(spark):
    lines = spark.createDataFrame([("f", 1, '{"a": 1}'), ("f", 2, " "), ("f", 3, '{"a": 1'), ("f", 4, None)],
                                  "file string, line_no bigint, value string")
    assert [(r.file, r.line_no) for r in E.broken_lines(lines).collect()] == [("f", 3)]
    assert E.require_json_lines(lines.where("line_no <> 3")).count() == 3
    with pytest.raises(Exception, match="invalid JSON in f, line 3"):
        E.require_json_lines(lines).collect()


def test_only_frames_without_a_primary_image_are_numbered(spark):
    frames = spark.createDataFrame([("a", 5), ("a", 9), ("a", 9), ("a", 20), ("b", 1)], "cam_id string, frame bigint")
    images = spark.createDataFrame([("a_frame9",), ("a_obj_0002",), ("a_obj_0002",), ("b_frame1",)], "stem string")
    got = {(r.cam_id, r.frame): r.stem for r in labels.image_names(frames, images).collect()}
    assert got == {("a", 5): None, ("a", 9): "a_frame9", ("a", 20): "a_obj_0002", ("b", 1): "b_frame1"}


def _brute_nearest(zones, x, y):
    def far(a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = max(0.0, min(1.0, ((x - a[0]) * dx + (y - a[1]) * dy) / (dx * dx + dy * dy)))
        return math.hypot(x - a[0] - t * dx, y - a[1] - t * dy)

    def distance(p):  # axis-parallel boxes
        inside = p[0][0] <= x <= p[2][0] and p[0][1] <= y <= p[2][1]
        return 0.0 if inside else min(far(a, b) for a, b in zip(p, p[1:] + p[:1]))

    return min((distance(z.polygon), i) for i, z in enumerate(zones))


@pytest.mark.parametrize("block_points", [100_000, 50])
def test_nearest_zone_by_tree_equals_brute_force(spark, block_points, monkeypatch):
    rng = random.Random(9)
    zones = []
    for i in range(60):  # small and very large boxes, some of them one on the other
        x, y, w, h = rng.uniform(0, 50), rng.uniform(0, 20), rng.choice([0.2, 1, 30]), rng.choice([0.3, 2, 9])
        zones.append(Zone(f"z{i}", "", [], [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]))
    zones.insert(20, Zone("twin", "", [], list(zones[3].polygon)))
    zones.insert(0, Zone("line", "", [], [(0, 0), (1, 1)]))
    points = [(i, rng.uniform(-40, 120), rng.uniform(-60, 60)) for i in range(300)] + [
        (300, 1e9, -1e9), (301, None, 1.0), (302, float("nan"), 1.0), (303, *zones[4].polygon[0])]
    df = spark.createDataFrame(points, "id bigint, x_m double, y_m double")
    got = audit._with_nearest(audit.near_zones(df, Site([], [], zones), block_points=block_points)).collect()
    assert len(got) == 304
    for r in got:
        if r.id in (301, 302):
            assert r.nearest_zone is None and r.distance_to_nearest_zone_m is None
            continue
        d, i = _brute_nearest(zones[1:], r.x_m, r.y_m)
        assert r.distance_to_nearest_zone_m == pytest.approx(d, abs=1e-4)
        if r.id != 300:
            assert r.nearest_zone == zones[1:][i].zone_id
    assert audit.nearest_zone(df, Site([], [], [])).where("nearest_zone is not null").count() == 0


def test_ten_thousand_zones_are_few_for_each_row(spark):
    zones = [Zone(f"z{i}", "", [], [(x, y), (x + 2, y), (x + 2, y + 2), (x, y + 2)])
             for i, (x, y) in enumerate((5 * (k % 100), 5 * (k // 100)) for k in range(10_000))]
    df = spark.range(20_000).select((F.rand(4) * 520 - 10).alias("x_m"), (F.rand(5) * 520 - 10).alias("y_m"))
    start = time.time()
    most, mean = audit.near_zones(df, Site([], [], zones)).agg(F.max(F.size("zones")), F.avg(F.size("zones"))).collect()[0]
    assert most <= 16 and mean < 8 and time.time() - start < 90
