"""Registered queries: choice of matrices, moved polygons, thinned frames, timing blocks, envelope lines, image names."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from sightgrid import schemas
from sightgrid.functions import geometry as G
from sightgrid.operators import alerts as A
from sightgrid.operators import calibration, health, labels
from sightgrid.operators import envelopes as E
from sightgrid.operators.ordered import frame_ordinals
from sightgrid.plans.alerting import ALERTS_SQL, RULES
from sightgrid.plans.fusion import numbered
from sightgrid.plans.health import ENVELOPE_SQL, P95_NEAREST, SYNC_SQL, TRACE_SQL, _lines, _sync, _trace
from sightgrid.plans.scalars import INV_SQL
from sightgrid.session import fresh_folder
from sightgrid.sources import run_directories
from sightgrid.sources.sinks import write_fixed_csv
from sightgrid.sources.tables import CAM_SQL, DEMO_SITE, DET_SQL, OVERLAP_SQL, RAW_SQL, _quoted, detections, raw_detections

c = F.col


def _two_matrices(cam):
    """cam_02 with both calibrations, cam_03 with the HD one alone, cam_05 with one of unknown resolution, cam_07 unchanged."""
    hd = [v * 0.4 if i % 3 == 0 else v * 0.5 if i % 3 == 1 else v for i, v in enumerate(cam.matrix)]
    if cam.cam_id == "cam_02":
        return replace(cam, matrix_hd=hd, hd_resolution=(1920.0, 1080.0))
    if cam.cam_id == "cam_03":
        return replace(cam, matrix=None, resolution=None, matrix_hd=hd, hd_resolution=(1920.0, 1080.0))
    return replace(cam, resolution=None) if cam.cam_id == "cam_05" else cam


HD_SITE = replace(DEMO_SITE, cameras=[_two_matrices(cam) for cam in DEMO_SITE.cameras])
SIZES = [(768.0, 577.0), (704.0, 576.0), (1919.0, 1082.0), (1280.0, 720.0)]


def _size(part):
    return F.element_at(F.array(*[F.lit(s[part]) for s in SIZES]), (c("det_id") % 4 + 1).cast("int"))


def chosen_homography(spark, sf):
    """Floor position of every detection by the matrix that suits its frame's size."""
    d = detections(spark, sf).select("det_id", "cam_id", "x1", "x2", "y2", _size(0).alias("w"), _size(1).alias("hh"))
    got = calibration.choose_homography(d, HD_SITE, c("w"), c("hh")).withColumn(
        "_p", G.apply_homography(c("h"), (c("x1") + c("x2")) / 2, c("y2")))
    return got.select("det_id", "matrix_name", "is_hd", F.bround("_p.x", 6).alias("floor_x"), F.bround("_p.y", 6).alias("floor_y"))


def _matrices_sql():
    rows = []
    for cam in HD_SITE.cameras:
        for name, hd, m, r in ((f"{cam.cam_id}_matrix", 0, cam.matrix, cam.resolution), ("matrix_hd", 1, cam.matrix_hd, cam.hd_resolution)):
            if m:
                rows.append((cam.cam_id, name, hd, *m, *(r or (None, None))))
    return _quoted(rows)


CHOICE_SQL = f"""WITH {DET_SQL}, mats(cam_id, name, hd, h00, h01, h02, h10, h11, h12, h20, h21, h22, cw, ch) AS (VALUES {_matrices_sql()}),
 sized AS (SELECT *, (x1 + x2) / 2 AS u, y2 AS v, CASE det_id % 4 {' '.join(f'WHEN {i} THEN {s[0]}' for i, s in enumerate(SIZES))} END AS w,
  CASE det_id % 4 {' '.join(f'WHEN {i} THEN {s[1]}' for i, s in enumerate(SIZES))} END AS hh FROM det),
 kinds AS (SELECT s.det_id, s.u, s.v, m.*, CASE WHEN abs(w - cw) <= 2 AND abs(hh - ch) <= 2 THEN 0 WHEN cw IS NOT NULL THEN 1 ELSE 2 END AS kind,
  coalesce(abs(ln(w/cw)) + abs(ln(hh/ch)), 0.0E0) AS far, cw / w AS rx, ch / hh AS ry FROM sized s JOIN mats m USING (cam_id)),
 best AS (SELECT *, CASE WHEN kind = 1 THEN rx ELSE 1.0E0 END AS sx, CASE WHEN kind = 1 THEN ry ELSE 1.0E0 END AS sy FROM kinds
  QUALIFY row_number() OVER (PARTITION BY det_id ORDER BY kind, CASE WHEN kind = 1 THEN far ELSE 0 END,
   CASE WHEN kind < 2 THEN 1 - hd ELSE hd END) = 1)
 SELECT det_id, name || CASE WHEN kind = 1 THEN '_scaled' ELSE '' END AS matrix_name, hd = 1 AS is_hd,
  round_even((h00*sx*u+h01*sy*v+h02)/(h20*sx*u+h21*sy*v+h22), 6) AS floor_x,
  round_even((h10*sx*u+h11*sy*v+h12)/(h20*sx*u+h21*sy*v+h22), 6) AS floor_y FROM best"""


def transferred_boxes(spark, sf):
    """Every detection's box as a polygon in the images of the overlapping cameras, in whole pixels."""
    corners = [("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2")]
    boxes = detections(spark, sf).select("det_id", "cam_id", F.array(*[
        F.struct(c(x).cast("double").alias("x"), c(y).cast("double").alias("y")) for x, y in corners]).alias("polygon"))
    return calibration.transfer_polygons(boxes, DEMO_SITE).select(
        "det_id", "other_cam", F.posexplode("polygon").alias("i", "p")).select(
        "det_id", "other_cam", c("i").cast("bigint").alias("corner"), c("p.x").alias("u"), c("p.y").alias("v"))


MOVED_SQL = f"""WITH {DET_SQL}, {CAM_SQL}, {INV_SQL}, {OVERLAP_SQL}, corners AS (
 SELECT det_id, cam_id, k AS corner, CASE WHEN k IN (0, 3) THEN x1 ELSE x2 END AS u, CASE WHEN k < 2 THEN y1 ELSE y2 END AS v
 FROM det, (VALUES (0), (1), (2), (3)) ks(k)),
 m AS (SELECT det_id, cam_id, corner, (h00*u+h01*v+h02)/(h20*u+h21*v+h22) AS x, (h10*u+h11*v+h12)/(h20*u+h21*v+h22) AS y
  FROM corners JOIN cams USING (cam_id)),
 nb AS (SELECT cam_a AS cam_id, cam_b AS other_cam FROM cam_overlaps UNION SELECT cam_b, cam_a FROM cam_overlaps)
 SELECT det_id, other_cam, CAST(corner AS BIGINT) AS corner, CAST(trunc((i00*x+i01*y+i02)/(i20*x+i21*y+i22)) AS BIGINT) AS u,
  CAST(trunc((i10*x+i11*y+i12)/(i20*x+i21*y+i22)) AS BIGINT) AS v FROM m JOIN nb USING (cam_id) JOIN inv ON inv.cam_id = other_cam"""


def thinned_frames(spark, sf):
    """Detections left in every fifth frame and in one frame per 0.3 s at 25 frames a second, by camera."""
    d = detections(spark, sf)
    parts = [(5, calibration.every_nth_frame(d, 5)), (7, calibration.every_seconds(d, 0.3, 25.0))]
    kept = [part.groupBy("cam_id").agg(F.count(F.lit(1)).alias("detections"), F.countDistinct("frame").alias("frames")).withColumn(
        "step", F.lit(step).cast("bigint")) for step, part in parts]
    return kept[0].unionByName(kept[1])


def scene_to_alert(spark, sf):
    """Latency from the scene to the alert where the scene's time was read off (two rows of three)."""
    scene = F.when(c("det_id") % 3 != 0, c("ts_s") - (c("det_id") % 900) / 1000.0)
    return raw_detections(spark, sf).select("det_id", calibration.end_to_end_ms(c("ts_s"), scene).alias("e2e_ms"))


def _full_trace(spark, sf):
    return _trace(spark, sf).withColumns({
        "batch_ready_epoch": c("metadata_start_epoch") - 0.5,
        "inference_start_epoch": F.when(c("k") % 5 != 0, c("metadata_start_epoch") - 0.4 + (c("k") % 9) / 100.0)}).withColumn(
        "inference_end_epoch", c("inference_start_epoch") + c("inference_tracking_ms") / 1000.0)


def envelope_timing(spark, sf):
    """Envelopes with their timing block: its fields and the alerts each carries."""
    d = numbered(spark, sf)
    found = A.alerts(d, DEMO_SITE, RULES, frame_ordinals(d, ["run_id"]))
    frames = d.groupBy("run_id", "frame").agg(F.max("ts_s").alias("m")).select(
        "run_id", "frame", (c("m") * 1000.0).alias("created_epoch_ms"), F.lit("V4").alias("model_version"),
        F.lit("yolov8s").alias("model"), F.lit("pt").alias("format"))
    e = E.build_envelopes(frames, A.zones_of(d, DEMO_SITE, ["det_id"]), found, 2, health.timing_block(_full_trace(spark, sf)))
    return e.select("frame", F.size("alerts").cast("bigint").alias("n_alerts"), *[
        c(f"timing.{n}").alias(n) for n, _ in schemas.fields(schemas.TIMING_DOC)])


TIMING_SQL = f"""WITH {ALERTS_SQL}, tr AS (WITH {TRACE_SQL} SELECT *, metadata_start_epoch - 0.5E0 AS ready, CASE WHEN k % 5 <> 0 THEN
  metadata_start_epoch - 0.4E0 + (k % 9) / 100.0E0 END AS start_ FROM trace),
 t AS (SELECT frame, count(DISTINCT cam_id) AS camera_count,
  round_even(coalesce(avg(capture_read_ms) FILTER (WHERE ok), 0), 3) AS capture_read_ms_mean,
  round_even(coalesce(max(capture_read_ms) FILTER (WHERE ok), 0), 3) AS capture_read_ms_max,
  round_even(min(e) FILTER (WHERE ok), 6) AS capture_read_end_epoch_min, round_even(max(e) FILTER (WHERE ok), 6) AS capture_read_end_epoch_max,
  round_even(max(ready), 6) AS batch_ready_epoch, round_even(min(start_), 6) AS inference_start_epoch_min,
  round_even(max(start_ + inference_tracking_ms / 1000.0E0), 6) AS inference_end_epoch_max,
  round_even(avg(inference_tracking_ms), 3) AS inference_tracking_ms_mean, round_even(max(inference_tracking_ms), 3) AS inference_tracking_ms_max,
  round_even(max(fusion_ms), 3) AS fusion_ms, round_even(max(alerts_ms), 3) AS alerts_ms,
  round_even(coalesce((max(metadata_start_epoch) - min(e) FILTER (WHERE ok)) * 1000.0E0, 0), 3) AS capture_to_metadata_ms_worst,
  round_even(coalesce((max(metadata_start_epoch) - max(e) FILTER (WHERE ok)) * 1000.0E0, 0), 3) AS capture_to_metadata_ms_latest
  FROM tr GROUP BY frame),
 published AS (SELECT DISTINCT frame FROM gdet WHERE frame % 2 = 0),
 al AS (SELECT frame, count(*) AS n FROM all_alerts GROUP BY frame)
 SELECT published.frame, coalesce(n, 0) AS n_alerts, t.* EXCLUDE (frame) FROM published LEFT JOIN t ON t.frame = published.frame
  LEFT JOIN al ON al.frame = published.frame"""


def _torn(spark, sf):
    """The view's envelope lines; every eleventh is cut short, every thirteenth blank."""
    at = c("line_no")
    return _lines(spark, sf).withColumn("value", F.when(at % 11 == 0, F.expr("left(value, length(value) - 1)")).when(
        at % 13 == 0, F.lit("  ")).otherwise(c("value")))


def broken_envelope_lines(spark, sf):
    """Lines of the envelope files that are not JSON."""
    return E.broken_lines(_torn(spark, sf)).select("file", "line_no")


def example_envelopes(spark, sf):
    """First envelope with a detection and with an alert of each file, told by their creation times and sizes."""
    got = E.first_example_envelopes(E.envelope_facts(_lines(spark, sf)))

    def size_of(column, field):
        return F.json_array_length(F.get_json_object(column, f"$.{field}")).cast("bigint")

    def created(column):
        return F.bround(F.get_json_object(column, "$.created_epoch_ms").cast("double"), 3)

    return got.select("file", created("example_with_detection").alias("detection_created_ms"),
                      size_of("example_with_detection", "detections").alias("n_detections"),
                      created("example_with_alert").alias("alert_created_ms"), size_of("example_with_alert", "alerts").alias("n_alerts"))


def image_names(spark, sf):
    """Images of the frames with class 5: some by their primary name, the rest by number, some numbers without an image."""
    frames = detections(spark, sf).where(c("class_id") == 5).select("cam_id", "frame").distinct()
    primary = frames.where(c("frame") % 3 == 0).select(F.format_string("%s_frame%d", "cam_id", "frame").alias("stem"))
    legacy = labels.image_sequence(frames).where(c("seq") % 4 != 0).select("stem")
    return labels.image_names(frames, primary.union(legacy))


def compared_run_directories(spark, sf):
    """Runs of the view written out as directories and compared: deliveries of two cameras, campaigns of two models."""
    root = fresh_folder(spark, "runs")
    d = raw_detections(spark, sf)
    for cam in ("cam_02", "cam_03"):
        d.where(c("cam_id") == cam).select(
            c("det_id").alias("event_id"), F.lit("").alias("transport"),
            F.when(c("det_id") % 10 == 0, "n/a").otherwise(c("value").cast("string")).alias("latency_ms")).write.csv(
            f"{root}/{cam}/{run_directories.DELIVERY}", header=True, emptyValue="")
    sync = _sync(spark, sf).withColumns({n: F.lit(None).cast("string") for n in ("model_version", "model", "format")})
    frames = detections(spark, sf).groupBy("model").agg(F.countDistinct("frame").alias("frames"), F.count(F.lit(1)).alias("detections"),
                                                        F.bround(F.max("value"), 3).alias("latency_max_ms"))
    for model in ("model_1", "model_2"):
        for name, kind, rows in ((run_directories.SUMMARY, "run_summary", frames.where(c("model") == model)),
                                 (run_directories.SYNC, "sync_events", sync.where(c("run_id") == model))):
            write_fixed_csv(rows, [n for n, _ in schemas.fields(schemas.RUN_FILES[kind])], f"{root}/{model}/{name}")
    got = run_directories.compare_run_directories(spark, f"{root}/*")
    return got.select(F.regexp_extract("run_dir", "([^/]+)$", 1).alias("run"), "summary_type", "transport", "events", "latency_mean_ms",
                      "latency_median_ms", "latency_p95_ms", "latency_max_ms", "frames", "duration_s", "effective_fps", "detections",
                      "dropped_cameras", "camera_count", "fusion_camera_pairs")


RUNS_SQL = f"""WITH {SYNC_SQL}, dl AS (SELECT cam_id AS run, value AS v FROM raw_det WHERE cam_id IN ('cam_02', 'cam_03') AND det_id % 10 <> 0)
 SELECT run, 'alert_delivery' AS summary_type, run AS transport, count(*) AS events, round_even(avg(v), 6) AS latency_mean_ms,
  round_even(quantile_cont(v, 0.5), 6) AS latency_median_ms, round_even({P95_NEAREST.format('v')}, 6) AS latency_p95_ms,
  round_even(max(v), 6) AS latency_max_ms, CAST(NULL AS BIGINT) AS frames, CAST(NULL AS DOUBLE) AS duration_s,
  CAST(NULL AS DOUBLE) AS effective_fps, CAST(NULL AS BIGINT) AS detections, NULL AS dropped_cameras, CAST(NULL AS BIGINT) AS camera_count,
  CAST(NULL AS BIGINT) AS fusion_camera_pairs FROM dl GROUP BY run UNION ALL
 SELECT run_id, 'phase3_campaign', NULL, NULL, 0.0E0, NULL, 0.0E0, hi, nf, round_even(dur, 3), round_even(nf / dur, 3), n, dropped, cams, 0
 FROM (SELECT model AS run_id, count(DISTINCT frame) AS nf, count(*) AS n, round_even(max(value), 3) AS hi FROM det GROUP BY model) f
 JOIN (SELECT run_id, max(last_elapsed_s) - min(first_elapsed_s) AS dur, count(*) AS cams, coalesce(string_agg(CASE WHEN dropped_early THEN
  cam_id END, ',' ORDER BY cam_id), '') AS dropped FROM cs GROUP BY run_id) k USING (run_id) WHERE run_id IN ('model_1', 'model_2')"""


QUERIES = {
    "compared_run_directories": (compared_run_directories, RUNS_SQL),
    "chosen_homography": (chosen_homography, CHOICE_SQL),
    "transferred_boxes": (transferred_boxes, MOVED_SQL),
    "thinned_frames": (thinned_frames, f"WITH {DET_SQL} " + " UNION ALL ".join(
        f"SELECT cam_id, count(*) AS detections, count(DISTINCT frame) AS frames, CAST({n} AS BIGINT) AS step FROM det WHERE frame % {n} = 0 "
        "GROUP BY cam_id" for n in (5, 7))),
    "scene_to_alert": (scene_to_alert, f"""WITH {RAW_SQL} SELECT det_id, CASE WHEN det_id % 3 <> 0 THEN
      round_even((ts_s - (ts_s - (det_id % 900)/1000.0E0)) * 1000.0E0, 3) END AS e2e_ms FROM raw_det"""),
    "envelope_timing": (envelope_timing, TIMING_SQL),
    "broken_envelope_lines": (broken_envelope_lines, f"WITH {ENVELOPE_SQL} SELECT file, line_no FROM env WHERE line_no % 11 = 0"),
    "example_envelopes": (example_envelopes, f"""WITH {ENVELOPE_SQL} SELECT file, round_even(arg_min(created_ms, line_no), 3) AS
      detection_created_ms, arg_min(n, line_no) AS n_detections, round_even(arg_min(created_ms, line_no) FILTER (WHERE na > 0), 3) AS
      alert_created_ms, arg_min(na, line_no) FILTER (WHERE na > 0) AS n_alerts FROM env GROUP BY file"""),
    "image_names": (image_names, f"""WITH {DET_SQL}, fr AS (SELECT DISTINCT cam_id, frame FROM det WHERE class_id = 5),
      legacy AS (SELECT cam_id, row_number() OVER (PARTITION BY cam_id ORDER BY frame) AS seq FROM fr),
      missed AS (SELECT *, row_number() OVER (PARTITION BY cam_id ORDER BY frame) AS seq FROM fr WHERE frame % 3 <> 0)
      SELECT cam_id, frame, cam_id || '_frame' || frame AS stem FROM fr WHERE frame % 3 = 0 UNION ALL
      SELECT m.cam_id, m.frame, CASE WHEN l.seq IS NOT NULL THEN printf('%s_obj_%04d', m.cam_id, m.seq) END AS stem FROM missed m
      LEFT JOIN legacy l ON l.cam_id = m.cam_id AND l.seq = m.seq AND l.seq % 4 <> 0"""),
}
