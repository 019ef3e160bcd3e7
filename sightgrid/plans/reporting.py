"""Registered queries: calibration audit, training labels, unions and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightgrid.functions import names
from sightgrid.operators import alerts as A
from sightgrid.operators import audit, labels, reports
from sightgrid.plans.scalars import DIST_SQL, LABELS_SQL, _label
from sightgrid.sources import run_files, sinks
from sightgrid.sources.tables import CAM_SQL, DEMO_SITE, DET_SQL, RAW_SQL, detections, raw_detections

c = F.col


def _declared(spark, sf):
    """Every detection as an alert of one or two cameras that declares zone_1, zone_2 or nothing."""
    second = F.when(c("det_id") % 3 == 0, F.lit("cam_07"))
    return detections(spark, sf).select(
        c("det_id").alias("alert_key"), (c("det_id") - c("det_id") % 2).cast("string").alias("alert_id"),
        F.when(c("class_id") == 11, "zone_violation_person").otherwise("forbidden_object").alias("alert_type"),
        F.when(c("det_id") % 5 == 0, "").when(c("det_id") % 2 == 0, "zone_1").otherwise("zone_2").alias("declared_zone"),
        F.array_distinct(F.array_compact(F.array(c("cam_id"), second))).alias("cameras"), "x_m", "y_m")


def audited_alerts(spark, sf):
    return audit.audit_alerts(_declared(spark, sf), DEMO_SITE).select(
        "alert_key", "inside_zones", "expected_zone_ok", "nearest_zone", "distance_to_nearest_zone_m", "worst_mean_error_cm",
        "worst_max_error_cm")


def audit_deduplicated(spark, sf):
    return audit.audit_by_type(audit.audit_alerts(_declared(spark, sf), DEMO_SITE, dedupe=True))


def audit_by_type(spark, sf):
    return audit.audit_by_type(audit.audit_alerts(_declared(spark, sf), DEMO_SITE))


def audit_by_camera(spark, sf):
    return audit.audit_by_camera(audit.audit_alerts(_declared(spark, sf), DEMO_SITE), DEMO_SITE)


def suspicious_alerts(spark, sf):
    return audit.suspicious_alerts(audit.audit_alerts(_declared(spark, sf), DEMO_SITE)).select("alert_key", "declared_zone")


def worst_calibration(spark, sf):
    return audit.worst_calibration_error(_declared(spark, sf), DEMO_SITE).select(
        "alert_key", "worst_mean_error_cm", "worst_max_error_cm")


AUDIT_SQL = DIST_SQL + ", " + CAM_SQL + """, al AS (SELECT det_id AS alert_key, CAST(det_id - det_id % 2 AS VARCHAR) AS alert_id,
  CASE WHEN class_id = 11 THEN 'zone_violation_person' ELSE 'forbidden_object' END AS alert_type, CASE WHEN det_id % 5 = 0 THEN ''
  WHEN det_id % 2 = 0 THEN 'zone_1' ELSE 'zone_2' END AS declared_zone, x_m, y_m,
  list_distinct(CASE WHEN det_id % 3 = 0 THEN [cam_id, 'cam_07'] ELSE [cam_id] END) AS cams FROM det),
 ins AS (SELECT det_id AS alert_key, string_agg(zone_id, '+' ORDER BY zone_ord) AS z, list(zone_id) AS zl FROM hits GROUP BY det_id),
 nz AS (SELECT det_id AS alert_key, arg_min(zone_id, (d, zone_ord)) AS nearest_zone, round_even(min(d), 4) AS distance_to_nearest_zone_m
  FROM zdist GROUP BY det_id),
 ex AS (SELECT alert_key, unnest(cams) AS cam_id FROM al),
 wc AS (SELECT alert_key, round_even(max(mean_error_cm), 2) AS worst_mean_error_cm, round_even(max(max_error_cm), 2) AS worst_max_error_cm
  FROM ex JOIN cams USING (cam_id) GROUP BY alert_key),
 au AS (SELECT al.*, coalesce(z, '') AS inside_zones, z IS NOT NULL AS inside_any_zone, CASE WHEN alert_type = 'zone_violation_person'
  THEN declared_zone <> '' AND coalesce(list_contains(zl, declared_zone), false) ELSE true END AS expected_zone_ok,
  nearest_zone, distance_to_nearest_zone_m, worst_mean_error_cm, worst_max_error_cm
  FROM al LEFT JOIN ins USING (alert_key) LEFT JOIN nz USING (alert_key) LEFT JOIN wc USING (alert_key))"""


def reprojection_report(spark, sf):
    """Calibration error per camera when each event is a reference point near its projected position."""
    d = raw_detections(spark, sf).join(DEMO_SITE.camera_dim(spark), "cam_id").select(
        "cam_id", "det_id", c("x1").alias("u"), c("y1").alias("v"), "h")
    from sightgrid.functions.geometry import apply_homography

    near = d.withColumn("_p", apply_homography(c("h"), c("u"), c("v"))).select(
        "cam_id", "u", "v", (c("_p.x") + (c("det_id") % 10) / 100.0).alias("x_m"),
        (c("_p.y") - (c("det_id") % 7) / 100.0).alias("y_m"))
    return audit.reprojection_report(near, DEMO_SITE)


REPROJECTION_SQL = f"""WITH {RAW_SQL}, e AS (SELECT cam_id, sqrt(power((det_id % 10)/100.0E0, 2) + power((det_id % 7)/100.0E0, 2)) * 100
  AS e FROM raw_det) SELECT cam_id, count(*) AS n_points, round_even(avg(e), 4) AS mean_error_cm, round_even(max(e), 4) AS max_error_cm,
  CASE WHEN avg(e) < 5 THEN 'EXCELLENT' WHEN avg(e) < 10 THEN 'BON' WHEN avg(e) < 20 THEN 'MOYEN' ELSE 'MAUVAIS' END AS verdict
  FROM e GROUP BY cam_id"""


def reference_points(spark, sf):
    d = raw_detections(spark, sf).select(
        F.concat_ws("_", "cam_id", "event_type").alias("cam_id"), F.floor("x_m").cast("double").alias("x_m"),
        F.when(c("event_type") == "error", 0.0).otherwise(F.floor("y_m") % 2).cast("double").alias("y_m"))
    return audit.reference_point_checks(d)


def parsed_alert_log(spark, sf):
    """Alert lines written by the view's detections (some without zone, some noise) and read back."""
    zone = F.when(c("det_id") % 4 == 0, "").otherwise(" zone=zone_1")
    line = F.when(c("det_id") % 9 == 0, F.lit("[INFO] frame done")).otherwise(F.concat(
        F.lit("[ALERT] Alert["), F.format_string("%08d", "det_id"), F.lit("] forbidden_object"),
        F.when(c("det_id") % 5 == 0, "").otherwise(":weak"), zone, F.lit(" gid="), c("track_id").cast("string"),
        F.format_string(" pos=(%.2fm,%.2fm) cams=", "x_m", "y_m"), c("cam_id"), F.lit("+cam_09"),
        F.format_string(" conf=%.2f", "confidence")))
    lines = detections(spark, sf).select(c("det_id").alias("line_no"), line.alias("value"))
    return run_files.parse_alert_lines(lines).select(
        "line_no", "alert_id", "alert_level", "declared_zone", "global_id", "x_m", "y_m",
        F.concat_ws("+", "cameras").alias("cameras"), "confidence")


def label_rows(spark, sf):
    """Label text parsed back: short lines and unreadable classes are dropped."""
    d = raw_detections(spark, sf)
    text = F.when(c("det_id") % 11 == 0, "3 0.1 0.2").when(c("det_id") % 13 == 0, "x 0.1 0.2 0.3 0.4").otherwise(
        F.concat((c("det_id") % 9).cast("string"), F.lit("  0.5 0.25 0.125 0."), (c("det_id") % 7 + 1).cast("string")))
    return run_files.parse_label_lines(d.select("det_id", text.alias("value"))).groupBy("class_id").agg(
        F.count(F.lit(1)).alias("n"), F.bround(F.sum("h"), 6).alias("sum_h"))


def unknown_classes(spark, sf):
    return labels.unknown_classes(raw_detections(spark, sf).select(_label().alias("class_name")))


MAPPING = {0: 6, 2: 1, 5: 5}


def _label_text(spark, sf):
    """Label lines of five to seven fields, some with a class that cannot be read."""
    d = raw_detections(spark, sf)
    name = F.when(c("det_id") % 13 == 0, "x").otherwise((c("det_id") % 8).cast("string"))
    more = F.when(c("det_id") % 3 == 0, " 0.6 0.7").when(c("det_id") % 3 == 1, " 0.6").otherwise("")
    return run_files.label_line_parts(d.select("det_id", "cam_id", F.concat(name, F.lit("  0.5 0.25 0.125 0.5"), more).alias("value")))


def remapped_labels(spark, sf):
    return labels.remap_labels(_label_text(spark, sf), MAPPING, ["cam_id"])[1]


def remapped_lines(spark, sf):
    """The rewritten lines, whole."""
    return labels.remap_labels(_label_text(spark, sf), MAPPING, ["cam_id"])[0].select("det_id", "line")


def excluded_labels(spark, sf):
    d = raw_detections(spark, sf).select("cam_id", (c("det_id") % 7).alias("class_id"))
    kept, survivors = labels.exclude_classes(d, names.LABEL_VOCABULARY, {"verre", "scie"})
    return kept.groupBy("cam_id").agg(F.count(F.lit(1)).alias("kept"), F.lit(len(survivors)).cast("bigint").alias("classes"))


def label_reconcile(spark, sf):
    d = raw_detections(spark, sf).select(F.concat_ws("_", "cam_id", "frame").alias("stem"), "event_type")
    return labels.label_set_report(d.where("event_type = 'signup'"), d.where("event_type <> 'signup'"))


def image_sequence(spark, sf):
    return labels.image_sequence(detections(spark, sf).where(c("class_id") == 5))


def unique_stems(spark, sf):
    d = raw_detections(spark, sf)
    incoming = d.where("event_type <> 'error'").select(c("det_id").alias("file_ord"), F.concat_ws("_", "cam_id", "track_id").alias("stem"))
    existing = d.where("event_type = 'error'").select(F.concat("cam_id", F.lit("_"), c("track_id"), F.when(
        c("det_id") % 2 == 0, "").otherwise(F.concat(F.lit("__rf"), (c("det_id") % 4 + 1).cast("string")))).alias("stem"))
    return labels.unique_stems(incoming, existing)


STEMS_SQL = f"""WITH {RAW_SQL}, inc AS (SELECT det_id AS file_ord, cam_id || '_' || track_id AS stem, row_number() OVER (PARTITION BY
  cam_id, track_id ORDER BY det_id) AS k FROM raw_det WHERE event_type <> 'error'),
 ex AS (SELECT DISTINCT cam_id || '_' || track_id AS stem, CASE WHEN det_id % 2 = 0 THEN 0 ELSE det_id % 4 + 1 END AS n FROM raw_det
  WHERE event_type = 'error'),
 most AS (SELECT stem, max(k) + (SELECT count(*) FROM ex WHERE ex.stem = inc.stem) AS numbers FROM inc GROUP BY stem),
 free AS (SELECT stem, n, row_number() OVER (PARTITION BY stem ORDER BY n) AS k FROM (SELECT stem, unnest(range(0, numbers)) AS n
  FROM most) r WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.stem = r.stem AND ex.n = r.n))
 SELECT file_ord, inc.stem, CASE WHEN n = 0 THEN inc.stem ELSE inc.stem || '__rf' || n END AS final_stem
 FROM inc JOIN free ON free.stem = inc.stem AND free.k = inc.k"""


def detection_mix(spark, sf):
    return reports.detection_mix(detections(spark, sf))


def event_cameras(spark, sf):
    return reports.event_camera_summary(raw_detections(spark, sf), ["frame", "class_name"])


def deduplicated_alerts(spark, sf):
    d = raw_detections(spark, sf).select(
        F.when(c("det_id") % 6 == 0, "").otherwise((c("det_id") - c("det_id") % 3).cast("string")).alias("alert_id"), "event_type",
        "cam_id", "frame", "det_id", "value")
    return reports.dedupe_alerts(d, [c("event_type"), c("cam_id"), c("frame").cast("string")], ["det_id"])


def union_of_runs(spark, sf):
    """Runs with different headers under one ordered header, missing cells empty."""
    d = raw_detections(spark, sf)
    a = d.groupBy("model", "cam_id").agg(F.count(F.lit(1)).alias("detections"))
    b = d.groupBy("model").agg(F.count(F.lit(1)).alias("frames"), F.bround(F.max("value"), 3).alias("latency_max_ms"))
    return run_files.concat_runs([a, b])


def union_header(spark, sf):
    d = raw_detections(spark, sf)
    a = d.groupBy(c("model").alias("run_dir")).agg(F.count(F.lit(1)).alias("events"))
    b = d.groupBy(c("cam_id").alias("run_dir")).agg(F.bround(F.avg("value"), 6).alias("mean_value"))
    return sinks.union_header([a, b])


def transport_latency(spark, sf):
    """Delivery latencies by transport: unreadable values skipped, empty transports named after their run."""
    from sightgrid.operators.quantiles import latency_stats

    d = raw_detections(spark, sf).select(
        F.coalesce(F.when(c("det_id") % 4 != 0, c("event_type")), c("cam_id")).alias("transport"),
        F.when(c("det_id") % 10 == 0, "n/a").otherwise(c("value").cast("string")).try_cast("double").alias("latency_ms"))
    return latency_stats(d, ["transport"], c("latency_ms"), 6, p95="nearest")


def run_paths(spark, sf):
    """(format, camera, model) read off result paths."""
    path = F.concat(F.lit("/data/phase2/"), F.when(c("det_id") % 3 == 0, "trd").otherwise("tad"), F.lit("/V3_fp32_engine/"),
                    c("cam_id"), F.when(c("det_id") % 2 == 0, F.concat(F.lit("/"), c("model"))).otherwise(""), F.lit("/out.csv"))
    return raw_detections(spark, sf).select("det_id", *run_files.path_context(path, "tad"))


def ordered_truth(spark, sf):
    """Truth events in frame order (the order matters to readers, the check compares the rows)."""
    return raw_detections(spark, sf).where(c("value") >= 220.0).select("cam_id", "frame", "det_id").orderBy("frame", "det_id")


QUERIES = {
    "audited_alerts": (audited_alerts, f"""WITH {AUDIT_SQL} SELECT alert_key, inside_zones, expected_zone_ok, nearest_zone,
      distance_to_nearest_zone_m, worst_mean_error_cm, worst_max_error_cm FROM au"""),
    "audit_by_type": (audit_by_type, f"""WITH {AUDIT_SQL} SELECT alert_type, count(*) AS alerts,
      count(*) FILTER (WHERE NOT expected_zone_ok) AS outside_declared_zone FROM au GROUP BY alert_type"""),
    "audit_deduplicated": (audit_deduplicated, f"""WITH {AUDIT_SQL} SELECT alert_type, count(*) AS alerts,
      count(*) FILTER (WHERE NOT expected_zone_ok) AS outside_declared_zone FROM au WHERE alert_key IN
      (SELECT min(alert_key) FROM al GROUP BY alert_id) GROUP BY alert_type"""),
    "audit_by_camera": (audit_by_camera, f"""WITH {AUDIT_SQL} SELECT cam_id, count(*) AS alerts,
      count(*) FILTER (WHERE NOT inside_any_zone) AS outside_any_zone, any_value(mean_error_cm) AS mean_error_cm,
      any_value(max_error_cm) AS max_error_cm FROM ex JOIN au USING (alert_key) JOIN cams USING (cam_id) GROUP BY cam_id"""),
    "suspicious_alerts": (suspicious_alerts, f"""WITH {AUDIT_SQL} SELECT alert_key, declared_zone FROM au WHERE NOT expected_zone_ok
      ORDER BY alert_key LIMIT 10"""),
    "worst_calibration": (worst_calibration, f"""WITH {AUDIT_SQL} SELECT alert_key, worst_mean_error_cm, worst_max_error_cm FROM au"""),
    "reprojection_report": (reprojection_report, REPROJECTION_SQL),
    "reference_points": (reference_points, f"""WITH {RAW_SQL}, p AS (SELECT cam_id || '_' || event_type AS cam_id, floor(x_m) AS x,
      CASE WHEN event_type = 'error' THEN 0 ELSE CAST(floor(y_m) AS BIGINT) % 2 END AS y FROM raw_det)
      SELECT cam_id, count(*) AS n_points, count(DISTINCT (x, y)) AS distinct_points, count(DISTINCT (x, y)) >= 4 AND
      max(greatest(abs(x), abs(y))) > 1e-8 AS usable FROM p GROUP BY cam_id"""),
    "parsed_alert_log": (parsed_alert_log, f"""WITH {DET_SQL} SELECT det_id AS line_no, printf('%08d', det_id) AS alert_id,
      CASE WHEN det_id % 5 = 0 THEN 'confirmed' ELSE 'weak' END AS alert_level, CASE WHEN det_id % 4 = 0 THEN '' ELSE 'zone_1' END AS
      declared_zone, track_id AS global_id, round_even(x_m, 2) AS x_m, round_even(y_m, 2) AS y_m, cam_id || '+cam_09' AS cameras,
      confidence FROM det WHERE det_id % 9 <> 0"""),
    "label_rows": (label_rows, f"""WITH {RAW_SQL} SELECT det_id % 9 AS class_id, count(*) AS n,
      round_even(sum((det_id % 7 + 1) / 10.0E0), 6) AS sum_h FROM raw_det WHERE det_id % 11 <> 0 AND det_id % 13 <> 0 GROUP BY 1"""),
    "unknown_classes": (unknown_classes, f"""SELECT l AS class_fixed, count(*) AS n FROM (SELECT {LABELS_SQL} AS l FROM events) e
      WHERE l = 'inconnu' GROUP BY l"""),
    "remapped_labels": (remapped_labels, f"""WITH {RAW_SQL}, l AS (SELECT cam_id, CASE WHEN det_id % 13 <> 0 THEN det_id % 8 END AS k
      FROM raw_det) SELECT cam_id, count(*) AS seen, count(*) FILTER (WHERE k IN (0, 2, 5)) AS mapped,
      count(*) FILTER (WHERE k IS NULL OR k NOT IN (0, 2, 5)) AS removed FROM l GROUP BY cam_id"""),
    "remapped_lines": (remapped_lines, f"""WITH {RAW_SQL} SELECT det_id, CASE det_id % 8 WHEN 0 THEN '6' WHEN 2 THEN '1' ELSE '5' END ||
      ' 0.5 0.25 0.125 0.5' || CASE det_id % 3 WHEN 0 THEN ' 0.6 0.7' WHEN 1 THEN ' 0.6' ELSE '' END AS line
      FROM raw_det WHERE det_id % 13 <> 0 AND det_id % 8 IN (0, 2, 5)"""),
    "excluded_labels": (excluded_labels, f"""WITH {RAW_SQL} SELECT cam_id, count(*) AS kept, CAST(5 AS BIGINT) AS classes FROM raw_det
      WHERE det_id % 7 NOT IN (3, 6) GROUP BY cam_id"""),
    "label_reconcile": (label_reconcile, f"""WITH {RAW_SQL}, s AS (SELECT cam_id || '_' || frame AS stem, event_type FROM raw_det),
      l AS (SELECT DISTINCT stem FROM s WHERE event_type = 'signup'), i AS (SELECT DISTINCT stem FROM s WHERE event_type <> 'signup')
      SELECT stem, 'label_without_image' AS problem FROM l WHERE stem NOT IN (SELECT stem FROM i) UNION ALL
      SELECT stem, 'image_without_label' FROM i WHERE stem NOT IN (SELECT stem FROM l)"""),
    "image_sequence": (image_sequence, f"""WITH {DET_SQL} SELECT cam_id, frame, seq, printf('%s_obj_%04d', cam_id, seq) AS stem FROM (
      SELECT cam_id, frame, row_number() OVER (PARTITION BY cam_id ORDER BY frame) AS seq FROM (SELECT DISTINCT cam_id, frame FROM det
      WHERE class_id = 5) d) q"""),
    "unique_stems": (unique_stems, STEMS_SQL),
    "detection_mix": (detection_mix, f"""WITH {DET_SQL} SELECT coalesce(class_name, '*') AS class_name, coalesce(cam_id, '*') AS
      cam_id, count(*) AS n, round_even(avg(confidence), 6) AS avg_confidence FROM det GROUP BY GROUPING SETS ((class_name), (cam_id), ())"""),
    "event_cameras": (event_cameras, f"""WITH {RAW_SQL} SELECT frame, class_name, array_to_string(list_sort(list(DISTINCT cam_id)), '+')
      AS cameras, count(DISTINCT cam_id) AS n_cameras, count(*) AS n_annotations FROM raw_det GROUP BY frame, class_name"""),
    "deduplicated_alerts": (deduplicated_alerts, f"""WITH {RAW_SQL}, a AS (SELECT CASE WHEN det_id % 6 = 0 THEN '' ELSE
      CAST(det_id - det_id % 3 AS VARCHAR) END AS alert_id, event_type, cam_id, frame, det_id, value FROM raw_det),
      k AS (SELECT *, CASE WHEN alert_id = '' THEN event_type || '-' || cam_id || '-' || frame ELSE alert_id END AS alert_key FROM a)
      SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY alert_key ORDER BY det_id) = 1"""),
    "union_of_runs": (union_of_runs, f"""WITH {RAW_SQL} SELECT model, cam_id, count(*) AS detections, CAST(NULL AS BIGINT) AS frames,
      CAST(NULL AS DOUBLE) AS latency_max_ms FROM raw_det GROUP BY model, cam_id UNION ALL SELECT model, NULL, NULL, count(*),
      round_even(max(value), 3) FROM raw_det GROUP BY model"""),
    "union_header": (union_header, f"""WITH {RAW_SQL} SELECT model AS run_dir, count(*) AS events, CAST(NULL AS DOUBLE) AS mean_value
      FROM raw_det GROUP BY model UNION ALL SELECT cam_id, NULL, round_even(avg(value), 6) FROM raw_det GROUP BY cam_id"""),
    "transport_latency": (transport_latency, f"""WITH {RAW_SQL}, v AS (SELECT CASE WHEN det_id % 4 <> 0 THEN event_type ELSE cam_id END
      AS transport, value FROM raw_det WHERE det_id % 10 <> 0) SELECT transport, count(*) AS n, round_even(avg(value), 6) AS
      latency_mean_ms, round_even(quantile_cont(value, 0.5), 6) AS latency_median_ms, round_even(list_sort(list(value))[CAST(round_even(0.95E0 *
      (count(*) - 1), 0) AS BIGINT) + 1], 6) AS latency_p95_ms, round_even(max(value), 6) AS latency_max_ms FROM v GROUP BY transport"""),
    "run_paths": (run_paths, f"""WITH {RAW_SQL} SELECT det_id, CASE WHEN det_id % 3 = 0 THEN '' ELSE 'fp32_engine' END AS format,
      CASE WHEN det_id % 3 = 0 THEN '' ELSE cam_id END AS camera, CASE WHEN det_id % 3 <> 0 AND det_id % 2 = 0 THEN model ELSE '' END
      AS model_hint FROM raw_det"""),
    "ordered_truth": (ordered_truth, f"""WITH {RAW_SQL} SELECT cam_id, frame, det_id FROM raw_det WHERE value >= 220"""),
}
