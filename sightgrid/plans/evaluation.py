"""Registered queries: matching alerts with truth events, windows, association truth, scores.

Events with an outstanding value stand for the annotated ones, all others for alerts; the tolerance is wide because the
view has minutes between events.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sightgrid.functions import names
from sightgrid.operators import fusion, matching, reports
from sightgrid.operators.quantiles import exact_percentiles
from sightgrid.plans.fusion import GID_SQL, numbered
from sightgrid.sources.tables import (
    CROSS_SQL, DEMO_SITE, DET_SQL, ON_EDGE_SQL, RAW_SQL, ZONE_SQL, detections, raw_detections)

c = F.col
TOL = 900.0
ANNOTATED = 220.0
KEYS = ["run_id", "cam_id"]


def _truth(spark, sf):
    """Appearance frame: the event's second, at one frame per second from the epoch."""
    return raw_detections(spark, sf).where(c("value") >= ANNOTATED).select(
        "run_id", "cam_id", "class_name", c("det_id").alias("truth_ord"), c("ts_s").alias("truth_t"), "frame",
        c("frame").alias("appear_frame"))


def _alerts(spark, sf):
    return raw_detections(spark, sf).where(c("value") < ANNOTATED).select(
        "run_id", "cam_id", c("det_id").alias("alert_ord"), c("ts_s").alias("alert_t"), "ts_s", "class_name", "confidence",
        "det_ord", "frame")


TRUTH_SQL = RAW_SQL + """, t AS (SELECT *, row_number() OVER (PARTITION BY cam_id ORDER BY det_id) AS i FROM raw_det
 WHERE value >= 220), a AS (SELECT * FROM raw_det WHERE value < 220)"""


def _walk(choice: str, tables: str = TRUTH_SQL, tol: float = TOL) -> str:
    """Recursive walk over the truth events of each camera in order; ``choice`` picks among the free alerts in reach.

    ``tables`` defines the truth events ``t`` and the alerts ``a``.
    """
    return f"""{tables}, walk(cam_id, i, used, pick) AS (
 SELECT DISTINCT cam_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT) FROM t
 UNION ALL SELECT cam_id, i, CASE WHEN p IS NULL THEN used ELSE list_append(used, p) END, p FROM (
  SELECT w.cam_id, w.i + 1 AS i, any_value(w.used) AS used, {choice} AS p FROM walk w
  JOIN t ON t.cam_id = w.cam_id AND t.i = w.i + 1
  LEFT JOIN a ON a.cam_id = w.cam_id AND abs(a.ts_s - t.ts_s) <= {tol} AND NOT list_contains(w.used, a.det_id)
  GROUP BY w.cam_id, w.i) s),
 matches AS (SELECT t.cam_id, t.det_id AS truth_ord, t.ts_s AS truth_t, a.det_id AS alert_ord, a.ts_s AS alert_t,
  a.ts_s - t.ts_s AS delay FROM t JOIN walk w ON w.cam_id = t.cam_id AND w.i = t.i LEFT JOIN a ON a.det_id = w.pick)"""


NEAREST = "arg_min(a.det_id, (abs(a.ts_s - t.ts_s), a.det_id))"
CLOSEST_SQL = f"""{TRUTH_SQL}, c AS (SELECT t.cam_id, t.det_id AS tid, a.det_id AS aid, abs(a.ts_s - t.ts_s) AS g FROM t
  JOIN a ON a.cam_id = t.cam_id AND abs(a.ts_s - t.ts_s) <= {TOL}),
 walk(cam_id, ut, ua, pt, pa) AS (SELECT DISTINCT cam_id, CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT),
   CAST(NULL AS BIGINT) FROM t
  UNION ALL SELECT cam_id, list_append(ut, p.tid), list_append(ua, p.aid), p.tid, p.aid FROM (
   SELECT w.cam_id, any_value(w.ut) AS ut, any_value(w.ua) AS ua,
    arg_min(struct_pack(tid := c.tid, aid := c.aid), (c.g, c.tid, c.aid)) AS p
   FROM walk w JOIN c ON c.cam_id = w.cam_id AND NOT list_contains(w.ut, c.tid) AND NOT list_contains(w.ua, c.aid)
   GROUP BY w.cam_id, len(w.ut)) s)"""
COLUMNS = ["cam_id", "truth_ord", "alert_ord", "delay"]


def _match(rule):
    def run(spark, sf):
        m = matching.match_events(_truth(spark, sf), _alerts(spark, sf), KEYS, rule, TOL)
        return m.select("cam_id", "truth_ord", "alert_ord", F.bround("delay", 3).alias("delay"))
    return run


def event_scores(spark, sf):
    return matching.score_events(_truth(spark, sf), _alerts(spark, sf), KEYS, tolerance=TOL).drop("run_id")


SCORE_TAIL = """SELECT cam_id, n_gt_events, tp, fp, n_gt_events - tp AS fn, round_even(tp/CAST(tp+fp AS DOUBLE), 4) AS "precision",
 round_even(tp/CAST(n_gt_events AS DOUBLE), 4) AS recall,
 round_even(2.0E0*tp/CAST(tp+fp+n_gt_events AS DOUBLE), 4) AS f1, delay_median, delay_p95, delay_mean, delay_min, delay_max FROM (
 SELECT cam_id, count(*) AS n_gt_events, count(alert_ord) AS tp, any_value(fp) AS fp,
 round_even(quantile_cont(delay, 0.5), 3) AS delay_median, round_even(quantile_cont(delay, 0.95), 3) AS delay_p95,
 round_even(avg(delay), 3) AS delay_mean, round_even(min(delay), 3) AS delay_min, round_even(max(delay), 3) AS delay_max
 FROM matches JOIN fps USING (cam_id) GROUP BY cam_id) s"""


def merged_event_scores(spark, sf):
    """Scores with false positives merged into sessions (gap 30 min, the view's time scale)."""
    return matching.score_events(_truth(spark, sf), _alerts(spark, sf), KEYS, merge_gap=1800.0, tolerance=TOL).drop("run_id")


def intrusion_scores(spark, sf):
    """Zone alerts scored per camera through the cameras that voted."""
    from sightgrid.operators import alerts as A

    hits = A.zone_hits(detections(spark, sf).where("class_name = 'personne'"), DEMO_SITE)
    found = hits.groupBy("run_id", "frame", "zone_id", "track_id").agg(
        F.min("ts_s").alias("ts_s"), F.array_sort(F.collect_set("cam_id")).alias("cameras")).withColumn(
        "alert_type", F.lit("zone_violation_person"))
    return matching.intrusion_score_by_camera(_truth(spark, sf), found, [x.cam_id for x in DEMO_SITE.cameras]).drop("run_id")


def object_scores(spark, sf):
    return matching.object_score_by_camera(_truth(spark, sf), detections(spark, sf), [11]).drop("run_id")


def first_detections(spark, sf):
    """First same-class detection at or after each truth event's frame, per camera."""
    t = _truth(spark, sf).withColumn("class_norm", names.normalize_class(c("class_name")))
    d = detections(spark, sf).withColumn("class_norm", names.normalize_class(c("class_name")))
    found = matching.first_detection_after(t, d, ["run_id", "cam_id", "class_norm"])
    return found.select("truth_ord", "appear_frame", "alert_frame", (c("alert_frame") - c("appear_frame")).alias("delay_frames"),
                        F.bround((c("alert_frame") - c("appear_frame")) / 25.0, 3).alias("delay_s"))


def outside_intrusions(spark, sf):
    t = matching.intrusion_windows(_truth(spark, sf).withColumn(
        "exit_s", F.when(c("truth_ord") % 2 == 0, c("truth_t") + 1200.0)).withColumn("appear_frame", c("truth_t")), 1.0, 600.0)
    return matching.outside_windows(_alerts(spark, sf), t, KEYS).select("cam_id", "alert_ord")


def outside_appearances(spark, sf):
    keys = ["run_id", "cam_id", "class_name"]
    t = matching.appearance_windows(_truth(spark, sf).withColumn("appear_frame", c("truth_t")), 1.0, TOL)
    return matching.outside_windows(_alerts(spark, sf), t, keys).select("cam_id", "alert_ord")


def false_positive_sessions(spark, sf):
    return matching.cluster_alerts(_alerts(spark, sf), KEYS, "ts_s", 600.0).drop("run_id")


def nearest_annotations(spark, sf):
    q = detections(spark, sf).select("run_id", "cam_id", "frame", "det_id")
    found = matching.nearest_annotation(q, _truth(spark, sf), KEYS)
    return found.select("det_id", "truth_ord", "gap")


def _links(spark, sf):
    links = fusion.fusion_links(numbered(spark, sf))
    return links.select("frame", names.canonical_pair(c("cam_a"), c("track_a"), c("cam_b"), c("track_b")).alias("pair"),
                        F.format_string("%010d %04d %s %s %04d %04d", "frame", "global_id", "cam_a", "cam_b", "track_a", "track_b")
                        .alias("pred_ord"))


def _truth_links(spark, sf):
    other = F.when(c("cam_id") == "cam_07", "cam_02").otherwise("cam_07")
    return detections(spark, sf).select(
        c("det_id").alias("truth_ord"), "frame",
        names.canonical_pair(c("cam_id"), c("track_id"), other, c("track_id")).alias("pair"),
        (c("det_id") % 2 == 0).alias("expected_same"))


def truth_link_join(spark, sf):
    j = matching.truth_link_join(_truth_links(spark, sf), _links(spark, sf), 3)
    return j.select("truth_ord", "frame", "expected_same", "predicted_same", "matched_frame", "result")


def association_quality(spark, sf):
    links = _links(spark, sf)
    return matching.association_quality(matching.truth_link_join(_truth_links(spark, sf), links, 3), links)


LINK_SQL = f"""{GID_SQL}, links AS (SELECT a.frame, a.cam_id || '|' || a.track_id || '|' || b.cam_id || '|' || b.track_id AS pair,
  printf('%010d %04d %s %s %04d %04d', a.frame, a.global_id, a.cam_id, b.cam_id, a.track_id, b.track_id) AS po
  FROM gdet a JOIN gdet b ON a.frame = b.frame AND a.global_id = b.global_id AND a.cam_id < b.cam_id),
 tl AS (SELECT det_id AS truth_ord, frame, CASE WHEN cam_id = 'cam_07' THEN 'cam_02|' || track_id || '|cam_07|' || track_id
  ELSE cam_id || '|' || track_id || '|cam_07|' || track_id END AS pair, det_id % 2 = 0 AS expected_same FROM det),
 judged AS (SELECT truth_ord, any_value(tl.frame) AS frame, any_value(expected_same) AS expected_same, count(po) > 0 AS predicted_same,
  arg_min(links.frame, po) AS matched_frame, min(po) AS matched_ord FROM tl LEFT JOIN links ON links.pair = tl.pair
  AND abs(links.frame - tl.frame) <= 3 GROUP BY truth_ord),
 res AS (SELECT *, CASE WHEN expected_same AND predicted_same THEN 'tp' WHEN predicted_same THEN 'fp' WHEN expected_same THEN 'fn'
  ELSE 'tn' END AS result FROM judged)"""


def missing_inputs(spark, sf):
    """Expected cameras and classes without any truth event."""
    return reports.missing_inputs(_truth(spark, sf), ["cam_01", "cam_02", "cam_03", "cam_05", "cam_07", "cam_09"], "cam_id")


def mapped_truth(spark, sf):
    """Truth events carry session-stamped camera ids; the id map brings them to the pipeline's cameras."""
    stamped = _truth(spark, sf).withColumn("gt_camera", F.concat("cam_id", F.lit("_20260506_131002"))).drop("cam_id")
    bridge = {f"{x.cam_id}_20260506_131002": x.cam_id for x in DEMO_SITE.cameras}
    return reports.map_truth_cameras(stamped, bridge).groupBy("cam_id", "gt_camera").agg(F.count(F.lit(1)).alias("n"))


def grouped_truth_events(spark, sf):
    """Annotations of one event over the cameras of a room, 15 min apart at most (the view's time scale)."""
    ann = raw_detections(spark, sf).select(
        "cam_id", "class_name", c("det_id").alias("ann_ord"), (c("ts_s") * 1000.0).alias("t_ms"))
    return reports.group_truth_events(ann, {"cam_03": 1, "cam_05": 1, "cam_07": 1, "cam_02": 2}, 900_000.0).select(
        "room", "class_name", "ann_ord", "event_id")


def _model_scores(spark, sf):
    d = raw_detections(spark, sf)
    pct = exact_percentiles(d, ["model"], c("value"), {"delay_median": (0.5, "linear")})
    return pct.withColumn("fps", F.bround(1000.0 / c("mean"), 6))


def best_model(spark, sf):
    return reports.best_model(_model_scores(spark, sf))


def _camera_scores(spark, sf):
    """Per model and camera: detections above 0.8 as hits, below 0.6 as false alarms, the rest as misses."""
    d = raw_detections(spark, sf)
    counts = d.groupBy("model", "cam_id").agg(
        F.count(F.when(c("confidence") >= 0.8, 1)).alias("tp"), F.count(F.when(c("confidence") < 0.6, 1)).alias("fp"),
        F.count(F.when((c("confidence") >= 0.6) & (c("confidence") < 0.8), 1)).alias("fn"),
        ((F.max("ts_s") - F.min("ts_s")) / 3600.0).alias("hours"))
    return matching.event_metrics(counts, c("hours"))


def event_metrics(spark, sf):
    return _camera_scores(spark, sf).drop("hours")


def model_leaderboard(spark, sf):
    return reports.leaderboard(_camera_scores(spark, sf))


SCORES_SQL = f"""{RAW_SQL}, sc AS (SELECT model, cam_id, count(*) FILTER (WHERE confidence >= 0.8) AS tp,
  count(*) FILTER (WHERE confidence < 0.6) AS fp, count(*) FILTER (WHERE confidence >= 0.6 AND confidence < 0.8) AS fn,
  (max(ts_s) - min(ts_s)) / 3600.0E0 AS hours FROM raw_det GROUP BY model, cam_id),
 ms AS (SELECT model, cam_id, tp, fp, fn, round_even(tp/CAST(tp+fp AS DOUBLE), 4) AS "precision", round_even(tp/CAST(tp+fn AS DOUBLE), 4)
  AS recall, round_even(2.0E0*tp/CAST(2*tp+fp+fn AS DOUBLE), 4) AS f1, round_even(fp/hours, 2) AS far_per_hour FROM sc)"""


def phase_comparison(spark, sf):
    phase2 = _camera_scores(spark, sf).select(F.lit("phase2").alias("phase"), "cam_id", "precision", "recall", "f1", "far_per_hour",
                                              F.when(c("cam_id") < "cam_04", "tad").otherwise("trd").alias("task"))
    phase3 = _camera_scores(spark, sf).select(F.lit("phase3").alias("phase"), "cam_id", "precision", "recall", "f1",
                                              F.lit("trd").alias("task"), c("fp").alias("n_faux_positifs"))
    return reports.phase_means(reports.phase_comparison([phase2, phase3]))


_T_SQL = "t AS (SELECT *, row_number() OVER (PARTITION BY cam_id ORDER BY det_id) AS i FROM raw_det WHERE value >= 220)"
INTRUSION_TABLES = f"""{DET_SQL}, {ZONE_SQL}, {_T_SQL}, hits AS (SELECT det_id, zone_id FROM det, zone_edges WHERE class_name = 'personne'
  GROUP BY det_id, zone_id HAVING bool_or({ON_EDGE_SQL}) OR count(*) FILTER (WHERE {CROSS_SQL}) % 2 = 1),
 a AS (SELECT row_number() OVER (ORDER BY cam_id, ts_s) AS det_id, cam_id, ts_s FROM (SELECT min(ts_s) AS ts_s,
  unnest(list(DISTINCT cam_id)) AS cam_id FROM det JOIN hits USING (det_id) GROUP BY frame, zone_id, track_id) q)"""
OBJECT_TABLES = f"""{DET_SQL}, {_T_SQL}, a AS (SELECT row_number() OVER (ORDER BY cam_id, ts_s) AS det_id, cam_id, ts_s FROM (
  SELECT DISTINCT cam_id, ts_s FROM det WHERE class_id <> 11 AND (cam_id, class_name) IN (SELECT (cam_id, class_name) FROM t)) q)"""
GROUPS_SQL = f"""{RAW_SQL}, x AS (SELECT CASE WHEN cam_id = 'cam_02' THEN 2 ELSE 1 END AS room, class_name, det_id, cam_id,
  ts_s * 1000.0E0 AS t FROM raw_det),
 n AS (SELECT *, row_number() OVER (PARTITION BY room, class_name ORDER BY t, det_id) AS i FROM x),
 walk AS (SELECT DISTINCT room, class_name, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(t DOUBLE, head BIGINT, cams VARCHAR[])[]) AS open,
   CAST(NULL AS BIGINT) AS head FROM x
  UNION ALL SELECT room, class_name, i, CASE WHEN home IS NULL THEN list_append(live, struct_pack(t := t, head := det_id, cams := [cam_id]))
    ELSE list_transform(live, lambda g: CASE WHEN g.head = home THEN struct_pack(t := g.t, head := g.head, cams :=
     list_append(g.cams, cam_id)) ELSE g END) END, coalesce(home, det_id) FROM (
   SELECT *, list_filter(live, lambda g: NOT list_contains(g.cams, cam_id))[1].head AS home FROM (
    SELECT n.*, list_filter(w.open, lambda g: n.t - g.t <= 900000) AS live FROM walk w JOIN n ON n.room = w.room
     AND n.class_name = w.class_name AND n.i = w.i + 1) a) b),
 placed AS (SELECT n.room, n.class_name, n.det_id, w.head FROM n JOIN walk w ON w.room = n.room AND w.class_name = n.class_name AND w.i = n.i),
 heads AS (SELECT room, det_id AS head, row_number() OVER (PARTITION BY room ORDER BY t, det_id) AS event_id FROM n
  WHERE det_id IN (SELECT head FROM placed))"""
_LEFT = "FROM a WHERE det_id NOT IN (SELECT alert_ord FROM matches WHERE alert_ord IS NOT NULL)"

QUERIES = {
    "match_truth_order": (_match("truth_order"), f"""WITH RECURSIVE {_walk(NEAREST)} SELECT cam_id, truth_ord, alert_ord,
      round_even(delay, 3) AS delay FROM matches"""),
    "match_first_free": (_match("first_free"), f"""WITH RECURSIVE {_walk('min(a.det_id)')} SELECT cam_id, truth_ord, alert_ord,
      round_even(delay, 3) AS delay FROM matches"""),
    "match_by_distance": (_match("distance_order"), f"""WITH RECURSIVE {CLOSEST_SQL} SELECT t.cam_id, t.det_id AS truth_ord,
      a.det_id AS alert_ord, round_even(a.ts_s - t.ts_s, 3) AS delay FROM t LEFT JOIN walk w ON w.pt = t.det_id LEFT JOIN a ON
      a.det_id = w.pa"""),
    "event_scores": (event_scores, f"""WITH RECURSIVE {_walk(NEAREST)}, fps AS (SELECT cam_id, count(*) AS fp FROM a WHERE
      det_id NOT IN (SELECT alert_ord FROM matches WHERE alert_ord IS NOT NULL) GROUP BY cam_id) {SCORE_TAIL}"""),
    "merged_event_scores": (merged_event_scores, f"""WITH RECURSIVE {_walk(NEAREST)}, left_over AS (SELECT cam_id, ts_s,
      lag(ts_s) OVER (PARTITION BY cam_id ORDER BY ts_s) AS p FROM a WHERE det_id NOT IN (SELECT alert_ord FROM matches WHERE
      alert_ord IS NOT NULL)), fps AS (SELECT cam_id, count(*) FILTER (WHERE p IS NULL OR ts_s - p > 1800) AS fp FROM left_over
      GROUP BY cam_id) {SCORE_TAIL}"""),
    "intrusion_scores": (intrusion_scores, f"""WITH RECURSIVE {_walk(NEAREST, INTRUSION_TABLES, matching.TOLERANCE_S)},
      fps AS (SELECT cam_id, count(*) AS fp {_LEFT} GROUP BY cam_id) {SCORE_TAIL}"""),
    "object_scores": (object_scores, f"""WITH RECURSIVE {_walk(NEAREST, OBJECT_TABLES, matching.TOLERANCE_S)},
      left_over AS (SELECT cam_id, ts_s, lag(ts_s) OVER (PARTITION BY cam_id ORDER BY ts_s) AS p {_LEFT}),
      fps AS (SELECT cam_id, count(*) FILTER (WHERE p IS NULL OR ts_s - p > {matching.MERGE_GAP_S}) AS fp FROM left_over GROUP BY cam_id)
      {SCORE_TAIL}"""),
    "first_detections": (first_detections, f"""WITH {DET_SQL}, t AS (SELECT * FROM raw_det WHERE value >= 220)
      SELECT truth_ord, appear_frame, alert_frame, alert_frame - appear_frame AS delay_frames,
      round_even((alert_frame - appear_frame) / 25.0E0, 3) AS delay_s FROM (SELECT t.det_id AS truth_ord, any_value(t.frame) AS
      appear_frame, min(d.frame) AS alert_frame FROM t LEFT JOIN det d ON d.cam_id = t.cam_id AND d.class_name = t.class_name
      AND d.frame >= t.frame GROUP BY t.det_id) q"""),
    "outside_intrusions": (outside_intrusions, f"""WITH {TRUTH_SQL} SELECT cam_id, det_id AS alert_ord FROM a WHERE NOT EXISTS (
      SELECT 1 FROM t WHERE t.cam_id = a.cam_id AND a.ts_s >= t.ts_s AND a.ts_s <= t.ts_s +
      CASE WHEN t.det_id % 2 = 0 THEN 1200.0E0 ELSE 600.0E0 END)"""),
    "outside_appearances": (outside_appearances, f"""WITH {TRUTH_SQL} SELECT cam_id, det_id AS alert_ord FROM a WHERE NOT EXISTS (
      SELECT 1 FROM t WHERE t.cam_id = a.cam_id AND t.class_name = a.class_name AND abs(a.ts_s - t.ts_s) <= {TOL})"""),
    "false_positive_sessions": (false_positive_sessions, f"""WITH {TRUTH_SQL}, l AS (SELECT *, lag(ts_s) OVER (PARTITION BY
      cam_id ORDER BY ts_s) AS p FROM a), s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts_s - p > 600 THEN 1 ELSE 0 END) OVER
      (PARTITION BY cam_id ORDER BY ts_s) AS g FROM l) SELECT cam_id, round_even(min(ts_s), 3) AS start_time, round_even(max(ts_s), 3) AS
      end_time, round_even(max(ts_s) - min(ts_s), 3) AS duration_s, count(*) AS n_detections, arg_min(class_name, (ts_s, det_ord)) AS
      class_name, round_even(avg(confidence), 4) AS avg_confidence FROM s GROUP BY cam_id, g"""),
    "nearest_annotations": (nearest_annotations, f"""WITH {DET_SQL}, t AS (SELECT cam_id, frame, det_id FROM raw_det WHERE
      value >= 220) SELECT d.det_id, arg_min(t.det_id, (abs(t.frame - d.frame), t.det_id)) AS truth_ord,
      min(abs(t.frame - d.frame)) AS gap FROM det d LEFT JOIN t ON t.cam_id = d.cam_id GROUP BY d.det_id"""),
    "truth_link_join": (truth_link_join, f"""WITH {LINK_SQL} SELECT truth_ord, frame, expected_same, predicted_same,
      matched_frame, result FROM res"""),
    "association_quality": (association_quality, f"""WITH {LINK_SQL}, s AS (SELECT count(*) AS truth_rows,
      count(DISTINCT matched_ord) AS evaluated_predictions, count(*) FILTER (WHERE result = 'tp') AS tp,
      count(*) FILTER (WHERE result = 'fp') AS fp, count(*) FILTER (WHERE result = 'fn') AS fn,
      count(*) FILTER (WHERE result = 'tn') AS tn, (SELECT count(*) FROM links) AS predicted_links FROM res)
      SELECT *, round_even(tp/CAST(tp+fp AS DOUBLE), 4) AS "precision", round_even(tp/CAST(tp+fn AS DOUBLE), 4) AS recall,
      round_even(2.0E0*tp/CAST(2*tp+fp+fn AS DOUBLE), 4) AS f1, predicted_links - evaluated_predictions AS ignored_predictions,
      round_even((tp+tn)/CAST(truth_rows AS DOUBLE), 4) AS accuracy FROM s"""),
    "missing_inputs": (missing_inputs, f"""WITH {TRUTH_SQL} SELECT cam_id FROM (VALUES ('cam_01'),('cam_02'),('cam_03'),('cam_05'),
      ('cam_07'),('cam_09')) v(cam_id) WHERE cam_id NOT IN (SELECT cam_id FROM t)"""),
    "mapped_truth": (mapped_truth, f"""WITH {TRUTH_SQL} SELECT cam_id, cam_id || '_20260506_131002' AS gt_camera, count(*) AS n
      FROM t GROUP BY 1, 2"""),
    "grouped_truth_events": (grouped_truth_events, f"""WITH RECURSIVE {GROUPS_SQL} SELECT CAST(room AS BIGINT) AS room, class_name,
      det_id AS ann_ord, event_id FROM placed JOIN heads USING (room, head)"""),
    "best_model": (best_model, f"""WITH {RAW_SQL}, m AS (SELECT model, quantile_cont(value, 0.5) AS d,
      round_even(1000.0E0 / avg(value), 6) AS fps FROM raw_det GROUP BY model) SELECT arg_min(model, (d, model)) AS best_delay_model,
      min(d) AS best_delay, arg_min(model, (-fps, model)) AS fastest_model, max(fps) AS fastest_fps FROM m"""),
    "event_metrics": (event_metrics, f"WITH {SCORES_SQL} SELECT * FROM ms"),
    "model_leaderboard": (model_leaderboard, f"""WITH {SCORES_SQL}, m AS (SELECT model, round_even(avg(f1), 6) AS mean_f1 FROM ms
      GROUP BY model) SELECT model, mean_f1, rank() OVER (ORDER BY mean_f1 DESC) AS rank FROM m"""),
    "phase_comparison": (phase_comparison, f"""WITH {SCORES_SQL}, u AS (SELECT 'phase2' AS phase, CASE WHEN cam_id < 'cam_04' THEN
      'tad' ELSE 'trd' END AS task, "precision" AS p, recall AS r, f1 AS f, far_per_hour AS h, CAST(NULL AS BIGINT) AS n FROM ms
      UNION ALL SELECT 'phase3', 'trd', "precision", recall, f1, NULL, fp FROM ms) SELECT phase, task, round_even(avg(p), 6) AS
      "precision", round_even(avg(r), 6) AS recall, round_even(avg(f), 6) AS f1, round_even(avg(n), 6) AS n_faux_positifs,
      round_even(avg(h), 6) AS far_per_hour FROM u GROUP BY phase, task"""),
}
