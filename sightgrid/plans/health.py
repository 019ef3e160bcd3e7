"""Registered queries: latencies, synchronisation, run health, pacing, overlays, envelopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightgrid.operators import alerts as A
from sightgrid.operators import envelopes as E
from sightgrid.operators import fusion, health, identity
from sightgrid.operators.ordered import frame_ordinals
from sightgrid.operators.quantiles import exact_percentiles, latency_stats
from sightgrid.plans.alerting import ALERTS_SQL, RULES
from sightgrid.plans.fusion import GID_SQL, numbered
from sightgrid.session import cut_lineage
from sightgrid.sources.tables import (
    CROSS_SQL, DEMO_SITE, DET_SQL, ON_EDGE_SQL, RAW_SQL, ZONE_SQL, detections, raw_detections)

c = F.col
FRAME0 = 473352  # frame number of the view's first hour


def latency_by_stage(spark, sf):
    return latency_stats(raw_detections(spark, sf), ["event_type"], c("value"), 6)


def latency_nearest_rank(spark, sf):
    return latency_stats(raw_detections(spark, sf), ["event_type", "cam_id"], c("value"), 6, p95="nearest")


def latency_overall(spark, sf):
    return latency_stats(raw_detections(spark, sf), [], c("value"), 6)


def inference_rate(spark, sf):
    return health.inference_rate(raw_detections(spark, sf), ["model"], c("value") / 1000.0)


def _trace(spark, sf):
    """Latency trace of the view: one row per (frame, camera)."""
    d = detections(spark, sf)
    per = d.groupBy("run_id", "frame", "cam_id").agg(
        F.max(c("value") * 1.0371).alias("capture_read_ms"), F.max("ts_s").alias("capture_read_end_epoch"),
        F.max("det_id").alias("k"))
    return per.withColumns({
        "capture_success": c("k") % 17 != 0, "inference_tracking_ms": (c("k") * 7 % 400) / 10.0,
        "fusion_ms": (c("k") % 13) / 100.0, "alerts_ms": (c("k") % 11) / 100.0, "metadata_ms": (c("k") % 7) / 100.0,
        "metadata_start_epoch": (c("frame") + 1) * 3600.0 + (c("frame") % 50) / 100.0})


TRACE_SQL = DET_SQL + """, trace AS (SELECT *, k % 17 <> 0 AS ok, (k * 7 % 400) / 10.0E0 AS inference_tracking_ms,
 (k % 13) / 100.0E0 AS fusion_ms, (k % 11) / 100.0E0 AS alerts_ms, (k % 7) / 100.0E0 AS metadata_ms,
 (frame + 1) * 3600.0E0 + (frame % 50) / 100.0E0 AS metadata_start_epoch FROM (SELECT frame, cam_id, max(value * 1.0371E0) AS capture_read_ms,
 max(ts_s) AS e, max(det_id) AS k FROM det GROUP BY frame, cam_id) q)"""


def frame_timing(spark, sf):
    return health.frame_timing(_trace(spark, sf)).drop("run_id")


def stage_latency(spark, sf):
    return health.stage_latency(_trace(spark, sf), ["cam_id"])


def _link_rows(spark, sf):
    return fusion.fusion_links(numbered(spark, sf).withColumn("run_id", c("model")))


def _link_stats(spark, sf):
    return health.fusion_link_stats(_link_rows(spark, sf), F.struct("frame", "global_id", "cam_a", "cam_b"))


def fusion_link_stats(spark, sf):
    return _link_stats(spark, sf)


def _sync(spark, sf):
    """Frame receipts: one row per (model run, frame, camera); camera cam_07 of model_2 misses every ninth frame."""
    d = detections(spark, sf).where(~((c("cam_id") == "cam_07") & (c("model") == "model_2") & (c("frame") % 9 == 0)))
    return d.select(c("model").alias("run_id"), (c("frame") - FRAME0).alias("campaign_frame"), "cam_id").distinct().withColumn(
        "elapsed_s", c("campaign_frame") / 25.0)


SYNC_SQL = DET_SQL + f""", sync AS (SELECT DISTINCT model AS run_id, frame - {FRAME0} AS f, cam_id, (frame - {FRAME0}) / 25.0E0 AS e
 FROM det WHERE NOT (cam_id = 'cam_07' AND model = 'model_2' AND frame % 9 = 0)),
 runs AS (SELECT run_id, max(f) + 1 AS total, max(e) AS run_last FROM sync GROUP BY run_id),
 cs AS (SELECT run_id, cam_id, count(*) AS frames, min(e) AS first_elapsed_s, max(e) AS last_elapsed_s,
  any_value(total) - count(DISTINCT f) AS missing_campaign_frames,
  CASE WHEN max(e) > min(e) THEN count(*) / (max(e) - min(e)) ELSE 0 END AS fps,
  max(e) < any_value(run_last) - 1.0 OR any_value(total) - count(DISTINCT f) > 0 AS dropped_early
  FROM sync JOIN runs USING (run_id) GROUP BY run_id, cam_id)"""


def camera_sync(spark, sf):
    return health.camera_sync_stats(_sync(spark, sf)).withColumn("effective_fps", F.bround("effective_fps", 6))


EXPECTED = ["cam_02", "cam_03", "cam_05", "cam_07", "cam_08"]


def expected_cameras(spark, sf):
    return health.camera_sync_stats(_sync(spark, sf), EXPECTED).select("run_id", "cam_id", "frames", "missing_campaign_frames",
                                                                       "dropped_early")


def _summary(spark, sf):
    d = cut_lineage(numbered(spark, sf).withColumn("run_id", c("model")))
    found = A.alerts(d, DEMO_SITE, RULES, frame_ordinals(d, ["run_id"]))
    return health.run_summary(d, d, found, fusion.fusion_links(d), identity.track_stability(d),
                              d.select("run_id", c("value").alias("latency_ms")))


def run_summary(spark, sf):
    return _summary(spark, sf)


RUN_ALERTS_SQL = f""", {ZONE_SQL}, spine AS (SELECT model, frame, row_number() OVER (PARTITION BY model ORDER BY frame) - 1 AS ord
  FROM (SELECT DISTINCT model, frame FROM det) f),
 hits AS (SELECT det_id, zone_id FROM det, zone_edges GROUP BY det_id, zone_id
  HAVING bool_or({ON_EDGE_SQL}) OR count(*) FILTER (WHERE {CROSS_SQL}) % 2 = 1),
 presence AS (SELECT model, frame, global_id, zone_id, count(DISTINCT zc.cam_id) AS votes FROM gdet JOIN hits USING (det_id)
  LEFT JOIN zone_cams zc USING (zone_id, cam_id) WHERE class_id = 11 GROUP BY model, frame, global_id, zone_id),
 entered AS (SELECT model, ord, lag(ord) OVER (PARTITION BY model, global_id, zone_id ORDER BY ord) AS before
  FROM presence p JOIN spine USING (model, frame) WHERE votes >= (SELECT greatest(1, CAST(ceil(count(*)*0.3E0) AS BIGINT))
  FROM zone_cams z WHERE z.zone_id = p.zone_id)),
 objects AS (SELECT model, frame, global_id, lower(trim(class_name)) AS object_key, count(DISTINCT cam_id) >= 2 AS sure
  FROM gdet WHERE class_id <> 11 GROUP BY model, frame, global_id, lower(trim(class_name))),
 levels AS (SELECT model, ord, sure, lag(ord) OVER w AS p_ord, lag(sure) OVER w AS p_sure FROM objects JOIN spine USING (model, frame)
  WINDOW w AS (PARTITION BY model, global_id, object_key ORDER BY ord)),
 al AS (SELECT model FROM entered WHERE before IS NULL OR before <> ord - 1 UNION ALL
  SELECT model FROM levels WHERE p_ord IS NULL OR p_ord <> ord - 1 OR (p_sure <> sure AND NOT p_sure))"""
SUMMARY_SQL = GID_SQL + RUN_ALERTS_SQL + """, g AS (SELECT *, lag(global_id) OVER (PARTITION BY model, cam_id, track_id ORDER BY frame, det_ord) AS p
  FROM gdet), lk AS (SELECT a.model AS run_id, a.frame, a.cam_id || '+' || b.cam_id AS pair, a.global_id, a.cam_id AS ca, b.cam_id AS cb
  FROM gdet a JOIN gdet b ON a.model = b.model AND a.frame = b.frame AND a.global_id = b.global_id AND a.cam_id < b.cam_id),
 summ AS (SELECT model AS run_id, count(DISTINCT frame) AS frames, count(*) AS detections,
  (SELECT count(*) FROM al WHERE al.model = g.model) AS alerts, count(DISTINCT global_id) AS unique_global_ids,
  (SELECT count(*) FROM lk WHERE lk.run_id = g.model) AS fusion_links, count(*) FILTER (WHERE p <> global_id) AS global_id_switches,
  round_even(avg(value), 3) AS latency_mean_ms, round_even(quantile_cont(value, 0.5), 3) AS latency_median_ms,
  round_even(quantile_cont(value, 0.95), 3) AS latency_p95_ms, round_even(max(value), 3) AS latency_max_ms FROM g GROUP BY model),
 pr AS (SELECT run_id, pair, count(*) AS n, min((frame, global_id, ca, cb)) AS first FROM lk GROUP BY run_id, pair),
 ls AS (SELECT run_id, (SELECT count(DISTINCT frame) FROM lk WHERE lk.run_id = pr.run_id) AS frames_with_fusion,
  count(*) AS camera_pairs, arg_min(pair, (-n, first)) AS top_pair, max(n) AS top_pair_links FROM pr GROUP BY run_id)"""


def _health(spark, sf):
    return health.run_health(_summary(spark, sf), health.camera_sync_stats(_sync(spark, sf)), _link_stats(spark, sf))


def run_health(spark, sf):
    return _health(spark, sf)


def compare_runs(spark, sf):
    return health.compare_runs(_health(spark, sf))


HEALTH_SQL = SUMMARY_SQL + SYNC_SQL.replace(DET_SQL, "") + """, cam AS (SELECT run_id, max(last_elapsed_s) - min(first_elapsed_s) AS dur,
  count(*) AS camera_count, count(*) FILTER (WHERE dropped_early) AS dropped_count,
  coalesce(string_agg(CASE WHEN dropped_early THEN cam_id END, ',' ORDER BY cam_id), '') AS dropped_cameras FROM cs GROUP BY run_id),
 hl AS (SELECT run_id, frames, round_even(dur, 3) AS duration_s, round_even(frames / dur, 3) AS effective_fps, detections, alerts, latency_mean_ms,
  latency_p95_ms, latency_max_ms, fusion_links, coalesce(frames_with_fusion, 0) AS frames_with_fusion,
  round_even(coalesce(frames_with_fusion, 0) / CAST(frames AS DOUBLE) * 100, 3) AS fusion_frame_rate_pct,
  round_even(fusion_links / CAST(frames AS DOUBLE), 6) AS fusion_links_per_frame,
  round_even(fusion_links / CAST(detections AS DOUBLE) * 1000, 3) AS fusion_links_per_1000_detections,
  coalesce(camera_pairs, 0) AS fusion_camera_pairs, coalesce(top_pair, '') AS top_fusion_pair,
  coalesce(top_pair_links, 0) AS top_fusion_pair_links, CAST(fusion_links > 0 AS BIGINT) AS fusion_active, dropped_cameras,
  dropped_count, camera_count FROM summ JOIN cam USING (run_id) LEFT JOIN ls USING (run_id))"""


def camera_scaling(spark, sf):
    runs = detections(spark, sf).groupBy("model").agg(
        F.countDistinct("frame").alias("frames"), F.bround(F.max("ts_s") - F.min("ts_s"), 3).alias("duration_s"))
    return health.camera_scaling(runs)


def sync_skew(spark, sf):
    return health.sync_skew(detections(spark, sf), ["frame"], 3_000_000.0)


def latency_report(spark, sf):
    return health.latency_report(raw_detections(spark, sf).withColumn("latency_ms", c("value")), ["cam_id"], 86_400.0)


def resampled(spark, sf):
    """Observations of each camera carried to a fixed rate of one tick per ten minutes."""
    return health.resample_fixed_rate(raw_detections(spark, sf), ["run_id", "cam_id"], 1.0 / 600.0).select(
        "cam_id", "tick", "det_ord", "duplicated")


def snapshot_staleness(spark, sf):
    """Age of the camera's last inference (a view event) at each other event; fresh within 20 minutes here."""
    d = raw_detections(spark, sf).select("run_id", "cam_id", "det_id", "ts_s", "event_type")
    return health.snapshot_staleness(d.where("event_type <> 'view'"), d.where("event_type = 'view'").drop("event_type"), ["run_id", "cam_id"], 1_200_000.0) \
        .select("det_id", "age_ms", "fresh")


def _newest(spark, sf):
    return detections(spark, sf).groupBy("run_id", "frame").agg(F.max("ts_s").alias("newest")).withColumn(
        "sync_ms", health.envelope_sync_ms(c("newest"), F.lit(0.0)))


def overlay_lookup(spark, sf):
    """Envelope shown at each video tick (every event is a tick) with two hours of overlay delay."""
    ticks = raw_detections(spark, sf).select("run_id", "det_id", (c("ts_s") * 1000.0).alias("tick_ms"))
    return health.overlay_asof(ticks, _newest(spark, sf), ["run_id"], 7_200_000.0).select("det_id", "overlay_frame")


def camera_freshness(spark, sf):
    """State of every camera at the end of each day (limits in hours here instead of seconds)."""
    d = raw_detections(spark, sf)
    day = F.floor(c("ts_s") / 86400).cast("bigint")
    last = d.groupBy("cam_id", day.alias("day")).agg(F.max("ts_s").alias("last_s"))
    return last.select("cam_id", "day", health.camera_freshness(
        c("last_s"), (c("day") + 1) * 86400.0 - 0.0).alias("state"))


def _envelopes(spark, sf):
    d = numbered(spark, sf)
    found = A.alerts(d, DEMO_SITE, RULES, frame_ordinals(d, ["run_id"]))
    frames = d.groupBy("run_id", "frame").agg(F.max("ts_s").alias("m")).select(
        "run_id", "frame", (c("m") * 1000.0 + c("frame") * 37 % 500).alias("created_epoch_ms"), F.lit("V4").alias("model_version"),
        F.lit("yolov8s").alias("model"), F.lit("pt").alias("format"))
    return E.build_envelopes(frames, A.zones_of(d, DEMO_SITE, ["det_id"]), found, 3)


def envelope_counts(spark, sf):
    from sightgrid.operators.envelopes import SCHEMA_NAME

    e = _envelopes(spark, sf)
    return e.where(c("schema") == SCHEMA_NAME).select(
        "frame", F.bround("created_epoch_s", 3).alias("created_s"), F.size("detections").cast("bigint").alias("detections"),
        F.bround(F.aggregate("detections", F.lit(0.0), lambda s, x: s + x["position_m"][0]), 3).alias("sum_x"))


def _lines(spark, sf):
    """The view's envelopes, alerts included, as JSON lines of two files.

    Every fifth frame lacks a field, every seventh its frame number, and some neighbours swap places.
    """
    d = numbered(spark, sf)
    found = A.alerts(d, DEMO_SITE, RULES, frame_ordinals(d, ["run_id"]))
    d = d.withColumn("inside_zones", F.lit(""))
    frames = d.groupBy("run_id", "frame").agg(F.max("ts_s").alias("m")).select(
        "run_id", "frame", (c("m") * 1000.0 + c("frame") * 37 % 500).alias("created_epoch_ms"), F.lit("V4").alias("model_version"),
        F.lit("yolov8s").alias("model"), F.lit("pt").alias("format"))
    e = E.build_envelopes(frames, d, found)
    k = c("frame") - FRAME0
    pair = F.floor(k / 2)
    line_no = k + F.when(pair % 20 == 0, F.when(k % 2 == 0, 1).otherwise(-1)).otherwise(0)
    text = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    text = F.when(c("frame") % 5 == 0, F.replace(text, F.lit('"format":"pt",'), F.lit(""))).otherwise(text)
    text = F.when(c("frame") % 7 == 0, F.replace(text, F.concat(F.lit('"frame":'), c("frame"), F.lit(",")), F.lit(""))).otherwise(text)
    return e.select(F.concat(F.lit("part-"), (F.floor(pair / 5) % 2).cast("string")).alias("file"), line_no.cast("bigint").alias("line_no"),
                    text.alias("value"))


def validate_envelopes(spark, sf):
    return E.validate_envelopes(cut_lineage(E.envelope_facts(_lines(spark, sf)).drop("value")))


def publish_intervals(spark, sf):
    return E.publish_intervals(cut_lineage(E.envelope_facts(_lines(spark, sf)).drop("value"))).select(
        "file", "line_no", "frame", F.bround("interval_ms", 3).alias("interval_ms"), "backwards")


def first_examples(spark, sf):
    return E.first_example(E.envelope_facts(_lines(spark, sf)))


ENVELOPE_SQL = ALERTS_SQL + f""", env AS (SELECT *, 'part-' || (k // 2 // 5) % 2 AS file, CASE WHEN g % 7 <> 0 THEN g END AS frame,
  k + CASE WHEN (k // 2) % 20 = 0 THEN CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END ELSE 0 END AS line_no FROM (
  SELECT frame AS g, frame - {FRAME0} AS k, max(ts_s) * 1000.0E0 + frame * 37 % 500 AS created_ms, count(*) AS n, round_even(max(ts_s), 6) AS newest
  FROM gdet GROUP BY frame) q LEFT JOIN (SELECT frame AS g, count(*) AS na FROM all_alerts GROUP BY frame) al USING (g)),
 step AS (SELECT *, created_ms - lag(created_ms) OVER (PARTITION BY file ORDER BY line_no) AS interval_ms,
  coalesce(frame < last_value(frame IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
   false) AS backwards, (round_even(created_ms / 1000.0E0, 6) - newest) * 1000.0E0 AS lag_ms FROM env),
 file_of AS (SELECT g AS frame, file FROM env)"""
P95_NEAREST = "list_sort(list({0}) FILTER (WHERE {0} IS NOT NULL))[CAST(round_even(0.95E0 * (count({0}) - 1), 0) AS BIGINT) + 1]"

STATS = """count(*) AS n, round_even(avg(value), 6) AS latency_mean_ms, round_even(quantile_cont(value, 0.5), 6) AS latency_median_ms,
 round_even({p95}, 6) AS latency_p95_ms, round_even(max(value), 6) AS latency_max_ms"""

QUERIES = {
    "latency_by_stage": (latency_by_stage, f"""WITH {RAW_SQL} SELECT event_type, {STATS.format(p95='quantile_cont(value, 0.95)')}
      FROM raw_det GROUP BY event_type"""),
    "latency_nearest_rank": (latency_nearest_rank, f"""WITH {RAW_SQL} SELECT event_type, cam_id,
      {STATS.format(p95=P95_NEAREST.format('value'))} FROM raw_det GROUP BY event_type, cam_id"""),
    "latency_overall": (latency_overall, f"WITH {RAW_SQL} SELECT {STATS.format(p95='quantile_cont(value, 0.95)')} FROM raw_det"),
    "inference_rate": (inference_rate, f"""WITH {RAW_SQL} SELECT model, round_even(stddev_pop(value), 1) AS latency_jitter_ms,
      round_even(1.0E0 / avg(value / 1000.0E0), 1) AS fps_inference FROM raw_det GROUP BY model"""),
    "frame_timing": (frame_timing, f"""WITH {TRACE_SQL} SELECT frame, count(DISTINCT cam_id) AS camera_count,
      round_even(coalesce(avg(capture_read_ms) FILTER (WHERE ok), 0), 3) AS capture_read_ms_mean,
      round_even(coalesce(max(capture_read_ms) FILTER (WHERE ok), 0), 3) AS capture_read_ms_max,
      round_even(min(e) FILTER (WHERE ok), 6) AS capture_read_end_epoch_min, round_even(max(e) FILTER (WHERE ok), 6) AS
      capture_read_end_epoch_max, round_even(avg(inference_tracking_ms), 3) AS inference_ms_mean,
      round_even(max(inference_tracking_ms), 3) AS inference_ms_max,
      round_even(coalesce((max(metadata_start_epoch) - min(e) FILTER (WHERE ok)) * 1000.0E0, 0), 3) AS capture_to_metadata_ms_worst,
      round_even(coalesce((max(metadata_start_epoch) - max(e) FILTER (WHERE ok)) * 1000.0E0, 0), 3) AS capture_to_metadata_ms_latest
      FROM trace GROUP BY frame"""),
    "stage_latency": (stage_latency, f"WITH {TRACE_SQL} " + " UNION ALL ".join(
        f"SELECT cam_id, '{k}' AS stage, round_even(avg({v}), 6) AS mean_ms, round_even(quantile_cont({v}, 0.95), 6) AS p95_ms FROM trace "
        "GROUP BY cam_id" for k, v in health.STAGES.items())),
    "fusion_link_stats": (fusion_link_stats, f"WITH {SUMMARY_SQL} SELECT * FROM ls"),
    "camera_sync": (camera_sync, f"WITH {SYNC_SQL} SELECT * EXCLUDE (fps), round_even(fps, 6) AS effective_fps FROM cs"),
    "expected_cameras": (expected_cameras, f"""WITH {SYNC_SQL} SELECT run_id, cam_id, coalesce(frames, 0) AS frames,
      coalesce(missing_campaign_frames, total) AS missing_campaign_frames, coalesce(dropped_early, true) AS dropped_early
      FROM (SELECT run_id, total, unnest({EXPECTED}) AS cam_id FROM runs) r LEFT JOIN cs USING (run_id, cam_id)"""),
    "run_summary": (run_summary, f"WITH {SUMMARY_SQL} SELECT * FROM summ"),
    "run_health": (run_health, f"WITH {HEALTH_SQL} SELECT * FROM hl"),
    "compare_runs": (compare_runs, f"""WITH {HEALTH_SQL} SELECT CAST(count(*) AS DOUBLE) AS runs, round_even(avg(effective_fps), 6) AS
      mean_effective_fps, round_even(avg(latency_p95_ms), 6) AS mean_latency_p95_ms,
      round_even(sum(dropped_count) / CAST(sum(camera_count) AS DOUBLE), 6) AS drop_rate,
      round_even(avg(CAST(fusion_links > 0 AS DOUBLE)), 6) AS fusion_enabled_rate FROM hl"""),
    "camera_scaling": (camera_scaling, f"""WITH {DET_SQL} SELECT *, round_even(frames / duration_s, 6) AS fps FROM (SELECT model,
      count(DISTINCT frame) AS frames, round_even(max(ts_s) - min(ts_s), 3) AS duration_s FROM det GROUP BY model) q"""),
    "sync_skew": (sync_skew, f"""WITH {DET_SQL} SELECT frame, cameras, CASE WHEN cameras >= 2 THEN s ELSE 0 END AS skew_ms,
      cameras < 2 OR s <= 3000000 AS released FROM (SELECT frame, count(DISTINCT cam_id) AS cameras,
      round_even((max(ts_s) - min(ts_s)) * 1000.0E0, 3) AS s FROM det GROUP BY frame) q"""),
    "latency_report": (latency_report, f"""WITH {RAW_SQL} SELECT cam_id, CAST(floor(ts_s / 86400) AS BIGINT) AS period,
      round_even(avg(value), 3) AS avg_ms, round_even(max(value), 3) AS max_ms FROM raw_det GROUP BY 1, 2"""),
    "resampled": (resampled, f"""WITH {RAW_SQL}, o AS (SELECT *, min(ts_s) OVER (PARTITION BY cam_id) AS t0 FROM raw_det),
      tk AS (SELECT cam_id, CAST(ceil((ts_s - t0) * (1.0E0/600.0E0)) AS BIGINT) AS k, max((ts_s, det_ord)) AS o FROM o GROUP BY 1, 2),
      n AS (SELECT *, lead(k) OVER (PARTITION BY cam_id ORDER BY k) AS nk FROM tk)
      SELECT cam_id, unnest(range(k, coalesce(nk, k + 1))) AS tick, o[2] AS det_ord,
      unnest(range(k, coalesce(nk, k + 1))) > k AS duplicated FROM n"""),
    "snapshot_staleness": (snapshot_staleness, f"""WITH {RAW_SQL} SELECT det_id, age_ms, coalesce(age_ms <= 1200000, false) AS fresh
      FROM (SELECT a.det_id, round_even((a.ts_s - b.ts_s) * 1000.0E0, 3) AS age_ms FROM (SELECT * FROM raw_det WHERE event_type <> 'view') a
      ASOF LEFT JOIN (SELECT * FROM raw_det WHERE event_type = 'view') b ON a.cam_id = b.cam_id AND a.ts_s >= b.ts_s) q"""),
    "overlay_lookup": (overlay_lookup, f"""WITH {DET_SQL}, e AS (SELECT frame, max(ts_s) * 1000.0E0 AS s FROM det GROUP BY frame)
      SELECT det_id, e.frame AS overlay_frame FROM (SELECT det_id, ts_s * 1000.0E0 - 7200000.0E0 AS t FROM raw_det) r
      ASOF LEFT JOIN e ON r.t >= e.s"""),
    "camera_freshness": (camera_freshness, f"""WITH {RAW_SQL} SELECT cam_id, day, CASE WHEN a < 2200 THEN 'live' WHEN a < 7000 THEN
      'stale' ELSE 'off' END AS state FROM (SELECT cam_id, CAST(floor(ts_s / 86400) AS BIGINT) AS day,
      (CAST(floor(any_value(ts_s) / 86400) AS BIGINT) + 1) * 86400.0E0 - max(ts_s) AS a FROM raw_det
      GROUP BY cam_id, CAST(floor(ts_s / 86400) AS BIGINT)) q"""),
    "envelope_counts": (envelope_counts, f"""WITH {GID_SQL} SELECT frame, round_even((max(ts_s) * 1000.0E0 + frame * 37 % 500) / 1000.0E0, 3)
      AS created_s, count(*) AS detections, round_even(sum(x_m), 3) AS sum_x FROM gdet WHERE frame % 3 = 0 GROUP BY frame"""),
    "validate_envelopes": (validate_envelopes, f"""WITH {ENVELOPE_SQL} SELECT file, count(*) AS envelopes, CAST(sum(n) AS BIGINT) AS
      detections, CAST(coalesce(sum(na), 0) AS BIGINT) AS alerts,
      (SELECT string_agg(cam_id, ', ' ORDER BY cam_id) FROM (SELECT DISTINCT cam_id FROM gdet JOIN file_of USING (frame) WHERE
       file_of.file = step.file) z) AS cameras,
      (SELECT string_agg(class_name, ', ' ORDER BY class_name) FROM (SELECT DISTINCT class_name FROM gdet JOIN file_of USING (frame) WHERE
       file_of.file = step.file) z) AS classes,
      (SELECT string_agg(alert_type, ', ' ORDER BY alert_type) FROM (SELECT DISTINCT alert_type FROM all_alerts JOIN file_of USING (frame)
       WHERE file_of.file = step.file) z) AS alert_types, CAST(sum(n) AS BIGINT) AS bbox_ok, CAST(sum(n) AS BIGINT) AS global_ids,
      count(*) FILTER (WHERE g % 5 = 0 OR g % 7 = 0) AS missing_envelope, CAST(0 AS BIGINT) AS missing_detection, CAST(0 AS BIGINT) AS
      missing_alert, count(*) FILTER (WHERE backwards) AS frame_backwards, round_even(avg(interval_ms), 3) AS publish_interval_mean_ms,
      round_even({P95_NEAREST.format('interval_ms')}, 3) AS publish_interval_p95_ms, round_even(avg(lag_ms), 3) AS metadata_lag_mean_ms,
      round_even({P95_NEAREST.format('lag_ms')}, 3) AS metadata_lag_p95_ms FROM step GROUP BY file"""),
    "publish_intervals": (publish_intervals, f"""WITH {ENVELOPE_SQL} SELECT file, line_no, frame, round_even(interval_ms, 3) AS interval_ms,
      backwards FROM step"""),
    "first_examples": (first_examples, f"""WITH {ENVELOPE_SQL} SELECT file, min(line_no) AS with_detection,
      min(line_no) FILTER (WHERE na > 0) AS with_alert FROM env GROUP BY file"""),
}
