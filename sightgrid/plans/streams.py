"""Registered queries: stream operators run over the events as a file stream, checked against their batch meaning.

A window or session leaves the stream once the watermark has passed its end, so the SQL keeps only closed ones.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sightgrid.operators import alerts as A
from sightgrid.plans.alerting import ALERTS_SQL, ENTRY, RULES
from sightgrid.plans.fusion import EXACT_IDS_SQL, GID_SQL, WIDE
from sightgrid.streaming import envelopes as S
from sightgrid.streaming import live, stateful
from sightgrid.session import cut_lineage, fresh_folder
from sightgrid.sources.tables import DEMO_SITE, RAW_SQL, as_detections, detections, event_stream

c = F.col


def _stream(spark, sf):
    return as_detections(event_stream(spark, sf))


FILES = 5


def filed(spark, sf):
    """The camera view as a stream of ``FILES`` files in order of time, read one by one; file borders cut frames in two."""
    folder = fresh_folder(spark, "arrivals")
    view = cut_lineage(detections(spark, sf).drop("model", "event_type", "value"))
    cuts = view.select(F.percentile_approx("ts_s", [k / FILES for k in range(1, FILES)]).alias("at")).first()["at"] or []
    for low, high in zip([None, *cuts], [*cuts, None]):  # one after the other: the file source reads in order of age
        part = view if low is None else view.where(c("ts_s") > low)
        (part if high is None else part.where(c("ts_s") <= high)).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(view.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _live_ids(spark, sf):
    """Identities of the stream: a frame is an hour of the view and complete when the hour is over."""
    return live.live_ids(filed(spark, sf), DEMO_SITE, F.timestamp_seconds((c("frame") + 1) * 3600.0), 1.0, WIDE, "1 hour", 1e9)


def live_global_ids(spark, sf):
    """Sticky ids of the frames that have closed, from micro-batches that cut frames in two."""
    found = S.run_available(_live_ids(spark, sf))
    return found.where("cam_id is not null").select("frame", "cam_id", "track_id", "class_key", "global_id", "ord")


def live_alerts(spark, sf):
    """From raw detections to alerts in one streaming query: barrier, identities, zones, votes and edges; ends of stays too."""
    found = S.run_available(live.live_edges(_live_ids(spark, sf), DEMO_SITE, RULES))
    return found.select("kind", "frame", "ord", "global_id", "zone_id", "class_name", "alert_level", "x_m", "y_m",
                        F.concat_ws("+", "cameras").alias("cameras"), "confidence")


def stream_delivery_latency(spark, sf):
    """Delivery latency of every event: created at its own time, received after a transport delay (some clocks ahead)."""
    d = _stream(spark, sf)
    created = c("ts_s") * 1000.0
    received = created + (c("det_id") % 500) - 50.0
    return S.run_available(d.select("det_id", F.bround(S.delivery_latency_ms(received, created), 3).alias("latency_ms")))


def stream_alert_dedupe(spark, sf):
    """Three events in a row carry one alert id; the replays are dropped."""
    d = _stream(spark, sf).select((c("det_id") - c("det_id") % 3).cast("string").alias("alert_id"), "event_time")
    return S.run_available(S.dedupe_alerts(d, "1 day").select("alert_id"))


def stream_stage_monitor(spark, sf):
    d = _stream(spark, sf).withColumn("latency_ms", c("value"))
    return S.run_available(S.latency_monitor(d, ["cam_id"], "6 hours", "1 hour")).select(
        "cam_id", F.unix_seconds("period_start").alias("period_start"), "avg_ms", "max_ms", "n")


def stream_released_ticks(spark, sf):
    return S.run_available(S.released_ticks(_stream(spark, sf), "10 minutes", 300_000.0, "1 hour")).select(
        F.unix_seconds("tick_start").alias("tick_start"), "skew_ms")


def stream_alert_sessions(spark, sf):
    return S.run_available(S.false_positive_sessions(_stream(spark, sf), ["cam_id"], "600 seconds", "1 hour")).select(
        "cam_id", F.unix_micros("start_time").alias("start_us"), F.unix_micros("end_time").alias("end_us"), "n_detections")


def stream_counters(spark, sf):
    """Running counters per run, kept in complete mode."""
    one = F.array(F.lit(1))
    d = _stream(spark, sf).select(c("model").alias("run_label"), "frame", one.alias("detections"),
                                  F.when(c("class_id") == 5, one).otherwise(F.slice(one, 1, 0)).alias("alerts"))
    return S.run_available(S.stream_counters(d), "complete")


def stream_persistence(spark, sf):
    """Three consecutive events of a camera with a person, by the camera's own event count."""
    d = _stream(spark, sf).select("cam_id", F.floor(c("det_id") / 4).alias("ord"), (c("class_id") == 11).alias("positive"))
    return S.run_available(stateful.live_persistence(d, ["cam_id"]))


def stream_presence_starts(spark, sf):
    """Presence of each event type at each camera by the camera's event count: where it starts."""
    d = _stream(spark, sf).select("cam_id", "event_type", F.floor(c("det_id") / 4).alias("ord"), F.lit("confirmed").alias("level"),
                                  "event_time")
    return S.run_available(stateful.presence_edges(d, ["cam_id", "event_type"], 3_600_000)).where("kind = 'start'").select(
        "cam_id", "event_type", "ord")


def batch_persistence(spark, sf):
    from sightgrid.sources.tables import raw_detections

    d = raw_detections(spark, sf).where("class_id = 11").select("cam_id", F.floor(c("det_id") / 4).alias("ord"))
    return A.persistence(d, ["cam_id"])


CLOSED = "(SELECT max(ts_s) - 3600.0E0 FROM raw_det)"
PERSIST_SQL = f"""WITH {RAW_SQL}, pos AS (SELECT cam_id, det_id // 4 AS ord FROM raw_det WHERE class_id = 11),
  isl AS (SELECT *, ord - row_number() OVER (PARTITION BY cam_id ORDER BY ord) AS g FROM pos),
  run AS (SELECT *, row_number() OVER (PARTITION BY cam_id, g ORDER BY ord) AS n FROM isl)
  SELECT cam_id, ord, n = 3 AS episode_start FROM run WHERE n >= 3"""
# frames that have ended by the last watermark
ENDED = "(frame + 1) * 3600 <= (SELECT max(ts_s) - 3600.0E0 FROM det)"
LIVE_SQL = f"""{ALERTS_SQL.replace(GID_SQL, EXACT_IDS_SQL)}, gone AS (SELECT *, max(ord) FILTER (WHERE {ENDED}) OVER () AS closed FROM spine)"""

QUERIES = {
    "live_global_ids": (live_global_ids, f"""WITH RECURSIVE {EXACT_IDS_SQL} SELECT frame, cam_id, track_id, k AS class_key, global_id,
      ord FROM gdet JOIN (SELECT frame, row_number() OVER (ORDER BY frame) - 1 AS ord FROM (SELECT DISTINCT frame FROM det) q) s
      USING (frame) WHERE {ENDED}"""),
    "live_alerts": (live_alerts, f"""WITH RECURSIVE {LIVE_SQL}
      SELECT 'zone' AS kind, frame, ord, global_id, zone_id, 'person' AS class_name, 'confirmed' AS alert_level, x_m, y_m, cameras,
       confidence FROM edges WHERE ({ENTRY}) AND {ENDED}
      UNION ALL SELECT 'exit', frame, ord + 1, global_id, zone_id, NULL, 'confirmed', NULL, NULL, '', NULL FROM edges
       WHERE (after IS NULL OR after <> ord + 1) AND ord < (SELECT max(closed) FROM gone)
      UNION ALL SELECT 'object', frame, ord, global_id, NULL, object_key, alert_level, x_m, y_m, cameras, confidence FROM raised
       WHERE {ENDED}"""),
    "stream_delivery_latency": (stream_delivery_latency, f"""WITH {RAW_SQL} SELECT det_id, round_even(greatest(0.0E0,
      (ts_s * 1000.0E0 + det_id % 500 - 50.0E0) - ts_s * 1000.0E0), 3) AS latency_ms FROM raw_det"""),
    "stream_alert_dedupe": (stream_alert_dedupe, f"""WITH {RAW_SQL} SELECT DISTINCT CAST(det_id - det_id % 3 AS VARCHAR) AS alert_id
      FROM raw_det"""),
    "stream_stage_monitor": (stream_stage_monitor, f"""WITH {RAW_SQL} SELECT cam_id, CAST(floor(ts_s / 21600) AS BIGINT) * 21600 AS
      period_start, round_even(avg(value), 3) AS avg_ms, round_even(max(value), 3) AS max_ms, count(*) AS n FROM raw_det
      WHERE (floor(ts_s / 21600) + 1) * 21600 <= {CLOSED} GROUP BY 1, 2"""),
    "stream_released_ticks": (stream_released_ticks, f"""WITH {RAW_SQL}, k AS (SELECT CAST(floor(ts_s / 600) AS BIGINT) * 600 AS
      tick_start, count(DISTINCT cam_id) AS n, round_even((max(ts_s) - min(ts_s)) * 1000.0E0, 3) AS skew_ms FROM raw_det GROUP BY 1)
      SELECT tick_start, skew_ms FROM k WHERE (n < 2 OR skew_ms <= 300000) AND tick_start + 600 <= {CLOSED}"""),
    "stream_alert_sessions": (stream_alert_sessions, f"""WITH {RAW_SQL}, e AS (SELECT cam_id, epoch_us(ts) AS us FROM events JOIN
      (SELECT det_id, cam_id FROM raw_det) r ON r.det_id = event_id), l AS (SELECT *, lag(us) OVER (PARTITION BY cam_id ORDER BY us)
      AS p FROM e), s AS (SELECT *, sum(CASE WHEN p IS NULL OR us - p > 600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY cam_id ORDER BY
      us) AS g FROM l) SELECT cam_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n_detections FROM s GROUP BY cam_id, g
      HAVING max(us) + 600000000 <= (SELECT max(us) - 3600000000 FROM e)"""),
    "stream_counters": (stream_counters, f"""WITH {RAW_SQL} SELECT model AS run_label, count(*) AS envelopes, count(*) AS detections,
      count(*) FILTER (WHERE class_id = 5) AS alerts, max(frame) AS last_frame FROM raw_det GROUP BY model"""),
    "stream_persistence": (stream_persistence, PERSIST_SQL),
    "batch_persistence": (batch_persistence, PERSIST_SQL),
    "stream_presence_starts": (stream_presence_starts, f"""WITH {RAW_SQL}, p AS (SELECT cam_id, event_type, det_id // 4 AS ord FROM
      raw_det) SELECT cam_id, event_type, ord FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.cam_id = p.cam_id AND
      q.event_type = p.event_type AND q.ord = p.ord - 1)"""),
}
