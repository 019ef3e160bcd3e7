"""Registered queries: zone presence, votes, entry and exit edges, escalation, persistence, trails."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightgrid.operators import alerts as A
from sightgrid.operators import reports
from sightgrid.operators.ordered import frame_ordinals
from sightgrid.plans.fusion import EXACT_IDS_SQL, GID_SQL, IDS_SQL, exact_identities, mutual_identities, numbered
from sightgrid.sources.tables import CROSS_SQL, DEMO_SITE, ON_EDGE_SQL, ZONE_SQL, detections, raw_detections

c = F.col
RULES = A.AlertRules(person_ids=(11,), zone_min_votes=1, zone_min_ratio=0.3)


def _presence(spark, sf):
    return A.zone_presence(numbered(spark, sf), DEMO_SITE, RULES)


def _spine(spark, sf):
    return frame_ordinals(raw_detections(spark, sf), ["run_id"])


def zone_presence(spark, sf):
    return _presence(spark, sf).select("frame", "global_id", "zone_id", "x_m", "y_m", "confidence",
                                       F.concat_ws("+", "cameras").alias("cameras"))


def zone_votes(spark, sf):
    return A.enough_votes(_presence(spark, sf), RULES).select(
        "frame", "global_id", "zone_id", F.size("cameras").cast("bigint").alias("votes"))


def zone_entries(spark, sf):
    voted = A.enough_votes(_presence(spark, sf), RULES)
    return A.zone_entries(voted, _spine(spark, sf)).select("frame", "global_id", "zone_id", "ord")


def zone_exits(spark, sf):
    voted = A.enough_votes(_presence(spark, sf), RULES)
    return A.zone_exits(voted, _spine(spark, sf)).select("frame", "global_id", "zone_id", "resolved_ord")


def object_presence(spark, sf):
    return A.object_presence(numbered(spark, sf), RULES).select(
        "frame", "global_id", "object_key", "x_m", "y_m", "confidence", F.concat_ws("+", "cameras").alias("cameras"),
        "alert_level")


def object_escalations(spark, sf):
    found = A.object_presence(numbered(spark, sf), RULES)
    return A.object_escalations(found, _spine(spark, sf)).select("frame", "global_id", "object_key", "alert_level", "ord")


def _alerts(spark, sf):
    return A.alerts(numbered(spark, sf), DEMO_SITE, RULES, _spine(spark, sf))


def alerts(spark, sf):
    return _alerts(spark, sf).select("frame", "alert_id", "alert_type", "alert_level", "global_id", "zone_id", "class_name",
                                     "x_m", "y_m", F.concat_ws("+", "cameras").alias("cameras"), "confidence")


def campaign_alerts(spark, sf):
    """The whole way: detections, links, components, sticky ids, then zone and object alerts on those ids."""
    found = A.alerts(mutual_identities(spark, sf), DEMO_SITE, RULES, _spine(spark, sf))
    return found.select("frame", "alert_id", "alert_type", "alert_level", "global_id", "zone_id", "class_name", "x_m", "y_m",
                        F.concat_ws("+", "cameras").alias("cameras"), "confidence")


def campaign_alerts_exact(spark, sf):
    """The same way over the optimal pairing."""
    found = A.alerts(exact_identities(spark, sf), DEMO_SITE, RULES, _spine(spark, sf))
    return found.select("frame", "alert_id", "alert_type", "alert_level", "global_id", "zone_id", "class_name", "x_m", "y_m",
                        F.concat_ws("+", "cameras").alias("cameras"), "confidence")


def alert_counts(spark, sf):
    return reports.alert_counts(_alerts(spark, sf))


def zone_alert_counts(spark, sf):
    """Flagship: new zone alerts by zone and number of voting cameras."""
    voted = A.enough_votes(_presence(spark, sf), RULES)
    return A.zone_entries(voted, _spine(spark, sf)).groupBy("zone_id", F.size("cameras").cast("bigint").alias("votes")).agg(
        F.count(F.lit(1)).alias("n_alerts"), F.countDistinct("global_id").alias("n_entities"),
        F.bround(F.avg("confidence"), 6).alias("avg_confidence"))


def recent_alerts(spark, sf):
    return reports.recent_alerts(_alerts(spark, sf)).select("alert_id", "alert_type", F.bround("ts_s", 3).alias("ts"))


def persistence(spark, sf):
    """Frames that complete three consecutive frames with a person in zone_1, per camera."""
    hits = A.zone_hits(detections(spark, sf).where(c("class_name") == "personne"), DEMO_SITE).where("zone_id = 'zone_1'")
    positive = hits.select("run_id", "cam_id", "frame").distinct().join(_spine(spark, sf), ["run_id", "frame"])
    return A.persistence(positive, ["run_id", "cam_id"]).drop("run_id")


def track_trails(spark, sf):
    d = detections(spark, sf).withColumn("foot", F.struct(
        ((c("x1") + c("x2")) / 2).cast("bigint").alias("u"), c("y2").cast("bigint").alias("v")))
    t = A.track_trail(d, 60)
    return t.select("det_id", F.size("trail").cast("bigint").alias("n"), F.aggregate(
        "trail", F.lit(0).cast("bigint"), lambda s, p: s + p["u"]).alias("sum_u"), c("trail")[0]["u"].alias("first_u"))


SPINE_SQL = "spine AS (SELECT frame, row_number() OVER (ORDER BY frame) - 1 AS ord FROM (SELECT DISTINCT frame FROM det) f)"
PRESENCE_SQL = f"""{GID_SQL}, {ZONE_SQL}, {SPINE_SQL}, hits AS (
 SELECT det_id, zone_id FROM det, zone_edges GROUP BY det_id, zone_id
 HAVING bool_or({ON_EDGE_SQL}) OR count(*) FILTER (WHERE {CROSS_SQL}) % 2 = 1),
 presence AS (SELECT frame, global_id, zone_id, arg_max(x_m, (confidence, -det_ord)) AS x_m,
  arg_max(y_m, (confidence, -det_ord)) AS y_m, arg_max(ts_s, (confidence, -det_ord)) AS ts_s, max(confidence) AS confidence,
  coalesce(array_to_string(list_sort(list(DISTINCT zc.cam_id) FILTER (WHERE zc.cam_id IS NOT NULL)), '+'), '') AS cameras,
  count(DISTINCT zc.cam_id) AS votes
  FROM gdet JOIN hits USING (det_id) LEFT JOIN zone_cams zc USING (zone_id, cam_id)
  WHERE class_id = 11 GROUP BY frame, global_id, zone_id),
 voted AS (SELECT p.*, ord FROM presence p JOIN spine USING (frame) WHERE votes >= (SELECT greatest(1, CAST(ceil(count(*)*0.3E0)
  AS BIGINT)) FROM zone_cams z WHERE z.zone_id = p.zone_id)),
 edges AS (SELECT *, lag(ord) OVER w AS before, lead(ord) OVER w AS after FROM voted
  WINDOW w AS (PARTITION BY global_id, zone_id ORDER BY ord))"""
OBJECT_SQL = f"""{GID_SQL}, {SPINE_SQL}, objects AS (
 SELECT frame, global_id, lower(trim(class_name)) AS object_key, arg_max(x_m, (confidence, -det_ord)) AS x_m,
  arg_max(y_m, (confidence, -det_ord)) AS y_m, arg_max(ts_s, (confidence, -det_ord)) AS ts_s, max(confidence) AS confidence,
  array_to_string(list_sort(list(DISTINCT cam_id)), '+') AS cameras,
  CASE WHEN count(DISTINCT cam_id) >= 2 THEN 'confirmed' ELSE 'weak' END AS alert_level
 FROM gdet WHERE class_id <> 11 GROUP BY frame, global_id, lower(trim(class_name))),
 levels AS (SELECT o.*, ord, lag(ord) OVER w AS p_ord, lag(alert_level) OVER w AS p_level FROM objects o JOIN spine USING (frame)
  WINDOW w AS (PARTITION BY global_id, object_key ORDER BY ord)),
 raised AS (SELECT * FROM levels WHERE p_ord IS NULL OR p_ord <> ord - 1 OR (p_level <> alert_level AND p_level <> 'confirmed'))"""
ENTRY = "before IS NULL OR before <> ord - 1"


def _id(kind, zone, name):
    return f"substr(sha256(concat_ws(',', 'session_1', '{kind}', global_id, {zone}, {name}, frame)), 1, 8)"


ALERTS_SQL = f"""{PRESENCE_SQL}, {OBJECT_SQL.replace(GID_SQL + ', ' + SPINE_SQL + ', ', '')},
 all_alerts AS (SELECT frame, {_id('zone_violation_person', 'zone_id', "'person'")} AS alert_id,
  'zone_violation_person' AS alert_type, 'confirmed' AS alert_level, global_id, zone_id, 'person' AS class_name, x_m, y_m,
  cameras, confidence, ts_s FROM edges WHERE {ENTRY}
  UNION ALL SELECT frame, {_id('forbidden_object', "''", 'object_key')}, 'forbidden_object', alert_level, global_id, NULL,
  object_key, x_m, y_m, cameras, confidence, ts_s FROM raised)"""

QUERIES = {
    "campaign_alerts": (campaign_alerts, f"""WITH RECURSIVE {ALERTS_SQL.replace(GID_SQL, IDS_SQL)} SELECT frame, alert_id, alert_type,
      alert_level, global_id, zone_id, class_name, x_m, y_m, cameras, confidence FROM all_alerts"""),
    "campaign_alerts_exact": (campaign_alerts_exact, f"""WITH RECURSIVE {ALERTS_SQL.replace(GID_SQL, EXACT_IDS_SQL)} SELECT frame,
      alert_id, alert_type, alert_level, global_id, zone_id, class_name, x_m, y_m, cameras, confidence FROM all_alerts"""),
    "zone_alert_counts": (zone_alert_counts, f"""WITH {PRESENCE_SQL} SELECT zone_id, votes, count(*) AS n_alerts,
      count(DISTINCT global_id) AS n_entities, round_even(avg(confidence), 6) AS avg_confidence FROM edges WHERE {ENTRY}
      GROUP BY zone_id, votes"""),
    "zone_presence": (zone_presence, f"""WITH {PRESENCE_SQL} SELECT frame, global_id, zone_id, x_m, y_m, confidence, cameras
      FROM presence"""),
    "zone_votes": (zone_votes, f"WITH {PRESENCE_SQL} SELECT frame, global_id, zone_id, votes FROM voted"),
    "zone_entries": (zone_entries, f"WITH {PRESENCE_SQL} SELECT frame, global_id, zone_id, ord FROM edges WHERE {ENTRY}"),
    "zone_exits": (zone_exits, f"""WITH {PRESENCE_SQL} SELECT frame, global_id, zone_id, ord + 1 AS resolved_ord FROM edges
      WHERE (after IS NULL OR after <> ord + 1) AND ord < (SELECT max(ord) FROM spine)"""),
    "object_presence": (object_presence, f"""WITH {OBJECT_SQL} SELECT frame, global_id, object_key, x_m, y_m, confidence,
      cameras, alert_level FROM objects"""),
    "object_escalations": (object_escalations, f"""WITH {OBJECT_SQL} SELECT frame, global_id, object_key, alert_level, ord
      FROM raised"""),
    "alerts": (alerts, f"""WITH {ALERTS_SQL} SELECT frame, alert_id, alert_type, alert_level, global_id, zone_id, class_name,
      x_m, y_m, cameras, confidence FROM all_alerts"""),
    "alert_counts": (alert_counts, f"""WITH {ALERTS_SQL} SELECT alert_type, alert_level, count(*) AS n FROM all_alerts
      GROUP BY 1, 2"""),
    "recent_alerts": (recent_alerts, f"""WITH {ALERTS_SQL} SELECT alert_id, alert_type, round_even(ts_s, 3) AS ts FROM all_alerts
      ORDER BY ts_s DESC, alert_id LIMIT 80"""),
    "persistence": (persistence, f"""WITH {PRESENCE_SQL}, pos AS (SELECT DISTINCT cam_id, frame, ord FROM det JOIN hits
      USING (det_id) JOIN spine USING (frame) WHERE class_name = 'personne' AND zone_id = 'zone_1'),
      isl AS (SELECT *, ord - row_number() OVER (PARTITION BY cam_id ORDER BY ord) AS g FROM pos),
      run AS (SELECT *, row_number() OVER (PARTITION BY cam_id, g ORDER BY ord) AS n FROM isl)
      SELECT frame, cam_id, ord, n = 3 AS episode_start FROM run WHERE n >= 3"""),
    "track_trails": (track_trails, f"""WITH {GID_SQL} SELECT det_id, count(*) OVER w AS n, CAST(sum(u) OVER w AS BIGINT) AS sum_u,
      first_value(u) OVER w AS first_u FROM (SELECT *, CAST(trunc((x1+x2)/2) AS BIGINT) AS u FROM det) d
      WINDOW w AS (PARTITION BY cam_id, track_id ORDER BY frame, det_ord ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"""),
}
