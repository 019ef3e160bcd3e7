"""Registered queries: scalar text, time and geometry functions over the camera view."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightgrid.functions import geometry as G
from sightgrid.functions import names as N
from sightgrid.operators import alerts as A
from sightgrid.operators import audit
from sightgrid.sources.tables import (
    CAM_SQL, CROSS_SQL, DEMO_SITE, DET_SQL, HITS_SQL, ON_EDGE_SQL, OVERLAP_SQL, RAW_SQL, ZONE_SQL, detections,
    raw_detections,
)

c = F.col

SPELLED = {"click": "Personne", "view": " Humain ", "purchase": "Téléphone_Portable", "signup": "",
           "error": "Niveau  à_Bulle"}
SPELLED_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SPELLED.items()) + " END"
LABELS = ["maillet", "amrteau", "télé^phone", "5", "scie", "inconnu", "mailley", "verre"]
LABELS_SQL = "CASE event_id % 8 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(LABELS)) + " END"


def _spelled():
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in SPELLED.items() for x in kv]), c("event_type"))


def _label():
    return F.element_at(F.array(*map(F.lit, LABELS)), (c("det_id") % 8 + 1).cast("int"))


def class_key(spark, sf):
    return raw_detections(spark, sf).select("det_id", N.class_key(_spelled(), c("class_id")).alias("class_key"))


def normalize_class(spark, sf):
    return raw_detections(spark, sf).select("det_id", N.normalize_class(_spelled()).alias("class_norm"))


def alert_class_key(spark, sf):
    return raw_detections(spark, sf).select("det_id", N.alert_class_key(_spelled()).alias("object_key"))


def fix_class_name(spark, sf):
    fixed = N.fix_class_name(_label())
    return raw_detections(spark, sf).select(
        "det_id", fixed.alias("class_fixed"), N.label_class_id(fixed).cast("bigint").alias("label_id"))


def person_rules(spark, sf):
    return raw_detections(spark, sf).select(
        "det_id", N.is_person(c("class_id"), _spelled(), [11]).alias("person"),
        N.is_ignored_for_objects(_spelled()).alias("ignored"), N.is_allowed_vehicle(c("event_type")).alias("vehicle"),
        N.live_kind(c("class_id")).alias("kind"))


def valid_detections(spark, sf):
    d = raw_detections(spark, sf).select(
        "det_id", "x1", "y1", F.when(c("det_id") % 11 == 0, c("x1") - 1).otherwise(c("x2")).alias("x2"), "y2",
        F.when(c("det_id") % 13 == 0, F.lit(float("nan"))).otherwise(c("confidence")).alias("confidence"))
    return d.where(G.valid_detection(c("x1"), c("y1"), c("x2"), c("y2"), c("confidence")))


def foot_points(spark, sf):
    box = [c(x) for x in ("x1", "y1", "x2", "y2")]
    return raw_detections(spark, sf).select("det_id", G.foot_point(*box).alias("f"), G.foot_point_px(*box).alias("i")).select(
        "det_id", c("f.u").alias("foot_u"), c("f.v").alias("foot_v"), c("i.u").alias("px_u"), c("i.v").alias("px_v"))


def bbox_center_size(spark, sf):
    box = [c(x) for x in ("x1", "y1", "x2", "y2")]
    return raw_detections(spark, sf).select("det_id", G.bbox_center(*box).alias("m"), G.bbox_size(*box).alias("s")).select(
        "det_id", c("m.u").alias("cu"), c("m.v").alias("cv"), c("s.w").alias("w"), c("s.h").alias("h"))


def _with_camera(spark, df):
    return df.join(DEMO_SITE.camera_dim(spark), "cam_id", "left")


def project_to_floor(spark, sf):
    d = _with_camera(spark, detections(spark, sf)).withColumn(
        "_p", G.apply_homography(c("h"), (c("x1") + c("x2")) / 2, c("y2")))
    return d.select("det_id", "cam_id", F.bround("_p.x", 6).alias("floor_x"), F.bround("_p.y", 6).alias("floor_y"))


def floor_to_pixels(spark, sf):
    inverse = DEMO_SITE.camera_dim(spark).select("cam_id", G.invert_homography(c("h")).alias("inv"))
    d = detections(spark, sf).join(DEMO_SITE.hint(inverse, len(DEMO_SITE.cameras)), "cam_id", "left").withColumn(
        "_p", G.apply_homography(c("inv"), c("x_m"), c("y_m")))
    return d.select("det_id", "cam_id", F.bround("_p.x", 2).alias("u"), F.bround("_p.y", 2).alias("v"))


INV_SQL = """inv AS (
 SELECT cam_id, (h11*h22-h12*h21)*s AS i00, (h02*h21-h01*h22)*s AS i01, (h01*h12-h02*h11)*s AS i02,
  (h12*h20-h10*h22)*s AS i10, (h00*h22-h02*h20)*s AS i11, (h02*h10-h00*h12)*s AS i12,
  (h10*h21-h11*h20)*s AS i20, (h01*h20-h00*h21)*s AS i21, (h00*h11-h01*h10)*s AS i22
 FROM (SELECT *, 1.0E0/(h00*(h11*h22-h12*h21)-h01*(h10*h22-h12*h20)+h02*(h10*h21-h11*h20)) AS s FROM cams) q)"""


def pixel_zone_hits(spark, sf):
    """Foot pixel inside the zone polygon projected into the camera's image, for the cameras that cover the zone."""
    zones = DEMO_SITE.zone_dim(spark).select("zone_id", "polygon", F.explode("zone_cameras").alias("cam_id"))
    inverse = DEMO_SITE.camera_dim(spark).select("cam_id", G.invert_homography(c("h")).alias("inv"))
    px = zones.join(inverse, "cam_id").withColumn("px", G.project_polygon(c("inv"), c("polygon"))).where(F.size("px") >= 3)
    px = DEMO_SITE.hint(px.select("cam_id", "zone_id", G.edges_of(c("px")).alias("e")),
                        sum(1 + len(z.polygon) for z in DEMO_SITE.zones) * len(DEMO_SITE.cameras))
    return detections(spark, sf).join(px, "cam_id").where(
        G.point_in_polygon(c("e"), (c("x1") + c("x2")) / 2, c("y2"))).select("det_id", "cam_id", "zone_id")


PIXEL_SQL = f"""WITH {DET_SQL}, {ZONE_SQL}, {CAM_SQL}, {INV_SQL}, px AS (
 SELECT zone_id, cam_id, round_even((i00*ax+i01*ay+i02)/(i20*ax+i21*ay+i22), 2) AS ax,
  round_even((i10*ax+i11*ay+i12)/(i20*ax+i21*ay+i22), 2) AS ay,
  round_even((i00*bx+i01*by_+i02)/(i20*bx+i21*by_+i22), 2) AS bx, round_even((i10*bx+i11*by_+i12)/(i20*bx+i21*by_+i22), 2) AS by_
 FROM zone_edges JOIN zone_cams USING (zone_id) JOIN inv USING (cam_id)),
 feet AS (SELECT det_id, cam_id, (x1+x2)/2 AS x_m, y2 AS y_m FROM det)
 SELECT det_id, cam_id, zone_id FROM feet JOIN px USING (cam_id) GROUP BY ALL
 HAVING bool_or({ON_EDGE_SQL}) OR count(*) FILTER (WHERE {CROSS_SQL}) % 2 = 1"""


def rescaled_projection(spark, sf):
    """Floor position when the frame comes in another resolution than the camera was calibrated for."""
    w = F.when(c("det_id") % 3 == 0, 768.0).when(c("det_id") % 3 == 1, 704.0).otherwise(1280.0)
    hgt = F.when(c("det_id") % 3 == 2, 720.0).otherwise(576.0)
    d = _with_camera(spark, detections(spark, sf)).withColumn("w", w).withColumn("hh", hgt)
    d = d.withColumn("_h", G.rescale_homography(c("h"), c("calib_w"), c("calib_h"), c("w"), c("hh"))).withColumn(
        "_p", G.apply_homography(c("_h"), (c("x1") + c("x2")) / 2, c("y2")))
    return d.select("det_id", F.bround("_p.x", 6).alias("floor_x"), F.bround("_p.y", 6).alias("floor_y"),
                    F.bround(G.resolution_distance(c("w"), c("hh"), c("calib_w"), c("calib_h")), 6).alias("res_distance"))


RESCALE_SQL = f"""WITH {DET_SQL}, {CAM_SQL}, r AS (
 SELECT *, CASE det_id % 3 WHEN 0 THEN 768.0E0 WHEN 1 THEN 704.0E0 ELSE 1280.0E0 END AS w,
  CASE det_id % 3 WHEN 2 THEN 720.0E0 ELSE 576.0E0 END AS hh FROM det JOIN cams USING (cam_id)),
 s AS (SELECT *, cw / w AS sx, ch / hh AS sy, (x1 + x2) / 2 AS u, y2 AS v FROM r)
 SELECT det_id, round_even((h00*sx*u+h01*sy*v+h02)/(h20*sx*u+h21*sy*v+h22), 6) AS floor_x,
  round_even((h10*sx*u+h11*sy*v+h12)/(h20*sx*u+h21*sy*v+h22), 6) AS floor_y,
  round_even(abs(ln(w/cw)) + abs(ln(hh/ch)), 6) AS res_distance FROM s"""


def aspect_corrected_boxes(spark, sf):
    fixed = c("cam_id").isin(DEMO_SITE.corrected_cameras)
    sx = F.when(fixed, F.lit(DEMO_SITE.corrected_resolution[0] / 704.0)).otherwise(F.lit(1.0))
    corners = F.array(F.struct(c("x1").alias("x"), c("y1").alias("y")), F.struct(c("x2").alias("x"), c("y2").alias("y")))
    return raw_detections(spark, sf).withColumn("_p", G.rescale_points(corners, sx, F.lit(1.0))).select(
        "det_id", c("_p")[0]["x"].alias("px1"), c("_p")[0]["y"].alias("py1"), c("_p")[1]["x"].alias("px2"),
        c("_p")[1]["y"].alias("py2"))


def zone_hits(spark, sf):
    return A.zone_hits(detections(spark, sf), DEMO_SITE).select("det_id", "zone_id", "x_m", "y_m")


def distance_to_zone(spark, sf):
    zone = DEMO_SITE.zones[1]
    poly = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in zone.polygon])
    return detections(spark, sf).select(
        "det_id", F.bround(G.distance_to_polygon(G.edges_of(poly), c("x_m"), c("y_m")), 6).alias("distance_m"))


SEGMENT_SQL = """sqrt(power(x_m - (ax + t*(bx-ax)), 2) + power(y_m - (ay + t*(by_-ay)), 2))"""
DIST_SQL = f"""{HITS_SQL}, zdist AS (
 SELECT det_id, zone_id, zone_ord, CASE WHEN h.det_id IS NOT NULL THEN 0.0E0 ELSE d END AS d FROM (
  SELECT det_id, zone_id, min(zone_ord) AS zone_ord, min({SEGMENT_SQL}) AS d FROM (
   SELECT det_id, zone_id, zone_ord, ax, ay, bx, by_, x_m, y_m, greatest(0.0E0, least(1.0E0,
    ((x_m-ax)*(bx-ax)+(y_m-ay)*(by_-ay))/((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)))) AS t FROM det, zone_edges) e
  GROUP BY det_id, zone_id) q LEFT JOIN (SELECT det_id, zone_id FROM hits) h USING (det_id, zone_id))"""


def inside_zones(spark, sf):
    return A.zones_of(detections(spark, sf), DEMO_SITE, ["det_id"]).select("det_id", "inside_zones")


def nearest_zone(spark, sf):
    return audit.nearest_zone(detections(spark, sf).select("det_id", "x_m", "y_m"), DEMO_SITE).select(
        "det_id", "nearest_zone", "distance_to_nearest_zone_m")


def plan_pixels(spark, sf):
    return detections(spark, sf).withColumn("_p", G.metres_to_plan(c("x_m"), c("y_m"), 42.3)).select(
        "det_id", "_p.px", "_p.py")


def coordinate_unit(spark, sf):
    """Unit of a coordinate set, by its largest absolute value (floor positions and boxes as two sets per camera)."""
    d = raw_detections(spark, sf)
    both = d.select("cam_id", F.explode(F.array(
        F.struct(F.lit("position").alias("set"), c("x_m").alias("a"), c("y_m").alias("b")),
        F.struct(F.lit("box").alias("set"), c("x1").alias("a"), c("y1").alias("b")))).alias("p"))
    return both.groupBy("cam_id", "p.set").agg(F.when(
        F.max(F.greatest(F.abs("p.a"), F.abs("p.b"))) > 50, "pixels").otherwise("metres").alias("unit"))


def camera_ids_from_files(spark, sf):
    n, k = c("det_id") % 12, c("det_id") % 5
    stem = F.when(k == 0, F.concat(F.lit("Camera_"), n.cast("string"), F.lit("_2.2_Record "), (n % 3).cast("string"))) \
        .when(k == 1, F.concat(F.lit("cam "), n.cast("string"))) \
        .when(k == 2, F.concat(F.lit("Hall Est "), n.cast("string"))) \
        .when(k == 3, F.concat(F.lit("cam_0"), (n % 10).cast("string"), F.lit("_20260506_131002"))) \
        .otherwise(F.concat(F.lit("Camera_"), n.cast("string"), F.lit("_1.10_20260303")))
    return raw_detections(spark, sf).select("det_id", stem.alias("stem")).select(
        "det_id", N.camera_id_from_file(c("stem")).alias("video_id"), N.base_camera_id(c("stem")).alias("base_id"))


FILES_SQL = f"""WITH {RAW_SQL}, s AS (SELECT det_id, CASE det_id % 5
  WHEN 0 THEN 'Camera_' || (det_id % 12) || '_2.2_Record ' || ((det_id % 12) % 3)
  WHEN 1 THEN 'cam ' || (det_id % 12) WHEN 2 THEN 'Hall Est ' || (det_id % 12)
  WHEN 3 THEN 'cam_0' || ((det_id % 12) % 10) || '_20260506_131002'
  ELSE 'Camera_' || (det_id % 12) || '_1.10_20260303' END AS stem FROM raw_det),
 p AS (SELECT *, regexp_extract(stem, '[Cc]am(?:era)?[\\s_]*(\\d+)', 1) AS num,
  regexp_extract(stem, '[Cc]am(?:era)?[\\s_]*\\d+[\\s_]+\\d+\\.\\d+[\\s_]+(.*)', 1) AS suf,
  regexp_extract(stem, 'cam_(\\d{{2}})', 1) AS two FROM s)
 SELECT det_id, CASE WHEN num = '' THEN lower(replace(stem, ' ', '_'))
   WHEN suf <> '' THEN 'cam_' || lpad(CAST(CAST(num AS BIGINT) AS VARCHAR), 2, '0') || '_' || lower(replace(suf, ' ', '_'))
   ELSE 'cam_' || lpad(CAST(CAST(num AS BIGINT) AS VARCHAR), 2, '0') END AS video_id,
  CASE WHEN two <> '' THEN 'cam_' || two
   WHEN num <> '' THEN 'cam_' || lpad(CAST(CAST(num AS BIGINT) AS VARCHAR), 2, '0') ELSE stem END AS base_id FROM p"""


def clock_text(spark, sf):
    ms = (c("det_id") * 137 % 7_200_000).cast("double")
    return raw_detections(spark, sf).select(
        "det_id", N.clock_text(ms).alias("clock"), F.bround(N.frame_to_seconds(c("det_id")), 3).alias("seconds"),
        N.seconds_to_frame(ms / 1000.0).alias("frame_no"))


def label_boxes(spark, sf):
    from sightgrid.operators.labels import label_lines

    boxes = raw_detections(spark, sf).select(
        "det_id", (c("det_id") % 7).alias("label_id"), c("x1").alias("x"), c("y1").alias("y"),
        (c("x2") - c("x1")).alias("w"), (c("y2") - c("y1")).alias("h"), F.lit(769.0).alias("img_w"),
        F.lit(577.0).alias("img_h"))
    return label_lines(boxes, ["det_id"])


WORDS = ["1", "", " Oui ", "no", "SAME", "incorrect", "", "n", "True", "0"]


def truth_flags(spark, sf):
    word = F.element_at(F.array(*map(F.lit, WORDS)), (c("det_id") % 10 + 1).cast("int"))
    alt = F.element_at(F.array(*map(F.lit, WORDS)), (c("det_id") % 7 + 1).cast("int"))
    d = raw_detections(spark, sf).select("det_id", N.truth_flag([word, alt]).alias("expected_same"))
    return d.where(c("expected_same").isNotNull())


def _words_sql(mod):
    return "CASE det_id % " + str(mod) + " " + " ".join(
        f"WHEN {i} THEN '{w}'" for i, w in enumerate(WORDS[:mod])) + " END"


def canonical_pairs(spark, sf):
    d = raw_detections(spark, sf)
    other = F.element_at(F.array(*[F.lit(x) for x in ("cam_07", "cam_02", "cam_05", "cam_03")]),
                         (c("user_mod") + 1).cast("int"))
    d = d.withColumn("user_mod", c("track_id") % 4).withColumn("other", other)
    d = d.withColumn("_p", N.canonical_pair(c("cam_id"), c("track_id"), c("other"), c("track_id") % 10))
    return d.groupBy("_p.cam_a", "_p.track_a", "_p.cam_b", "_p.track_b").agg(F.count(F.lit(1)).alias("n"))


def subsampled_frames(spark, sf):
    return detections(spark, sf).where(c("frame") % 5 == 0).groupBy("frame").agg(F.count(F.lit(1)).alias("detections"))


def safe_values(spark, sf):
    text = F.when(c("det_id") % 4 == 0, "").when(c("det_id") % 4 == 1, "n/a").otherwise(c("value").cast("string"))
    return raw_detections(spark, sf).groupBy("cam_id").agg(
        F.count(N.safe_double(text)).alias("readable"),
        F.bround(N.safe_div(F.sum(N.safe_double(text)), F.count(N.safe_double(text))), 6).alias("mean_value"),
        F.bround(N.safe_div(F.sum("value"), F.count(F.when(c("track_id") < 0, 1))), 6).alias("no_denominator"))


def neighbour_transfer(spark, sf):
    """Foot pixel of each detection moved to its overlap neighbours: own homography, then their inverse."""
    d = _with_camera(spark, detections(spark, sf)).select(
        "det_id", "cam_id", G.apply_homography(c("h"), (c("x1") + c("x2")) / 2, c("y2")).alias("m"))
    others = DEMO_SITE.camera_dim(spark).select(c("cam_id").alias("other_cam"), G.invert_homography(c("h")).alias("inv"))
    j = d.join(DEMO_SITE.neighbours(spark), "cam_id").join(DEMO_SITE.hint(others, len(DEMO_SITE.cameras)), "other_cam")
    return j.withColumn("_p", G.apply_homography(c("inv"), c("m.x"), c("m.y"))).select(
        "det_id", "other_cam", F.bround("_p.x", 2).alias("u"), F.bround("_p.y", 2).alias("v"))


TRANSFER_SQL = f"""WITH {DET_SQL}, {CAM_SQL}, {INV_SQL}, {OVERLAP_SQL}, m AS (
 SELECT det_id, cam_id, (h00*u+h01*y2+h02)/(h20*u+h21*y2+h22) AS x, (h10*u+h11*y2+h12)/(h20*u+h21*y2+h22) AS y
 FROM (SELECT *, (x1+x2)/2 AS u FROM det) d JOIN cams USING (cam_id)),
 nb AS (SELECT cam_a AS cam_id, cam_b AS other_cam FROM cam_overlaps UNION SELECT cam_b, cam_a FROM cam_overlaps)
 SELECT det_id, other_cam, round_even((i00*x+i01*y+i02)/(i20*x+i21*y+i22), 2) + 0.0E0 AS u,
  round_even((i10*x+i11*y+i12)/(i20*x+i21*y+i22), 2) + 0.0E0 AS v
 FROM m JOIN nb USING (cam_id) JOIN inv ON inv.cam_id = other_cam"""


def alert_log_lines(spark, sf):
    hits = A.zone_hits(detections(spark, sf), DEMO_SITE).withColumns({
        "alert_type": F.lit("zone_violation_person"), "alert_level": F.lit("confirmed"), "global_id": c("track_id"),
        "cameras": F.array("cam_id")})
    hits = hits.withColumn("alert_id", N.alert_id(
        c("run_id"), c("alert_type"), c("global_id"), c("zone_id"), c("class_name"), c("frame")))
    return hits.select("det_id", "zone_id", N.alert_log_line({k: c(k) for k in (
        "alert_id", "alert_type", "alert_level", "zone_id", "global_id", "x_m", "y_m", "cameras", "confidence")}).alias("line"))


LOG_SQL = f"""WITH {HITS_SQL} SELECT det_id, zone_id, 'Alert[' || substr(sha256(concat_ws(',', run_id,
  'zone_violation_person', track_id, zone_id, class_name, frame)), 1, 8) || '] zone_violation_person:confirmed zone='
  || zone_id || ' gid=' || track_id || ' pos=(' || printf('%.2f', x_m) || 'm,' || printf('%.2f', y_m) || 'm) cams='
  || cam_id || ' conf=' || printf('%.2f', confidence) AS line FROM det JOIN hits USING (det_id)"""


def end_to_end_latency(spark, sf):
    scene = F.when(c("det_id") % 3 != 0, c("ts_s") - (c("det_id") % 900) / 1000.0)
    return raw_detections(spark, sf).select("det_id", F.bround((c("ts_s") - scene) * 1000.0, 3).alias("e2e_ms"))


def visible_e2e(spark, sf):
    from sightgrid.operators.health import overlay_delay_ms, visible_e2e_ms

    per = detections(spark, sf).groupBy("frame").agg(
        F.max((c("det_id") * 31 % 1500).cast("double")).alias("video"), F.max(c("value")).alias("ai"),
        F.max((c("det_id") % 90).cast("double")).alias("delivery"))
    overlay = overlay_delay_ms(c("video"), 400.0, 20.0, 50.0)
    return per.select("frame", F.bround(overlay, 3).alias("overlay_ms"), F.bround(
        visible_e2e_ms(c("video"), c("ai"), c("delivery"), overlay), 3).alias("visible_ms"))


_H = "(h20*u+h21*v+h22)"
QUERIES = {
    "class_key": (class_key, f"""SELECT event_id AS det_id, CASE WHEN k IN ('person','persons','personne','personnes',
      'human','humain') THEN 'person' WHEN k = '' THEN cid ELSE k END AS class_key FROM (SELECT event_id,
      CASE WHEN event_type IN ('click','view') THEN '11' ELSE '5' END AS cid,
      trim(regexp_replace(replace(lower(strip_accents(CASE WHEN {SPELLED_SQL} = '' THEN
       CASE WHEN event_type IN ('click','view') THEN '11' ELSE '5' END ELSE {SPELLED_SQL} END)), '_', ' '), '\\s+', ' ', 'g'))
      AS k FROM events) q"""),
    "normalize_class": (normalize_class,
                        f"SELECT event_id AS det_id, trim(lower(strip_accents({SPELLED_SQL}))) AS class_norm FROM events"),
    "alert_class_key": (alert_class_key, f"SELECT event_id AS det_id, lower(trim({SPELLED_SQL})) AS object_key FROM events"),
    "fix_class_name": (fix_class_name, f"""SELECT det_id, class_fixed, CAST(list_position(['maillet','marteau',
      'niveau à bulle','scie','tabouret','téléphone','verre'], class_fixed) - 1 AS BIGINT) AS label_id FROM (
      SELECT event_id AS det_id, CASE l WHEN 'amrteau' THEN 'marteau' WHEN 'mailet' THEN 'maillet'
       WHEN 'maillety' THEN 'maillet' WHEN 'mailley' THEN 'maillet' WHEN 'télé^phone' THEN 'téléphone' WHEN '5' THEN 'verre'
       ELSE l END AS class_fixed FROM (SELECT event_id, {LABELS_SQL} AS l FROM events) a) b"""),
    "person_rules": (person_rules, f"""SELECT event_id AS det_id, event_type IN ('click','view') OR
      lower(trim({SPELLED_SQL})) IN ('person','personne','human','humain') AS person,
      trim(lower({SPELLED_SQL})) IN ('personne','person','persons','people') AS ignored,
      event_type IN ('car','truck','bicycle','motorcycle') AS vehicle,
      CASE WHEN event_type IN ('click','view') THEN 'person' ELSE 'object' END AS kind FROM events"""),
    "valid_detections": (valid_detections, f"""WITH {RAW_SQL} SELECT det_id, x1, y1, x2, y2, confidence FROM raw_det
      WHERE det_id % 11 <> 0 AND det_id % 13 <> 0"""),
    "foot_points": (foot_points, f"""WITH {RAW_SQL} SELECT det_id, (x1+x2)/2 AS foot_u, y2 AS foot_v,
      CAST(trunc((x1+x2)/2) AS BIGINT) AS px_u, CAST(trunc(y2) AS BIGINT) AS px_v FROM raw_det"""),
    "bbox_center_size": (bbox_center_size, f"""WITH {RAW_SQL} SELECT det_id, (x1+x2)/2 AS cu, (y1+y2)/2 AS cv,
      x2-x1 AS w, y2-y1 AS h FROM raw_det"""),
    "project_to_floor": (project_to_floor, f"""WITH {DET_SQL}, {CAM_SQL} SELECT det_id, cam_id,
      round_even((h00*u+h01*v+h02)/{_H}, 6) AS floor_x, round_even((h10*u+h11*v+h12)/{_H}, 6) AS floor_y
      FROM (SELECT *, (x1+x2)/2 AS u, y2 AS v FROM det) d JOIN cams USING (cam_id)"""),
    "floor_to_pixels": (floor_to_pixels, f"""WITH {DET_SQL}, {CAM_SQL}, {INV_SQL} SELECT det_id, cam_id,
      round_even((i00*x_m+i01*y_m+i02)/(i20*x_m+i21*y_m+i22), 2) AS u,
      round_even((i10*x_m+i11*y_m+i12)/(i20*x_m+i21*y_m+i22), 2) AS v FROM det JOIN inv USING (cam_id)"""),
    "pixel_zone_hits": (pixel_zone_hits, PIXEL_SQL),
    "rescaled_projection": (rescaled_projection, RESCALE_SQL),
    "aspect_corrected_boxes": (aspect_corrected_boxes, f"""WITH {RAW_SQL} SELECT det_id,
      CAST(round_even(x1*sx, 0) AS BIGINT) AS px1, CAST(y1 AS BIGINT) AS py1,
      CAST(round_even(x2*sx, 0) AS BIGINT) AS px2, CAST(y2 AS BIGINT) AS py2 FROM (SELECT *,
      CASE WHEN cam_id IN ('cam_02','cam_05') THEN 768.0E0/704.0E0 ELSE 1.0E0 END AS sx FROM raw_det) r"""),
    "zone_hits": (zone_hits, f"WITH {HITS_SQL} SELECT det_id, zone_id, x_m, y_m FROM hits JOIN det USING (det_id)"),
    "distance_to_zone": (distance_to_zone, f"""WITH {DIST_SQL} SELECT det_id, round_even(d, 6) AS distance_m FROM zdist
      WHERE zone_id = 'zone_2'"""),
    "inside_zones": (inside_zones, f"""WITH {HITS_SQL} SELECT det_id, coalesce(z, '') AS inside_zones FROM det LEFT JOIN (
      SELECT det_id, string_agg(zone_id, '+' ORDER BY zone_ord) AS z FROM hits GROUP BY det_id) h USING (det_id)"""),
    "nearest_zone": (nearest_zone, f"""WITH {DIST_SQL} SELECT det_id, arg_min(zone_id, (d, zone_ord)) AS nearest_zone,
      round_even(min(d), 4) AS distance_to_nearest_zone_m FROM zdist GROUP BY det_id"""),
    "plan_pixels": (plan_pixels, f"""WITH {DET_SQL} SELECT det_id, CAST(trunc(x_m*42.3E0) AS BIGINT) AS px,
      CAST(trunc(y_m*42.3E0) AS BIGINT) AS py FROM det"""),
    "coordinate_unit": (coordinate_unit, f"""WITH {RAW_SQL} SELECT cam_id, 'position' AS "set", CASE WHEN
      max(greatest(abs(x_m), abs(y_m))) > 50 THEN 'pixels' ELSE 'metres' END AS unit FROM raw_det GROUP BY cam_id
      UNION ALL SELECT cam_id, 'box', CASE WHEN max(greatest(abs(x1), abs(y1))) > 50 THEN 'pixels' ELSE 'metres' END
      FROM raw_det GROUP BY cam_id"""),
    "camera_ids_from_files": (camera_ids_from_files, FILES_SQL),
    "clock_text": (clock_text, """SELECT event_id AS det_id,
      printf('%02d:%02d.%03d', ms // 60000, (ms // 1000) % 60, ms % 1000) AS clock, round_even(event_id / 25.0E0, 3) AS seconds,
      CAST(floor(ms / 1000.0E0 * 25.0E0) AS BIGINT) AS frame_no
      FROM (SELECT event_id, event_id * 137 % 7200000 AS ms FROM events) e"""),
    "label_boxes": (label_boxes, f"""WITH {RAW_SQL} SELECT det_id, printf('%d %.6f %.6f %.6f %.6f', det_id % 7,
      greatest(0.0E0, least(1.0E0, (x1+(x2-x1)/2)/769.0E0)), greatest(0.0E0, least(1.0E0, (y1+(y2-y1)/2)/577.0E0)),
      greatest(0.0E0, least(1.0E0, (x2-x1)/769.0E0)), greatest(0.0E0, least(1.0E0, (y2-y1)/577.0E0))) AS line FROM raw_det"""),
    "truth_flags": (truth_flags, f"""WITH {RAW_SQL} SELECT det_id, lower(trim(w)) IN ('1','true','yes','y','oui','o','same',
      'correct') AS expected_same FROM (SELECT det_id, coalesce(nullif({_words_sql(10)}, ''), nullif({_words_sql(7)}, ''))
      AS w FROM raw_det) q WHERE w IS NOT NULL"""),
    "canonical_pairs": (canonical_pairs, f"""WITH {RAW_SQL}, p AS (SELECT cam_id AS ca, CAST(track_id AS VARCHAR) AS ta,
      CASE track_id % 4 WHEN 0 THEN 'cam_07' WHEN 1 THEN 'cam_02' WHEN 2 THEN 'cam_05' ELSE 'cam_03' END AS cb,
      CAST(track_id % 10 AS VARCHAR) AS tb FROM raw_det),
      o AS (SELECT *, (cb, tb) < (ca, ta) AS sw FROM p)
      SELECT CASE WHEN sw THEN cb ELSE ca END AS cam_a, CASE WHEN sw THEN tb ELSE ta END AS track_a,
      CASE WHEN sw THEN ca ELSE cb END AS cam_b, CASE WHEN sw THEN ta ELSE tb END AS track_b, count(*) AS n FROM o
      GROUP BY 1, 2, 3, 4"""),
    "subsampled_frames": (subsampled_frames, f"""WITH {DET_SQL} SELECT frame, count(*) AS detections FROM det
      WHERE frame % 5 = 0 GROUP BY frame"""),
    "safe_values": (safe_values, f"""WITH {RAW_SQL} SELECT cam_id, count(v) AS readable,
      round_even(coalesce(sum(v) / nullif(count(v), 0), 0.0E0), 6) AS mean_value, 0.0E0 AS no_denominator FROM (
      SELECT cam_id, CASE WHEN det_id % 4 IN (0, 1) THEN NULL ELSE value END AS v FROM raw_det) q GROUP BY cam_id"""),
    "neighbour_transfer": (neighbour_transfer, TRANSFER_SQL),
    "alert_log_lines": (alert_log_lines, LOG_SQL),
    "end_to_end_latency": (end_to_end_latency, f"""WITH {RAW_SQL} SELECT det_id, CASE WHEN det_id % 3 <> 0 THEN
      round_even((ts_s - (ts_s - (det_id % 900)/1000.0E0)) * 1000.0E0, 3) END AS e2e_ms FROM raw_det"""),
    "visible_e2e": (visible_e2e, f"""WITH {DET_SQL} SELECT frame, round_even(o, 3) AS overlay_ms,
      round_even(greatest(video, ai + delivery, o), 3) AS visible_ms FROM (SELECT *, CASE WHEN video > 0 THEN video + 70.0E0
      ELSE 400.0E0 END AS o FROM (SELECT frame, max(CAST(det_id*31 % 1500 AS DOUBLE)) AS video, max(value) AS ai,
      max(CAST(det_id % 90 AS DOUBLE)) AS delivery FROM det GROUP BY frame) a) b"""),
}
