"""Readers for the given parquet tables and the camera view over ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightgrid.session import ship_package
from sightgrid.sources.site import Camera, Site, Zone


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_seconds(ts: str = "ts"):
    return F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1e6)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as a file stream."""
    batch = table(spark, sf_dir, "events")
    return spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def raw_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a detection of one of four cameras (no de-duplication)."""
    return as_detections(table(spark, sf_dir, "events"))


def as_detections(events: DataFrame) -> DataFrame:
    e, uid = F.col("event_id"), F.col("user_id")
    person = F.col("event_type").isin("click", "view")
    cams = [(0, "cam_02"), (1, "cam_03"), (2, "cam_05")]
    cam = F.when(e % 4 == cams[0][0], cams[0][1])
    for k, name in cams[1:]:
        cam = cam.when(e % 4 == k, name)
    box_w, box_h = (20 + e % 60).cast("double"), (40 + e % 90).cast("double")
    x1, y1 = ((e * 13) % 700).cast("double"), ((e * 29) % 480).cast("double")
    return events.select(
        F.lit("session_1").alias("run_id"), F.concat(F.lit("model_"), (uid % 3).cast("string")).alias("model"),
        e.alias("det_id"), F.floor(epoch_seconds() / 3600).cast("bigint").alias("frame"),
        epoch_seconds().alias("ts_s"), cam.otherwise("cam_07").alias("cam_id"), (uid % 40).alias("track_id"),
        F.when(person, 11).otherwise(5).cast("bigint").alias("class_id"),
        F.when(person, "personne").otherwise(F.col("event_type")).alias("class_name"),
        ((50 + (e * 7) % 50).cast("double") / 100).alias("confidence"),
        x1.alias("x1"), y1.alias("y1"), (x1 + box_w).alias("x2"), (y1 + box_h).alias("y2"),
        (4.0 + (F.round(F.col("value") * 100).cast("bigint") % 500).cast("double") / 100).alias("x_m"),
        (2.0 + ((e * 37) % 500).cast("double") / 100).alias("y_m"),
        F.col("event_type"), F.col("value"), F.col("ts").cast("timestamp").alias("event_time"),
        ((e % 4) * F.lit(10**12) + e).alias("det_ord"),
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camera view: one detection per (frame, camera, track, class), the most confident one."""
    best = Window.partitionBy("frame", "cam_id", "track_id", "class_name").orderBy(F.desc("confidence"), "det_id")
    return (
        raw_detections(spark, sf_dir).withColumn("_rn", F.row_number().over(best)).where("_rn = 1").drop("_rn")
    )


# the same views for the SQL check
RAW_SQL = """raw_det AS (
 SELECT 'session_1' AS run_id, 'model_' || CAST(user_id % 3 AS VARCHAR) AS model, event_id AS det_id,
  CAST(floor(epoch(ts) / 3600) AS BIGINT) AS frame, epoch(ts) AS ts_s,
  CASE event_id % 4 WHEN 0 THEN 'cam_02' WHEN 1 THEN 'cam_03' WHEN 2 THEN 'cam_05' ELSE 'cam_07' END AS cam_id,
  CAST(user_id % 40 AS BIGINT) AS track_id,
  CAST(CASE WHEN event_type IN ('click', 'view') THEN 11 ELSE 5 END AS BIGINT) AS class_id,
  CASE WHEN event_type IN ('click', 'view') THEN 'personne' ELSE event_type END AS class_name,
  CAST(50 + (event_id * 7) % 50 AS DOUBLE) / 100 AS confidence,
  CAST((event_id * 13) % 700 AS DOUBLE) AS x1, CAST((event_id * 29) % 480 AS DOUBLE) AS y1,
  CAST((event_id * 13) % 700 AS DOUBLE) + CAST(20 + event_id % 60 AS DOUBLE) AS x2,
  CAST((event_id * 29) % 480 AS DOUBLE) + CAST(40 + event_id % 90 AS DOUBLE) AS y2,
  4.0E0 + CAST(CAST(round(value * 100) AS BIGINT) % 500 AS DOUBLE) / 100 AS x_m,
  2.0E0 + CAST((event_id * 37) % 500 AS DOUBLE) / 100 AS y_m,
  event_type, value, (event_id % 4) * 1000000000000 + event_id AS det_ord
 FROM events)"""
DET_SQL = RAW_SQL + """, det AS (
 SELECT * EXCLUDE (rn) FROM (
  SELECT r.*, row_number() OVER (PARTITION BY frame, cam_id, track_id, class_name ORDER BY confidence DESC, det_id)
   AS rn FROM raw_det r) q WHERE rn = 1)"""

# Site of the camera view: four cameras of one room, two zones (a rectangle and a concave shape). The matrices,
# polygons and errors below are test constants of this repository.
DEMO_SITE = Site(
    cameras=[
        Camera("cam_02", "room_1", [0.0125, 0.0004, 0.5, 0.0002, 0.0131, 0.3, 0.00001, 0.00004, 1.0], 2.5, 4.0,
               (768.0, 576.0)),
        Camera("cam_03", "room_1", [0.0114, -0.0003, 1.1, 0.0005, 0.0122, 0.9, -0.00002, 0.00005, 1.0], 9.5, 20.25,
               (768.0, 576.0)),
        Camera("cam_05", "room_1", [0.0133, 0.0011, 0.2, -0.0004, 0.0119, 1.4, 0.00003, -0.00002, 1.0], 1.5, 3.25,
               (704.0, 576.0)),
        Camera("cam_07", "room_1", [0.0109, 0.0002, 0.8, 0.0001, 0.0127, 0.1, -0.00004, 0.00001, 1.0], 3.75, 6.25,
               (1920.0, 1080.0)),
    ],
    overlaps=[("room_1", a, b) for i, a in enumerate(["cam_02", "cam_03", "cam_05", "cam_07"])
              for b in ["cam_02", "cam_03", "cam_05", "cam_07"][i + 1:]],
    zones=[
        Zone("zone_1", "entrance", ["cam_02", "cam_03", "cam_05", "cam_07"], [(6, 3), (8, 3), (8, 5), (6, 5)]),
        Zone("zone_2", "bench", ["cam_03", "cam_05"], [(4.5, 5.5), (8.5, 5.5), (8.5, 6.8), (7.0, 6.0), (4.5, 6.8)]),
    ],
    corrected_cameras=["cam_02", "cam_05"],
)


def _quoted(values) -> str:
    return ", ".join("(" + ", ".join(
        "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v:.10f}E0"
        if isinstance(v, float) else str(v) for v in row) + ")" for row in values)


def _edges(site: Site):
    for i, z in enumerate(site.zones):
        n = len(z.polygon)
        for k in range(n):
            (ax, ay), (bx, by_) = z.polygon[k], z.polygon[(k + 1) % n]
            yield z.zone_id, i, k, float(ax), float(ay), float(bx), float(by_)


ZONE_SQL = (
    "zone_edges(zone_id, zone_ord, edge_ord, ax, ay, bx, by_) AS (VALUES " + _quoted(_edges(DEMO_SITE)) + "), "
    "zone_cams(zone_id, cam_id) AS (VALUES " + _quoted((z.zone_id, c) for z in DEMO_SITE.zones for c in z.cameras)
    + ")"
)
CAM_SQL = "cams(cam_id, h00, h01, h02, h10, h11, h12, h20, h21, h22, mean_error_cm, max_error_cm, cw, ch) AS (VALUES " \
    + _quoted((c.cam_id, *c.matrix, c.mean_error_cm, c.max_error_cm, *c.resolution) for c in DEMO_SITE.cameras) + ")"
OVERLAP_SQL = "cam_overlaps(room_id, cam_a, cam_b) AS (VALUES " + _quoted(DEMO_SITE.overlaps) + ")"

ON_EDGE_SQL = (
    "(abs((bx - ax) * (y_m - ay) - (by_ - ay) * (x_m - ax)) <= 1e-9 AND x_m BETWEEN least(ax, bx) AND greatest(ax, bx)"
    " AND y_m BETWEEN least(ay, by_) AND greatest(ay, by_))"
)
CROSS_SQL = (
    "((ay > y_m) <> (by_ > y_m) AND x_m < (bx - ax) * (y_m - ay) / nullif(by_ - ay, 0) + ax)"
)
# (det row, zone) pairs with the point inside or on the border
HITS_SQL = DET_SQL + ", " + ZONE_SQL + f""", hits AS (
 SELECT det_id, zone_id, min(zone_ord) AS zone_ord FROM det, zone_edges
 GROUP BY det_id, zone_id
 HAVING bool_or({ON_EDGE_SQL}) OR count(*) FILTER (WHERE {CROSS_SQL}) % 2 = 1)"""
