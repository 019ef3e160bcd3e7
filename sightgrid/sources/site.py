"""Site dimensions: rooms, camera overlaps, zones, homographies, aspect corrections.

A site is described by a small configuration that people write by hand, so its row counts are known before any
DataFrame exists. ``Site.hint`` broadcasts a dimension only while that known count is below a limit; past it the
same equi-joins run as shuffled joins.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightgrid.functions.geometry import H_FIELDS, edges_of

BROADCAST_ROWS = 100_000

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
HOMOGRAPHY = T.StructType([T.StructField(n, T.DoubleType()) for n in H_FIELDS])

ZONE_SCHEMA = T.StructType([
    T.StructField("zone_id", T.StringType()), T.StructField("zone_ord", T.LongType()),
    T.StructField("zone_name", T.StringType()), T.StructField("zone_cameras", T.ArrayType(T.StringType())),
    T.StructField("polygon", T.ArrayType(POINT)),
])
CAMERA_SCHEMA = T.StructType([
    T.StructField("cam_id", T.StringType()), T.StructField("room_id", T.StringType()),
    T.StructField("h", HOMOGRAPHY), T.StructField("mean_error_cm", T.DoubleType()),
    T.StructField("max_error_cm", T.DoubleType()), T.StructField("calib_w", T.DoubleType()),
    T.StructField("calib_h", T.DoubleType()),
])
MATRIX_SCHEMA = T.StructType([T.StructField("cam_id", T.StringType())] + [
    T.StructField(side + part, kind) for side in ("sub", "hd")
    for part, kind in (("", HOMOGRAPHY), ("_w", T.DoubleType()), ("_h", T.DoubleType()))])
OVERLAP_SCHEMA = T.StructType([
    T.StructField("room_id", T.StringType()), T.StructField("pair_ord", T.LongType()),
    T.StructField("cam_a", T.StringType()), T.StructField("cam_b", T.StringType()),
])


@dataclass(frozen=True)
class Zone:
    zone_id: str
    name: str
    cameras: list[str]
    polygon: list[tuple[float, float]]


@dataclass(frozen=True)
class Camera:
    cam_id: str
    room_id: str | None = None
    matrix: list[float] | None = None
    mean_error_cm: float | None = None
    max_error_cm: float | None = None
    resolution: tuple[float, float] | None = None
    matrix_hd: list[float] | None = None
    hd_resolution: tuple[float, float] | None = None


@dataclass(frozen=True)
class Site:
    cameras: list[Camera]
    overlaps: list[tuple[str, str, str]]
    zones: list[Zone]
    corrected_cameras: list[str] = field(default_factory=list)
    corrected_resolution: tuple[float, float] = (768.0, 576.0)

    @staticmethod
    def hint(df: DataFrame, rows: int) -> DataFrame:
        """Broadcast a dimension of known size: rows of bounded width, or corners where rows carry polygons (some 50 bytes each)."""
        return F.broadcast(df) if rows <= BROADCAST_ROWS else df

    def camera_dim(self, spark: SparkSession) -> DataFrame:
        rows = [
            (c.cam_id, c.room_id, tuple(map(float, c.matrix)) if c.matrix else None, c.mean_error_cm, c.max_error_cm,
             c.resolution[0] if c.resolution else None, c.resolution[1] if c.resolution else None)
            for c in self.cameras
        ]
        return self.hint(spark.createDataFrame(rows, CAMERA_SCHEMA), len(rows))

    def matrix_dim(self, spark: SparkSession) -> DataFrame:
        """Both calibrations of every camera: substream and HD matrix with the resolutions they were made at."""
        rows = [
            (c.cam_id, *[v for m, r in ((c.matrix, c.resolution), (c.matrix_hd, c.hd_resolution))
                         for v in (tuple(map(float, m)) if m else None, *(map(float, r) if r else (None, None)))])
            for c in self.cameras
        ]
        return self.hint(spark.createDataFrame(rows, MATRIX_SCHEMA), len(rows))

    def overlap_dim(self, spark: SparkSession) -> DataFrame:
        rows = [(room, i, a, b) for i, (room, a, b) in enumerate(self.overlaps)]
        return self.hint(spark.createDataFrame(rows, OVERLAP_SCHEMA), len(rows))

    def room_pairs(self, spark: SparkSession) -> DataFrame:
        """One row per room with its overlapping camera pairs, in declared order."""
        rooms: dict[str, list[tuple[str, str]]] = {}
        for room, a, b in self.overlaps:
            rooms.setdefault(room, []).append((a, b))
        rows = list(rooms.items())
        return self.hint(
            spark.createDataFrame(rows, "room_id string, pairs array<struct<cam_a:string,cam_b:string>>"), len(rows)
        )

    def overlap_rooms(self, spark: SparkSession) -> DataFrame:
        """Room of every camera that overlaps another one."""
        rows = sorted({(cam, room) for room, a, b in self.overlaps for cam in (a, b)})
        return self.hint(spark.createDataFrame(rows, "cam_id string, room_id string"), len(rows))

    def neighbours(self, spark: SparkSession) -> DataFrame:
        """Overlap partners of every camera, both directions, each once."""
        rows = sorted({(a, b) for _, a, b in self.overlaps} | {(b, a) for _, a, b in self.overlaps})
        return self.hint(spark.createDataFrame(rows, "cam_id string, other_cam string"), len(rows))

    def _zone_rows(self, min_points: int) -> list[tuple]:
        return [
            (z.zone_id, i, z.name, list(z.cameras), [(float(x), float(y)) for x, y in z.polygon])
            for i, z in enumerate(self.zones) if len(z.polygon) >= min_points
        ]

    def zone_dim(self, spark: SparkSession, min_points: int = 1) -> DataFrame:
        rows = self._zone_rows(min_points)
        return self.hint(
            spark.createDataFrame(rows, ZONE_SCHEMA).withColumn("edges", edges_of(F.col("polygon"))),
            sum(1 + len(r[4]) for r in rows)
        )

    def zone_cells(self, spark: SparkSession, cell: float, min_points: int = 1) -> DataFrame:
        """One row per (zone, grid cell its bounding box touches); joining on the cell replaces a theta join."""
        rows = []
        for z in self._zone_rows(min_points):
            xs, ys = [p[0] for p in z[4]], [p[1] for p in z[4]]
            for cx in range(math.floor((min(xs) - 1e-6) / cell), math.floor((max(xs) + 1e-6) / cell) + 1):
                for cy in range(math.floor((min(ys) - 1e-6) / cell), math.floor((max(ys) + 1e-6) / cell) + 1):
                    rows.append((*z, cx, cy))
        schema = T.StructType([
            *ZONE_SCHEMA.fields, T.StructField("cell_x", T.LongType()), T.StructField("cell_y", T.LongType())
        ])
        df = spark.createDataFrame(rows, schema).withColumn("edges", edges_of(F.col("polygon")))
        return self.hint(df, sum(1 + len(r[4]) for r in rows))


def site_from_config(config: dict) -> Site:
    """Read a site from the parsed YAML layout (rooms, camera_overlaps, zones_interdites, homographie,
    aspect_ratio_fix). Malformed overlap pairs are skipped; a nested matrix wins over a flat ``<cam>_matrix``.
    """
    rooms = {c: r for r, v in (config.get("rooms") or {}).items() for c in v.get("cameras", [])}
    homographies = config.get("homographie") or {}
    cam_ids = sorted(
        set(rooms)
        | {k.removesuffix("_matrix") for k, v in homographies.items() if k.endswith("_matrix") or isinstance(v, dict)}
    )
    cameras = []
    for cam in cam_ids:
        nested = homographies.get(cam)
        nested = nested if isinstance(nested, dict) else {}
        matrix = nested.get("matrix") or homographies.get(f"{cam}_matrix")
        sizes = [nested.get(k) for k in ("substream_resolution", "hd_resolution")]
        sub_size, hd_size = [tuple(map(float, r)) if r and len(r) == 2 else None for r in sizes]
        flat, flat_hd = [[float(v) for row in m for v in row] if m else None for m in (matrix, nested.get("matrix_hd"))]
        cameras.append(Camera(cam, rooms.get(cam), flat, nested.get("mean_error_cm"), nested.get("max_error_cm"), sub_size,
                              flat_hd, hd_size))
    overlaps = [
        (room, pair[0], pair[1])
        for room, pairs in (config.get("camera_overlaps") or {}).items() for pair in pairs or [] if len(pair) == 2
    ]
    zones = [
        Zone(zid, z.get("nom", zid), list(z.get("cameras_concernees") or []),
             [tuple(p) for p in z.get("coordonnees_metres") or []])
        for zid, z in (config.get("zones_interdites") or {}).items()
    ]
    fix = config.get("aspect_ratio_fix") or {}
    enabled = fix.get("enabled", False)
    return Site(
        cameras, overlaps, zones, list(fix.get("distorted_cameras", [])) if enabled else [],
        tuple(map(float, fix["corrected_resolution"])) if enabled else (768.0, 576.0),
    )


def load_site(path: str) -> Site:
    import yaml

    with open(path, encoding="utf-8") as fh:
        return site_from_config(yaml.safe_load(fh) or {})
