"""Calibration audit of alerts: zones containing them, nearest zone, worst camera error."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightgrid.functions.geometry import apply_homography, distance, distance_to_polygon, is_finite, point_in_polygon
from sightgrid.functions.zone_tree import ZoneTree
from sightgrid.sources.site import BROADCAST_ROWS, Site, Zone


def _cell_size(zones: list[Zone]) -> float:
    """Side of the floor cells: about four of them to a zone of an evenly filled floor."""
    xs, ys = [p[0] for z in zones for p in z.polygon], [p[1] for z in zones for p in z.polygon]
    wide, high = max(xs) - min(xs), max(ys) - min(ys)
    return max(math.sqrt(wide * high / len(zones)) / 2, max(wide, high) / 4096, 1e-6)


def near_zones(df: DataFrame, site: Site, min_points: int = 3, block_points: int = BROADCAST_ROWS) -> DataFrame:
    """``zones``: of each row's ``x_m, y_m`` the zones that contain it or may be its nearest, with their edges.

    Points are gathered into floor cells, and only the distinct cells look into the zones: a packed tree gives each cell those that no
    other zone keeps from being nearest to some point of it. Rows then meet their cell's few zones in an equi-join, so neither the
    plan nor the work of a row grows with the number of zones. A tree travels to the tasks with at most ``block_points`` corners (larger
    sites are cut into blocks, whose answers are merged by their bounds). NULL for rows without a finite position and where there is no zone.
    """
    zones = [(i, z) for i, z in enumerate([z for z in site.zones if len(z.polygon) >= min_points])]
    ddl = "zones array<struct<zone_ord:bigint,zone_id:string,e:array<struct<ax:double,ay:double,bx:double,by:double>>>>"
    if not zones:
        return df.withColumn("zones", F.lit(None).cast(ddl.split(" ", 1)[1]))
    cell = _cell_size([z for _, z in zones])
    placed = df.withColumns({f"_cell_{a}": F.when(is_finite(F.col("x_m")) & is_finite(F.col("y_m")), F.rint(F.col(f"{a}_m") / cell))
                             for a in "xy"})
    cells = placed.where(F.col("_cell_x").isNotNull()).select("_cell_x", "_cell_y").distinct()

    blocks, points = [[]], 0
    for entry in zones:
        if blocks[-1] and points + len(entry[1].polygon) > block_points:
            blocks.append([])
            points = 0
        blocks[-1].append(entry)
        points += len(entry[1].polygon)

    def looked_up(block: list[tuple[int, Zone]]) -> DataFrame:
        rings = [[(float(x), float(y)) for x, y in z.polygon] for _, z in block]
        heads = [(i, z.zone_id) for i, z in block]

        def run(batches):
            tree = ZoneTree(rings)
            for batch in batches:
                rows = []
                for cx, cy in zip(batch["_cell_x"], batch["_cell_y"]):
                    # a cell reaches half a side around its middle, and a hair more for rounding
                    rx, ry = (cell * 0.500001 + abs(v) * cell * 1e-12 for v in (cx, cy))
                    found, bound = tree.candidates((cx * cell - rx, cy * cell - ry, cx * cell + rx, cy * cell + ry))
                    for low, k in found:
                        edges = [(*p, *q) for p, q in zip(rings[k], rings[k][1:] + rings[k][:1])]
                        rows.append((cx, cy, low, bound, *heads[k], [dict(zip(("ax", "ay", "bx", "by"), e)) for e in edges]))
                yield pd.DataFrame(rows, columns=["_cell_x", "_cell_y", "low", "bound", "zone_ord", "zone_id", "e"])

        return cells.mapInPandas(run, "_cell_x double, _cell_y double, low double, bound double, zone_ord bigint, zone_id string, "
                                      "e array<struct<ax:double,ay:double,bx:double,by:double>>")

    found = looked_up(blocks[0])
    for block in blocks[1:]:
        found = found.unionByName(looked_up(block))
    met = found.groupBy("_cell_x", "_cell_y").agg(
        F.min("bound").alias("_bound"), F.array_sort(F.collect_list(F.struct("zone_ord", "zone_id", "e", "low"))).alias("_all"))
    kept = F.transform(F.filter("_all", lambda z: z["low"] <= F.col("_bound")), lambda z: F.struct(
        z["zone_ord"].alias("zone_ord"), z["zone_id"].alias("zone_id"), z["e"].alias("e")))
    return placed.join(met.select("_cell_x", "_cell_y", kept.alias("zones")), ["_cell_x", "_cell_y"], "left").select(*df.columns, "zones")


def _with_nearest(df: DataFrame) -> DataFrame:
    best = F.array_min(F.transform("zones", lambda z: F.struct(
        distance_to_polygon(z["e"], F.col("x_m"), F.col("y_m")).alias("d"), z["zone_ord"].alias("o"),
        z["zone_id"].alias("zone_id"))))
    return df.withColumn("_best", best).withColumns({
        "nearest_zone": F.col("_best.zone_id"), "distance_to_nearest_zone_m": F.bround("_best.d", 4)}).drop("_best", "zones")


def nearest_zone(df: DataFrame, site: Site) -> DataFrame:
    """``nearest_zone`` and its distance (0 inside); the first declared zone on equal distance, NULL without a position."""
    return _with_nearest(near_zones(df, site))


def worst_calibration_error(alerts: DataFrame, site: Site) -> DataFrame:
    """Largest mean and largest maximum error among the cameras of each alert."""
    dim = site.camera_dim(alerts.sparkSession).select("cam_id", "mean_error_cm", "max_error_cm")
    worst = alerts.select("alert_key", F.explode("cameras").alias("cam_id")).join(dim, "cam_id").groupBy(
        "alert_key").agg(F.bround(F.max("mean_error_cm"), 2).alias("worst_mean_error_cm"),
                         F.bround(F.max("max_error_cm"), 2).alias("worst_max_error_cm"))
    return alerts.join(worst, "alert_key", "left")


def audit_alerts(alerts: DataFrame, site: Site, dedupe: bool = False) -> DataFrame:
    """Every alert with its containing zones, whether the declared zone agrees, nearest zone and worst error.

    A log names an alert twice when both the detector and the campaign wrote it; ``dedupe`` keeps the first line.
    """
    if dedupe:
        first = alerts.groupBy("alert_id").agg(F.min("alert_key").alias("alert_key"))
        alerts = alerts.join(first, ["alert_id", "alert_key"], "left_semi")
    inside = F.filter("zones", lambda z: point_in_polygon(z["e"], F.col("x_m"), F.col("y_m")))
    named = F.coalesce(F.transform(inside, lambda z: z["zone_id"]), F.array().cast("array<string>"))
    checked = near_zones(alerts, site).withColumn("_in", named).withColumns({
        "inside_zones": F.concat_ws("+", F.col("_in")), "inside_any_zone": F.size("_in") > 0,
        "expected_zone_ok": F.when(
            F.col("alert_type") == "zone_violation_person",
            F.coalesce(F.array_contains("_in", F.nullif("declared_zone", F.lit(""))), F.lit(False))).otherwise(True),
    }).drop("_in")
    return worst_calibration_error(_with_nearest(checked), site)


def audit_by_camera(audited: DataFrame, site: Site) -> DataFrame:
    dim = site.camera_dim(audited.sparkSession).select("cam_id", "mean_error_cm", "max_error_cm")
    return audited.select(F.explode("cameras").alias("cam_id"), "inside_any_zone").groupBy("cam_id").agg(
        F.count(F.lit(1)).alias("alerts"), F.count(F.when(~F.col("inside_any_zone"), 1)).alias("outside_any_zone")
    ).join(dim, "cam_id", "left")


def audit_by_type(audited: DataFrame) -> DataFrame:
    return audited.groupBy("alert_type").agg(
        F.count(F.lit(1)).alias("alerts"),
        F.count(F.when(~F.col("expected_zone_ok"), 1)).alias("outside_declared_zone"))


def suspicious_alerts(audited: DataFrame, limit: int = 10) -> DataFrame:
    """The first person alerts that lie outside their declared zone."""
    return audited.where(~F.col("expected_zone_ok")).orderBy("alert_key").limit(limit)


def reprojection_report(points: DataFrame, site: Site) -> DataFrame:
    """Per camera mean and max floor error (cm) of reference points and the verdict band of the mean."""
    dim = site.camera_dim(points.sparkSession).select("cam_id", "h")
    err = points.join(dim, "cam_id").withColumn("_p", apply_homography(F.col("h"), F.col("u"), F.col("v"))).withColumn(
        "_e", distance(F.col("_p.x"), F.col("_p.y"), F.col("x_m"), F.col("y_m")) * 100)
    mean = F.avg("_e")
    return err.groupBy("cam_id").agg(
        F.count("_e").alias("n_points"), F.bround(mean, 4).alias("mean_error_cm"),
        F.bround(F.max("_e"), 4).alias("max_error_cm"),
        F.when(mean < 5, "EXCELLENT").when(mean < 10, "BON").when(mean < 20, "MOYEN").otherwise("MAUVAIS").alias("verdict"))


def reference_point_checks(points: DataFrame, min_points: int = 4) -> DataFrame:
    """Per camera: enough distinct points (6 decimals), not all at the origin."""
    # distinct first: a hot camera is reduced before it is counted
    distinct = points.groupBy("cam_id", F.bround("x_m", 6).alias("x"), F.bround("y_m", 6).alias("y")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.greatest(F.abs("x_m"), F.abs("y_m"))).alias("far"))
    return distinct.groupBy("cam_id").agg(
        F.sum("n").alias("n_points"), F.count(F.lit(1)).alias("distinct_points"),
        ((F.count(F.lit(1)) >= min_points) & (F.max("far") > 1e-8)).alias("usable"))
