"""Which calibrated matrix a frame is projected with, and polygons moved from one camera's image to its neighbours'."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightgrid.functions.geometry import (
    apply_homography, invert_homography, project_polygon, rescale_homography, resolution_distance,
)
from sightgrid.sources.site import Site

RESOLUTION_TOLERANCE_PX = 2


def _same_resolution(aw: Column, ah: Column, bw: Column, bh: Column) -> Column:
    def near(a: Column, b: Column) -> Column:
        return F.abs(a.cast("bigint") - b.cast("bigint")) <= RESOLUTION_TOLERANCE_PX

    return F.coalesce(near(aw, bw) & near(ah, bh), F.lit(False))


def choose_homography(df: DataFrame, site: Site, width: Column, height: Column) -> DataFrame:
    """``h``, ``matrix_name`` and ``is_hd`` for frames of the given size (``cam_id``); NULL for a camera without a matrix.

    A matrix calibrated at the frame's resolution is taken as it is, the HD one first. Otherwise the one whose resolution is
    nearest is rescaled (HD on equal distance); without any resolution the substream matrix is used, then the HD one.
    """
    dim = site.matrix_dim(df.sparkSession)
    sub_name = F.concat("cam_id", F.lit("_matrix"))

    def answer(h: Column, name: Column, hd: bool) -> Column:
        return F.struct(h.alias("h"), name.alias("name"), F.lit(hd).alias("hd"))

    def rescaled(side: str, name: Column, hd: bool) -> Column:
        w, h = F.col(f"{side}_w").cast("bigint"), F.col(f"{side}_h").cast("bigint")
        return answer(rescale_homography(F.col(side), w, h, width.cast("bigint"), height.cast("bigint")),
                      F.concat(name, F.lit("_scaled")), hd)

    known = {s: F.col(s).isNotNull() & F.col(f"{s}_w").isNotNull() for s in ("hd", "sub")}
    far = {s: resolution_distance(width, height, F.col(f"{s}_w"), F.col(f"{s}_h")) for s in ("hd", "sub")}
    fits = {s: known[s] & _same_resolution(width, height, F.col(f"{s}_w"), F.col(f"{s}_h")) for s in ("hd", "sub")}
    hd_name = F.lit("matrix_hd")
    choice = (
        F.when(fits["hd"], answer(F.col("hd"), hd_name, True))
        .when(fits["sub"], answer(F.col("sub"), sub_name, False))
        .when(known["hd"] & (~known["sub"] | (far["hd"] <= far["sub"])), rescaled("hd", hd_name, True))
        .when(known["sub"], rescaled("sub", sub_name, False))
        .when(F.col("sub").isNotNull(), answer(F.col("sub"), sub_name, False))
        .when(F.col("hd").isNotNull(), answer(F.col("hd"), hd_name, True)))
    return df.join(dim, "cam_id", "left").withColumn("_choice", choice).select(
        *df.columns, F.col("_choice.h").alias("h"), F.col("_choice.name").alias("matrix_name"), F.col("_choice.hd").alias("is_hd"))


def transfer_polygons(polygons: DataFrame, site: Site) -> DataFrame:
    """Each pixel ``polygon`` of ``cam_id`` in the image of every overlap neighbour (``other_cam``), in whole pixels.

    Points go through the camera's matrix to the floor and through the neighbour's inverse to its image and are cut to whole pixels;
    points without an image are left out. Cameras without a matrix or without neighbours give no row.
    """
    spark = polygons.sparkSession
    own = site.camera_dim(spark).where(F.col("h").isNotNull()).select("cam_id", F.col("h").alias("_h"))
    others = site.camera_dim(spark).select(F.col("cam_id").alias("other_cam"), invert_homography(F.col("h")).alias("_inv")).where(
        F.col("_inv").isNotNull())
    routes = own.join(site.neighbours(spark), "cam_id").join(others, "other_cam")  # one row per overlap and direction
    moved = polygons.join(Site.hint(routes, 2 * len(site.overlaps)), "cam_id").withColumn(
        "_floor", project_polygon(F.col("_h"), F.col("polygon"), None)).withColumn(
        "_px", F.transform("_floor", lambda p: apply_homography(F.col("_inv"), p["x"], p["y"])))
    whole = F.transform(F.filter("_px", lambda p: p.isNotNull()), lambda p: F.struct(
        p["x"].cast("bigint").alias("x"), p["y"].cast("bigint").alias("y")))
    return moved.withColumn("polygon", whole).select(*polygons.columns, "other_cam")


def every_nth_frame(df: DataFrame, n: int) -> DataFrame:
    """Rows of every ``n``-th frame number; ``n`` below one keeps all."""
    return df.where(F.col("frame") % max(1, n) == 0)


def every_seconds(df: DataFrame, seconds: float, fps: float) -> DataFrame:
    """Rows of one frame per ``seconds`` of a video: the step is cut to whole frames, one at least."""
    return every_nth_frame(df, int(fps * seconds))


def end_to_end_ms(alert_epoch: Column, scene_epoch: Column) -> Column:
    """Time from the scene (read off by hand) to the alert; NULL where either is unknown."""
    return F.bround((alert_epoch - scene_epoch) * 1000.0, 3)
