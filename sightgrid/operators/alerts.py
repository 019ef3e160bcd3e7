"""Zone intrusions and forbidden objects: votes per frame, then edges between consecutive processed frames.

State that a sequential detector keeps between frames is expressed by letting each row meet its neighbour of the next
processed frame, so no window ever holds a whole entity.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightgrid.functions import names
from sightgrid.functions.geometry import point_in_polygon
from sightgrid.operators.ordered import FRAME_BUCKET, split_ordinal
from sightgrid.sources.site import Site

CELL_M = 1.0


@dataclass(frozen=True)
class AlertRules:
    person_ids: tuple[int, ...] = (0,)
    zone_min_votes: int = 1
    zone_min_ratio: float = 0.0
    object_min_votes: int = 2
    emit_weak: bool = True


def zone_hits(dets: DataFrame, site: Site, cell: float = CELL_M, min_points: int = 1) -> DataFrame:
    """Detections joined with every zone that contains them (border included)."""
    cells = site.zone_cells(dets.sparkSession, cell, min_points)
    keyed = dets.where(F.col("x_m").isNotNull() & F.col("y_m").isNotNull()).withColumns({
        "cell_x": F.floor(F.col("x_m") / cell), "cell_y": F.floor(F.col("y_m") / cell)})
    return keyed.join(cells, ["cell_x", "cell_y"]).where(
        point_in_polygon(F.col("edges"), F.col("x_m"), F.col("y_m"))
    ).drop("cell_x", "cell_y", "edges", "polygon")


def zones_of(dets: DataFrame, site: Site, key: list[str]) -> DataFrame:
    """``inside_zones`` per detection: zone ids in declared order, joined with ``+``."""
    hits = zone_hits(dets.select(*key, "x_m", "y_m"), site).groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("zone_ord", "zone_id"))).alias("_z")
    )
    return dets.join(hits, key, "left").withColumn(
        "inside_zones", F.coalesce(F.concat_ws("+", F.transform("_z", lambda z: z["zone_id"])), F.lit(""))
    ).drop("_z")


def _best(*fields: str) -> Column:
    """Fields of the most confident row, the earliest on ties."""
    return F.max_by(F.struct(*fields), F.struct(F.col("confidence"), -F.col("det_ord")))


def zone_presence(fused: DataFrame, site: Site, rules: AlertRules = AlertRules()) -> DataFrame:
    """Per (run, frame, entity, zone): best observation of the person and the covering cameras that voted."""
    persons = fused.where(
        names.is_person(F.col("class_id"), F.col("class_name"), list(rules.person_ids))
        & F.col("global_id").isNotNull()
    )
    covered = F.array_contains("zone_cameras", F.col("cam_id"))
    return zone_hits(persons, site).groupBy("run_id", "frame", "global_id", "zone_id").agg(
        _best("x_m", "y_m", "ts_s").alias("best"), F.max("confidence").alias("confidence"),
        F.array_sort(F.collect_set(F.when(covered, F.col("cam_id")))).alias("cameras"),
        F.max(F.size(F.array_distinct("zone_cameras"))).alias("n_cover"),
    ).select("run_id", "frame", "global_id", "zone_id", "best.x_m", "best.y_m", "best.ts_s", "confidence", "cameras",
             "n_cover")


def enough_votes(presence: DataFrame, rules: AlertRules = AlertRules()) -> DataFrame:
    required = F.greatest(
        F.lit(rules.zone_min_votes), F.ceil(F.col("n_cover") * rules.zone_min_ratio).cast("int"), F.lit(1)
    )
    return presence.where(F.size("cameras") >= required)


def object_presence(fused: DataFrame, rules: AlertRules = AlertRules()) -> DataFrame:
    """Per (run, frame, entity, class): best observation of a forbidden object, its cameras and alert level."""
    objects = fused.where(
        ~names.is_person(F.col("class_id"), F.col("class_name"), list(rules.person_ids))
        & ~names.is_allowed_vehicle(F.col("class_name"))
        & F.col("x_m").isNotNull() & F.col("global_id").isNotNull()
    ).withColumn("object_key", names.alert_class_key(F.col("class_name")))
    n = F.size("cameras")
    level = F.when(n >= rules.object_min_votes, "confirmed")
    if rules.emit_weak:
        level = level.when(n >= 1, "weak")
    return (
        objects.groupBy("run_id", "frame", "global_id", "object_key").agg(
            F.min_by("class_name", "det_ord").alias("class_name"), _best("x_m", "y_m", "ts_s").alias("best"),
            F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("cam_id")).alias("cameras"),
        )
        .withColumn("alert_level", level)
        .select("run_id", "frame", "global_id", "object_key", "class_name", "best.x_m", "best.y_m", "best.ts_s",
                "confidence", "cameras", "alert_level")
    )


def _beside_neighbour(here: DataFrame, keys: list[str], shift: int, neighbour: Column) -> DataFrame:
    """``_neighbour``: ``neighbour`` of the row with the same keys one processed frame before (``shift`` 1) or after (-1).

    Each row also leaves a marker at the frame it is the neighbour of; rows and markers of one (keys, frame) meet in a
    group of at most two, so one shuffle answers the question and no key is ever gathered.
    """
    both = here.withColumn("_neighbour", neighbour).withColumn("_m", F.explode(F.array(F.lit(0), F.lit(shift)))).withColumn(
        "_at", F.col("ord") + F.col("_m"))
    spot = Window.partitionBy(*keys, "_at")
    return both.withColumn("_neighbour", F.max(F.when(F.col("_m") != 0, F.col("_neighbour"))).over(spot)).where(
        "_m = 0").drop("_m", "_at")


def consecutive_difference(active: DataFrame, spine: DataFrame, keys: list[str], forward: bool = True) -> DataFrame:
    """Rows of ``active`` whose key is not active in the previous (or next) processed frame.

    ``spine`` lists every processed frame of a run with its ordinal, also those with nothing active.
    """
    here = active.join(spine, ["run_id", "frame"])
    return _beside_neighbour(here, keys, 1 if forward else -1, F.lit(True)).where(F.col("_neighbour").isNull()).drop(
        "_neighbour")


def zone_entries(voted: DataFrame, spine: DataFrame) -> DataFrame:
    return consecutive_difference(voted, spine, ["run_id", "global_id", "zone_id"])


def zone_exits(voted: DataFrame, spine: DataFrame) -> DataFrame:
    """Last frame of every stay that ends before the run does; ``resolved_ord`` is the frame that notices it."""
    keys = ["run_id", "global_id", "zone_id"]
    last = spine.groupBy("run_id").agg(F.max("ord").alias("_last"))
    gone = consecutive_difference(voted, spine, keys, forward=False).join(last, "run_id")
    return gone.where(F.col("ord") < F.col("_last")).withColumn("resolved_ord", F.col("ord") + 1).drop("_last")


def object_escalations(presence: DataFrame, spine: DataFrame) -> DataFrame:
    """Rows whose level differs from the previous processed frame's, unless that one was already confirmed."""
    keys = ["run_id", "global_id", "object_key"]
    here = presence.where(F.col("alert_level").isNotNull()).join(spine, ["run_id", "frame"])
    before = F.col("_neighbour")
    return _beside_neighbour(here, keys, 1, F.col("alert_level")).where(
        before.isNull() | ((before != F.col("alert_level")) & (before != "confirmed"))).drop("_neighbour")


ALERT_COLUMNS = ["run_id", "frame", "ts_s", "alert_id", "alert_type", "alert_level", "global_id", "zone_id",
                 "class_name", "x_m", "y_m", "cameras", "confidence"]


def alerts(fused: DataFrame, site: Site, rules: AlertRules, spine: DataFrame) -> DataFrame:
    """All new alerts of a run: people entering zones and objects appearing or escalating.

    ``spine`` numbers the frames that were processed (``frame_ordinals``), those without detections too: who is away in an
    empty frame enters anew in the next.
    """
    zone = zone_entries(enough_votes(zone_presence(fused, site, rules), rules), spine).select(
        "*", F.lit("zone_violation_person").alias("alert_type"), F.lit("confirmed").alias("alert_level"),
        F.lit("person").alias("class_name"),
    )
    objects = object_escalations(object_presence(fused, rules), spine).select(
        "*", F.lit("forbidden_object").alias("alert_type"), F.lit(None).cast("string").alias("zone_id")
    )
    both = zone.unionByName(objects, allowMissingColumns=True)
    return both.withColumn("alert_id", names.alert_id(
        F.col("run_id"), F.col("alert_type"), F.col("global_id"), F.col("zone_id"), F.col("class_name"), F.col("frame")
    )).select(*ALERT_COLUMNS)


def _with_halo(df: DataFrame, position: str, reach: int, width: int) -> DataFrame:
    """Cut ``position`` into buckets; the last ``reach`` positions of a bucket are repeated in the next as halo."""
    bucket = F.floor(F.col(position) / width).cast("bigint")
    near_end = F.col(position) % width >= width - reach
    return df.withColumn("_h", F.explode(F.when(near_end, F.array(bucket, bucket + 1)).otherwise(F.array(bucket)))) \
        .withColumn("_halo", F.col("_h") != bucket)


def persistence(positives: DataFrame, keys: list[str], n: int = 3, width: int = FRAME_BUCKET) -> DataFrame:
    """Positive frames that complete at least ``n`` consecutive ones; ``episode_start`` marks exactly the n-th.

    ``positives`` holds the positive frames by dense ordinal ``ord``, each once per key.
    """
    cut = _with_halo(positives, "ord", n, width)
    order = Window.partitionBy(*keys, "_h").orderBy("ord")
    counted = cut.withColumn("_n", F.count(F.lit(1)).over(order.rangeBetween(-(n - 1), 0))).withColumn(
        "_n1", F.count(F.lit(1)).over(order.rangeBetween(-n, 0)))
    return counted.where((F.col("_n") == n) & ~F.col("_halo")).withColumn(
        "episode_start", F.col("_n1") == n).drop("_n", "_n1", "_h", "_halo")


def track_trail(dets: DataFrame, length: int = 60, width: int = FRAME_BUCKET) -> DataFrame:
    """``trail``: the last ``length`` foot points of the track up to each detection, oldest first."""
    keys = ["run_id", "cam_id", "track_id"]
    points = dets.withColumn("_b", F.floor(F.col("frame") / width).cast("bigint"))
    placed = split_ordinal(points, keys, ["frame", "det_ord"], "_b", "_pos").drop("_b")
    cut = _with_halo(placed, "_pos", length - 1, width)
    upto = Window.partitionBy(*keys, "_h").orderBy("_pos").rowsBetween(-(length - 1), 0)
    return cut.withColumn("trail", F.collect_list("foot").over(upto)).where(~F.col("_halo")).drop(
        "_h", "_halo", "_pos")
