"""Fusion-threshold sweeps: the pairing is solved once, every distance limit replays identities on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightgrid.functions import names
from sightgrid.operators.fusion import optimal_links
from sightgrid.operators.identity import assign_global_ids
from sightgrid.operators.matching import event_metrics, pair_counts
from sightgrid.session import cut_lineage
from sightgrid.sources.site import Site

THRESHOLDS_CM = (50, 100, 150, 200)
_SEP = "\u0001"


def _per_threshold(df: DataFrame, thresholds: tuple[int, ...]) -> DataFrame:
    """Repeat ``df`` per threshold; the threshold becomes part of the run key."""
    return df.withColumn("threshold_cm", F.explode(F.array(*[F.lit(t).cast("bigint") for t in thresholds]))).withColumn(
        "run_id", F.concat_ws(_SEP, "run_id", F.col("threshold_cm").cast("string")))


def _split_run(df: DataFrame) -> DataFrame:
    parts = F.split("run_id", _SEP)
    return df.withColumn("threshold_cm", parts[1].cast("bigint")).withColumn("run_id", parts[0])


def replay(dets: DataFrame, site: Site, thresholds: tuple[int, ...], window_s: float) -> DataFrame:
    """Detections with ``global_id`` for every threshold; ``run_id`` carries the threshold."""
    links = cut_lineage(optimal_links(dets, site, window_s))
    gated = _per_threshold(links, thresholds).where(F.col("distance_m") < F.col("threshold_cm") / 100.0)
    return assign_global_ids(_per_threshold(dets, thresholds), gated.drop("threshold_cm"))


def sweep_with_truth(dets: DataFrame, site: Site, thresholds: tuple[int, ...] = THRESHOLDS_CM,
                     window_s: float = 0.1) -> DataFrame:
    """Association quality per threshold on labelled detections (``truth_id``)."""
    fused = cut_lineage(replay(dets, site, thresholds, window_s))
    ids = fused.groupBy("run_id").agg(
        F.countDistinct("frame").alias("frames"), F.countDistinct("global_id").alias("unique_global_ids"))
    scored = event_metrics(pair_counts(fused, ["run_id"]))
    rate = {
        "false_match_rate": F.bround(names.safe_div(F.col("fp"), F.col("fp") + F.col("tn")), 4),
        "missed_match_rate": F.bround(names.safe_div(F.col("fn"), F.col("tp") + F.col("fn")), 4),
    }
    return _split_run(scored.withColumns(rate).join(ids, "run_id"))


def sweep_operational(dets: DataFrame, site: Site, person_ids: list[int],
                      thresholds: tuple[int, ...] = THRESHOLDS_CM, window_s: float = 0.5) -> DataFrame:
    """Per threshold, without truth: identities seen by two or more cameras in a frame, and distinct identities."""
    persons = dets.where(F.col("class_id").isin(person_ids) & F.col("x_m").isNotNull() & F.col("y_m").isNotNull())
    return structure_counts(replay(persons, site, thresholds, window_s))


def structure_counts(fused: DataFrame) -> DataFrame:
    """``frames, predicted_links, unique_global_ids`` per run (and threshold)."""
    seen = fused.groupBy("run_id", "frame", "global_id").agg(
        F.min("cam_id").alias("_lo"), F.max("cam_id").alias("_hi"))
    return _split_run(seen.groupBy("run_id").agg(
        F.countDistinct("frame").alias("frames"),
        F.count(F.when(F.col("_lo") != F.col("_hi"), 1)).alias("predicted_links"),
        F.countDistinct("global_id").alias("unique_global_ids"),
    ))
