"""Report tables: alert counts, phase comparison, best model, detection mix, leaderboards, recent alerts."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightgrid.operators.ordered import split_ordinal, split_running, time_bucket
from sightgrid.operators.replay import CHUNK_ROWS, in_chunks, replay_chunks
from sightgrid.session import cut_lineage

COMPARISON = ["precision", "recall", "f1", "n_faux_positifs", "far_per_hour", "fps", "latency_mean_ms"]


def alert_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("alert_type", "alert_level").agg(F.count(F.lit(1)).alias("n"))


def phase_comparison(parts: list[DataFrame]) -> DataFrame:
    """Long table of several phases' score tables; columns a phase lacks become NULL."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def phase_means(comparison: DataFrame) -> DataFrame:
    """Mean of every metric by (phase, task), missing values skipped."""
    present = [c for c in COMPARISON if c in comparison.columns]
    return comparison.groupBy("phase", "task").agg(*[F.bround(F.avg(c), 6).alias(c) for c in present])


def best_model(scores: DataFrame) -> DataFrame:
    """Model with the smallest median delay and the fastest one, among models that have a median."""
    valid = scores.where(F.col("delay_median").isNotNull())
    return valid.agg(
        F.min(F.struct("delay_median", "model")).alias("_b"), F.min(F.struct((-F.col("fps")).alias("s"), "model")).alias("_f")
    ).select(F.col("_b.model").alias("best_delay_model"), F.col("_b.delay_median").alias("best_delay"),
             F.col("_f.model").alias("fastest_model"), (-F.col("_f.s")).alias("fastest_fps"))


def detection_mix(dets: DataFrame) -> DataFrame:
    """Detections by class, by camera, and in total."""
    return dets.groupingSets([["class_name"], ["cam_id"], []], "class_name", "cam_id").agg(
        F.count(F.lit(1)).alias("n"), F.bround(F.avg("confidence"), 6).alias("avg_confidence")
    ).select(F.coalesce("class_name", F.lit("*")).alias("class_name"), F.coalesce("cam_id", F.lit("*")).alias("cam_id"),
             "n", "avg_confidence")


def event_camera_summary(annotations: DataFrame, keys: list[str]) -> DataFrame:
    """Cameras and annotation count of each event."""
    return annotations.groupBy(*keys).agg(
        F.concat_ws("+", F.array_sort(F.collect_set("cam_id"))).alias("cameras"),
        F.size(F.collect_set("cam_id")).cast("bigint").alias("n_cameras"), F.count(F.lit(1)).alias("n_annotations"))


def leaderboard(scores: DataFrame, key: str = "model", metric: str = "f1") -> DataFrame:
    """Mean score over cameras with its rank (one more than the number of better ones)."""
    means = scores.groupBy(key).agg(F.bround(F.avg(metric), 6).alias(f"mean_{metric}"))
    values = means.groupBy((-F.col(f"mean_{metric}")).alias("_s")).agg(F.count(F.lit(1)).alias("_n")).withColumns(
        {"_all": F.lit(0), "_b": F.floor(F.col("_s") * 100)})
    upto = split_running(values, ["_all"], ["_s"], "_b", F.col("_n"), "sum", "_upto")
    ranks = upto.select((-F.col("_s")).alias(f"mean_{metric}"), (F.col("_upto") - F.col("_n") + 1).alias("rank"))
    return means.join(ranks, f"mean_{metric}").select(key, f"mean_{metric}", "rank")


def recent_alerts(alerts: DataFrame, limit: int = 80) -> DataFrame:
    """Newest alerts first (the report's fixed length)."""
    return alerts.orderBy(F.desc("ts_s"), "alert_id").limit(limit)


def dedupe_alerts(alerts: DataFrame, fallback: list[Column], order: list[str]) -> DataFrame:
    """The first row, by ``order``, of each alert id; rows without id are told apart by the fallback columns."""
    key = F.coalesce(F.nullif("alert_id", F.lit("")), F.concat_ws("-", *fallback))
    first = F.min_by(F.struct(*alerts.columns), F.struct(*order))
    return alerts.groupBy(key.alias("alert_key")).agg(first.alias("_first")).select("_first.*", "alert_key")


def _open_groups(window_ms: float):
    """One chunk of annotations in order, from the groups that are open before it.

    A camera's annotations fill groups in order of their creation, so those it is in are always the first of the open ones:
    one place for each camera says which comes next, and no group is searched.
    """
    def step(chunk: pd.DataFrame, before: str | None) -> tuple[pd.DataFrame, str]:
        state = json.loads(before) if before else {"groups": [], "next": {}}
        groups, place, first = state["groups"], state["next"], 0
        chunk = chunk.sort_values(["t_ms", "ann_ord"], kind="stable")
        homes, t = [], -math.inf
        for t, item, cam in zip(chunk["t_ms"].tolist(), chunk["ann_ord"].tolist(), chunk["cam_id"].tolist()):
            while first < len(groups) and t - groups[first][0] > window_ms:
                first += 1
            at = max(place.get(cam, 0), first)
            if at == len(groups):
                groups.append([t, item])
            place[cam] = at + 1
            homes.append(groups[at])
        out = chunk.assign(t_ref=[h[0] for h in homes], head=[h[1] for h in homes])
        left = {cam: n - first for cam, n in place.items() if n > first}
        return out, json.dumps({"groups": groups[first:], "next": left}, sort_keys=True)

    return step


def group_truth_events(annotations: DataFrame, rooms: dict[str, int], window_ms: float = 5000.0,
                       chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Annotations of one real event over cameras: same room and class, within the window of the group's first item,
    each camera at most once; groups numbered per room in creation order. A camera without a room is an error.

    The timeline of a room and class is replayed in chunks of ``chunk_rows``; what a chunk hands on is the groups that are
    still open, so no task holds more than a chunk and the annotations of one window.
    """
    room = F.create_map(*[F.lit(x) for kv in rooms.items() for x in kv])
    known = F.coalesce(F.try_element_at(room, F.col("cam_id")), F.raise_error(
        F.concat(F.lit("camera without a room: "), F.coalesce("cam_id", F.lit("NULL")))))
    placed = annotations.select(known.cast("bigint").alias("room"), "class_name", F.col("ann_ord").cast("bigint").alias("ann_ord"),
                                "cam_id", F.col("t_ms").cast("double").alias("t_ms"))
    keys = ["room", "class_name"]
    cut = in_chunks(placed.withColumn("_b", time_bucket(F.col("t_ms"), 3_600_000.0)), keys, ["t_ms", "ann_ord"], "_b", chunk_rows)
    rows = cut_lineage(replay_chunks(cut, keys, _open_groups(window_ms), "room bigint, class_name string, ann_ord bigint, cam_id string, "
                                     "t_ms double, t_ref double, head bigint"))
    heads = rows.select("room", "t_ref", "head").distinct().withColumn("_b", time_bucket(F.col("t_ref"), 3_600_000.0))
    numbered = split_ordinal(heads, ["room"], ["t_ref", "head"], "_b", "_n").select(
        "room", "head", "t_ref", (F.col("_n") + 1).alias("event_id"))
    return rows.drop("t_ref").join(numbered, ["room", "head"]).select(
        "room", "class_name", "ann_ord", "cam_id", "t_ms", "t_ref", "event_id")


def missing_inputs(present: DataFrame, expected: list[str], column: str) -> DataFrame:
    """Expected names that have no row."""
    spine = present.sparkSession.createDataFrame([(e,) for e in expected], f"{column} string")
    return spine.join(present.select(column).distinct(), column, "left_anti")


def map_truth_cameras(truth: DataFrame, bridge: dict[str, str]) -> DataFrame:
    """Truth rows with the pipeline's camera id (``gt_camera`` is the annotated id); unmapped ids drop out."""
    table = F.create_map(*[F.lit(x) for kv in bridge.items() for x in kv])
    return truth.withColumn("cam_id", F.try_element_at(table, F.col("gt_camera"))).where(F.col("cam_id").isNotNull())
