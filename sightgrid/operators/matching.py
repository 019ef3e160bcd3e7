"""Alerts against annotated events: one-to-one matchers, first detections, truth windows, false-positive sessions."""

from __future__ import annotations

import logging

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightgrid.functions import matchers, names
from sightgrid.functions.matchers import SLACK_S
from sightgrid.operators import replay
from sightgrid.operators.ordered import frame_bucket, gap_sessions, split_running, time_bucket
from sightgrid.operators.quantiles import exact_percentiles
from sightgrid.session import cut_lineage

TOLERANCE_S = 10.0
MERGE_GAP_S = 3.0
ACTIVE_S = 30.0
log = logging.getLogger(__name__)


# ---- timeline look-ups: a running extreme over a merged timeline replaces a range join

def latest_not_after(
    probes: DataFrame, facts: DataFrame, keys: list[str], probe_time: str, fact_time: str, value: Column, name: str,
    width: float = 3600.0,
) -> DataFrame:
    """For every probe the greatest ``value`` among facts with ``fact_time <= probe_time`` (NULL if none)."""
    left = probes.withColumn("_t", F.col(probe_time).cast("double")).withColumn("_probe", F.lit(True))
    right = facts.select(*keys, F.col(fact_time).cast("double").alias("_t"), value.alias("_v"),
                         F.lit(False).alias("_probe"))
    both = left.unionByName(right, allowMissingColumns=True).withColumn("_b", time_bucket(F.col("_t"), width))
    found = split_running(both, keys, ["_t"], "_b", F.col("_v"), "max", name)
    return found.where("_probe").drop("_t", "_v", "_probe", "_b")


def first_detection_after(events: DataFrame, dets: DataFrame, keys: list[str], appear: str = "appear_frame") -> DataFrame:
    """``alert_frame``: earliest detection frame at or after the appearance, per event (events are independent)."""
    probes = events.withColumn("_neg", -F.col(appear))
    facts = dets.select(*keys, (-F.col("frame")).alias("_neg")).distinct()
    found = latest_not_after(probes, facts, keys, "_neg", "_neg", F.col("_neg"), "_hit", width=4096.0)
    return found.withColumn("alert_frame", -F.col("_hit")).drop("_neg", "_hit")


def outside_windows(alerts: DataFrame, windows: DataFrame, keys: list[str], time: str = "ts_s") -> DataFrame:
    """Alerts that lie in no window: the furthest end among windows already begun decides."""
    found = latest_not_after(alerts, windows, keys, time, "start_s", F.col("end_s"), "_reach")
    return found.where(F.col("_reach").isNull() | (F.col("_reach") < F.col(time))).drop("_reach")


def intrusion_windows(truth: DataFrame, fps: float = 25.0, active_s: float = ACTIVE_S) -> DataFrame:
    """[start, end] of every annotated intrusion: annotated exit if there is one, else ``active_s`` after the start."""
    exits = [F.col(c).cast("double") for c in ("exit_s",) if c in truth.columns]
    exits += [F.col(c).cast("double") / fps for c in ("exit_frame",) if c in truth.columns]
    start = F.col("appear_frame") / F.lit(fps)
    return truth.withColumn("start_s", start).withColumn("end_s", F.coalesce(*exits, start + active_s))


def appearance_windows(truth: DataFrame, fps: float = 25.0, tolerance_s: float = TOLERANCE_S) -> DataFrame:
    t = F.col("appear_frame") / F.lit(fps)
    return truth.withColumn("start_s", t - tolerance_s).withColumn("end_s", t + tolerance_s)


def nearest_annotation(queries: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Annotation nearest to each query frame; the earlier one in file order on equal distance."""
    facts = truth.groupBy(*keys, "appear_frame").agg(F.min("truth_ord").alias("truth_ord"))
    at = F.col("appear_frame")
    back = latest_not_after(queries, facts, keys, "frame", "appear_frame",
                            F.struct(at.alias("f"), F.col("truth_ord").alias("o")), "_back", width=4096.0)
    back = back.withColumn("_neg", -F.col("frame"))
    ahead = latest_not_after(back, facts.withColumn("_neg", -at), keys, "_neg", "_neg",
                             F.struct((-at).alias("f"), F.col("truth_ord").alias("o")), "_ahead", width=4096.0)
    options = F.array_compact(F.array(*[
        F.when(F.col(c).isNotNull(), F.struct(
            F.abs(F.col(f"{c}.f") * sign - F.col("frame")).alias("gap"), F.col(f"{c}.o").alias("truth_ord")))
        for c, sign in (("_back", 1), ("_ahead", -1))
    ]))
    return ahead.withColumn("_best", F.array_min(options)).select(
        *[c for c in queries.columns], F.col("_best.truth_ord").alias("truth_ord"), F.col("_best.gap").alias("gap")
    )


# ---- one-to-one matching

RULES = ("truth_order", "first_free", "distance_order")


def _chunked_line(truth: DataFrame, instants: DataFrame, keys: list[str], tolerance: float, width: float,
                  chunk_rows: int) -> DataFrame:
    """Truth events and alerts in chunks of ``chunk_rows`` consecutive rows; each chunk also holds the alerts its truth can reach.

    ``viewers`` names all chunks that hold an alert where there are several. What a chunk reaches is found from one row per chunk.
    """
    types = {**dict(instants.dtypes), **dict(truth.dtypes)}
    none = {c: F.lit(0).cast(types[c]) for c in ("truth_ord", "alert_ord", "copies")}
    line = truth.select(*keys, F.col("truth_t").alias("t"), F.lit(False).alias("is_alert"), "truth_ord",
                        none["alert_ord"].alias("alert_ord"), none["copies"].alias("copies")).unionByName(
        instants.select(*keys, F.col("alert_t").alias("t"), F.lit(True).alias("is_alert"), none["truth_ord"].alias("truth_ord"),
                        "alert_ord", "copies"))
    line = cut_lineage(replay.in_chunks(line.withColumn("_b", time_bucket(F.col("t"), width)), keys,
                                        ["t", "is_alert", "truth_ord"], "_b", chunk_rows))
    reach = tolerance + SLACK_S
    heads = line.groupBy(*keys, "chunk").agg(
        F.min("t").alias("head"), (F.min(F.when(~F.col("is_alert"), F.col("t"))) - reach).alias("_s"),
        (F.max(F.when(~F.col("is_alert"), F.col("t"))) + reach).alias("_e"))
    heads = cut_lineage(heads)
    # rows from _s to _e lie in the chunks from the last one that begins before _s to the last one that begins by _e
    spans = heads.where(F.col("_s").isNotNull()).drop("head").withColumn("_before", F.col("_s") - SLACK_S)
    for probe, name in (("_before", "_lo"), ("_e", "_hi")):
        spans = latest_not_after(spans, heads, keys, probe, "head", F.col("chunk"), name, width)
    homes = spans.select(*keys, F.explode(F.sequence(F.coalesce("_lo", F.lit(0)), "_hi")).alias("home"),
                         F.struct("chunk", "_s", "_e").alias("_span")).groupBy(*keys, "home").agg(
        F.collect_list("_span").alias("_spans"))
    viewers = F.transform(F.filter("_spans", lambda p: F.col("t").between(p["_s"], p["_e"])), lambda p: p["chunk"])
    seen = line.where("is_alert").withColumnRenamed("chunk", "home").join(homes, [*keys, "home"]).withColumn(
        "viewers", viewers).drop("_spans", "home")
    held = seen.withColumn("chunk", F.explode("viewers")).withColumn("viewers", F.when(F.size("viewers") > 1, F.col("viewers")))
    return line.where(~F.col("is_alert")).unionByName(held, allowMissingColumns=True)


def match_events(
    truth: DataFrame, alerts: DataFrame, keys: list[str], rule: str = "truth_order", tolerance: float = TOLERANCE_S,
    width: float = 3600.0, chunk_rows: int = replay.CHUNK_ROWS,
) -> DataFrame:
    """One row per truth event (``keys, truth_ord, truth_t``) with ``alert_t, alert_ord, delay`` (NULL if missed).

    ``truth`` has ``truth_ord, truth_t``; ``alerts`` has ``alert_ord, alert_t``. Alerts of one instant are counted
    together; rows without a time match nothing. The timeline is cut into chunks of ``chunk_rows`` rows at any place, and a chunk
    also sees the alerts within the tolerance of its truth events. All chunks are matched side by side. Pairs taken on alerts that
    several chunks see go to the others as claims, and chunks whose claims have changed are matched again. A claim only counts
    from its own place in the rule's order on, so the first pairs of that order are right after one round and stay so, and
    once no claim changes the result is that of one pass over everything. Chains of changes seldom cross many borders, so few
    rounds are needed; they are logged.
    """
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule}")
    instants = alerts.where(F.col("alert_t").isNotNull()).groupBy(*keys, F.col("alert_t").cast("double").alias("alert_t")).agg(
        F.min("alert_ord").alias("alert_ord"), F.count(F.lit(1)).alias("copies"))
    events = truth.select(*keys, "truth_ord", F.col("truth_t").cast("double").alias("truth_t"))
    rows = cut_lineage(_chunked_line(events.where(F.col("truth_t").isNotNull()), instants, keys, tolerance, width, chunk_rows))
    by, types = [*keys, "chunk"], dict(rows.dtypes)
    out_ddl = ", ".join([*[f"`{k}` {types[k]}" for k in by], f"truth_ord {types['truth_ord']}", "truth_t double",
                         f"alert_ord {types['alert_ord']}", "alert_t double", "viewers array<bigint>"])
    mail_ddl = ", ".join([*[f"`{k}` {types[k]}" for k in by], "sender bigint", f"truth_ord {types['truth_ord']}",
                          "truth_t double", "alert_t double"])

    def matched(key: tuple, part: pd.DataFrame, mail: pd.DataFrame) -> pd.DataFrame:
        t = part[~part["is_alert"]]
        a = part[part["is_alert"]].sort_values("t")
        times = a["t"].to_numpy()
        claims = list(zip(mail["truth_ord"], mail["truth_t"], mail["sender"], np.searchsorted(times, mail["alert_t"])))
        found = matchers.pick(rule, tolerance, key[-1], list(zip(t["truth_ord"], t["t"])),
                              matchers.FreeAlerts(times, a["alert_ord"].to_numpy(), a["copies"].to_numpy()), claims)
        ords, seen_by = a["alert_ord"].to_numpy(), a["viewers"].to_numpy()
        out = pd.DataFrame({"truth_ord": t["truth_ord"].to_numpy(), "truth_t": t["t"].to_numpy()})
        for i, k in enumerate(by):
            out[k] = pd.Series([key[i]] * len(out), dtype=object)
        for name, values in (("alert_ord", ords), ("alert_t", times), ("viewers", seen_by)):
            out[name] = pd.Series([values[j] if j >= 0 else None for j in found], dtype=object)
        return out[[*by, "truth_ord", "truth_t", "alert_ord", "alert_t", "viewers"]]

    mail = inbox = rows.sparkSession.createDataFrame([], mail_ddl)
    todo, parts = rows, []
    while True:
        picks = cut_lineage(todo.groupBy(*by).cogroup(inbox.groupBy(*by)).applyInPandas(matched, out_ddl).withColumn(
            "_round", F.lit(len(parts))))
        parts.append(picks)
        sent = picks.where(F.col("viewers").isNotNull()).select(
            *keys, F.explode("viewers").alias("_to"), F.col("chunk").alias("sender"), "truth_ord", "truth_t", "alert_t").where(
            "_to <> sender").withColumnRenamed("_to", "chunk").select(*mail.columns)
        if len(parts) == 1 and sent.isEmpty():  # no pair lies on an alert that two chunks see
            break
        matched_now = todo.select(*keys, F.col("chunk").alias("sender")).distinct()
        fresh = cut_lineage(sent.unionByName(mail.join(matched_now, [*keys, "sender"], "left_anti")))
        changed = cut_lineage(fresh.withColumn("_w", F.lit(1)).unionByName(mail.withColumn("_w", F.lit(-1))).groupBy(
            *fresh.columns).agg(F.sum("_w").alias("_w")).where("_w <> 0").select(*by).distinct())
        mail = fresh
        if changed.isEmpty():
            break
        todo, inbox = rows.join(changed, by, "left_semi"), mail.join(changed, by, "left_semi")
    log.info("%s: %d rounds over chunks", rule, len(parts))
    result = parts[0]
    if len(parts) > 1:
        for part in parts[1:]:
            result = result.unionByName(part)
        last = result.groupBy(*by).agg(F.max("_round").alias("_last"))
        result = result.join(last, by, "left").where(F.col("_round") == F.coalesce("_last", F.lit(0)))
    untimed = events.where(F.col("truth_t").isNull()).select(
        *keys, "truth_ord", "truth_t", F.lit(None).cast(types["alert_ord"]).alias("alert_ord"),
        F.lit(None).cast("double").alias("alert_t"))
    return result.select(*keys, "truth_ord", "truth_t", "alert_ord", "alert_t").unionByName(untimed).withColumn(
        "delay", F.col("alert_t") - F.col("truth_t"))


def unmatched_instants(alerts: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """Instants that still hold alerts after matching, with how many (``left_over``)."""
    total = alerts.groupBy(*keys, "alert_t").agg(F.count(F.lit(1)).alias("copies"))
    used = matches.where(F.col("alert_t").isNotNull()).groupBy(*keys, "alert_t").agg(F.count(F.lit(1)).alias("used"))
    left = total.join(used, [*keys, "alert_t"], "left").withColumn(
        "left_over", F.col("copies") - F.coalesce("used", F.lit(0)))
    return left.where("left_over > 0").drop("copies", "used")


# ---- false-positive sessions and scores

def cluster_alerts(alerts: DataFrame, keys: list[str], time: str = "ts_s", gap: float = MERGE_GAP_S) -> DataFrame:
    """Alerts merged into sessions: a gap longer than ``gap`` seconds opens a new one."""
    return gap_sessions(alerts, keys, time, gap).groupBy(*keys, "session_start").agg(
        F.bround(F.min(time), 3).alias("start_time"), F.bround(F.max(time), 3).alias("end_time"),
        F.bround(F.max(time) - F.min(time), 3).alias("duration_s"), F.count(F.lit(1)).alias("n_detections"),
        F.min_by("class_name", F.struct(time, "det_ord")).alias("class_name"),
        F.bround(F.avg("confidence"), 4).alias("avg_confidence"),
    ).drop("session_start")


def event_metrics(counts: DataFrame, hours: Column | None = None) -> DataFrame:
    """Precision, recall and F1 (rounded to 4 digits) from ``tp, fp, fn``, and false alarms per hour."""
    p = names.safe_div(F.col("tp"), F.col("tp") + F.col("fp"))
    r = names.safe_div(F.col("tp"), F.col("tp") + F.col("fn"))
    out = counts.withColumn("_p", p).withColumn("_r", r).withColumn(
        "_f", names.safe_div(2 * F.col("_p") * F.col("_r"), F.col("_p") + F.col("_r")))
    out = out.withColumns({"precision": F.bround("_p", 4), "recall": F.bround("_r", 4), "f1": F.bround("_f", 4)})
    if hours is not None:
        out = out.withColumn("far_per_hour", F.bround(names.safe_div(F.col("fp"), hours), 2))
    return out.drop("_p", "_r", "_f")


def delay_stats(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Median, p95, mean, min and max of the matched delays (keys without a match do not appear)."""
    hit = matches.where(F.col("delay").isNotNull())
    pct = exact_percentiles(hit, keys, F.col("delay"), {"_p50": (0.5, "linear"), "_p95": (0.95, "linear")})
    return pct.select(
        *keys, F.bround("_p50", 3).alias("delay_median"), F.bround("_p95", 3).alias("delay_p95"),
        F.bround("mean", 3).alias("delay_mean"), F.bround("min", 3).alias("delay_min"), F.bround("max", 3).alias("delay_max"),
    )


def score_events(truth: DataFrame, alerts: DataFrame, keys: list[str], merge_gap: float = 0.0,
                 tolerance: float = TOLERANCE_S, spine: DataFrame | None = None) -> DataFrame:
    """Event score per key: matches in truth order, false positives raw or merged, precision, recall, F1, delays.

    ``spine`` lists keys that get a row even with neither truth nor alert.
    """
    matches = cut_lineage(match_events(truth, alerts, keys, "truth_order", tolerance))
    left = unmatched_instants(alerts, matches, keys)
    if merge_gap > 0:
        left = cut_lineage(left)
        fp = gap_sessions(left, keys, "alert_t", merge_gap, "_s").groupBy(*keys, "_s").count().groupBy(*keys).agg(
            F.count(F.lit(1)).alias("fp"))
    else:
        fp = left.groupBy(*keys).agg(F.sum("left_over").alias("fp"))
    base = matches.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_gt_events"), F.count("alert_t").alias("tp"))
    counts = base.join(fp, keys, "full_outer")
    if spine is not None:
        counts = counts.join(spine.select(*keys).distinct(), keys, "full_outer")
    counts = counts.fillna(0, ["n_gt_events", "tp", "fp"]).withColumn(
        "fn", F.col("n_gt_events") - F.col("tp"))
    return event_metrics(counts).join(delay_stats(matches, keys), keys, "left")


def intrusion_score_by_camera(truth: DataFrame, alerts: DataFrame, cameras: list[str]) -> DataFrame:
    """Zone alerts scored per camera; an alert counts for each camera that voted, for all if none is named."""
    named = F.when(F.size("cameras") > 0, F.array_intersect("cameras", F.array(*map(F.lit, cameras)))).otherwise(
        F.array(*map(F.lit, cameras)))
    per_cam = alerts.where(F.col("alert_type") == "zone_violation_person").select(
        "run_id", F.explode(named).alias("cam_id"), F.col("ts_s").alias("alert_t"), F.col("ts_s").alias("alert_ord"))
    return score_events(truth.where(F.col("cam_id").isin(cameras)), per_cam, ["run_id", "cam_id"],
                        spine=_every_camera([truth, alerts], cameras))


def _every_camera(parts: list[DataFrame], cameras: list[str]) -> DataFrame:
    """(run_id, cam_id) of every run met in ``parts`` and every camera."""
    runs = parts[0].select("run_id")
    for part in parts[1:]:
        runs = runs.union(part.select("run_id"))
    return runs.distinct().select("run_id", F.explode(F.array(*map(F.lit, cameras))).alias("cam_id"))


def object_score_by_camera(truth: DataFrame, dets: DataFrame, person_ids: list[int], cameras: list[str] | None = None) -> DataFrame:
    """Object detections as candidates, only classes annotated for the camera, distinct instants, FPs merged (3 s)."""
    classes = truth.select("run_id", "cam_id", names.normalize_class(F.col("class_name")).alias("class_norm")).distinct()
    times = dets.where(~F.col("class_id").isin(person_ids)).withColumn(
        "class_norm", names.normalize_class(F.col("class_name"))
    ).join(classes, ["run_id", "cam_id", "class_norm"], "left_semi").select(
        "run_id", "cam_id", F.col("ts_s").alias("alert_t"), F.col("ts_s").alias("alert_ord")).distinct()
    return score_events(truth, times, ["run_id", "cam_id"], merge_gap=MERGE_GAP_S,
                        spine=_every_camera([truth, dets], cameras) if cameras else None)


# ---- association truth

def truth_link_join(truth: DataFrame, predicted: DataFrame, tolerance: int = 0) -> DataFrame:
    """Each annotated pair with the first predicted link (file order) of the same pair within ``tolerance`` frames.

    Frames are cut into buckets of ``tolerance + 1`` so that the tolerance becomes an equi-join on three buckets.
    """
    width = tolerance + 1
    bucket = frame_bucket(F.col("frame"), width)
    spread = F.array(bucket - 1, bucket, bucket + 1) if tolerance else F.array(bucket)
    probes = truth.withColumn("_b", F.explode(spread))
    links = predicted.select("pair", F.col("frame").alias("_pf"), F.col("pred_ord").alias("_po")).withColumn(
        "_b", frame_bucket(F.col("_pf"), width))
    hits = probes.join(links, ["pair", "_b"]).where(F.abs(F.col("_pf") - F.col("frame")) <= tolerance).groupBy(
        "truth_ord").agg(F.min(F.struct("_po", "_pf")).alias("_m"))
    joined = truth.join(hits, "truth_ord", "left")
    same = F.col("_m").isNotNull()
    return joined.select(
        *truth.columns, same.alias("predicted_same"), F.col("_m._pf").alias("matched_frame"),
        F.col("_m._po").alias("matched_ord"),
        F.when(F.col("expected_same") & same, "tp").when(~F.col("expected_same") & same, "fp")
        .when(F.col("expected_same"), "fn").otherwise("tn").alias("result"),
    )


def association_quality(judged: DataFrame, predicted: DataFrame) -> DataFrame:
    """Overall precision, recall, F1, accuracy and how many predictions no annotation covers."""
    sums = judged.agg(
        F.count(F.lit(1)).alias("truth_rows"), F.countDistinct("matched_ord").alias("evaluated_predictions"),
        *[F.count(F.when(F.col("result") == r, 1)).alias(r) for r in ("tp", "fp", "fn", "tn")],
    ).withColumn("_one", F.lit(1))
    total = predicted.agg(F.count(F.lit(1)).alias("predicted_links")).withColumn("_one", F.lit(1))
    return event_metrics(sums.join(total, "_one").drop("_one")).withColumn(
        "ignored_predictions", F.col("predicted_links") - F.col("evaluated_predictions")
    ).withColumn("accuracy", F.bround(names.safe_div(F.col("tp") + F.col("tn"), F.col("truth_rows")), 4))


def pair_counts(fused: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fp, fn, tn over all cross-camera pairs of each frame, by counting groups instead of forming pairs.

    The pairs inside a group of ``n`` detections with ``n_c`` per camera number ``(n^2 - sum n_c^2) / 2``.
    """
    by = [*keys, "frame"]

    def pairs(df: DataFrame, group: list[str], name: str) -> DataFrame:
        per_cam = df.groupBy(*by, *group, "cam_id").agg(F.count(F.lit(1)).alias("_n"))
        per_group = per_cam.groupBy(*by, *group).agg(
            ((F.sum("_n") * F.sum("_n") - F.sum(F.col("_n") * F.col("_n"))) / 2).cast("bigint").alias("_p"))
        return per_group.groupBy(*keys).agg(F.sum("_p").alias(name))

    known = fused.where(F.col("truth_id") != "")
    linked = fused.where(F.col("global_id").isNotNull())
    out = pairs(fused, [], "all_pairs")
    for df, group, name in (
        (linked, ["global_id"], "predicted_links"), (known, ["truth_id"], "truth_links"),
        (linked.where(F.col("truth_id") != ""), ["global_id", "truth_id"], "tp"),
    ):
        out = out.join(pairs(df, group, name), keys, "left")
    out = out.fillna(0)
    return out.withColumns({
        "fp": F.col("predicted_links") - F.col("tp"), "fn": F.col("truth_links") - F.col("tp"),
        "tn": F.col("all_pairs") - F.col("predicted_links") - F.col("truth_links") + F.col("tp"),
    }).drop("all_pairs")
