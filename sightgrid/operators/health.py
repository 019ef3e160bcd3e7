"""Run health: summaries, stage latencies, camera synchronisation, freshness, paced resampling, overlay look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightgrid import schemas
from sightgrid.functions import names
from sightgrid.operators.matching import latest_not_after
from sightgrid.operators.ordered import split_lag, time_bucket
from sightgrid.operators.quantiles import exact_percentiles, latency_stats

STAGES = {  # fixed values: report label and trace column
    "Capture": "capture_read_ms", "Inference + tracking": "inference_tracking_ms", "Fusion": "fusion_ms",
    "Alertes": "alerts_ms", "Metadata": "metadata_ms",
}
TICK_STRETCH = 4096  # ticks that one row of a long gap stands for until they are written


def run_summary(frames: DataFrame, fused: DataFrame, alerts: DataFrame, links: DataFrame, stability: DataFrame,
                latencies: DataFrame) -> DataFrame:
    """One row per run: volumes, distinct identities, id switches, inference latency."""
    parts = [
        fused.groupBy("run_id").agg(F.count(F.lit(1)).alias("detections"),
                                    F.countDistinct("global_id").alias("unique_global_ids")),
        alerts.groupBy("run_id").agg(F.count(F.lit(1)).alias("alerts")),
        links.groupBy("run_id").agg(F.count(F.lit(1)).alias("fusion_links")),
        stability.groupBy("run_id").agg(F.sum("global_id_switches").alias("global_id_switches")),
        latency_stats(latencies, ["run_id"], F.col("latency_ms")).drop("n"),
    ]
    out = frames.groupBy("run_id").agg(F.countDistinct("frame").alias("frames"))
    for part in parts:
        out = out.join(part, "run_id", "left")
    return out.fillna(0)


def frame_timing(trace: DataFrame) -> DataFrame:
    """Per (run, frame): capture and inference durations and the worst and latest capture-to-metadata time."""
    ok = F.coalesce(F.col("capture_success"), F.lit(True))
    read = F.when(ok, F.coalesce("capture_read_ms", F.lit(0.0)))
    end = F.when(ok & (F.col("capture_read_end_epoch") > 0), F.col("capture_read_end_epoch"))
    agg = trace.groupBy("run_id", "frame").agg(
        F.countDistinct("cam_id").alias("camera_count"),
        F.avg(read).alias("_read_mean"), F.max(read).alias("_read_max"),
        F.min(end).alias("_end_min"), F.max(end).alias("_end_max"),
        F.avg(F.coalesce("inference_tracking_ms", F.lit(0.0))).alias("_inf_mean"),
        F.max("inference_tracking_ms").alias("_inf_max"), F.max("metadata_start_epoch").alias("_meta"),
    )

    def ms(c: Column) -> Column:
        return F.bround(F.coalesce(c, F.lit(0.0)), 3)

    return agg.select(
        "run_id", "frame", "camera_count", ms(F.col("_read_mean")).alias("capture_read_ms_mean"),
        ms(F.col("_read_max")).alias("capture_read_ms_max"), F.bround("_end_min", 6).alias("capture_read_end_epoch_min"),
        F.bround("_end_max", 6).alias("capture_read_end_epoch_max"), ms(F.col("_inf_mean")).alias("inference_ms_mean"),
        ms(F.col("_inf_max")).alias("inference_ms_max"),
        ms((F.col("_meta") - F.col("_end_min")) * 1000.0).alias("capture_to_metadata_ms_worst"),
        ms((F.col("_meta") - F.col("_end_max")) * 1000.0).alias("capture_to_metadata_ms_latest"),
    )


def timing_block(trace: DataFrame) -> DataFrame:
    """``run_id, frame, timing``: the envelope's timing fields as one struct.

    On top of ``frame_timing``: when the batch was ready, first start and last end of inference (NULL where none is known) and the
    durations of fusion and alerts, which are the frame's and stand in each of its rows.
    """
    marks = trace.groupBy("run_id", "frame").agg(
        F.bround(F.max("batch_ready_epoch"), 6).alias("batch_ready_epoch"),
        F.bround(F.min("inference_start_epoch"), 6).alias("inference_start_epoch_min"),
        F.bround(F.max("inference_end_epoch"), 6).alias("inference_end_epoch_max"),
        *[F.bround(F.coalesce(F.max(c), F.lit(0.0)), 3).alias(c) for c in ("fusion_ms", "alerts_ms")])
    both = frame_timing(trace).withColumnsRenamed({
        "inference_ms_mean": "inference_tracking_ms_mean", "inference_ms_max": "inference_tracking_ms_max"}).join(marks, ["run_id", "frame"])
    return both.select("run_id", "frame", F.struct(*[n for n, _ in schemas.fields(schemas.TIMING_DOC)]).alias("timing"))


def stage_latency(trace: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and p95 of each stage duration."""
    long = trace.unpivot(keys, [F.col(c).alias(c) for c in STAGES.values()], "stage_column", "ms")
    by = [*keys, "stage_column"]
    pct = exact_percentiles(long, by, F.col("ms"), {"_p95": (0.95, "linear")})
    label = F.create_map(*[F.lit(x) for k, v in STAGES.items() for x in (v, k)])
    return pct.select(
        *keys, F.try_element_at(label, F.col("stage_column")).alias("stage"), F.bround("mean", 6).alias("mean_ms"),
        F.bround("_p95", 6).alias("p95_ms"))


def fusion_link_stats(links: DataFrame, order: Column) -> DataFrame:
    """Frames with a link, number of camera pairs, busiest pair (the first seen on equal counts)."""
    pair = F.concat_ws("+", F.least("cam_a", "cam_b"), F.greatest("cam_a", "cam_b"))
    frames = links.groupBy("run_id").agg(F.countDistinct("frame").alias("frames_with_fusion"))
    pairs = links.where((F.col("cam_a") != "") & (F.col("cam_b") != "")).groupBy("run_id", pair.alias("pair")).agg(
        F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    top = pairs.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("camera_pairs"),
        F.min(F.struct((-F.col("n")).alias("n"), "first", "pair")).alias("_top"))
    return frames.join(top, "run_id", "left").select(
        "run_id", "frames_with_fusion", F.coalesce("camera_pairs", F.lit(0)).alias("camera_pairs"),
        F.coalesce("_top.pair", F.lit("")).alias("top_pair"),
        F.coalesce(-F.col("_top.n"), F.lit(0)).alias("top_pair_links"))


def camera_sync_stats(sync: DataFrame, expected: list[str] | None = None) -> DataFrame:
    """Per (run, camera): frames received, first and last time, missing frames, fps, early drop-out.

    With ``expected`` every listed camera gets a row; absent ones are reported with zeros and as dropped.
    """
    frame, elapsed = F.coalesce("campaign_frame", F.lit(0)), F.coalesce("elapsed_s", F.lit(0.0))
    runs = sync.groupBy("run_id").agg((F.max(frame) + 1).alias("_total"), F.max(elapsed).alias("_run_last"))
    cams = sync.groupBy("run_id", "cam_id").agg(
        F.count(F.lit(1)).alias("frames"), F.countDistinct(frame).alias("_distinct"),
        F.min(elapsed).alias("first_elapsed_s"), F.max(elapsed).alias("last_elapsed_s"))
    if expected is None:
        joined = cams.join(runs, "run_id")
    else:
        spine = runs.withColumn("cam_id", F.explode(F.array(*map(F.lit, expected))))
        joined = spine.join(cams, ["run_id", "cam_id"], "left").fillna(
            0, ["frames", "_distinct", "first_elapsed_s", "last_elapsed_s"])
    missing = F.col("_total") - F.col("_distinct")
    span = F.col("last_elapsed_s") - F.col("first_elapsed_s")
    return joined.select(
        "run_id", "cam_id", "frames", "first_elapsed_s", "last_elapsed_s", missing.alias("missing_campaign_frames"),
        F.when(span > 0, F.col("frames") / span).otherwise(0.0).alias("effective_fps"),
        ((F.col("frames") == 0) | (F.col("last_elapsed_s") < F.col("_run_last") - 1.0) | (missing > 0)).alias(
            "dropped_early"))


def run_health(summary: DataFrame, sync_stats: DataFrame, link_stats: DataFrame) -> DataFrame:
    """Rates per frame, per 1000 detections and in percent of frames; zero-safe."""
    cams = sync_stats.groupBy("run_id").agg(
        F.max("last_elapsed_s").alias("_last"),
        F.min(F.when(F.col("frames") > 0, F.col("first_elapsed_s"))).alias("_first"),
        F.count(F.lit(1)).alias("camera_count"), F.count(F.when(F.col("dropped_early"), 1)).alias("dropped_count"),
        F.concat_ws(",", F.array_sort(F.collect_list(F.when(F.col("dropped_early"), F.col("cam_id"))))).alias(
            "dropped_cameras"))
    j = summary.join(cams, "run_id", "left").join(link_stats, "run_id", "left")
    zero = F.lit(0)
    duration = F.coalesce("_last", zero) - F.coalesce("_first", zero)
    frames_fused = F.coalesce("frames_with_fusion", zero)
    return j.select(
        "run_id", "frames", F.bround(duration, 3).alias("duration_s"),
        F.bround(F.when(duration > 0, F.col("frames") / duration).otherwise(0.0), 3).alias("effective_fps"),
        "detections", "latency_mean_ms", "latency_p95_ms", "latency_max_ms", "fusion_links",
        frames_fused.alias("frames_with_fusion"),
        F.bround(names.safe_div(frames_fused, F.col("frames")) * 100, 3).alias("fusion_frame_rate_pct"),
        F.bround(names.safe_div(F.col("fusion_links"), F.col("frames")), 6).alias("fusion_links_per_frame"),
        F.bround(names.safe_div(F.col("fusion_links"), F.col("detections")) * 1000, 3).alias(
            "fusion_links_per_1000_detections"),
        F.coalesce("camera_pairs", zero).alias("fusion_camera_pairs"),
        F.coalesce("top_pair", F.lit("")).alias("top_fusion_pair"),
        F.coalesce("top_pair_links", zero).alias("top_fusion_pair_links"),
        (F.col("fusion_links") > 0).cast("bigint").alias("fusion_active"), "alerts",
        F.coalesce("dropped_cameras", F.lit("")).alias("dropped_cameras"),
        F.coalesce("dropped_count", zero).alias("dropped_count"), F.coalesce("camera_count", zero).alias("camera_count"),
    )


def compare_runs(health: DataFrame) -> DataFrame:
    return health.agg(
        F.count(F.lit(1)).cast("double").alias("runs"),
        F.bround(F.coalesce(F.avg("effective_fps"), F.lit(0.0)), 6).alias("mean_effective_fps"),
        F.bround(F.coalesce(F.avg("latency_p95_ms"), F.lit(0.0)), 6).alias("mean_latency_p95_ms"),
        F.bround(names.safe_div(F.sum("dropped_count"), F.sum("camera_count")), 6).alias("drop_rate"),
        F.bround(F.coalesce(F.avg((F.col("fusion_links") > 0).cast("double")), F.lit(0.0)), 6).alias(
            "fusion_enabled_rate"))


def camera_scaling(summary: DataFrame) -> DataFrame:
    """Frames per second of each configuration from its frame count and known duration."""
    return summary.withColumn("fps", F.bround(names.safe_div(F.col("frames"), F.col("duration_s")), 6))


def inference_rate(df: DataFrame, keys: list[str], seconds: Column) -> DataFrame:
    """Jitter (population standard deviation, ms) and frames per second of pure inference."""
    return df.groupBy(*keys).agg(
        F.bround(F.stddev_pop(seconds * 1000.0), 1).alias("latency_jitter_ms"),
        F.bround(names.safe_div(F.lit(1.0), F.avg(seconds)), 1).alias("fps_inference"))


def sync_skew(captures: DataFrame, keys: list[str], tolerance_ms: float = 200.0) -> DataFrame:
    """Spread of the capture times of a tick; a tick with two or more cameras passes within the tolerance."""
    agg = captures.groupBy(*keys).agg(
        F.countDistinct("cam_id").alias("cameras"),
        F.bround((F.max("ts_s") - F.min("ts_s")) * 1000.0, 3).alias("_skew"))
    return agg.select(*keys, "cameras", F.when(F.col("cameras") >= 2, F.col("_skew")).otherwise(0.0).alias("skew_ms"),
                      ((F.col("cameras") < 2) | (F.col("_skew") <= tolerance_ms)).alias("released"))


def latency_report(df: DataFrame, keys: list[str], period_s: float) -> DataFrame:
    """Average and maximum latency per report period."""
    return df.groupBy(*keys, time_bucket(F.col("ts_s"), period_s).alias("period")).agg(
        F.bround(F.avg("latency_ms"), 3).alias("avg_ms"), F.bround(F.max("latency_ms"), 3).alias("max_ms"))


def resample_fixed_rate(obs: DataFrame, keys: list[str], fps: float = 25.0) -> DataFrame:
    """Last observation carried to every tick of a fixed rate; repeats are flagged.

    Each observation itself emits the ticks up to its successor, so no tick table is built. A long gap is cut into stretches of
    ``TICK_STRETCH`` ticks first, which are dealt out by key and stretch, so a camera that was silent for a year is neither one array nor one task.
    """
    origin = obs.groupBy(*keys).agg(F.min("ts_s").alias("_t0"), F.max("ts_s").alias("_t1"))
    tick = F.ceil((F.col("ts_s") - F.col("_t0")) * fps).cast("bigint")
    work = obs.join(origin, keys).withColumn("_tick", tick).withColumn("_b", time_bucket(F.col("ts_s")))
    # of several observations inside one tick only the last is written
    work = work.groupBy(*keys, "_tick").agg(
        F.max(F.struct("ts_s", "det_ord")).alias("_o"), F.max("_b").alias("_b"), F.max("_t1").alias("_t1"))
    here = F.struct(F.col("_tick").alias("tick"), F.col("_o").alias("o"))
    lagged = split_lag(work, keys, ["_tick"], "_b", here, "_prev")
    spans = lagged.where(F.col("_prev").isNotNull()).select(
        *keys, F.col("_prev.o").alias("o"), F.col("_prev.tick").alias("first"), (F.col("_tick") - 1).alias("last"))
    tail = work.where(F.col("_o.ts_s") == F.col("_t1")).select(
        *keys, F.col("_o").alias("o"), F.col("_tick").alias("first"), F.col("_tick").alias("last"))
    dealt = spans.union(tail).withColumn(
        "_from", F.explode(F.sequence("first", "last", F.lit(TICK_STRETCH).cast("bigint")))).repartition(*keys, "_from")
    return dealt.select(
        *keys, F.col("o.ts_s").alias("source_ts"), F.col("o.det_ord").alias("det_ord"), "first",
        F.explode(F.sequence("_from", F.least("last", F.col("_from") + TICK_STRETCH - 1))).alias("tick"),
    ).withColumn("duplicated", F.col("tick") > F.col("first")).drop("first")


def snapshot_staleness(ticks: DataFrame, inferences: DataFrame, keys: list[str], max_age_ms: float = 800.0) -> DataFrame:
    """Age of the last inference at each tick and whether it is still fresh."""
    found = latest_not_after(ticks, inferences, keys, "ts_s", "ts_s", F.col("ts_s"), "_last")
    age = F.bround((F.col("ts_s") - F.col("_last")) * 1000.0, 3)
    return found.withColumn("age_ms", age).withColumn(
        "fresh", F.coalesce(F.col("age_ms") <= max_age_ms, F.lit(False))).drop("_last")


def envelope_sync_ms(source_ts: Column, created_ms: Column) -> Column:
    """Newest source timestamp in ms, else the creation time."""
    return F.coalesce(F.when(source_ts > 0, source_ts * 1000.0), created_ms)


def overlay_asof(ticks: DataFrame, envelopes: DataFrame, keys: list[str], delay_ms: float) -> DataFrame:
    """Frame of the last envelope whose sync time is not after ``tick - delay``."""
    target = ticks.withColumn("_target", F.col("tick_ms") - delay_ms)
    found = latest_not_after(target, envelopes, keys, "_target", "sync_ms", F.struct("sync_ms", "frame"), "_e",
                             width=3_600_000.0)
    return found.withColumn("overlay_frame", F.col("_e.frame")).drop("_target", "_e")


def overlay_delay_ms(max_video_lag: Column, fixed_ms: float, offset_ms: float = 0.0, safety_ms: float = 0.0) -> Column:
    return F.when(max_video_lag > 0, max_video_lag + offset_ms + safety_ms).otherwise(F.lit(fixed_ms))


def visible_e2e_ms(max_video_lag: Column, ai_path: Column, delivery: Column, overlay: Column) -> Column:
    return F.greatest(F.coalesce(max_video_lag, F.lit(0.0)), ai_path + delivery, overlay)


def camera_freshness(last_seen_ms: Column, now_ms: Column) -> Column:
    age = now_ms - last_seen_ms
    return F.when(last_seen_ms.isNull(), "off").when(age < 2200, "live").when(age < 7000, "stale").otherwise("off")


def with_manifest(summary: DataFrame, manifests: DataFrame) -> DataFrame:
    """Run rows with the parameters of their manifest, empty where there is none."""
    return summary.join(manifests, "run_id", "left").fillna("")
