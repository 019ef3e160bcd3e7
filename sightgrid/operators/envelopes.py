"""Per-frame metadata envelopes: building them, validating them, examples and publish intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightgrid.operators.ordered import carry_in
from sightgrid.operators.quantiles import exact_percentiles

SCHEMA_NAME = "sightgrid.metadata.v1"
# The fields an envelope, a detection and an alert must carry.
ENVELOPE_FIELDS = ["schema", "created_epoch_ms", "created_epoch_s", "frame", "run_label", "model_version", "model",
                   "format", "detections", "alerts"]
DETECTION_FIELDS = ["camera_id", "track_id", "global_id", "class_id", "class_name", "confidence", "bbox_px",
                    "foot_point_px", "position_m", "zones", "timestamp"]
ALERT_FIELDS = ["alert_id", "alert_type", "alert_level", "global_id", "zone_id", "class_name", "position_m", "cameras",
                "confidence", "timestamp"]


def _pair(a: str, b: str, digits: int) -> Column:
    return F.when(F.col(a).isNotNull(), F.array(F.bround(a, digits), F.bround(b, digits)))


def detection_doc() -> Column:
    return F.struct(
        F.col("cam_id").alias("camera_id"), "track_id", "global_id", "class_id", "class_name",
        F.bround("confidence", 4).alias("confidence"),
        F.array(*[F.bround(c, 2) for c in ("x1", "y1", "x2", "y2")]).alias("bbox_px"),
        F.array(F.bround((F.col("x1") + F.col("x2")) / 2, 2), F.bround("y2", 2)).alias("foot_point_px"),
        _pair("x_m", "y_m", 3).alias("position_m"),
        F.filter(F.split("inside_zones", r"\+"), lambda z: z != "").alias("zones"),
        F.bround("ts_s", 6).alias("timestamp"),
    )


def alert_doc() -> Column:
    return F.struct(
        "alert_id", "alert_type", "alert_level", "global_id", "zone_id", "class_name",
        _pair("x_m", "y_m", 3).alias("position_m"), "cameras", F.bround("confidence", 4).alias("confidence"),
        F.bround("ts_s", 6).alias("timestamp"),
    )


def build_envelopes(frames: DataFrame, dets: DataFrame, alerts: DataFrame, every_n: int = 1,
                    timing: DataFrame | None = None) -> DataFrame:
    """One document per published frame with its detections and alerts in order.

    ``frames`` has ``run_id, frame, created_epoch_ms`` and the model columns; only every ``every_n``-th frame is kept,
    and that filter is applied to all inputs before anything is grouped. ``timing`` (``run_id, frame, timing``) adds the timing
    block; a frame without one has none in its document.
    """
    kept = (F.col("frame") % max(1, every_n)) == 0
    d = dets.where(kept).groupBy("run_id", "frame").agg(F.array_sort(F.collect_list(
        F.struct("det_ord", detection_doc().alias("doc")))).alias("_d"))
    a = alerts.where(kept).groupBy("run_id", "frame").agg(F.array_sort(F.collect_list(
        F.struct("alert_id", alert_doc().alias("doc")))).alias("_a"))
    work, block = frames.where(kept).join(d, ["run_id", "frame"], "left").join(a, ["run_id", "frame"], "left"), []
    if timing is not None:
        work, block = work.join(timing.where(kept).select("run_id", "frame", "timing"), ["run_id", "frame"], "left"), ["timing"]
    return (
        work
        .select(
            F.lit(SCHEMA_NAME).alias("schema"), "created_epoch_ms",
            F.bround(F.col("created_epoch_ms") / 1000.0, 6).alias("created_epoch_s"), "frame",
            F.col("run_id").alias("run_label"), "model_version", "model", "format",
            F.coalesce(F.transform("_d", lambda x: x["doc"]), F.array()).alias("detections"),
            F.coalesce(F.transform("_a", lambda x: x["doc"]), F.array()).alias("alerts"), *block,
        )
    )


def envelope_facts(lines: DataFrame) -> DataFrame:
    """Per raw JSON line: what is missing, counts, camera and class sets, newest source time.

    ``lines`` has ``file, line_no, value``. Nested objects are read as ``map<string,string>`` so that an absent key is
    told apart from a NULL.
    """
    nested = "array<map<string,string>>"
    parsed = lines.where(F.trim("value") != "").withColumn("j", F.from_json(
        "value", f"frame string, created_epoch_ms string, created_epoch_s string, detections {nested}, alerts {nested}"
    ))
    dets = F.coalesce(F.col("j.detections"), F.array())
    alerts = F.coalesce(F.col("j.alerts"), F.array())

    def lacks(objects: Column, fields: list[str]) -> Column:
        wanted = F.array(*map(F.lit, fields))
        return F.size(F.filter(objects, lambda o: F.size(F.array_except(wanted, F.map_keys(o))) > 0))

    def values(objects: Column, key: str) -> Column:
        return F.array_compact(F.transform(objects, lambda o: F.nullif(F.try_element_at(o, F.lit(key)), F.lit(""))))

    times = F.transform(
        F.concat(values(dets, "timestamp"), values(alerts, "timestamp")), lambda t: t.try_cast("double"))
    voters = F.flatten(F.transform(values(alerts, "cameras"), lambda c: F.from_json(c, "array<string>")))
    keys = F.coalesce(F.json_object_keys("value"), F.array())
    return parsed.select(
        "file", "line_no", "value",
        (F.size(F.array_except(F.array(*map(F.lit, ENVELOPE_FIELDS)), keys)) > 0).alias("incomplete"),
        F.col("j.frame").try_cast("bigint").alias("frame"),
        F.col("j.created_epoch_ms").try_cast("double").alias("created_ms"),
        F.col("j.created_epoch_s").try_cast("double").alias("created_s"),
        F.size(dets).cast("bigint").alias("detections"), F.size(alerts).cast("bigint").alias("alerts"),
        lacks(dets, DETECTION_FIELDS).cast("bigint").alias("missing_detection"),
        lacks(alerts, ALERT_FIELDS).cast("bigint").alias("missing_alert"),
        F.size(F.filter(values(dets, "bbox_px"), lambda b: F.json_array_length(b) == 4)).cast("bigint").alias("bbox_ok"),
        F.size(values(dets, "global_id")).cast("bigint").alias("global_ids"),
        F.array_distinct(F.concat(values(dets, "camera_id"), voters)).alias("cameras"),
        F.array_distinct(values(dets, "class_name")).alias("classes"),
        F.array_distinct(values(alerts, "alert_type")).alias("alert_types"),
        F.greatest(F.array_max(times), F.lit(0.0)).alias("newest_ts"),
    )


def publish_intervals(facts: DataFrame, bucket: int = 100_000) -> DataFrame:
    """Per line the interval to the file's last envelope with a creation time (ms), and whether the frame number is below the
    last one given. The two series are apart: a line that lacks one of the two still counts in the other.
    """
    known = facts.where(F.col("created_ms").isNotNull() | F.col("frame").isNotNull()).select(
        "file", "line_no", "frame", "created_ms", F.floor(F.col("line_no") / bucket).alias("_b"))
    last = lambda c: F.last(c, ignorenulls=True)
    carried = carry_in(known, ["file"], "_b", {
        f"_{c}": (F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_no"))), last) for c in ("frame", "created_ms")})
    inside = Window.partitionBy("file", "_b").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    before = {c: F.coalesce(last(c).over(inside), F.col(f"_{c}")) for c in ("frame", "created_ms")}
    return carried.select(
        "file", "line_no", "frame", (F.col("created_ms") - before["created_ms"]).alias("interval_ms"),
        F.coalesce(F.col("frame") < before["frame"], F.lit(False)).alias("backwards"))


def _names(facts: DataFrame, column: str) -> DataFrame:
    """Distinct names per file, joined with ``, `` (the distinct set is small by nature: cameras, classes, types)."""
    return facts.select("file", F.explode(column).alias("v")).distinct().groupBy("file").agg(
        F.array_join(F.array_sort(F.collect_list("v")), ", ").alias(column))


def validate_envelopes(facts: DataFrame) -> DataFrame:
    """One row per file: structure problems, inventories, publish interval and metadata lag."""
    counts = facts.groupBy("file").agg(
        F.count(F.lit(1)).alias("envelopes"),
        *[F.sum(c).alias(c) for c in ("detections", "alerts", "bbox_ok", "global_ids")],
        F.count(F.when(F.col("incomplete"), 1)).alias("missing_envelope"),
        F.sum("missing_detection").alias("missing_detection"), F.sum("missing_alert").alias("missing_alert"))
    steps = publish_intervals(facts)
    backwards = steps.groupBy("file").agg(F.count(F.when(F.col("backwards"), 1)).alias("frame_backwards"))
    lags = facts.where((F.col("newest_ts") > 0) & F.col("created_s").isNotNull()).select(
        "file", ((F.col("created_s") - F.col("newest_ts")) * 1000.0).alias("lag_ms"))
    out = counts.join(backwards, "file", "left")
    for df, value, tag in ((steps, "interval_ms", "_i"), (lags, "lag_ms", "_l")):
        p95 = exact_percentiles(df, ["file"], F.col(value), {f"{tag}_p95": (0.95, "nearest")})
        out = out.join(p95.select("file", f"{tag}_p95", F.col("mean").alias(f"{tag}_mean")), "file", "left")
    for column in ("cameras", "classes", "alert_types"):
        out = out.join(_names(facts, column), "file", "left")
    return out.fillna(0).fillna("").select(
        "file", "envelopes", "detections", "alerts", "cameras", "classes", "alert_types", "bbox_ok", "global_ids",
        "missing_envelope", "missing_detection", "missing_alert", "frame_backwards",
        F.bround("_i_mean", 3).alias("publish_interval_mean_ms"), F.bround("_i_p95", 3).alias("publish_interval_p95_ms"),
        F.bround("_l_mean", 3).alias("metadata_lag_mean_ms"), F.bround("_l_p95", 3).alias("metadata_lag_p95_ms"))


def first_example(facts: DataFrame) -> DataFrame:
    """First line of a file with a detection and first line with an alert."""
    return facts.groupBy("file").agg(
        F.min(F.when(F.col("detections") > 0, F.col("line_no"))).alias("with_detection"),
        F.min(F.when(F.col("alerts") > 0, F.col("line_no"))).alias("with_alert"))


def first_example_envelopes(facts: DataFrame) -> DataFrame:
    """First envelope of a file with a detection and first one with an alert, as written (``facts`` with their ``value``)."""
    def first(count: str) -> Column:
        return F.min_by("value", F.when(F.col(count) > 0, F.col("line_no")))

    return facts.groupBy("file").agg(first("detections").alias("example_with_detection"), first("alerts").alias("example_with_alert"))


def _broken() -> Column:
    return (F.trim("value") != "") & F.try_parse_json("value").isNull()


def broken_lines(lines: DataFrame) -> DataFrame:
    """``file, line_no, value`` of lines that are neither blank nor JSON (strict JSON: no NaN or Infinity)."""
    return lines.where(_broken()).select("file", "line_no", "value")


def require_json_lines(lines: DataFrame) -> DataFrame:
    """``lines`` as they are; a job that meets a line that is not JSON fails and names file and line number."""
    fault = F.raise_error(F.concat(F.lit("invalid JSON in "), "file", F.lit(", line "), F.col("line_no").cast("string")))
    return lines.withColumn("value", F.when(_broken(), fault).otherwise(F.col("value")))
