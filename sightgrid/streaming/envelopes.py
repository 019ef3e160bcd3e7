"""Envelope and alert streams: source, explosion, delivery latency, de-duplication, windows, sessions.

The watermark (10 s by default, the matching tolerance) is a choice of this engine: recorded frames come in lockstep and
have no late data. Everything here is a plain DataFrame transformation and works on batches as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightgrid import schemas
from sightgrid.session import fresh_folder

WATERMARK = "10 seconds"


def read_envelope_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Envelope JSON lines as they arrive in ``folder``, with the time they were picked up."""
    reader = spark.readStream.schema(schemas.ENVELOPE)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(folder).withColumn("received_epoch_ms", F.unix_micros(F.current_timestamp()) / 1000.0)


def stream_detections(envelopes: DataFrame) -> DataFrame:
    return envelopes.select("run_label", "frame", F.explode("detections").alias("d")).select("run_label", "frame", "d.*")


def stream_alerts(envelopes: DataFrame) -> DataFrame:
    """Alerts with the creation time of their envelope and an event time for watermarks."""
    keep = [c for c in ("received_epoch_ms",) if c in envelopes.columns]
    return envelopes.select("run_label", "frame", "created_epoch_ms", *keep, F.explode("alerts").alias("a")).select(
        "run_label", "frame", "created_epoch_ms", *keep, "a.*",
        F.timestamp_millis(F.col("created_epoch_ms").cast("bigint")).alias("event_time"))


def delivery_latency_ms(received_ms: Column, created_ms: Column) -> Column:
    """Never negative, even when the clocks of sender and receiver differ; 0 without a creation time."""
    return F.greatest(F.lit(0.0), received_ms - F.coalesce(created_ms, received_ms))


def dedupe_alerts(alerts: DataFrame, watermark: str = WATERMARK, time: str = "event_time") -> DataFrame:
    return alerts.withWatermark(time, watermark).dropDuplicatesWithinWatermark(["alert_id"])


def stream_counters(envelopes: DataFrame) -> DataFrame:
    """Envelope, detection and alert counts and the last frame per run (complete mode)."""
    return envelopes.groupBy("run_label").agg(
        F.count(F.lit(1)).alias("envelopes"), F.sum(F.size("detections")).alias("detections"),
        F.sum(F.size("alerts")).alias("alerts"), F.max("frame").alias("last_frame"))


def released_ticks(captures: DataFrame, tick: str, tolerance_ms: float, watermark: str = WATERMARK,
                   time: str = "event_time") -> DataFrame:
    """Ticks whose cameras were captured within the tolerance of each other; the watermark closes a tick."""
    agg = captures.withWatermark(time, watermark).groupBy("run_id", F.window(time, tick).alias("w")).agg(
        (F.min("cam_id") == F.max("cam_id")).alias("_alone"), F.min("ts_s").alias("_lo"), F.max("ts_s").alias("_hi"))
    skew = F.bround((F.col("_hi") - F.col("_lo")) * 1000.0, 3)
    return agg.where(F.col("_alone") | (skew <= tolerance_ms)).select(
        "run_id", F.col("w.start").alias("tick_start"), skew.alias("skew_ms"))


def latency_monitor(latencies: DataFrame, keys: list[str], period: str, watermark: str = WATERMARK,
                    time: str = "event_time") -> DataFrame:
    """Average and maximum latency per key and report period."""
    return latencies.withWatermark(time, watermark).groupBy(*keys, F.window(time, period).alias("w")).agg(
        F.bround(F.avg("latency_ms"), 3).alias("avg_ms"), F.bround(F.max("latency_ms"), 3).alias("max_ms"),
        F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("period_start"), "avg_ms", "max_ms", "n")


def false_positive_sessions(alerts: DataFrame, keys: list[str], gap: str = "3 seconds", watermark: str = WATERMARK,
                            time: str = "event_time") -> DataFrame:
    """Alerts merged while they follow each other within the gap."""
    return alerts.withWatermark(time, watermark).groupBy(*keys, F.session_window(time, gap).alias("s")).agg(
        F.count(F.lit(1)).alias("n_detections"), F.max(time).alias("end_time")).select(
        *keys, F.col("s.start").alias("start_time"), "end_time", "n_detections")


def run_available(stream: DataFrame, mode: str = "append", through: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a stream over what is there now into the shared folder and return the result as a table.

    Append mode uses the exactly-once file sink. The other modes write each micro-batch to a folder of its own (complete mode:
    to one folder), so a batch that is tried again replaces what its first try left.
    """
    spark = stream.sparkSession
    out, state = fresh_folder(spark, "stream-out"), fresh_folder(spark, "stream-state")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        def store(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/micro_batch={0 if mode == 'complete' else number}")

        query = writer.foreachBatch(store).start()
    query.awaitTermination()
    result = spark.read.schema(stream.schema).parquet(out).select(*stream.columns)
    return through(result) if through else result
