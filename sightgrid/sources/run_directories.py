"""Run directories compared: alert-delivery benchmarks and campaigns, one row each.

All files of a kind are read in one scan over the directories; the driver only lists names. A directory with ``alert_latency.csv``
is a delivery benchmark, else one with ``phase3/summary.csv`` and ``phase3/sync_events.csv`` is a campaign; others are left out.
A file may also be a folder of part files, as Spark writes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightgrid.operators import health
from sightgrid.operators.quantiles import latency_stats
from sightgrid.sources.run_files import read_manifests, read_run_csv
from sightgrid.sources.sinks import union_header

DELIVERY, SUMMARY, SYNC = "alert_latency.csv", "phase3/summary.csv", "phase3/sync_events.csv"
LINKS, MANIFEST = "phase3/fusion_links.csv", "manifest.json"


def _having(spark: SparkSession, pattern: str, name: str) -> set[str]:
    """Directories matching the pattern that hold ``name``."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{pattern.rstrip('/')}/{name}")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    return {s.getPath().toString().removesuffix(f"/{name}") for s in found}


def _run_dir(name: str) -> Column:
    """Directory of the run whose file ``name`` (or part of it) a row came from, without the scheme's empty authority."""
    directory = F.regexp_replace(F.col("_metadata.file_path"), rf"/\Q{name}\E(?:/[^/]*)?$", "")
    return F.regexp_replace(directory, r"^file:/+", "file:/")


def _first_line() -> Column:
    return F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("id"))


def delivery_rows(spark: SparkSession, dirs: set[str]) -> DataFrame:
    """Delivery latencies of each directory: unreadable ones are skipped, and a run left without any has zeros.

    The transport is the last one named in the file, else the directory's name.
    """
    raw = spark.read.csv([f"{d}/{DELIVERY}" for d in sorted(dirs)], header=True, enforceSchema=False, nullValue="",
                         schema="event_id string, transport string, latency_ms string")
    rows = raw.select(_run_dir(DELIVERY).alias("run_dir"), "transport", F.trim("latency_ms").try_cast("double").alias("latency_ms"),
                      _first_line().alias("_at"))
    named = rows.groupBy("run_dir").agg(F.max_by("transport", F.when(F.col("transport") != "", F.col("_at"))).alias("transport"))
    stats = latency_stats(rows, ["run_dir"], F.col("latency_ms"), 6, p95="nearest").withColumnRenamed("n", "events")
    spine = spark.createDataFrame([(d, d.rsplit("/", 1)[1]) for d in sorted(dirs)], "run_dir string, _name string")
    return spine.join(named, "run_dir", "left").join(stats, "run_dir", "left").fillna(
        0, [c for c in stats.columns if c != "run_dir"]).select(
        "run_dir", F.lit("alert_delivery").alias("summary_type"), F.coalesce("transport", "_name").alias("transport"),
        *[c for c in stats.columns if c != "run_dir"])


def campaign_rows(spark: SparkSession, dirs: set[str], with_links: set[str], with_manifest: set[str],
                  expected: list[str] | None = None) -> DataFrame:
    """Health of each campaign (from the first line of its summary) with the parameters of its manifest, empty where there is none."""
    def read(kind: str, name: str, of: set[str]) -> DataFrame:
        return read_run_csv(spark, kind, [f"{d}/{name}" for d in sorted(of)], defaults=True, run_id=_run_dir(name), at=_first_line())

    summary = read("run_summary", SUMMARY, dirs)
    columns = [c for c in summary.columns if c not in ("run_id", "_at")]
    first = summary.groupBy("run_id").agg(F.min_by(F.struct(*columns), "_at").alias("s")).select("run_id", "s.*")
    sync = read("sync_events", SYNC, dirs)
    if with_links & dirs:
        links = health.fusion_link_stats(read("fusion_links", LINKS, with_links & dirs), F.col("_at"))
    else:
        links = spark.createDataFrame([], "run_id string, frames_with_fusion bigint, camera_pairs bigint, top_pair string, "
                                          "top_pair_links bigint")
    rows = health.run_health(first, health.camera_sync_stats(sync, expected), links)
    if with_manifest & dirs:
        found = read_manifests(spark, [f"{d}/{MANIFEST}" for d in sorted(with_manifest & dirs)])
        rows = health.with_manifest(rows, found.withColumn("run_id", F.regexp_replace("run_id", r"^file:/+", "file:/")))
    return rows.withColumnRenamed("run_id", "run_dir").withColumn("summary_type", F.lit("phase3_campaign"))


def compare_run_directories(spark: SparkSession, pattern: str, expected: list[str] | None = None) -> DataFrame | None:
    """One row per run directory that matches ``pattern``; ``run_dir`` first, the other columns sorted. None where there is no run."""
    delivery = _having(spark, pattern, DELIVERY)
    campaigns = (_having(spark, pattern, SUMMARY) & _having(spark, pattern, SYNC)) - delivery
    parts = []
    if delivery:
        parts.append(delivery_rows(spark, delivery))
    if campaigns:
        parts.append(campaign_rows(spark, campaigns, _having(spark, pattern, LINKS), _having(spark, pattern, MANIFEST), expected))
    return union_header(parts) if parts else None
