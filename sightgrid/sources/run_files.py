"""Readers of run files: typed CSV, envelope JSON lines, ground truth, alert logs, manifests, label files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightgrid import schemas
from sightgrid.functions import names
from sightgrid.functions.names import strip
from sightgrid.operators.ordered import split_ordinal

# Fixed value: shape of an alert inside a log line.
ALERT_PATTERN = (
    r"(?U)Alert\[([^\]]+)\]\s+(\w+)(?::(\w+))?(?:\s+zone=(\w+))?\s+gid=(-?\d+)\s+"
    r"pos=\((-?\d+(?:\.\d+)?)m,(-?\d+(?:\.\d+)?)m\)\s+cams=([^\s]+)\s+conf=(-?\d+(?:\.\d+)?)"
)


def _typed(c: Column, kind: str) -> Column:
    """A text cell as its type; whole numbers may be written as ``3.0``."""
    if kind == "string":
        return c
    number = F.nullif(F.trim(c), F.lit("")).cast("double")
    return number if kind == "double" else number.cast(kind)


def read_run_csv(spark: SparkSession, kind: str, path: str | list[str], columns: list[str] | None = None,
                 defaults: bool = False, run_id: Column | None = None, at: Column | None = None) -> DataFrame:
    """A run file by its kind. ``columns`` names the header when a file carries fewer columns.

    Columns are pruned and typed in the scan's projection; ``defaults`` puts 0 for missing numbers.
    ``run_id`` and ``at`` add the run a row belongs to and its place (``_at``), told from the file's metadata.
    """
    types = dict(schemas.fields(schemas.RUN_FILES[kind]))
    header = columns or list(types)
    raw = spark.read.csv(path, header=True, schema=", ".join(f"`{n}` string" for n in header), enforceSchema=False,
                         nullValue="", multiLine=False)
    extra = [v.alias(n) for v, n in ((run_id, "run_id"), (at, "_at")) if v is not None]
    df = raw.select(*[_typed(F.col(n), types.get(n, "string")).alias(n) for n in header], *extra)
    return df.fillna(0) if defaults else df


def read_envelopes(spark: SparkSession, path: str | list[str], strict: bool = False) -> DataFrame:
    """Envelope JSON lines with their schema; broken lines are kept in ``_corrupt`` or fail the job when ``strict``."""
    if strict:
        return spark.read.json(path, schema=schemas.ENVELOPE, mode="FAILFAST")
    return spark.read.json(path, schema=schemas.ENVELOPE + ", _corrupt string", mode="PERMISSIVE",
                           columnNameOfCorruptRecord="_corrupt")


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, line_no, value`` of text files of any size.

    Files are read in blocks; a line's number is its place in its block plus the lines of the earlier blocks.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"), "value")
    return split_ordinal(raw, ["file"], ["_id"], "_block", "_n").select(
        "file", (F.col("_n") + 1).alias("line_no"), "value")


def read_ground_truth(spark: SparkSession, path: str | list[str], camera: str | None = None) -> DataFrame:
    """Annotated events of a JSON array: ``truth_ord`` is the file order, ``class_norm`` the comparable class."""
    df = spark.read.json(path, schema=schemas.TRUTH, multiLine=True)
    df = df.withColumn("truth_ord", F.monotonically_increasing_id())
    if camera is not None:
        df = df.where(F.col("id_camera") == camera)
    return df.select(
        F.col("id_camera").alias("cam_id"), F.col("id_evenement").alias("event_id"),
        F.col("classe_objet").alias("class_name"), "zone_id", F.col("id_salle").alias("room"), "truth_ord",
        F.coalesce("trame_violation", "trame_apparition").alias("appear_frame"),
        F.coalesce("horodatage_violation", "horodatage_apparition").alias("t_ms"),
        names.normalize_class(F.col("classe_objet")).alias("class_norm"),
        # the exit time is written in seconds although the other times are in ms
        F.coalesce("horodatage_sortie", "t_sortie_sec", "temps_sortie").alias("exit_s"),
        F.coalesce("trame_sortie", "frame_sortie").alias("exit_frame"),
    )


def parse_alert_lines(lines: DataFrame) -> DataFrame:
    """Alerts found in log lines (``line_no, value``): first hit per line, level defaults to confirmed."""
    def group(i: int) -> Column:
        return F.regexp_extract("value", ALERT_PATTERN, i)

    keep = [c for c in lines.columns if c != "value"]
    return lines.where(F.col("value").rlike(ALERT_PATTERN)).select(
        *keep, F.trim("value").alias("raw_line"), group(1).alias("alert_id"), group(2).alias("alert_type"),
        F.coalesce(F.nullif(group(3), F.lit("")), F.lit("confirmed")).alias("alert_level"),
        group(4).alias("declared_zone"), group(5).cast("bigint").alias("global_id"), group(6).cast("double").alias("x_m"),
        group(7).cast("double").alias("y_m"),
        F.filter(F.split(group(8), r"\+"), lambda s: s != "").alias("cameras"), group(9).cast("double").alias("confidence"),
    )


def parse_alert_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_alert_lines(read_lines(spark, path))


def run_directory() -> Column:
    """Directory part of the file a row came from."""
    return F.regexp_replace(F.col("_metadata.file_path"), r"/[^/]*$", "")


def read_manifests(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Run parameters by directory."""
    ddl = ("mode string, capture_backend string, gst_protocol string, gst_latency_ms string, gst_pipeline string, "
           "ffmpeg_fallback string, record_video string, record_fps string")
    return spark.read.json(path, schema=ddl, multiLine=True).select(run_directory().alias("run_id"), "*")


def path_context(path: Column, task: str) -> list[Column]:
    """(format, camera, model) from ``phase2/<task>/<version_format>/<camera>/[<model>/]file``; empty if it differs."""
    tail = F.regexp_extract(path, rf"(?:^|/)phase2/{task}/([^/]+/[^/]+/(?:[^/]+/)?[^/]+)$", 1)
    parts = F.split(tail, "/")
    version_format = F.get(parts, F.lit(0))
    fmt = F.when(F.instr(version_format, "_") > 0, F.regexp_replace(version_format, r"^[^_]*_", "")).otherwise(version_format)
    found = tail != ""
    return [
        F.when(found, fmt).otherwise("").alias("format"),
        F.when(found, F.get(parts, F.lit(1))).otherwise("").alias("camera"),
        F.when(found & (F.size(parts) > 3), F.get(parts, F.lit(2))).otherwise("").alias("model_hint"),
    ]


def label_line_parts(lines: DataFrame) -> DataFrame:
    """Every label line of at least five fields: class (NULL if unreadable), box and ``rest``, all fields after the class."""
    keep = [c for c in lines.columns if c != "value"]
    parts = F.split(strip(F.col("value")), r"\s+")
    return lines.where(F.size(parts) >= 5).select(*keep, F.get(parts, F.lit(0)).try_cast("bigint").alias("class_id"), *[
        F.get(parts, F.lit(i + 1)).try_cast("double").alias(n) for i, n in enumerate(("xc", "yc", "w", "h"))],
        F.array_join(F.slice(parts, F.lit(2), F.size(parts)), " ").alias("rest"))


def parse_label_lines(lines: DataFrame) -> DataFrame:
    """Training labels ``class xc yc w h ...`` of text lines; short lines and unreadable classes are dropped."""
    return label_line_parts(lines).where(F.col("class_id").isNotNull())


def read_label_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Label rows with the stem of their file and the line number."""
    lines = read_lines(spark, path).withColumn("stem", F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?$", 1)).drop("file")
    return parse_label_lines(lines)


def read_transport_latency(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Delivery latencies; unreadable ones are skipped and an empty transport takes the directory's name."""
    raw = spark.read.csv(path, header=True, schema="event_id string, transport string, latency_ms string",
                         enforceSchema=False, nullValue="")
    directory = F.regexp_extract(run_directory(), r"([^/]+)$", 1)
    return raw.select(
        run_directory().alias("run_id"), F.col("event_id").try_cast("bigint").alias("event_id"),
        F.coalesce("transport", directory).alias("transport"), F.col("latency_ms").try_cast("double").alias("latency_ms"),
    ).where(F.col("latency_ms").isNotNull())


def require_columns(df: DataFrame, needed: list[str]) -> DataFrame:
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def concat_runs(parts: list[DataFrame]) -> DataFrame:
    """Union of run tables; the columns are the union of the headers in the order they are first met."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def read_existing_csv(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """Union of CSV files with differing headers; missing files are skipped, NULL when none exists."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = [p for p in paths if hadoop(p).getFileSystem(conf).exists(hadoop(p))]
    parts = [spark.read.csv(p, header=True, nullValue="") for p in found]
    return concat_runs(parts) if parts else None
