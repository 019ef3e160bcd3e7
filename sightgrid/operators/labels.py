"""Training-label tables: spelling, remapping, exclusion, file naming and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightgrid.functions import names
from sightgrid.functions.geometry import bbox_to_label
from sightgrid.operators.ordered import split_ordinal


def corrected_labels(annotations: DataFrame) -> DataFrame:
    """Spelling corrected, class id of the closed vocabulary added (NULL when unknown)."""
    fixed = annotations.withColumn("class_fixed", names.fix_class_name(F.col("class_name")))
    return fixed.withColumn("label_id", names.label_class_id(F.col("class_fixed")))


def unknown_classes(annotations: DataFrame) -> DataFrame:
    return corrected_labels(annotations).where(F.col("label_id").isNull()).groupBy("class_fixed").agg(
        F.count(F.lit(1)).alias("n"))


def label_lines(boxes: DataFrame, key: list[str]) -> DataFrame:
    """Label text per box: class and normalised centre box with six decimals."""
    b = bbox_to_label(*[F.col(c) for c in ("x", "y", "w", "h", "img_w", "img_h")])
    return boxes.withColumn("_b", b).select(*key, F.format_string(
        "%d %.6f %.6f %.6f %.6f", F.col("label_id"), *[F.bround(f"_b.{f}", 6) for f in ("xc", "yc", "w", "h")]
    ).alias("line"))


def remap_labels(labels: DataFrame, mapping: dict[int, int], key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(remapped label rows, per-key counts seen / mapped / removed).

    Rows with an unreadable (null) class count as seen; they and classes outside the mapping are dropped. Where the rows hold
    the text after the class (``rest``), the rewritten ``line`` keeps all of it.
    """
    table = F.create_map(*[F.lit(int(x)).cast("bigint") for kv in mapping.items() for x in kv])
    tagged = labels.withColumn("new_class", F.try_element_at(table, F.col("class_id")))
    report = tagged.groupBy(*key).agg(
        F.count(F.lit(1)).alias("seen"), F.count("new_class").alias("mapped"),
        F.count(F.when(F.col("new_class").isNull(), 1)).alias("removed"))
    kept = tagged.where(F.col("new_class").isNotNull()).withColumn("class_id", F.col("new_class")).drop("new_class")
    if "rest" in labels.columns:
        kept = kept.withColumn("line", F.concat_ws(" ", "class_id", "rest"))
    return kept, report


def exclude_classes(labels: DataFrame, vocabulary: list[str], excluded: set[str]) -> tuple[DataFrame, list[str]]:
    """Label rows without the excluded classes, and the surviving class names (ids are kept)."""
    ids = [i for i, n in enumerate(vocabulary) if n in excluded]
    return labels.where(~F.col("class_id").isin(ids)), [n for n in vocabulary if n not in excluded]


def label_set_report(labels: DataFrame, images: DataFrame) -> DataFrame:
    """Labels without an image and images without a label, by stem."""
    lab, img = labels.select("stem").distinct(), images.select("stem").distinct()
    return lab.join(img, "stem", "left_anti").withColumn("problem", F.lit("label_without_image")).union(
        img.join(lab, "stem", "left_anti").withColumn("problem", F.lit("image_without_label")))


def image_sequence(frames: DataFrame, width: int = 4096) -> DataFrame:
    """1-based running number per camera in frame order."""
    spine = frames.select("cam_id", "frame").distinct().withColumn("_b", F.floor(F.col("frame") / width).cast("bigint"))
    placed = split_ordinal(spine, ["cam_id"], ["frame"], "_b", "_n").drop("_b")
    return placed.select("cam_id", "frame", (F.col("_n") + 1).alias("seq")).withColumn(
        "stem", F.format_string("%s_obj_%04d", "cam_id", "seq"))


def image_names(frames: DataFrame, images: DataFrame) -> DataFrame:
    """The image of every distinct (``cam_id, frame``): ``<cam>_frame<n>`` if ``images`` (``stem``) has it, else the legacy name.

    Only frames that miss the primary name take a running number of their camera, in frame order, whether or not an image of that
    number exists; where none does, ``stem`` is NULL.
    """
    known = images.select("stem").distinct()
    spine = frames.select("cam_id", "frame").distinct().withColumn("stem", F.format_string("%s_frame%d", "cam_id", "frame"))
    marked = spine.join(known.withColumn("_has", F.lit(True)), "stem", "left")
    named = marked.where("_has").select("cam_id", "frame", "stem")
    legacy = image_sequence(marked.where(F.col("_has").isNull())).join(known.withColumn("_has", F.lit(True)), "stem", "left")
    return named.unionByName(legacy.select("cam_id", "frame", F.when(F.col("_has"), F.col("stem")).alias("stem")))


def unique_stems(incoming: DataFrame, existing: DataFrame, width: int = 4096) -> DataFrame:
    """Stem each incoming file gets: its own if free, else the first free ``__rfN``.

    The k-th file of a stem takes the k-th number not in use with it, number 0 standing for the bare stem.
    """
    suffix = r"__rf(\d+)$"
    taken = existing.select(F.col("stem").alias("base"), F.lit(0).cast("bigint").alias("n")).union(
        existing.where(F.col("stem").rlike(suffix)).select(
            F.regexp_replace("stem", suffix, ""), F.regexp_extract("stem", suffix, 1).cast("bigint")))
    used = taken.groupBy("base").agg(F.array_sort(F.collect_set("n")).alias("used"))
    placed = split_ordinal(incoming.withColumn("_b", F.floor(F.col("file_ord") / width).cast("bigint")), ["stem"],
                           ["file_ord"], "_b", "_k")
    joined = placed.join(used, F.col("stem") == F.col("base"), "left")
    n = F.aggregate(F.coalesce("used", F.array().cast("array<bigint>")), F.col("_k"),
                    lambda at, u: F.when(u <= at, at + 1).otherwise(at))
    return joined.withColumn("_n", n).select("file_ord", "stem", F.when(F.col("_n") == 0, F.col("stem")).otherwise(
        F.concat("stem", F.lit("__rf"), F.col("_n"))).alias("final_stem"))
