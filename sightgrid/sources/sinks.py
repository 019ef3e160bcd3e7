"""Writers: stable-header CSV, union-header CSV, envelope JSON lines, label files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_fixed_csv(df: DataFrame, columns: list[str], path: str) -> None:
    """CSV with exactly ``columns`` in that order; other columns are left out, absent ones stay empty."""
    present = set(df.columns)
    df.select(*[F.col(c) if c in present else F.lit(None).cast("string").alias(c) for c in columns]).write.mode(
        "overwrite").csv(path, header=True, emptyValue="")


def union_header(parts: list[DataFrame], first: str = "run_dir") -> DataFrame:
    """Union of summary tables with the sorted union of their columns, ``first`` in front."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    rest = sorted(c for c in out.columns if c != first)
    return out.select(*([first] if first in out.columns else []), *rest)


def write_union_csv(parts: list[DataFrame], path: str, first: str = "run_dir") -> None:
    union_header(parts, first).write.mode("overwrite").csv(path, header=True, emptyValue="")


def write_envelopes(envelopes: DataFrame, path: str) -> None:
    """One JSON document per line; NULL fields are written so that a reader sees every key."""
    envelopes.write.mode("overwrite").json(path, ignoreNullFields=False)


def write_label_files(lines: DataFrame, path: str) -> None:
    """One text file per image stem below ``path/stem=<stem>`` (``lines`` has ``stem, line_no, line``)."""
    text = lines.groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l")).select(
        "stem", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("value"))
    text.write.mode("overwrite").partitionBy("stem").text(path)
