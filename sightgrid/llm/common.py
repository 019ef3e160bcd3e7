"""Helpers of the operators: table readers, shared files, Arrow batches and connected components."""

from __future__ import annotations

import functools
import os
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightgrid.session import cut_lineage, fresh_folder, ship_package
from sightgrid.sources.tables import table

WORD_CLASS = r"[^\x20\x09-\x0D]"  # a word is a run of these; the rest is white space
BATCH_BYTES, ARROW_BYTES = 8 << 20, 24 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and continue from there (compressed; survives executor loss)."""
    spark = df.sparkSession
    folder = fresh_folder(spark, name)
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def hinted(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """``df`` (a stored table of narrow rows) for broadcast if it has few rows, else as it is: then the join is shuffled."""
    return F.broadcast(df) if df.count() <= rows else df


def ready(df: DataFrame) -> DataFrame:
    """Make sure that Python workers of ``df``'s session can import this package and get batches of bounded size."""
    ship_package(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return df


def lean(make: Callable) -> Callable:
    """``make`` (a generator over Arrow batches) as a task that leaves little in its Python worker.

    Spark keeps workers for later tasks of any operator, beside an executor's heap. Token tables that another operator has
    left are dropped before the task; what it has freed goes back to the system after it, where the C library can do so.
    """

    @functools.wraps(make)
    def run(batches):
        import ctypes

        tokens = sys.modules.get("sightgrid.llm.tokens")
        if tokens:
            tokens.forget()
        yield from make(batches)
        pa.default_memory_pool().release_unused()
        getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)(0)

    return run


def file_system(uri: str):
    """(pyarrow file system, path) of a folder that driver and executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else "file:/" + uri.removeprefix("file:").lstrip("/"))


def write_file(uri: str, chunks, attempt: str) -> None:
    """Write ``chunks`` (bytes) to ``uri`` in one step: an attempt that dies leaves nothing under the final name."""
    fs, path = file_system(uri)
    part = f"{path}.{attempt}"
    fs.create_dir(os.path.dirname(path), recursive=True)
    with fs.open_output_stream(part) as out:
        for chunk in chunks:
            out.write(chunk)
    fs.move(part, path)


def map_file(uri: str, dtype) -> np.ndarray:
    """The file as an array: memory-mapped where the shared folder is a mounted path, else read through its file system."""
    fs, path = file_system(uri)
    if fs.type_name == "local":
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.zeros(0, dtype)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=dtype)


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``limit`` bytes of text (a longer single text is a slice of its own), nulls as ''."""
    import pyarrow.compute as pc

    k = batch.schema.get_field_index(column)
    text = pc.fill_null(batch.column(k).cast(pa.large_string()), "")
    batch = batch.set_column(k, column, text)
    ends = np.cumsum(np.asarray(pc.binary_length(text)), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, to - at)
        pa.default_memory_pool().release_unused()
        at = to


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(first word of each text and the end, code of every word, distinct words) of non-null texts."""
    import pyarrow.compute as pc

    parts = pc.ascii_split_whitespace(texts)
    flat = parts.flatten()
    offsets = np.asarray(parts.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    keep = np.asarray(pc.greater(pc.binary_length(flat), 0)) if len(flat) else np.zeros(0, bool)
    if not keep.all():  # leading and trailing white space leave empty strings
        offsets = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])[offsets]
        flat = flat.filter(pa.array(keep))
    coded = flat.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return offsets, np.asarray(coded.indices, dtype=np.int64), coded.dictionary


def per_row(offsets: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive ``offsets``."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def word_count(text) -> F.Column:
    """Words of a text as a native column (null text: 0)."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit values whose result bits depend on all input bits."""
    h = h.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each distinct word."""
    import hashlib

    out = np.empty(len(words), np.uint64)
    for k, w in enumerate(words.to_pylist()):
        out[k] = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long): the smallest node that links reach.

    Each round every node takes the smallest label among itself and its neighbours and then the label of its label; rounds
    stop when no label changes. Edges within one label are dropped from round to round, so later rounds carry little. A node
    with very many links is reduced by partial aggregation before the shuffle.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    links = cut_lineage(both)
    labels = cut_lineage(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                         .select("node", F.least("node", "m").alias("component")))
    while True:
        seen = links.join(labels.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b")
        lower = seen.groupBy(F.col("a").alias("node")).agg(F.min("cb").alias("m"))
        best = labels.join(lower, "node").select("node", "component", F.least("component", "m").alias("next"))
        # the root a node hung on hears of the smaller label too, else long chains need a round for each step
        told = best.groupBy(F.col("component").alias("node")).agg(F.min("next").alias("told"))
        best = best.join(told, "node", "left").select(
            "node", "component", F.least("next", F.coalesce("told", "next")).alias("next"))
        up = best.select(F.col("node").alias("next"), F.col("next").alias("top"))
        new = cut_lineage(best.join(up, "next", "left").select(
            "node", F.least("next", F.coalesce("top", "next")).alias("component"),
            (F.least("next", F.coalesce("top", "next")) < F.col("component")).alias("changed")))
        labels = new.select("node", "component")
        if new.where("changed").isEmpty():
            return labels
