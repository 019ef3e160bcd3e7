"""Token-id output: flat files of unsigned integers with 64-bit document offsets, read by memory mapping.

One shard is one range of document ids: ``shard-N.bin`` (ids, little-endian, two bytes where the vocabulary allows it, else
four), ``shard-N.doc`` (64-bit document ids) and ``shard-N.idx`` (64-bit offsets of its documents in the whole output, one
more than documents). Shards are written side by side; a shard's base is the prefix sum of the sizes before it, known once
all are written, and only then are the offsets made.

Defined results: a null text is an empty one (the end id alone); null document ids come first; repeated rows are each
written; documents with one id stand in the order of a hash of their text; an empty table gives no shard. Other columns are
not read. Rows of one id may span shards, so a hot id is no hot task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightgrid.llm.common import BATCH_BYTES, map_file, ready, stored, text_slices, write_file
from sightgrid.llm.tokens import encoder

_SHARD = "shard int, path string, docs long, null_ids long, tokens long, width int"
_ROWS = "doc_id long, start long, n_tokens long, ids binary"


def _shard_writer(folder: str, tokenizer: str, end_id: int):
    def run(batches):
        from sightgrid.llm import tokens

        enc, context = tokens.encoder(tokenizer), TaskContext.get()
        shard, attempt = context.partitionId(), f"try{context.taskAttemptId()}"
        path, ids, counts = f"{folder}/shard-{shard:06d}", [], []

        def chunks():
            for batch in batches:
                for part in text_slices(batch):
                    flat, bounds = enc.encode(part.column("text"))
                    size = np.diff(bounds)
                    out = np.full(len(flat) + len(size), end_id, enc.dtype)
                    out[np.arange(len(flat)) + np.repeat(np.arange(len(size)), size)] = flat
                    ids.extend(part.column("doc_id").to_pylist())
                    counts.append(size + 1)
                    yield out.tobytes()

        stream = chunks()
        head = next(stream, None)
        if head is None:
            return

        def all_chunks():
            yield head
            yield from stream

        write_file(f"{path}.bin", all_chunks(), attempt)
        count = np.concatenate(counts).astype("<i8")
        known = [i for i in ids if i is not None]  # nulls come first
        write_file(f"{path}.doc", [np.array(known, "<i8").tobytes()], attempt)
        write_file(f"{path}.len", [count.tobytes()], attempt)
        yield pa.RecordBatch.from_pylist([{"shard": shard, "path": path, "docs": len(ids), "null_ids": len(ids) - len(known),
                                           "tokens": int(count.sum()), "width": enc.dtype.itemsize}], schema=schema)

    schema = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("null_ids", pa.int64()),
                        ("tokens", pa.int64()), ("width", pa.int32())])
    return run


def _offset_writer(batches):
    for batch in batches:
        for row in batch.to_pylist():
            size = map_file(f"{row['path']}.len", "<i8")
            offsets = row["base"] + np.concatenate([np.zeros(1, "<i8"), np.cumsum(size)])
            write_file(f"{row['path']}.idx", [offsets.astype("<u8").tobytes()], f"try{TaskContext.get().taskAttemptId()}")
        yield batch


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Encode every text of ``docs`` (doc_id, text), add ``end_id`` and write shards to ``folder``; returns the shard table."""
    spark = ready(docs).sparkSession
    keys = ["doc_id", F.xxhash64("text"), F.spark_partition_id()]
    ordered = (docs.select("doc_id", "text").withColumns({"h": keys[1], "p": keys[2]})
               .repartitionByRange("doc_id", "h", "p").sortWithinPartitions("doc_id", "h", "p").select("doc_id", "text"))
    sizes = stored(ordered.mapInArrow(_shard_writer(folder, tokenizer, end_id), _SHARD), "shard-sizes")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    based = sizes.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    return stored(_one_task_each(based).mapInArrow(_offset_writer, f"{_SHARD}, base long"), "shards")


def _one_task_each(shards: DataFrame) -> DataFrame:
    return shards.repartition(max(1, shards.count()))


def _reader(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    for batch in batches:
        for row in batch.to_pylist():
            ids = map_file(f"{row['path']}.bin", f"<u{row['width']}")
            offsets, known = map_file(f"{row['path']}.idx", "<u8").astype(np.int64), map_file(f"{row['path']}.doc", "<i8")
            base, doc = int(offsets[0]), [None] * row["null_ids"] + known.tolist()
            at = 0
            while at < len(doc):
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BATCH_BYTES // 4, side="right")) - 1)
                cuts = offsets[at:to + 1] - base
                flat = np.asarray(ids[cuts[0]:cuts[-1]]).astype("<u4")
                cells = pa.BinaryArray.from_buffers(pa.binary(), to - at, [
                    None, pa.py_buffer(((cuts - cuts[0]) * 4).astype("<i4").tobytes()), pa.py_buffer(flat.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(doc[at:to], pa.int64()), pa.array(offsets[at:to]),
                                                  pa.array(np.diff(cuts)), cells], schema=schema)
                at = to


def read_token_files(shards: DataFrame) -> DataFrame:
    """doc_id, start (ids before the document), n_tokens and ids (little-endian unsigned 32-bit) of every document."""
    return _one_task_each(ready(shards)).mapInArrow(_reader, _ROWS)
