"""Packing of documents into sequences of at most ``length`` tokens: bounded-space online best fit.

Each partition keeps ``windows`` open windows. A document that is longer than a window gives full windows first; what remains
goes to the open window that it fills best. If it fits none, the fullest is emitted: a gap of more than ``slack`` ids in it
is first filled with the document's beginning, and the rest is placed anew. Windows still open at the end of a partition are
merged in a tree: those of ``fan`` partitions are packed by the same rule, until one group is left; its last tokens are
joined, and the last sequence is cut into powers of two, which need no padding.

Memory in a task is the open windows (of ``fan`` partitions while merging), whatever the input. Ids are written once with
their pieces and only open windows are shuffled.

Defined results: a null text is an empty document (its end id alone); null and repeated doc_ids are packed as rows of their
own; an empty table gives no piece. Other columns are not read. Which documents share a sequence follows the input's
partitioning.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightgrid.llm.common import BATCH_BYTES, ready, stored, text_slices

_COLUMNS = ("part int, open boolean, sequence_id long, offset long, doc_id long, start long, length long, doc_tokens long, "
            "ids binary")
_SCHEMA = pa.schema([("part", pa.int32()), ("open", pa.bool_()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
                     ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
                     ("ids", pa.binary())])


class Packer:
    """The open windows of one partition. A piece is (doc_id, start, doc_tokens, ids)."""

    def __init__(self, length: int, windows: int, slack: int, part: int, turn: int):
        self.length, self.windows, self.slack, self.part = length, windows, slack, part
        self.open: list[list] = []  # [filled, pieces]
        self.next_id = (turn << 56) | (part << 32)
        self.rows, self.bytes = [], 0

    def add(self, pieces: list) -> None:
        size = sum(len(p[3]) for p in pieces)
        while size >= self.length:
            head, pieces = _split(pieces, self.length)
            self._emit(head)
            size -= self.length
        while size:
            fits = [w for w in self.open if w[0] + size <= self.length]
            if fits:
                best = max(fits, key=lambda w: w[0])
                best[0] += size
                best[1] += pieces
                if best[0] == self.length:
                    self.open.remove(best)
                    self._emit(best[1])
                return
            if len(self.open) < self.windows:
                self.open.append([size, list(pieces)])
                return
            fullest = max(self.open, key=lambda w: w[0])
            self.open.remove(fullest)
            gap = self.length - fullest[0]
            if gap > self.slack:
                head, pieces = _split(pieces, gap)
                fullest[1] += head
                size -= gap
            self._emit(fullest[1])

    def close(self, last: bool) -> None:
        """Hand over the open windows; of the last group, as sequences of full length and then powers of two."""
        if not last:
            for _, pieces in self.open:
                self._emit(pieces, True)
            return
        rest = [p for _, pieces in self.open for p in pieces]
        left = sum(len(p[3]) for p in rest)
        while left:
            step = self.length if left >= self.length else 1 << (left.bit_length() - 1)
            head, rest = _split(rest, step)
            self._emit(head)
            left -= step

    def _emit(self, pieces: list, is_open: bool = False) -> None:
        offset = 0
        for doc_id, start, doc_tokens, ids in pieces:
            self.rows.append((self.part, is_open, self.next_id, offset, doc_id, start, len(ids), doc_tokens,
                              ids.astype("<u4").tobytes()))
            offset += len(ids)
        self.bytes += 4 * offset
        self.next_id += 1

    def batches(self, least: int):
        if self.rows and self.bytes >= least:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*self.rows), _SCHEMA)]
            self.rows, self.bytes = [], 0
            yield pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)


def _split(pieces: list, n: int) -> tuple[list, list]:
    """The first ``n`` ids of ``pieces`` and the rest."""
    head, k = [], 0
    while n:
        doc_id, start, tokens, ids = pieces[k]
        if len(ids) > n:
            head.append((doc_id, start, tokens, ids[:n]))
            return head, [(doc_id, start + n, tokens, ids[n:]), *pieces[k + 1:]]
        head.append(pieces[k])
        n -= len(ids)
        k += 1
    return head, pieces[k:]


def _document_packer(tokenizer: str, end_id: int, length: int, windows: int, slack: int):
    def run(batches):
        from sightgrid.llm import tokens

        enc = tokens.encoder(tokenizer)
        packer = Packer(length, windows, slack, TaskContext.get().partitionId(), 0)
        for batch in batches:
            for part in text_slices(batch):
                flat, bounds = enc.encode(part.column("text"))
                for k, doc_id in enumerate(part.column("doc_id").to_pylist()):
                    ids = np.append(flat[bounds[k]:bounds[k + 1]], np.array([end_id], enc.dtype))
                    packer.add([(doc_id, 0, len(ids), ids)])
                    yield from packer.batches(BATCH_BYTES)
        packer.close(False)
        yield from packer.batches(0)

    return run


def _merger(length: int, windows: int, slack: int, turn: int, last: bool):
    def run(key, table):
        packer = Packer(length, windows, slack, key[0].as_py(), turn)
        now, pieces = None, []
        for row in table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).to_pylist():
            if row["sequence_id"] != now and pieces:
                packer.add(pieces)
                pieces = []
            now = row["sequence_id"]
            pieces.append((row["doc_id"], row["start"], row["doc_tokens"], np.frombuffer(row["ids"], "<u4")))
        if pieces:
            packer.add(pieces)
        packer.close(last)
        out = list(packer.batches(0))
        return pa.Table.from_batches(out, schema=_SCHEMA)

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int, length: int = 4096, windows: int = 16, slack: int = 8,
         fan: int = 16) -> DataFrame:
    """Pieces of the packed sequences: sequence_id, offset, doc_id, start, length, doc_tokens, ids (binary, 32-bit)."""
    first = ready(docs).select("doc_id", "text").mapInArrow(
        _document_packer(tokenizer, end_id, length, windows, slack), _COLUMNS)
    now = stored(first, "packed")
    done, turn = now.where("not open"), 1
    parts = now.where("open").agg(F.max("part")).first()[0]
    while parts is not None:
        groups = parts // fan
        merged = now.where("open").withColumn("part", F.floor(F.col("part") / fan).cast("int")).groupBy("part").applyInArrow(
            _merger(length, windows, slack, turn, groups == 0), _COLUMNS)
        now = stored(merged, "merged")
        done, turn = done.unionByName(now.where("not open")), turn + 1
        parts = now.where("open").agg(F.max("part")).first()[0]
    return done.select("sequence_id", "offset", "doc_id", "start", "length", "doc_tokens", "ids")
