"""Language-model scores of documents by stupid backoff, counted over all of them.

The score of a word after its context is count(context word) / count(context) where that n-gram occurs, else ``ALPHA`` times
the score after a context shorter by one; a single word's score is its share of all words. A document is scored by the rest
of the corpus: its own n-grams are taken out of the counts first, so a text is not its own evidence. A word that no other document has counts as one occurrence of the lowest order.

How the counts meet the texts: documents are read in slices. A slice is coded once (distinct words and the order of their
codes) and stored in the shared folder. Each slice sends its distinct n-grams of each order with their counts, packed by hash
bucket: at most one entry for each slice and n-gram, so a word or pair that every document has is no hot key. A bucket is a
part of the count tables: it sums the counts of each hash and answers every entry. The answers come back by slice, are joined to
the slice's n-grams, and sums are made for each document. Texts are never shuffled. Hashes, counts and answers travel as
compressed byte planes; counts have 64 bits from end to end. A bucket stands for ``BUCKET`` bytes of text, however many there
are, so the part of a table that a task holds does not grow with the input; a slice is at least one text, so a very long text
is one slice and needs memory in proportion to itself.

Defined results: a null or empty text has no words, score 0 and a null mean; words are runs without white space, in lower
case; null and repeated doc_ids are rows of their own; copies are other documents and count as evidence; an empty table gives
no row. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightgrid.llm.common import file_system, mix, per_row, ready, stored, text_slices, words_of, write_file
from sightgrid.session import fresh_folder

ALPHA, ORDER, SLICE, BUCKET = 0.4, 3, 8 << 20, 4 << 20
_SENT = pa.schema([("slice", pa.int64()), ("order", pa.int32()), ("bucket", pa.int32()), ("amount", pa.int64()),
                   ("hashes", pa.binary()), ("counts", pa.binary())])  # order 0: a slice's head with the bytes it was stored from
_BACK = pa.schema([("slice", pa.int64()), ("order", pa.int32()), ("bucket", pa.int32()), ("amount", pa.int64()), ("totals", pa.binary())])
_SCORE = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("partial", pa.float64()), ("shares", pa.int64())])


def planes(values: np.ndarray) -> bytes:
    """64-bit values as compressed bytes, lowest bytes of all first: the high ones are zeros and cost nothing."""
    return pa.compress(np.ascontiguousarray(values.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8).T), "zstd", asbytes=True)


def from_planes(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, n).T).view("<u8").ravel()


def shrink(sorted_hashes: np.ndarray) -> bytes:
    """Ascending hashes by their differences: the five low bytes are random and stay as they are, the high ones are compressed alone."""
    gaps = np.diff(sorted_hashes, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    return gaps[:5].tobytes() + pa.compress(gaps[5:].tobytes(), "zstd", asbytes=True)


def grow(data: bytes, n: int) -> np.ndarray:
    high = pa.decompress(data[5 * n:], decompressed_size=3 * n, codec="zstd", asbytes=True)
    gaps = np.frombuffer(data[:5 * n] + high, np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(gaps.T).view("<u8").ravel(), dtype=np.uint64)


def ngrams(word_hash: np.ndarray, code: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the n-gram that ends at each word, whether the text has that many words before it)."""
    n = len(code)
    inside = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
    h = np.full(n, order, np.uint64)
    for k in range(order - 1, -1, -1):
        h[k:] = mix(h[k:] ^ word_hash[code[:n - k]])
    return h, inside >= order - 1


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int64) if buckets > 1 else np.zeros(len(hashes), np.int64)


def _sender(folder: str, order: int, buckets: int):
    def run(batches):
        import pyarrow.compute as pc
        import xxhash

        part_id, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in text_slices(batch, limit=SLICE):
                offsets, code, words = words_of(pc.utf8_lower(part.column("text")))
                of_word = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))
                slice_id = (part_id << 32) + n
                n += 1
                ids = part.column("doc_id")
                known = np.asarray(ids.is_valid())
                narrow = code.astype("<u4").view(np.uint8).reshape(-1, 4).T if len(code) else np.zeros((4, 0), np.uint8)
                data = [np.array([len(ids), len(code), len(words)], "<i8").tobytes(), np.asarray(ids.fill_null(0)).astype("<i8").tobytes(),
                        known.astype("u1").tobytes(), offsets.astype("<i8").tobytes(), of_word.tobytes(), np.ascontiguousarray(narrow).tobytes()]
                write_file(f"{folder}/{slice_id:016x}", [pa.compress(b"".join(data), "zstd", asbytes=True)], f"try{TaskContext.get().taskAttemptId()}")
                yield pa.RecordBatch.from_pylist([{"slice": slice_id, "order": 0, "bucket": slice_id % ((1 << 31) - 1), "amount": sum(map(len, data)),
                                                   "hashes": b"", "counts": b""}], schema=_SENT)
                for k in range(1, order + 1):
                    h, whole = ngrams(of_word, code, offsets, k)
                    distinct, count = np.unique(h[whole], return_counts=True)
                    bucket = _bucket(distinct, buckets)  # by the high bits: a bucket is a stretch of the sorted hashes
                    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
                    rows = [{"slice": slice_id, "order": k, "bucket": int(bucket[a]), "amount": int(b - a), "hashes": shrink(distinct[a:b]),
                             "counts": planes(count[a:b])} for a, b in zip(cuts, [*cuts[1:], len(bucket)])]
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=_SENT)

    return run


def _totals(key, table):
    """One bucket of one order's count table: the sum of the counts of each hash, for every entry that was sent."""
    if key[0].as_py() == 0:  # heads go on to their slices
        return pa.table([table["slice"], table["order"], table["bucket"], table["amount"], pa.nulls(len(table), pa.binary())], schema=_BACK)
    rows = table.select(["slice", "amount", "hashes", "counts"]).to_pylist()
    hashes, place = np.unique(np.concatenate([grow(r["hashes"], r["amount"]) for r in rows]), return_inverse=True)
    total = np.zeros(len(hashes), np.uint64)
    np.add.at(total, place, np.concatenate([from_planes(r["counts"], r["amount"]) for r in rows]))
    out, at = [], 0
    for r in rows:
        n = r["amount"]
        out.append({"slice": r["slice"], "order": key[0].as_py(), "bucket": key[1].as_py(), "amount": n, "totals": planes(total[place[at:at + n]])})
        at += n
    return pa.Table.from_pylist(out, schema=_BACK)


def _scorer(folder: str, order: int):
    def run(key, table):
        slice_id = key[0].as_py()
        fs, path = file_system(f"{folder}/{slice_id:016x}")
        with fs.open_input_file(path) as f:
            packed = f.read()
        rows = table.to_pylist()
        size = next(r["amount"] for r in rows if r["order"] == 0)
        data = pa.decompress(packed, decompressed_size=size, codec="zstd", asbytes=True)
        n_docs, n_words, n_distinct = np.frombuffer(data, "<i8", 3).tolist()
        at = 24
        ids = np.frombuffer(data, "<i8", n_docs, at)
        known = np.frombuffer(data, "u1", n_docs, at + 8 * n_docs).astype(bool)
        at += 9 * n_docs
        offsets = np.frombuffer(data, "<i8", n_docs + 1, at)
        at += 8 * (n_docs + 1)
        of_word = np.frombuffer(data, "<u8", n_distinct, at)
        at += 8 * n_distinct
        code = np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * n_words, at).reshape(4, n_words).T).view("<u4").ravel().astype(np.int64)
        doc = np.repeat(np.arange(n_docs), np.diff(offsets))
        answers = {}
        for r in rows:
            answers.setdefault(r["order"], []).append((r["bucket"], r["totals"], r["amount"]))
        others = []  # others[k]: occurrences, in other documents, of the n-gram of order k + 1 that ends at each word
        for k in range(1, order + 1):
            h, whole = ngrams(of_word, code, offsets, k)
            distinct, place = np.unique(h[whole], return_inverse=True)
            total = np.concatenate([from_planes(t, n) for _, t, n in sorted(answers.get(k, []))]).astype(np.int64) if len(distinct) else np.zeros(0, np.int64)
            mine = doc[whole]
            pair, where, own = np.unique(mine * max(1, len(distinct)) + place, return_inverse=True, return_counts=True)
            left = np.zeros(n_words, np.int64)
            left[whole] = total[place] - own[where]
            others.append(np.where(whole, left, -1))
        # a share of all other words is its count here; the division by their number, which is not known yet, comes last
        score, shares = np.maximum(others[0], 1).astype(np.float64), np.ones(n_words, np.int64)
        for k in range(2, order + 1):
            before = np.zeros(n_words, np.int64)
            before[1:] = np.maximum(others[k - 2][:-1], 0)  # the context: the shorter n-gram that ends one word earlier
            has = others[k - 1] > 0
            backed = np.where(others[k - 1] < 0, score, ALPHA * score)  # too near the beginning: that context doesn't exist
            score, shares = np.where(has, others[k - 1] / np.maximum(before, 1), backed), np.where(has, 0, shares)
        total = per_row(offsets, np.log(score)) if n_words else np.zeros(n_docs)
        return pa.table([pa.array(ids, pa.int64(), mask=~known), pa.array(np.diff(offsets)), pa.array(total), pa.array(per_row(offsets, shares))], schema=_SCORE)

    return run


def scored(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, n_words, log_score (natural log, summed over the words) and mean_log_score of every document."""
    spark = ready(docs).sparkSession
    folder = fresh_folder(spark, "slices")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 << max(4, (size // BUCKET).bit_length())
    sent = docs.select("doc_id", "text").mapInArrow(
        _sender(folder, order, buckets), "slice long, order int, bucket int, amount long, hashes binary, counts binary")
    back = sent.groupBy("order", "bucket").applyInArrow(_totals, "slice long, order int, bucket int, amount long, totals binary")
    rows = stored(back.groupBy("slice").applyInArrow(_scorer(folder, order), "doc_id long, n_words long, partial double, shares long"), "scores")
    n = rows.agg(F.sum("n_words")).first()[0] or 0
    log_score = F.col("partial") - F.col("shares") * F.log(F.greatest(F.lit(1), F.lit(n) - F.col("n_words")))
    return rows.select("doc_id", "n_words", log_score.alias("log_score")).withColumn(
        "mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))
