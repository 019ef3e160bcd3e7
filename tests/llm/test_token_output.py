import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sightgrid.llm import packing, queries, token_files
from sightgrid.llm.tokens import Encoder
from sightgrid.session import fresh_folder
from tests.llm.helpers import SCHEMA, documents, given

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


@pytest.mark.parametrize("name", FILES)
def test_cut_texts_give_the_ids_of_whole_texts(spark, name):
    path = queries.vocabulary(name)
    plain, mine = Tokenizer.from_file(path), Encoder(path)
    texts = [r.text or "" for r in documents(spark).collect() + given(spark).collect()]
    texts += ["a\xa0  b", "a  b", "a \nb", "\n\n\na", "a\n\n", "a \t\t b　", "'s 't it's", "1234 12,5", "a\u0085b", "​ x"]
    for part in (texts, texts[::-1], texts[:3]):
        flat, bounds = mine.encode(pa.array(part, pa.large_string()))
        for k, text in enumerate(part):
            assert flat[bounds[k]:bounds[k + 1]].tolist() == plain.encode(text, add_special_tokens=False).ids, text[:80]


def test_files_round_trip(spark):
    path = queries.vocabulary(FILES[0])
    plain = Tokenizer.from_file(path)
    for docs in (documents(spark).repartition(4), given(spark).repartition(7)):
        shards = token_files.write_token_files(docs, fresh_folder(spark, "t"), path, 2)
        rows = sorted(token_files.read_token_files(shards).collect(), key=lambda r: r.start)
        want = docs.select("doc_id", "text").collect()
        assert sorted((r.doc_id if r.doc_id is not None else -1, bytes(r.ids)) for r in rows) == sorted(
            (r.doc_id if r.doc_id is not None else -1,
             np.array(plain.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for r in want)
        at, last = 0, -1
        for r in rows:
            assert r.start == at and r.n_tokens == len(r.ids) // 4 and (r.doc_id is None or r.doc_id >= last)
            at, last = at + r.n_tokens, -1 if r.doc_id is None else r.doc_id


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    path = queries.vocabulary(FILES[0])
    assert token_files.read_token_files(token_files.write_token_files(none, fresh_folder(spark, "t"), path, 2)).count() == 0
    assert packing.pack(none, path, 2).count() == 0


@pytest.mark.parametrize("parts", [1, 9, 40])
def test_packing(spark, parts):
    path = queries.vocabulary(FILES[1])
    plain = Tokenizer.from_file(path)
    docs = documents(spark).select("doc_id", "text").union(given(spark).select("doc_id", "text")).repartition(parts)
    rows = packing.pack(docs, path, 2, length=256, windows=4, fan=4).collect()
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) // 4
        of_doc[r.doc_id].append(r)
        of_sequence[r.sequence_id].append(r)
    want = defaultdict(list)
    for r in docs.collect():
        want[r.doc_id].append(np.array(plain.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4").tobytes())
    for doc, texts in want.items():
        pieces = sorted(of_doc[doc], key=lambda r: r.start)
        assert sum(r.length for r in pieces) * 4 == sum(map(len, texts))
        if len(texts) == 1:
            assert b"".join(bytes(r.ids) for r in pieces) == texts[0]
            assert {r.doc_tokens for r in pieces} == {len(texts[0]) // 4}
    padding = 0
    for pieces in of_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
        padding += 0 if at & (at - 1) == 0 else 256 - at
    assert padding <= 0.03 * sum(r.length for r in rows)


def test_queries_agree_with_the_library(spark):
    plain = Tokenizer.from_file(queries.vocabulary(FILES[0]))
    got = {r.doc_id: r for r in queries.op1_token_files(spark, "/root/testdata/sf0.001").collect()}
    start = 0
    for r in given(spark).orderBy("doc_id").collect():
        ids = np.array(plain.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens) == (start, len(ids))
        assert got[r.doc_id].ids_crc32 == zlib.crc32(ids.tobytes())
        start += len(ids)
