"""Own merges against the library, on given texts, awkward rows and random characters."""

import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sightgrid.llm import bpe
from sightgrid.llm.queries import vocabulary
from tests.llm.helpers import AWKWARD, SCHEMA, documents, given

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


def library(name, texts):
    own = Tokenizer.from_file(vocabulary(name))
    ids = [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]
    return [(i, own.decode(i, skip_special_tokens=False)) for i in ids]


def held(name, texts):
    codec = bpe.codec(vocabulary(name))
    ids, bounds = codec.encode(pa.array(texts, pa.large_string()))
    return [(ids[a:b].tolist(), codec.text_of(ids[a:b])) for a, b in zip(bounds, bounds[1:])]


def random_texts(n, seed=3):
    draw = random.Random(seed)
    ranges = [(32, 127), (32, 127), (9, 0x250), (0x250, 0x3000), (0x3000, 0xD7FF), (0x10000, 0x1FFFF)]
    known = [" ", "a", "ing", "'s", "'LL", "12", "\n", "<|endoftext|>", "<|startof", "Σ", "İ", "́", "é", "_", "²", "\x85", "　"]
    return ["".join(chr(draw.randrange(*draw.choice(ranges))) if draw.random() < .4 else draw.choice(known)
                    for _ in range(draw.randrange(80))) for _ in range(n)]


@pytest.mark.parametrize("name", FILES)
def test_random_texts(name):
    texts = random_texts(1500)
    assert held(name, texts) == library(name, texts)


@pytest.mark.parametrize("name", FILES)
def test_long_words_and_all_latin_characters(name):
    texts = ["ab" * 20000 + ".", "ß" * 300, "!?" * 200, "x" * 49, "in" * 24, *(f"a{chr(c)}b1{chr(c)}_'s" for c in range(0x250))]
    assert held(name, texts) == library(name, texts)


def test_both_ways_of_merging_agree():
    codec = bpe.codec(vocabulary(FILES[0]))
    draw = random.Random(5)
    for _ in range(500):
        word = "".join(draw.choice("abeinrst") for _ in range(draw.randrange(1, 60)))
        assert codec._merge(word) == codec._merge_long(word)


@pytest.mark.parametrize("name", FILES)
def test_over_tables(spark, name):
    path = vocabulary(name)
    for df in (documents(spark), given(spark)):
        rows = bpe.decoded(bpe.encoded(df, path, ("doc_id", "text")), path).select("row.*", "n_tokens", "ids", "decoded").collect()
        assert len(rows) == df.count()
        once = bpe.there_and_back(df, path, ("doc_id", "text")).select("row.*", "n_tokens", "ids", "decoded").collect()
        assert sorted(map(repr, once)) == sorted(map(repr, rows))
        want = library(name, [r["text"] or "" for r in rows])
        got = [(np.frombuffer(r["ids"], "<u4").tolist(), r["decoded"]) for r in rows]
        assert got == want and all(r["n_tokens"] == len(w[0]) for r, w in zip(rows, want))
    assert sum(r[1] is None for r in AWKWARD) == 1


def test_empty_table(spark):
    path = vocabulary(FILES[0])
    assert bpe.decoded(bpe.encoded(spark.createDataFrame([], SCHEMA), path), path).collect() == []
    assert bpe.there_and_back(spark.createDataFrame([], SCHEMA), path).collect() == []
