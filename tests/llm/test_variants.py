"""Spelling variants against all pairs, and the index against edits that are written out."""

import random
import re
import string
import zlib
from collections import Counter

from sightgrid.llm import variants
from tests.llm.helpers import AWKWARD, SCHEMA, documents, given

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def edits(word, letters):
    cut = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    out = {a + b[1:] for a, b in cut if b} | {a + c + b for a, b in cut for c in letters} | {a + c + b[1:] for a, b in cut if b for c in letters}
    return out - {word}


def brute(rows):
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run] += 1
    words = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    letters = {c for w in words for c in w}
    near = {w: sorted(edits(w, letters) & set(words), key=lambda o: (-words[o], o)) for w in words}
    form = {w: near[w][0] if near[w] and words[near[w][0]] >= 5 * c else None for w, c in words.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (c, len(near[w]), form[w], words.get(form[w]), root(w)) for w, c in words.items()}


def found(df):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in variants.grouped(df).collect()}


def crowded(seed=1):
    """Words of few letters, so that many are near, with chains of counts."""
    draw = random.Random(seed)
    words = ["".join(draw.choice("abé") for _ in range(draw.choice([5, 6, 6, 7, 8]))) for _ in range(400)]
    text = " ".join(w for w in words for _ in range(draw.choice([1, 5, 6, 30, 160, 900])))
    return [(k, text if k == 1 else text[::7], "en", "a", 1) for k in (1, 2)]


def test_index():
    draw = random.Random(4)
    words = sorted({"".join(draw.choice("abcd") for _ in range(draw.randrange(6, 9))) for _ in range(2000)})
    for short in (6, 7, 8):
        mine = [w for w in words if len(w) in (short, short + 1)]
        index = variants.Index(mine)
        for query in mine[:200]:
            want = sorted(o for o in edits(query, "abcd") & set(mine) if min(len(o), len(query)) == short)
            assert [mine[k] for k in variants.members(index.near(query, short))] == want
            apart = [o for o in want if o[:short // 2] != query[:short // 2]]
            assert [mine[k] for k in variants.members(index.near(query, short, short // 2))] == apart


def test_crowded_words(spark):
    rows = crowded()
    got = found(spark.createDataFrame(rows, SCHEMA))
    assert got == brute(rows) and len({v[4] for v in got.values()}) < len(got)


def test_blocks_of_crowded_groups(spark):
    words = variants.stored(variants.vocabulary(spark.createDataFrame(crowded(), SCHEMA)), "words")
    whole, cut = ({r["word"]: (r["n_near"], tuple(r["best"])) for r in variants.near_words(words, block).collect()} for block in (1 << 15, 7))
    assert whole == cut and whole


def test_awkward_and_given_rows(spark):
    assert found(documents(spark)) == brute(AWKWARD)
    df = given(spark)
    assert found(df) == brute([tuple(r) for r in df.select("doc_id", "text").collect()])


def test_empty_table(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == {}
