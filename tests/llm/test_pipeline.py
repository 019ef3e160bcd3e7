"""Each stage of the pipeline against a brute-force version, on what the stage before it kept."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sightgrid.llm import packing, pii, queries
from sightgrid.llm.common import lean, stored
from tests.llm.helpers import SCHEMA, WORD, documents, given
from tests.llm.test_jaccard_join import brute as brute_components
from tests.llm.test_mixing import water_fill
from tests.llm.test_pii import plain_spans
from tests.llm.test_quality import KneserNey, base

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = given(spark), []
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, docs, SF), "step")
        out.append((docs.collect(), after.collect(), docs.columns, after.columns))
        docs = after
    return out


def middle(values):
    return sorted(values)[math.ceil(len(values) / 2) - 1]


def test_quality(steps):
    docs, kept, before, after = steps[0]
    assert before == after
    want = []
    for lang in {r.lang for r in docs}:
        here = [r for r in docs if r.lang == lang]
        model, rows = KneserNey([r.text for r in here]), []
        for r in here:
            lp = [math.log(model.chance(g)) for w in WORD.findall(r.text) for g in KneserNey.grams(w)]
            rows.append((r.doc_id, base(r.text)[-1], lp))
        good = [lp for _, failed, lp in rows if not failed]
        score = lambda lp: -sum(lp) / len(lp)
        centre = middle([score(lp) for lp in good])
        mad = middle([abs(score(lp) - centre) for lp in good])
        every = np.array([x for lp in good for x in lp])
        want += [d for d, failed, lp in rows if not failed and abs(score(lp) - centre) <= 6 * (1.4826 * mad + every.std() / math.sqrt(len(lp)))]
    assert sorted(r.doc_id for r in kept) == sorted(want)


def test_near_duplicates(steps):
    docs, kept, before, after = steps[1]
    assert before == after
    assert sorted(r.doc_id for r in kept) == sorted({c for _, _, c in brute_components(docs)})


def test_personal_data(steps):
    docs, kept, before, after = steps[2]
    assert before == after and len(docs) == len(kept)
    new = {r.doc_id: r for r in kept}
    for r in docs:
        if not plain_spans(r.text) and not pii.disguised(r.text):
            assert new[r.doc_id] == r
        else:
            text = new[r.doc_id].text
            assert not plain_spans(text) and new[r.doc_id].n_chars == len(text)
            assert all(r.text[s:e] not in text for _, s, e in plain_spans(r.text))


def test_source_mix(steps):
    docs, kept, before, after = steps[3]
    assert before == after
    size = lambda r: len(WORD.findall(r.text))
    sizes, got = defaultdict(int), defaultdict(int)
    for r in docs:
        sizes[r.source] += size(r)
    for r in kept:
        got[r.source] += size(r)
    assert {tuple(r) for r in kept} <= {tuple(r) for r in docs} and max(Counter(r.doc_id for r in kept).values()) <= 3
    names = sorted(sizes)
    longest = {s: max(size(r) for r in docs if r.source == s) for s in names}
    for s, t in zip(names, water_fill([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])):
        assert abs(got[s] - t) <= 0.5 * longest[s] + 0.05 * t + 96


def test_packing(steps):
    docs, pieces, _, _ = steps[4]
    plain = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    want = Counter(i for r in docs for i in [*plain.encode(r.text, add_special_tokens=False).ids, 2])
    assert Counter(i for p in pieces for i in np.frombuffer(p.ids, "<u4").tolist()) == want
    of = defaultdict(list)
    for p in pieces:
        of[p.sequence_id].append(p)
    for ps in of.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096


def test_awkward_and_empty_tables(spark):
    for docs in (documents(spark), spark.createDataFrame([], SCHEMA)):
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, SF), "step")
        assert docs.count() >= 0


def test_a_stage_keeps_little_in_its_workers(spark):
    """Workers are used again: what packing remembers and what a task has freed is not held while other stages run."""

    def tables(batches):
        import sys

        import pyarrow as pa

        known = sys.modules.get("sightgrid.llm.tokens")
        for _ in batches:
            pass
        yield pa.RecordBatch.from_pydict({"kept": [len(known._encoders) if known else 0]})

    one = given(spark).coalesce(1)
    assert packing.pack(one, queries.vocabulary("word_bpe_49k.json"), queries.END_ID).count()
    before = one.mapInArrow(tables, "kept long").first().kept
    assert pii.redacted_documents(one).agg({"text": "max"}).first()
    assert before == 1 and one.mapInArrow(tables, "kept long").first().kept == 0


def test_a_task_hands_back_what_it_has_freed():
    held = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096
    top = []

    def busy(batches):
        for batch in batches:
            blocks = [np.ones(20_000, np.uint8) for _ in range(10_000)]
            top.append(blocks[-1])  # what lies below a block in use is not given back by freeing it
            yield batch

    before = held()
    assert list(lean(busy)(iter([1]))) == [1]
    assert held() - before < 100_000_000
