import math
from collections import Counter

import pytest

from sightgrid.llm import lm_scoring, queries
from tests.llm.helpers import SCHEMA, WORD, documents, given


def brute(texts, order):
    docs = [[w.lower() for w in WORD.findall(t or "")] for t in texts]
    count = [Counter(tuple(d[i:i + k]) for d in docs for i in range(len(d) - k + 1)) for k in range(order + 1)]
    total, out = sum(map(len, docs)), []
    for d in docs:
        own = [Counter(tuple(d[i:i + k]) for i in range(len(d) - k + 1)) for k in range(order + 1)]
        left = lambda g: count[len(g)][g] - own[len(g)][g]
        rest = max(1, total - len(d))

        def score(g):
            if len(g) == 1:
                return left(g) / rest if left(g) else 1 / rest
            return left(g) / left(g[:-1]) if left(g) else lm_scoring.ALPHA * score(g[1:])

        out.append((len(d), sum(math.log(score(tuple(d[max(0, i - order + 1):i + 1]))) for i in range(len(d)))))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_against_brute_force(spark, order, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SLICE", 20_000)  # many slices
    for docs in (given(spark).select("doc_id", "text").repartition(3), documents(spark).where("doc_id is not null and doc_id <> 2")):
        rows = docs.collect()
        want = {r.doc_id: w for r, w in zip(rows, brute([r.text for r in rows], order))}
        got = lm_scoring.scored(docs, order).collect()
        assert len(got) == len(rows)
        for r in got:
            n, score = want[r.doc_id]
            assert r.n_words == n and r.log_score == pytest.approx(score, rel=1e-9, abs=1e-9)


def test_query_and_awkward_rows(spark):
    got = {r.doc_id: r for r in queries.op3_lm_scoring(spark, "/root/testdata/sf0.001").collect()}
    rows = given(spark).collect()
    for r, (n, score) in zip(rows, brute([r.text for r in rows], 3)):
        assert (got[r.doc_id].n_words, got[r.doc_id].log_score) == (n, pytest.approx(score))
    assert lm_scoring.scored(documents(spark)).count() == documents(spark).count()
    assert lm_scoring.scored(spark.createDataFrame([], SCHEMA)).count() == 0
    assert lm_scoring.ORDER == 3


def test_counts_and_buckets_have_no_ceiling(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    h, big = np.array([3, 1 << 63], np.uint64), np.array([5 * 10**9, (1 << 53) + 1], np.int64)
    sent = pa.Table.from_pylist([{"slice": k, "order": 1, "bucket": 0, "amount": 2, "hashes": lm_scoring.shrink(h),
                                  "counts": lm_scoring.planes(big)} for k in (7, 8)], schema=lm_scoring._SENT)
    for r in lm_scoring._totals((pa.scalar(1), pa.scalar(0)), sent).to_pylist():
        assert lm_scoring.from_planes(r["totals"], r["amount"]).tolist() == [10**10, (1 << 54) + 2]
    monkeypatch.setattr(lm_scoring, "BUCKET", 4)  # far more buckets than n-grams
    docs = documents(spark).where("doc_id is not null and doc_id <> 2")
    rows = docs.collect()
    want = {r.doc_id: w for r, w in zip(rows, brute([r.text for r in rows], 3))}
    for r in lm_scoring.scored(docs).collect():
        assert (r.n_words, r.log_score) == (want[r.doc_id][0], pytest.approx(want[r.doc_id][1], rel=1e-9, abs=1e-9))


def test_awkward_rows_have_the_scores_of_the_docstring(spark):
    """Null ids, repeated ids, empty and null texts, copies: rows of their own, scored as such."""
    docs = documents(spark)
    rows = docs.collect()
    want = sorted(brute([r.text for r in rows], 3))
    got = lm_scoring.scored(docs).collect()
    assert [(r.n_words, r.log_score) for r in sorted(got, key=lambda r: (r.n_words, r.log_score))] == [
        (n, pytest.approx(x, rel=1e-9, abs=1e-9)) for n, x in want]
    assert all((r.mean_log_score is None) == (r.n_words == 0) for r in got)
