import numpy as np
import pyarrow as pa
import xxhash

from sightgrid.llm import queries, toxicity
from tests.llm.helpers import SCHEMA, documents, given


def test_model_separates_what_a_word_separates():
    pick = np.random.default_rng(2)
    texts = [" ".join(f"w{k}" for k in pick.integers(0, 300, 40)) + (" vile" if i % 5 == 0 else "") for i in range(600)]
    places, bounds = toxicity.features(pa.array(texts, pa.large_string()))
    y = np.array([float(i % 5 == 0) for i in range(600)])
    chain = toxicity.fit_chain(places, bounds, np.column_stack([y, 1 - y]), np.arange(600) % toxicity.FOLDS)
    first, second = toxicity.predict(chain, places, bounds)
    assert ((first >= chain[0][1]) == (y == 1)).mean() > 0.97
    assert ((second >= chain[1][1]) == (y == 0)).mean() > 0.97
    assert chain[1][0].dense[0] < 0  # the later model reads the earlier category


def test_features_hash_each_distinct_word_and_beginning_once(monkeypatch):
    words = [f"unter{k:03d}" for k in range(200)] + ["(Unter000)", "ähnlich", "ab", "--", "abc", "abcd"]
    texts = pa.array([" ".join(words[k:] + words[:k]) for k in range(3)] + ["", "ab --"], pa.large_string())
    digest, calls = xxhash.xxh3_64_intdigest, []
    monkeypatch.setattr(xxhash, "xxh3_64_intdigest", lambda w: calls.append(w) or digest(w))
    places, bounds = toxicity.features(texts)
    assert len(calls) == len(set(calls))
    plain = [{w.lower().strip(toxicity.SIGNS) for w in t.split()} - {""} for t in texts.to_pylist()]
    want = [sorted({digest(s) % toxicity.DIMS for w in t for s in [w, *[w[:n] + "*" for n in toxicity.STEMS if len(w) > n]]}) for t in plain]
    assert [places[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want


def test_held_out_accuracy(spark):
    docs, labels = given(spark, sf="0.1"), given(spark, "labels", "0.1")
    fitted, held = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    rows = toxicity.scored(docs, fitted, queries.CATEGORIES, ["doc_id"]).select("row.doc_id", "toxic", "p_toxic")
    got = rows.join(held.withColumnRenamed("toxic", "is_toxic"), "doc_id").collect()
    hits = sum(r.toxic and r.is_toxic == 1 for r in got)
    assert hits >= 0.88 * sum(r.is_toxic == 1 for r in got)  # some labels here are of texts without a toxic word
    assert hits >= 0.95 * sum(r.toxic for r in got)


def test_query(spark):
    got = queries.op8_toxicity(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == given(spark, sf="0.01").count() and all(0 <= r.p_toxic <= 1 for r in got)


def test_awkward_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (None, 0, 1), (2, None, 0), (3, 1, None), (77, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.scored(docs, labels, queries.CATEGORIES, ["doc_id"]).count() == docs.count()
    assert toxicity.scored(docs, labels.where("false"), queries.CATEGORIES, ["doc_id"]).count() == docs.count()
    none = spark.createDataFrame([], SCHEMA)
    assert toxicity.scored(none, labels, queries.CATEGORIES, ["doc_id"]).count() == 0
