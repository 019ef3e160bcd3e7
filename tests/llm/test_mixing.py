import pytest
from pyspark.sql import functions as F

from sightgrid.llm import mixing, queries
from tests.llm.helpers import SCHEMA, WORD, documents, given


def water_fill(sizes, weights, repeats=3):
    total, capped = sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        rest = total - sum(repeats * sizes[i] for i in capped)
        share = {i: rest * weights[i] / sum(weights[j] for j in free) for i in free}
        over = {i for i in free if share[i] > repeats * sizes[i]}
        if not over:
            return [repeats * sizes[i] if i in capped else share[i] for i in range(len(sizes))]
        capped |= over


def test_targets_and_schedule(spark):
    rows = [(k, "w " * (1 + k * 7 % 90), "en", None if k % 11 == 0 else f"s{k % 5 if k % 5 < 3 else (k // 5) % 4 + 3}", 0) for k in range(900)]
    rows += [(5000 + k, "hot words of one source " * 9, "en", "s0", 0) for k in range(450)] + [(9, "", "en", "empty", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mixed(docs).collect()
    assert len(got) == len(rows)
    sizes, taken, target = {}, {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert r.taken <= 3 * r["size"]
    names = sorted(s for s in sizes if s is not None) + [None]
    want = water_fill([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])
    for s, t in zip(names, want):
        assert target[s] == pytest.approx(t)
        assert abs(taken[s] - t) <= 0.03 * t + 3 * 32, s
    again = mixing.mixed(docs.repartition(13)).collect()
    key = lambda r: (r.doc_id, r.taken, r["size"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_awkward_rows(spark):
    docs = documents(spark)
    got = mixing.mixed(docs).collect()
    assert sorted(r["size"] for r in got) == sorted(len(WORD.findall(r.text or "")) for r in docs.collect())
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mixed(docs.where("false")).count() == 0


def test_small_sources_meet_their_targets(spark):
    rows = [(k, "w " * 3000, "en", "a big one", 0) for k in range(20)]
    rows += [(100, "w " * 10, "en", "tiny", 0), (101, "w " * 40, "en", "small", 0), (102, "w", "en", "one word", 0)]
    rows += [(200 + k, "w " * 100, "en", "two thousand", 0) for k in range(20)]
    taken, target = {}, {}
    for r in mixing.mixed(spark.createDataFrame(rows, SCHEMA)).collect():
        taken[r.source], target[r.source] = taken.get(r.source, 0) + r.taken, r.target
    assert target["tiny"] == 30 and target["small"] == 120
    for s, t in target.items():
        assert abs(taken[s] - t) <= 1 + 0.005 * t, (s, taken[s], t)


def test_columns_of_any_name(spark):
    """The names that the operator makes itself, as columns of the input."""
    docs = spark.createDataFrame([(k, f"some words of text {k}", "en", "ab"[k % 2], k) for k in range(30)], SCHEMA)
    names = ["copies", "key", "row", "from", "of", "size", "target", "taken", "n", "bucket", "block", "start", "words", "times", "k_copy", "a.b"]
    wide = docs.select("*", *[F.lit(name).alias(name) for name in names])
    got, plain = mixing.mixed_documents(wide), mixing.mixed_documents(docs)
    assert got.columns == wide.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(r["doc_id"] for r in plain.collect())
    assert all(r[name] == name for r in got.collect() for name in names)


def test_copies_follow_the_mix(spark):
    docs = given(spark)
    kept = mixing.mixed_documents(docs)
    words = {r.source: r.target for r in mixing.mixed(docs).collect()}
    got = {}
    for r in kept.collect():
        got[r.source] = got.get(r.source, 0) + len(WORD.findall(r.text))
    for s, t in words.items():
        assert abs(got.get(s, 0) - t) < 0.15 * t + 1500


def test_no_python_on_the_main_path(spark):
    plan = queries.op10_mixing(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
