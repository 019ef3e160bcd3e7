import math
import random

from sightgrid.llm import queries, topk


def brute(rows, every, k=10):
    known = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            known[i, tuple(math.floor(1024 * x) for x in v)] = True
    out = set()
    for q, a in known:
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in known if i != q and len(a) == len(b))
            out |= {(q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1)}
    return out


def result(df):
    return {tuple(r) for r in df.select("query_id", "rank", df.columns[2], "score").collect()}


def test_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    got = queries.op4_topk(spark, "/root/testdata/sf0.01")
    assert result(got) == brute(rows, 100)


def test_many_routes_equal_vectors_and_lengths(spark, monkeypatch):
    monkeypatch.setattr(topk, "PER_ROUTE", 60)
    monkeypatch.setattr(topk, "GROUP", 40)
    monkeypatch.setattr(topk, "PAGE", 8)
    pick = random.Random(9)
    rows = [(i, [pick.gauss(i % 5, 0.3) for _ in range(6)]) for i in range(400)]
    rows += [(400 + i, [0.5, -0.25, 1.0, 0.0, 2.0, 0.125]) for i in range(200)]  # a third of all rows is one vector
    rows += [(600 + i, [pick.random() for _ in range(3)]) for i in range(30)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 20)
    as_float = spark.createDataFrame(rows, "vec_id long, embedding array<float>").collect()
    assert result(got) == brute([(r.vec_id, r.embedding) for r in as_float], 20)


def test_awkward_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, [float("inf"), 1.0]), (None, [3.0, 3.0]),
            (5, [-1.0, 0.0]), (6, []), (100, [1.0]), (7, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as id", "2 as dim", "'x' as score")
    assert result(topk.top_k(df, 100)) == brute(rows, 100)
    assert topk.top_k(df.where("false"), 100).count() == 0
