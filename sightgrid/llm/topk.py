"""Exact top-k search by inner product over an M-tree.

Vectors are turned into integers, floor(1024 x). Inner products become a metric by one more component: with M the greatest
length, each vector gets sqrt(M^2 - |v|^2) and a query 0, and then d(q, v)^2 = |q|^2 + M^2 - 2 q.v, so the nearest have the
highest score.

The tree is built by Spark: routing objects are a bounded sample (``ROUTES`` at most, those with the smallest hash of their
id); each vector goes to the nearest. A routing object's vectors are cut by their distance from it into pages; those of a
crowded one are first dealt to groups of bounded size, so equal vectors are no hot task. A page keeps a centre, its covering
radius, the centre's distance from the routing object (its parent), and each entry's distance from the centre.

Search runs in two rounds. Each query first descends to its nearest routing object, which bounds its k-th score. Then it goes
to every routing object whose covering ball can hold something as near. There its pages are taken best-first: the stored
parent distances bound a page before any distance is computed, then the centre's distance bounds it closer, then the
entries' stored distances leave few inner products to compute. Queries travel in blocks; nothing but the routing objects and
one radius for each is collected. The bounds only skip what cannot be among the best; scores are exact integers.

Defined results: vectors that are null or hold a null, NaN or infinite component, and rows without an id, take no part;
repeated rows of one id and vector count once; rows of the query's id are never its answers; vectors of different lengths are
not compared; a query with fewer than k others gets them all; ties go to the smaller id; an empty table gives no row.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightgrid.llm.common import ready, stored

SCALE, ROUTES, PER_ROUTE, GROUP, PAGE, QUERY_BLOCK = 1024, 1024, 1024, 4096, 128, 256
SLACK = 1e-3  # distances are of integers of some thousands, far above the rounding of double precision


def whole_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and v (array of whole numbers) of the rows that take part."""
    x = F.col(vector_col)
    fine = x.isNotNull() & F.col(id_col).isNotNull() & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return (ready(df).where(fine).select(F.col(id_col).cast("long").alias("id"), F.transform(
        x, lambda c: F.floor(c.cast("double") * SCALE).cast("long")).alias("v"))).dropDuplicates(["id", "v"])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), dim)


def _raised(v: np.ndarray, top: float) -> np.ndarray:
    return np.column_stack([v, np.sqrt(np.maximum(0.0, top - (v * v).sum(1)))])


def _assign(routes: dict, top: dict):
    """routes: dim -> matrix of routing objects with the added component."""

    def run(batches):
        schema = pa.schema([("dim", pa.int32()), ("route", pa.int32()), ("id", pa.int64()), ("v", pa.list_(pa.int64())), ("away", pa.float64())])
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                v = _raised(_matrix(part.column("v"), int(dim)), top[int(dim)])
                r = routes[int(dim)]
                squares = (v * v).sum(1)[:, None] + (r * r).sum(1)[None] - 2 * v @ r.T
                near = squares.argmin(1)
                away = np.sqrt(((v - r[near]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([part.column("dim"), pa.array(near, pa.int32()), part.column("id"), part.column("v").cast(pa.list_(pa.int64())),
                                                  pa.array(away)], schema=schema)

    return run


_PAGE = pa.struct([("centre_away", pa.float64()), ("radius", pa.float64()), ("ids", pa.binary()), ("vectors", pa.binary()), ("parents", pa.binary())])
_TREES = pa.schema([("dim", pa.int32()), ("route", pa.int32()), ("pages", pa.list_(_PAGE))])


def _pages(top: dict):
    """The pages of one group of a routing object, in one row."""

    def run(key, table):
        dim, pages = key[0].as_py(), []
        order = np.lexsort((np.asarray(table["id"]), np.asarray(table["away"])))
        ids, away = np.asarray(table["id"])[order], np.asarray(table["away"])[order]
        v = _matrix(table["v"].combine_chunks(), dim)[order]
        raised = _raised(v, top[dim])
        for a in range(0, len(ids), PAGE):
            b = min(len(ids), a + PAGE)
            centre = (b - a) // 2
            parents = np.sqrt(((raised[a:b] - raised[a + centre]) ** 2).sum(1))
            first = np.concatenate([[centre], np.delete(np.arange(b - a), centre)])  # the centre is the first entry
            pages.append({"centre_away": float(away[a + centre]), "radius": float(parents.max()), "ids": ids[a:b][first].astype("<i8").tobytes(),
                          "vectors": v[a:b][first].astype("<f8").tobytes(), "parents": parents[first].astype("<f8").tobytes()})
        return pa.table([pa.array([dim], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([pages], pa.list_(_PAGE))], schema=_TREES)

    return run


class Tree:
    """Some pages of one routing object, searched best-first."""

    def __init__(self, rows: list[dict], dim: int, top: float):
        self.dim, self.top = dim, top
        self.ids = [np.frombuffer(r["ids"], "<i8") for r in rows]
        self.vectors = [np.frombuffer(r["vectors"], "<f8").reshape(-1, dim) for r in rows]
        self.parents = [np.frombuffer(r["parents"], "<f8") for r in rows]
        self.centre_away = np.array([r["centre_away"] for r in rows])
        self.radius = np.array([r["radius"] for r in rows])

    def search(self, query_id: int, q: np.ndarray, from_route: float, worst: float, k: int) -> list[tuple[int, int]]:
        """Up to ``k`` (score, -id) that can be among the best; ``worst``: a score that the k-th reaches anyhow."""
        best: list[tuple[int, int]] = []
        scale = float(q @ q) + self.top

        def reach() -> float:
            least = max(worst, best[0][0]) if len(best) == k else worst
            return np.sqrt(max(0.0, scale - 2 * least)) + SLACK if least > -np.inf else np.inf

        bounds = np.abs(from_route - self.centre_away) - self.radius  # from stored distances alone
        heap = [(float(b), int(i), False) for i, b in enumerate(bounds)]
        heapq.heapify(heap)
        while heap:
            bound, i, near = heapq.heappop(heap)
            if bound > reach():
                break
            if not near:
                to_centre = float(np.sqrt(max(0.0, scale - 2 * float(self.vectors[i][0] @ q))))
                closer = to_centre - self.radius[i]
                if heap and closer > heap[0][0]:
                    heapq.heappush(heap, (closer, i, True))
                    continue
                if closer > reach():
                    continue
            else:
                to_centre = bound + self.radius[i]
            left = np.flatnonzero(np.abs(to_centre - self.parents[i]) <= reach())
            scores = self.vectors[i][left] @ q
            for score, one in zip(scores.tolist(), self.ids[i][left].tolist()):
                if one == query_id or score < worst:
                    continue
                entry = (int(score), -one)
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return best


def _searcher(top: dict, k: int):
    def run(batches):
        schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
        for batch in batches:
            for row in batch.to_pylist():
                dim, out = row["dim"], []
                tree = Tree(row["pages"], dim, top[dim])
                for q in row["queries"]:
                    v = np.array(q["v"], np.float64)
                    worst = -np.inf if q["worst"] is None else q["worst"]
                    out += [(q["id"], -i, s) for s, i in tree.search(q["id"], v, q["away"], worst, k)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    return run


def _found(pages: DataFrame, queries: DataFrame, top: dict, k: int) -> DataFrame:
    """query_id, id, score of each query (dim, route, id, v, away, worst) in its routing object's pages: k at most of a group."""
    dealt = queries.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64)))
    row = F.row_number().over(Window.partitionBy("dim", "route", "part").orderBy("id")) - 1
    blocks = dealt.withColumn("block", F.floor(row / QUERY_BLOCK)).groupBy("dim", "route", "part", "block").agg(
        F.collect_list(F.struct("id", "v", "away", "worst")).alias("queries"))  # QUERY_BLOCK of them at most
    pairs = pages.join(blocks, ["dim", "route"]).select("dim", "pages", "queries")
    return pairs.mapInArrow(_searcher(top, k), "query_id long, id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, every: int, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, id, score: the k best others of each row whose id is divisible by ``every``."""
    rows = stored(whole_vectors(vectors, id_col, vector_col).withColumn("dim", F.size("v")), "vectors")
    square = F.aggregate("v", F.lit(0).cast("long"), lambda s, c: s + c * c)
    known = {r["dim"]: r for r in rows.groupBy("dim").agg(F.max(square).alias("top"), F.count(F.lit(1)).alias("n")).collect()}
    if not known:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), "id", F.lit(0).cast("long").alias("score")).where("false")
    top = {d: float(r["top"]) for d, r in known.items()}
    routes = {}
    for d, r in known.items():
        n = min(ROUTES, -(-r["n"] // PER_ROUTE))
        sample = rows.where(F.col("dim") == d).orderBy(F.xxhash64("id"), "id").limit(n).select("v").collect()
        objects = sorted({tuple(s["v"]) for s in sample})
        routes[d] = _raised(np.array(objects, np.float64).reshape(len(objects), d), top[d])
    placed = stored(rows.mapInArrow(_assign(routes, top), "dim int, route int, id long, v array<long>, away double"), "routed")
    sizes = placed.groupBy("dim", "route").agg(F.count(F.lit(1)).alias("rows"), F.max("away").alias("ball"))
    dealt = placed.join(sizes.select("dim", "route", "rows"), ["dim", "route"]).withColumn(
        "group", F.pmod(F.xxhash64("id"), F.ceil(F.col("rows") / GROUP)))
    pages = stored(dealt.select("dim", "route", "group", "id", "v", "away").groupBy("dim", "route", "group").applyInArrow(
        _pages(top), "dim int, route int, pages array<struct<centre_away: double, radius: double, ids: binary, vectors: binary, parents: binary>>"), "pages")
    queries = rows.where(F.pmod("id", F.lit(every)) == 0)
    balls = {(r["dim"], r["route"]): r["ball"] for r in sizes.collect()}  # one for each routing object
    far = stored(queries.mapInArrow(_distances(routes, balls, top), "dim int, route int, id long, v array<long>, away double, near double, first boolean"), "distances")
    first = _found(pages, far.where("first").select("dim", "route", "id", "v", "away", F.lit(None).cast("double").alias("worst")), top, k)
    held = stored(_best(first, k), "first")
    bound = held.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("worst"))
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)
    tops = F.create_map(*[x for d, t in top.items() for x in (F.lit(d), F.lit(t))])
    reach = F.sqrt(F.greatest(F.lit(0.0), square + tops[F.col("dim")] - 2 * F.col("worst"))) + SLACK
    more = far.where("not first").join(bound, "id", "left").where(F.col("worst").isNull() | (F.col("near") <= reach))
    rest = _found(pages, more.select("dim", "route", "id", "v", "away", "worst"), top, k)
    both = _best(held.select("query_id", "id", "score").union(rest), k)
    return both.select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")


def _distances(routes: dict, balls: dict, top: dict):
    """Each query's distance from every routing object that has vectors, and the least distance of any of them."""

    def run(batches):
        schema = pa.schema([("dim", pa.int32()), ("route", pa.int32()), ("id", pa.int64()), ("v", pa.list_(pa.int64())), ("away", pa.float64()),
                            ("near", pa.float64()), ("first", pa.bool_())])
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                q, r = np.append(np.array(row["v"], np.float64), 0.0), routes[row["dim"]]
                full = [k for k in range(len(r)) if (row["dim"], k) in balls]
                away = np.sqrt(((r[full] - q) ** 2).sum(1))
                nearest = int(away.argmin())
                for j, k in enumerate(full):
                    out.append((row["dim"], k, row["id"], row["v"], float(away[j]), float(away[j]) - balls[row["dim"], k], j == nearest))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


ORACLE = """
with v as (
  select distinct vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 100 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""
