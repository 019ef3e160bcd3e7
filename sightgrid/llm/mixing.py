"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame functions only).

Sizes are words. A source's target is its weight's share of all words, at most ``repeats`` times its own size; what exceeds
that is shared again by weight (water filling, solved by prefix sums over the sources). A source's documents are shuffled by a
hash, laid end to end and cut into blocks: of ``block`` words, or, in sources of fewer than ``FINE`` such blocks, into ``FINE``
equal parts (of a word at least), so that small sources meet their targets too. A source's share of the S slots of the schedule
is its target in blocks. Slot s stands at the golden-ratio point (s * A mod S) / S, with A the first number from S / golden
ratio on that shares no divisor with S, and the cumulative shares map that point to a source: over all slots every source gets
exactly its share, and nearly so over any stretch. The slots of a source are ranked; rank r takes block r mod (its blocks). Ranks beyond
``repeats`` rounds take nothing, so no document exceeds ``repeats`` times its size.

Scale: ranks and positions inside a source are two-level prefix sums (sums of chunks or hash buckets first, then a window
inside each), so a source with a third of all rows is no one task's window. Buckets are of id and text, so a common id is spread.
Windows without a key run over one row per source.

Defined results: a null text has size 0; a null source is a source of its own, last in order; null and repeated doc_ids are
rows of their own; a source without words has target 0; an empty table gives no row; very long texts are read whole and counted
natively. Extra columns are not read, or kept in a struct, and may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightgrid.llm.common import stored, word_count

GOLDEN = 0.6180339887498949  # 1 / golden ratio
CELLS, HALF = 1 << 14, 1 << 20  # equal shares of the points, in which slots meet sources; where long products are cut
CHUNK, BUCKET_DIGITS = 1 << 12, 3  # slots of a chunk; hex digits of the hash that name a bucket
WEIGHTS, FINE = (5, 2, 1), 64


def shuffle_key() -> Column:
    """The hash by which documents are shuffled and known."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit("")))))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and the hash that shuffles; the text is read once."""
    return stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), shuffle_key().alias("key")), "sized")


def blocks_of(size: Column, block: int) -> Column:
    """Number of blocks of a source."""
    return F.when(size >= FINE * block, F.ceil(size / block)).otherwise(F.least(size, F.lit(FINE))).cast("long")


def block_at(word: Column, size: Column, block: int) -> Column:
    """The block that holds a word of a source."""
    return F.when(size >= FINE * block, F.floor(word / block)).otherwise(
        F.floor(((word + 1) * blocks_of(size, block) - 1) / size)).cast("long")


def block_start(number: Column, size: Column, block: int) -> Column:
    """The first word of a block; that of the block after the last is the source's size."""
    return F.when(size >= FINE * block, F.least(number * block, size)).otherwise(
        F.floor(number * size / blocks_of(size, block))).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = 3) -> DataFrame:
    """source, source_size, weight, target (double): one row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("n") % len(weights) + 1).cast("int"))
    rows = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
            .withColumn("n", F.row_number().over(order) - 1).withColumn("weight", weight)
            .withColumn("total", F.sum("source_size").over(Window.partitionBy())))
    cap = F.col("source_size") * repeats
    fill = Window.orderBy((cap / F.col("weight")).asc(), F.col("n").asc())
    before, onward = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum("weight").over(onward)
    free = rows.withColumn("level", level).withColumn("level", F.when(F.col("level") * F.col("weight") < cap, F.col("level")))
    # the first source in filling order that its cap does not hold sets the level for itself and all after it
    level = F.min(F.struct(F.when(F.col("level").isNotNull(), 0).otherwise(1), cap / F.col("weight"), "n", "level")).over(Window.partitionBy())["level"]
    return free.withColumn("level", level).select(
        "n", "source", "source_size", "weight", "total",
        F.when(F.col("level").isNull() | (F.col("level") * F.col("weight") >= cap), cap.cast("double"))
        .otherwise(F.col("level") * F.col("weight")).alias("target"))


def slots(target: DataFrame, block: int, repeats: int = 3) -> DataFrame:
    """n (source number), block number and how often the schedule takes it."""
    spark = target.sparkSession
    blocks = blocks_of(F.col("source_size"), block)
    want = F.when(F.col("source_size") >= FINE * block, F.col("target") / block).otherwise(F.col("target") * blocks / F.col("source_size"))
    upto = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    edges = target.where("source_size > 0").select("n", blocks.alias("blocks"), F.floor(F.sum(want).over(upto) + 0.5).alias("upper"))
    edges = stored(edges.withColumn("lower", F.coalesce(F.lag("upper").over(Window.orderBy("n")), F.lit(0))), "edges")
    count = edges.agg(F.max("upper")).first()[0] or 0
    step = next(k for k in range(int(count * GOLDEN), 2 * count + 2) if math.gcd(k, count) == 1) if count else 0
    cell = count // CELLS + 1
    spread = edges.where("upper > lower").select("n", "lower", "upper", F.explode(F.sequence(
        F.floor(F.col("lower") / cell), F.floor((F.col("upper") - 1) / cell))).alias("cell"))
    # slot * step mod count, cut in two so that no product leaves 64 bits
    high, low = F.floor(F.col("id") / HALF), F.col("id") % HALF
    point = (high * step % count * HALF % count + low * step % count) % count if count else F.lit(0)
    at = (spark.range(count).select(F.col("id").alias("slot"), point.alias("point"))
          .withColumn("cell", F.floor(F.col("point") / cell)).join(spread, "cell")  # points spread evenly over the cells
          .where("point >= lower and point < upper").select("slot", "n"))
    at = at.withColumn("chunk", F.floor(F.col("slot") / CHUNK))
    sums = at.groupBy("n", "chunk").count()
    base = sums.select("n", "chunk", F.coalesce(F.sum("count").over(
        Window.partitionBy("n").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("n", "chunk").orderBy("slot")) - 1
    ranked = at.withColumn("inside", inside).join(base, ["n", "chunk"]).withColumn("rank", F.col("base") + F.col("inside"))
    return (ranked.join(edges.select("n", "blocks"), "n").where(F.col("rank") < F.col("blocks") * repeats)
            .select("slot", "n", (F.col("rank") % F.col("blocks")).alias("block")))


def placed(sizes: DataFrame) -> DataFrame:
    """Every document with ``start``, its place in the shuffled words of its source."""
    rows = sizes.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    base = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(
        Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "size")
    rows = rows.withColumns({"row": F.row_number().over(inside), "before": F.coalesce(
        F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    return (rows.join(base, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
            .withColumn("start", F.col("base") + F.col("before")).drop("s", "b", "base", "before"))


def pieces(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = 32, repeats: int = 3) -> tuple[DataFrame, DataFrame]:
    """(documents with their source's figures and a row key, pieces that the schedule takes of them).

    A piece is (n, bucket, row) of its document, its first word there, its number of words and ``times``, the slots taking it.
    """
    sizes = sized(docs)
    target = stored(targets(sizes, weights, repeats), "targets")
    known = target.select(F.col("source").alias("s"), "n", "source_size", "target")
    rows = stored(placed(sizes).join(known, F.col("source").eqNullSafe(F.col("s"))).drop("s"), "placed")
    times = slots(target, block, repeats).groupBy("n", "block").agg(F.count(F.lit(1)).alias("times"))
    whole, begin, end = F.col("source_size"), F.col("start"), F.col("start") + F.col("size")
    cut = rows.where("size > 0").select("n", "bucket", "row", "start", "size", "source_size", F.explode(F.sequence(
        block_at(begin, whole, block), block_at(end - 1, whole, block))).alias("block"))
    first = F.greatest(begin, block_start(F.col("block"), whole, block))
    last = F.least(end, block_start(F.col("block") + 1, whole, block))
    taken = cut.join(times, ["n", "block"]).select("n", "bucket", "row", (first - begin).alias("word"), (last - first).alias("words"), "times")
    return rows, taken


def mixed(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, key, size, source_size, target and taken (words that the mix takes, repeats counted)."""
    rows, taken = pieces(docs, **options)
    words = taken.groupBy("n", "bucket", "row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    return rows.join(words, ["n", "bucket", "row"], "left").select(
        "doc_id", "source", "key", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, to the nearest whole copy.

    A document of which the last round takes half or more is kept whole in that round; equal rows share evenly what the mix
    takes of them; documents without words are in no block and go.
    """
    copies = (mixed(docs, **options).where("taken > 0").groupBy("source", "key")  # the key is of id and text
              .agg(F.floor(F.sum("taken") / F.sum("size") + 0.5).cast("int").alias("copies")).where("copies > 0"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("source").alias("from"), shuffle_key().alias("of"))
    found = rows.join(copies, F.col("from").eqNullSafe(F.col("source")) & (F.col("of") == F.col("key")))
    return found.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


ORACLE = f"""
with d as (
  select doc_id, source, text, md5(coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))) as key,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents),
s as (
  select *, case n % 3 when 0 then 5 when 1 then 2 else 1 end as weight from (
    select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as n,
           cast(sum(sum(size)) over () as bigint) as total from d group by source) q),
l as (
  select *, (total - coalesce(sum(source_size * 3) over (o rows between unbounded preceding and 1 preceding), 0))
            / cast(sum(weight) over (o rows between current row and unbounded following) as double) as lv
  from s window o as (order by (source_size * 3) / cast(weight as double), n)),
c as (
  select min_by(lv, row(source_size * 3 / cast(weight as double), n)) as level from l where lv * weight < source_size * 3),
t as (
  select s.*, case when level is null or level * weight >= source_size * 3 then cast(source_size * 3 as double)
              else level * weight end as target from s, c),
e as (
  select *, coalesce(lag(upper) over (order by n), 0) as lower from (
    select *, cast(floor(sum(case when source_size >= {FINE * 32} then target / 32 else target * blocks / source_size end)
        over (order by n rows unbounded preceding) + 0.5) as bigint) as upper
    from (select *, case when source_size >= {FINE * 32} then (source_size + 31) // 32 else least(source_size, {FINE}) end as blocks
      from t where source_size > 0) q) q),
z as (select max(upper) as total, (select min(k) from (select unnest(range(cast(floor(max(upper) * {GOLDEN}) as bigint),
      2 * max(upper) + 2)) as k) g where gcd(k, (select max(upper) from e)) = 1) as step from e),
p as (
  select slot, cast(cast(slot as hugeint) * step % total as bigint) as point
  from (select unnest(range((select total from z))) as slot) q, z),
r as (
  select e.n, e.blocks, row_number() over (partition by e.n order by slot) - 1 as rk from p join e on point >= lower and point < upper),
k as (select n, rk % blocks as block, count(*) as times from r where rk < 3 * blocks group by all),
f as (
  select d.*, t.n, t.source_size, t.target, row_number() over () as line,
         coalesce(sum(size) over (partition by d.source order by key, size rows between unbounded preceding and 1 preceding), 0) as a
  from d join t on d.source is not distinct from t.source),
b as (
  select line, n, a, size, source_size, unnest(range(cast(case when source_size >= {FINE * 32} then a // 32
      else ((a + 1) * least(source_size, {FINE}) - 1) // source_size end as bigint), cast(case when source_size >= {FINE * 32}
      then (a + size - 1) // 32 else ((a + size) * least(source_size, {FINE}) - 1) // source_size end + 1 as bigint))) as b from f where size > 0),
w as (
  select line, cast(sum(times * (least(a + size, case when source_size >= {FINE * 32} then least((b + 1) * 32, source_size)
      else (b + 1) * source_size // least(source_size, {FINE}) end) - greatest(a, case when source_size >= {FINE * 32} then b * 32
      else b * source_size // least(source_size, {FINE}) end))) as bigint) as taken
  from b join k on k.n = b.n and k.block = b.b group by line)
select doc_id, cast(size as bigint) as size, source_size, target, coalesce(taken, 0) as taken from f left join w on f.line = w.line
"""
