"""Merkle manifest of a dataset: a tree for each source, a tree over the sources, and a proof for every row.

A leaf is the SHA-256 of a row's fields, each as its UTF-8 byte count, a colon and its value, or ``-`` if null. Leaves of a source
stand in the order of their ids; ``FANOUT`` consecutive nodes are hashed together until one is left.

Slot pivot: one conditional aggregate for each slot spreads a parent's children into ``FANOUT`` columns. Concatenating these
columns and hashing is the parent; concatenating them without the own slot is a child's siblings. The pivot of the leaves
carries what their rows need later, so proofs come out of unfolding it and leaves are shuffled once for it. Proofs are made from the
root down: a node hands its chain of siblings to its children, so the joins are of parents, a sixteenth of the rows.

Scale: positions come from one range shuffle of the narrow leaf table and prefix sums of partition sizes; no window or join has a
source as its key alone. Every join and grouping is by (source, parent), so a source with a third of all rows is spread. The levels
are log16 of the largest source, and each level's table a sixteenth of the one below. One root and one depth go to the driver.

Defined results: a null id sorts before all others, is ``-`` in the leaf and never tampered with; rows of one id are ordered by
leaf, and equal rows are leaves of their own; a null source is a tree of its own, first in order; empty and very long texts are
values like others; an empty table gives no row. Clashing extra columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightgrid.llm.common import stored

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
CHAIN = "array<struct<before:string,after:string>>"


def leaf_hash(**replaced: Column) -> Column:
    """The hash of a row of ``documents``; ``replaced`` gives other values for some fields."""
    def field(name: str) -> Column:
        value = replaced.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[field(name) for name in FIELDS]), 256)


def tampered_leaf(modulus: int = 5) -> Column:
    """The leaf of a row whose text was lower-cased in A-Z, for ids whose crc32 the modulus divides; else null."""
    hit = F.crc32(F.col("doc_id").cast("string")) % modulus == 0
    return F.when(hit, leaf_hash(text=F.translate("text", string.ascii_uppercase, string.ascii_lowercase)))


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` (stored, without null in ``salt``) with ``part`` and ``place``, their number from 0 in ``order``."""
    laid = stored(rows.repartitionByRange(*order, F.col("salt")).sortWithinPartitions(*order, F.col("salt"))
                  .drop("salt").withColumn("at", F.monotonically_increasing_id()), name)
    laid = laid.withColumns({"part": F.shiftright("at", 33), "row": F.col("at").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = laid.groupBy("part").count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    base = sizes.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    return laid.join(F.broadcast(base), "part").withColumn("place", F.col("base") + F.col("row")).drop("at", "row", "base")


def leaves(docs: DataFrame) -> DataFrame:
    """tree (number of the source, null first), source, place (in the tree), n (its leaves), doc_id, digest, altered."""
    rows = stored(docs.select("doc_id", "source", leaf_hash().alias("digest"), tampered_leaf().alias("altered"))
                  .withColumn("salt", F.monotonically_increasing_id()), "leaves")
    placed = numbered(rows, [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("digest")], "ordered-leaves")
    # a source's first place, told to each partition that holds rows of it: no join has a hot source as its key
    held = placed.groupBy("part", "source").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    trees = held.groupBy("source").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    trees = numbered(stored(trees.withColumn("salt", F.lit(0)), "trees"), [F.col("first")], "ordered-trees")
    trees = trees.select(F.col("source").alias("of"), F.col("place").alias("tree"), "first", "n")
    starts = held.select(F.col("part").alias("p"), "source").join(trees, F.col("source").eqNullSafe(F.col("of"))).drop("source")
    return (placed.join(starts, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("of")))
            .select("tree", "source", (F.col("place") - F.col("first")).alias("place"), "n", "doc_id", "digest", "altered"))


def depth_of(n: Column) -> Column:
    """Levels above the leaves of a tree with n leaves."""
    return F.when(n <= 1, 0).otherwise(F.length(F.hex(n - 1)))  # hexadecimal digits of the last place: FANOUT is 16


def pivot(nodes: DataFrame) -> DataFrame:
    """One row for each parent: tree, place, n and its children in ``FANOUT`` columns of (digest, doc_id, altered)."""
    child = F.struct("digest", "doc_id", "altered")
    slots = [F.max(F.when(F.col("place") % FANOUT == k, child)).alias(f"s{k}") for k in range(FANOUT)]
    return (nodes.groupBy("tree", F.floor(F.col("place") / FANOUT).alias("parent"))
            .agg(F.first("n").alias("n"), *slots).withColumnRenamed("parent", "place"))


def _text(slots) -> Column:
    return F.concat(*[F.coalesce(F.col(f"s{k}.digest"), F.lit("")) for k in slots]) if slots else F.lit("")


def levels(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """(pivots from the leaves up, top nodes: tree, digest, n) of ``nodes`` (tree, place, n, digest, doc_id, altered)."""
    depth = nodes.agg(F.max(depth_of(F.col("n")))).first()[0] or 0
    tops = nodes.where(depth_of(F.col("n")) == 0).select("tree", "digest", "n")
    pivots, below = [], nodes
    for level in range(1, depth + 1):
        pivots.append(stored(pivot(below.where(depth_of(F.col("n")) >= level)), f"{name}-{level}"))
        below = pivots[-1].select("tree", "place", "n", F.sha2(_text(range(FANOUT)), 256).alias("digest"),
                                  F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("altered"))
        tops = tops.union(below.where(depth_of(F.col("n")) == level).select("tree", "digest", "n"))
    return pivots, tops


def chains(nodes: DataFrame, pivots: list[DataFrame], tops: DataFrame) -> DataFrame:
    """``nodes`` (tree, n, digest, doc_id, altered) each with its chain, the siblings before and after it, level by level.

    ``tops`` (tree, n, above) gives the chain that goes on above a tree's last node, and is kept as a column.
    """
    top = tops.select("tree", F.lit(0).cast("long").alias("place"), F.col("above").alias("chain"), "above", depth_of(F.col("n")).alias("depth"))
    known = top.where("1 = 0").drop("depth")
    for level in range(len(pivots), 0, -1):
        known = known.union(top.where(F.col("depth") == level).drop("depth"))
        children = F.array(*[
            F.when(F.col(f"s{k}").isNotNull(), F.struct(
                F.lit(k).alias("slot"), F.col(f"s{k}").alias("node"), F.struct(
                    _text(range(k)).alias("before"), _text(range(k + 1, FANOUT)).alias("after")).alias("own")))
            for k in range(FANOUT)])
        opened = (pivots[level - 1].join(known, ["tree", "place"])
                  .select("tree", "place", "n", "chain", "above", F.explode(F.array_compact(children)).alias("c"))
                  .select("tree", (F.col("place") * FANOUT + F.col("c.slot")).alias("place"), "n", "above", "c.node.*",
                          F.concat(F.array("c.own"), "chain").alias("chain")))
        known = opened.select("tree", "place", "chain", "above")
    columns = ["tree", "n", "digest", "doc_id", "altered", "chain", "above"]
    lone = (nodes.where(depth_of(F.col("n")) == 0).join(top.where("depth = 0").select("tree", "chain", "above"), "tree").select(*columns))
    return opened.select(*columns).union(lone) if pivots else lone


def fold(digest: Column, chain: Column) -> Column:
    """The root that a node and its siblings lead to."""
    return F.aggregate(chain, digest, lambda node, level: F.sha2(F.concat(level["before"], node, level["after"]), 256))


def proof_hash(chain: Column) -> Column:
    return F.sha2(F.array_join(F.transform(chain, lambda level: F.concat(level["before"], level["after"])), ""), 256)


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, altered (the leaf found later, null where nothing was changed), subroot, root and chain of every row."""
    nodes = stored(leaves(docs), "nodes")
    pivots, tops = levels(nodes, "level")
    sources = tops.agg(F.count(F.lit(1))).first()[0]
    upper = tops.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(sources).cast("long").alias("n"),
                        "digest", F.col("tree").alias("doc_id"), F.lit(None).cast("string").alias("altered"))
    upper = stored(upper, "subroots")  # the tree of the sources; doc_id is the source's number here
    upper_pivots, upper_top = levels(upper, "upper")
    found = upper_top.first()
    root = found["digest"] if found else None
    ends = upper_top.select("tree", "n", F.array().cast(CHAIN).alias("above"))
    above = stored(chains(upper, upper_pivots, ends).select(F.col("doc_id").alias("tree"), "digest", "chain"), "above")
    heads = tops.select("tree", "n").join(above, "tree").select(
        "tree", "n", F.col("chain").alias("above"))
    rows = chains(nodes, pivots, heads)
    # the subroot is what the chain up to the source's top leads to: its length is the tree's depth
    own = F.slice("chain", F.lit(1), F.size("chain") - F.size("above"))
    return rows.select("doc_id", F.col("digest").alias("leaf"), "altered", fold(F.col("digest"), own).alias("subroot"),
                       F.lit(root).cast("string").alias("root"), "chain")


def verified(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (of the row as found later) and verified."""
    rows = manifest(docs).withColumn("folded_root", fold(F.coalesce("altered", "leaf"), F.col("chain")))
    return rows.select("doc_id", "leaf", "subroot", "root", proof_hash(F.col("chain")).alias("proof_sha256"), "folded_root",
                       (F.col("folded_root") == F.col("root")).alias("verified"))


def _oracle(deep: int = 8) -> str:
    """DuckDB SQL, a fixed number of levels deep: trees that end earlier pass their top node on."""
    field = lambda c: f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')"
    leaf = lambda text: f"sha256(concat({', '.join(field(c) for c in FIELDS[:-1])}, {field(text)}))"
    lowered = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    steps = []

    def climb(name: str, of: str) -> str:
        for level in range(1, deep + 1):
            last = f"{name}{level - 1}"
            run = "over (partition by tree, place // 16 order by place rows between"
            steps.append(f"""
{name}x{level} as (select *, coalesce(string_agg(digest, '') {run} unbounded preceding and 1 preceding), '') as before,
  coalesce(string_agg(digest, '') {run} 1 following and unbounded following), '') as after from {last}),
{name}{level} as (select tree, place // 16 as place, max((n + 15) // 16) as n,
  case when max(n) = 1 then max(digest) else sha256(string_agg(digest, '' order by place)) end as digest from {last} group by all)""")
        return of

    climb("a", "leaves")
    steps.append(f"""
b0 as (select 0 as tree, cast(tree as bigint) as place, count(*) over () as n, digest from a{deep})""")
    climb("b", "sources")
    chain, folded = [], "found"
    for name, place in (("a", "d.place"), ("b", "d.tree")):
        for level in range(1, deep + 1):
            x = f"{name}x{level}"
            power = 16 ** (level - 1)
            chain.append((x, f"{x}.tree = {'d.tree' if name == 'a' else '0'} and {x}.place = {place} // {power}"))
            folded = f"case when {x}.n = 1 then {folded} else sha256({x}.before || {folded} || {x}.after) end"
    proof = " || ".join(f"{x}.before || {x}.after" for x, _ in chain)
    joins = " ".join(f"join {x} on {on}" for x, on in chain)
    # the folding is nested, so it is taken in two halves to keep the expression short
    return f"""
with crc as (select list(v order by i) as t from (select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from range(256) r(i)) q),
d as (
  select *, dense_rank() over (order by source nulls first) - 1 as tree, count(*) over (partition by source) as n,
    row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as place
  from (select doc_id, source, {leaf('text')} as leaf, {leaf(lowered)} as lowered,
      xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(cast(doc_id as varchar)) + 1),
        lambda k: cast(ascii(cast(doc_id as varchar)[k]) as bigint))),
        lambda c, x: xor(c >> 8, t[cast(xor(c, x) & 255 as bigint) + 1]))) % 5 = 0 as hit from documents, crc) q),
a0 as (select tree, place, n, leaf as digest from d),{','.join(steps)},
f as (select d.doc_id, d.leaf, a{deep}.digest as subroot, case when hit then lowered else leaf end as found, b{deep}.digest as root,
    d.tree, d.place from d join a{deep} on a{deep}.tree = d.tree cross join b{deep})
select doc_id, leaf, subroot, root, sha256({proof}) as proof_sha256, {folded} as folded_root, {folded} = root as verified
from f d {joins}"""


ORACLE = _oracle(5)
