"""Global identities over time: sticky ids, session-wide components, switches, solo sightings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightgrid.operators.fusion import NODE, frame_components, with_class_key
from sightgrid.operators.ordered import frame_bucket, split_lag, split_ordinal, split_running
from sightgrid.session import cut_lineage

CHUNK_ROWS = 4096  # rows that one task replays at a time, beside those of a frame that crosses the border
COMP = ["comp_cam", "comp_track", "comp_class"]


def _key(columns: list[str]):
    return F.concat_ws("\u0001", *[F.col(c).cast("string") for c in columns])


def _replay(pdf: pd.DataFrame, want: str) -> pd.DataFrame:
    """Replay one chunk of frames in order: a component takes its own new id or the smallest id its members hold.

    Rows with frame -1 bring the ids held before the chunk.
    """
    held: dict[str, int] = {}
    rows = pdf.sort_values(["frame", "comp"], kind="stable")
    before = int((rows["frame"] < 0).sum())
    nodes, gids = rows["node"].tolist(), rows["gid"].tolist()
    held.update(zip(nodes[:before], gids[:before]))
    frames, comps, n, at, found = rows["frame"].tolist(), rows["comp"].tolist(), len(rows), before, []
    while at < n:
        end = at + 1
        while end < n and frames[end] == frames[at] and comps[end] == comps[at]:
            end += 1
        known = [held[x] for x in nodes[at:end] if x in held] + [g for g in gids[at:end] if g == g]
        if known:
            gid = min(known)
            for x in nodes[at:end]:
                held[x] = gid
            found.append((frames[at], comps[at], gid))
        at = end
    run, chunk = pdf["run_id"].iloc[0], pdf["chunk"].iloc[0]
    if want == "comps":
        return pd.DataFrame({
            "run_id": pd.Series([run] * len(found), dtype=object),
            "frame": pd.Series([f for f, _, _ in found], dtype="int64"),
            "comp": pd.Series([c for _, c, _ in found], dtype=object),
            "gid": pd.Series([g for _, _, g in found], dtype="int64"),
        })
    return pd.DataFrame({
        "run_id": pd.Series([run] * len(held), dtype=object), "chunk": pd.Series([chunk] * len(held), dtype="int64"),
        "node": pd.Series(list(held), dtype=object), "gid": pd.Series(list(held.values()), dtype="int64"),
    })


def assign_global_ids(dets: DataFrame, links: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``dets`` with ``global_id``: sticky ids in frame order, exactly as a sequential registry would give them.

    A component whose members are all new gets the next number, in (frame, first detection) order; otherwise it takes
    the smallest number its members hold. Because numbers only ever shrink, an identity is the smallest *birth* number
    that reaches a track through the past, which does not need one task per run:

    * births are found by comparing each track's first frame with its component, and numbered with a split rank;
    * chunks of whole frames, some ``chunk_rows`` rows each, are replayed side by side, given what each track held before;
    * what a track held is the minimum over all earlier chunks; chunks are replayed again until that stops changing.

    Only linked components and first sightings are replayed; every other detection just keeps its track's number.
    """
    keyed = with_class_key(dets)
    comps = frame_components(links)
    nodes = keyed.groupBy("run_id", "frame", *NODE).agg(F.min("det_ord").alias("det_ord"))
    rows = nodes.join(comps, ["run_id", "frame", *NODE], "left").select(
        "run_id", "frame", _key(NODE).alias("node"), "det_ord", F.col("comp_cam").isNotNull().alias("linked"),
        F.when(F.col("comp_cam").isNotNull(), _key(COMP)).otherwise(_key(NODE)).alias("comp"),
    )
    rows = cut_lineage(rows)

    first = rows.groupBy("run_id", "node").agg(F.min(F.struct("frame", "comp")).alias("f"))
    new_members = first.select("run_id", "f.frame", "f.comp").groupBy("run_id", "frame", "comp").agg(
        F.count(F.lit(1)).alias("new")
    )
    sizes = rows.groupBy("run_id", "frame", "comp").agg(
        F.count(F.lit(1)).alias("size"), F.min("det_ord").alias("first_ord")
    )
    births = (
        new_members.join(sizes, ["run_id", "frame", "comp"]).where(F.col("new") == F.col("size"))
        .withColumn("_b", frame_bucket(F.col("frame")))
    )
    births = split_ordinal(births, ["run_id"], ["frame", "first_ord"], "_b", "_n").select(
        "run_id", "frame", "comp", (F.col("_n") + 1).alias("gid")
    )
    events = rows.join(births, ["run_id", "frame", "comp"], "left").where(
        F.col("linked") | F.col("gid").isNotNull()
    ).select("run_id", "frame", "node", "comp", "gid")
    rows_of = events.groupBy("run_id", "frame").count().withColumn("_b", frame_bucket(F.col("frame")))
    upto = split_running(rows_of, ["run_id"], ["frame"], "_b", F.col("count"), "sum", "_upto")
    chunk_of = upto.select("run_id", "frame", F.floor((F.col("_upto") - F.col("count")) / chunk_rows).alias("chunk"))
    events = cut_lineage(events.join(chunk_of, ["run_id", "frame"]).select("run_id", "chunk", "frame", "node", "comp", "gid"))

    ends_schema = "run_id string, chunk bigint, node string, gid bigint"
    comps_schema = "run_id string, frame bigint, comp string, gid bigint"

    def replay(carry: DataFrame | None, want: str) -> DataFrame:
        todo = events if carry is None else events.unionByName(
            carry.withColumn("frame", F.lit(-1).cast("bigint")).withColumn("comp", F.lit(None).cast("string"))
        )
        return todo.groupBy("run_id", "chunk").applyInPandas(
            lambda pdf: _replay(pdf, want), ends_schema if want == "ends" else comps_schema
        )

    present = events.select("run_id", "chunk", "node").distinct()
    earlier = Window.partitionBy("run_id", "node").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = events.select("run_id", "chunk").distinct().groupBy("run_id").count().agg(F.max("count")).first()[0]
    carry = None
    while chunks and chunks > 1:
        ends = replay(carry, "ends")
        merged = present.join(ends, ["run_id", "chunk", "node"], "left")
        nxt = cut_lineage(
            merged.select("run_id", "chunk", "node", F.min("gid").over(earlier).alias("gid"))
            .where(F.col("gid").isNotNull())
        )
        if carry is None:
            changed = not nxt.isEmpty()
        else:
            changed = not nxt.join(carry, ["run_id", "chunk", "node", "gid"], "left_anti").isEmpty()
        carry = nxt
        if not changed:
            break

    found = replay(carry, "comps")
    timeline = rows.join(found, ["run_id", "frame", "comp"], "left").withColumn("_b", frame_bucket(F.col("frame")))
    timeline = split_running(timeline, ["run_id", "node"], ["frame"], "_b", F.col("gid"), "min", "global_id")
    return keyed.withColumn("node", _key(NODE)).join(
        timeline.select("run_id", "frame", "node", "global_id"), ["run_id", "frame", "node"], "left"
    ).drop("node", "match_key")


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``node, component`` (smallest node) by alternating large-star and small-star steps.

    Every step is a grouped minimum and an equi-join, so a component or a node of any size is spread over tasks.
    """
    pairs = edges.select(F.greatest(u, v).alias("hi"), F.least(u, v).alias("lo")).where("hi <> lo").distinct()
    pairs = cut_lineage(pairs)
    while True:
        both = pairs.union(pairs.select("lo", "hi")).toDF("n", "m")
        low = both.groupBy("n").agg(F.least(F.col("n"), F.min("m")).alias("low"))
        large = both.join(low, "n").where(F.col("m") > F.col("n")).select(F.col("m").alias("hi"), F.col("low").alias("lo"))
        large = large.where("hi <> lo").distinct()
        low2 = large.groupBy("hi").agg(F.min("lo").alias("low"))
        small = large.join(low2, "hi").select(F.col("lo").alias("hi"), F.col("low").alias("lo")).union(
            low2.select("hi", F.col("low").alias("lo"))
        ).where("hi <> lo").distinct()
        nxt = cut_lineage(small)
        same = nxt.count() == pairs.count() and nxt.join(pairs, ["hi", "lo"], "left_anti").isEmpty()
        pairs = nxt
        if same:
            break
    roots = pairs.select(F.col("lo").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)


def transitive_global_ids(links: DataFrame) -> DataFrame:
    """Order-free identities: components of all links of a run over the whole session, by their smallest node."""
    def node(side: str):
        return F.struct("run_id", F.col(f"cam_{side}").alias("cam_id"), F.col(f"track_id_{side}").alias("track_id"),
                        F.col(f"class_key_{side}").alias("class_key"))

    found = connected_components(links.select(node("a").alias("u"), node("b").alias("v")))
    return found.select(
        F.col("node.run_id").alias("run_id"), F.col("node.cam_id").alias("cam_id"),
        F.col("node.track_id").alias("track_id"), F.col("node.class_key").alias("class_key"),
        F.col("component.cam_id").alias("root_cam"), F.col("component.track_id").alias("root_track"),
        F.col("component.class_key").alias("root_class"),
    )


def track_stability(fused: DataFrame, gid: str = "global_id") -> DataFrame:
    """Per (run, camera, track): first and last frame, age, id switches and the ids it carried."""
    keys = ["run_id", "cam_id", "track_id"]
    all_rows = fused.groupBy(*keys).agg(
        F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count(F.lit(1)).alias("age")
    )
    known = fused.where(F.col(gid).isNotNull()).withColumn("_b", frame_bucket(F.col("frame")))
    known = split_lag(known, keys, ["frame", "det_ord"], "_b", F.col(gid), "_prev")
    switched = known.groupBy(*keys).agg(
        F.count(F.when(F.col("_prev") != F.col(gid), 1)).alias("global_id_switches"),
        F.concat_ws("+", F.array_sort(F.collect_set(gid))).alias("global_ids"),
    )
    return all_rows.join(switched, keys, "left").fillna({"global_id_switches": 0, "global_ids": ""})


def solo_entities(fused: DataFrame, gid: str = "global_id") -> DataFrame:
    """Identities seen by a single camera in a frame."""
    return fused.where(F.col(gid).isNotNull()).groupBy("run_id", "frame", gid).agg(
        F.min("cam_id").alias("cam_id"), F.max("cam_id").alias("_last"), F.count(F.lit(1)).alias("detections")
    ).where(F.col("cam_id") == F.col("_last")).drop("_last")
