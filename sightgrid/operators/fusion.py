"""Cross-camera linking inside a frame: candidate pairs, optimal and mutual-nearest links, components.

A detection row has ``run_id, frame, cam_id, track_id, class_id, class_name, ts_s, x_m, y_m, det_ord``; ``det_ord``
orders the detections of a frame (camera order first). Positions may be NULL.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightgrid.functions import names
from sightgrid.functions.assignment import solve_batch
from sightgrid.functions.geometry import distance
from sightgrid.sources.site import Site

OUT_OF_REACH = 1e6  # fixed value: cost of a pair that fails the time gate
NODE = ["cam_id", "track_id", "class_key"]


def with_class_key(dets: DataFrame, class_match: bool = True) -> DataFrame:
    keyed = dets.withColumn("class_key", names.class_key(F.col("class_name"), F.col("class_id")))
    return keyed.withColumn("match_key", F.col("class_key") if class_match else F.lit("*"))


def candidate_pairs(
    dets: DataFrame, site: Site, max_distance: float = 1.0, window_s: float = 0.5, class_match: bool = True
) -> DataFrame:
    """Pairs of detections of overlapping cameras in one frame, closer than ``max_distance`` and ``window_s``.

    The floor is cut into cells of ``max_distance``; a detection looks only into its own and the eight neighbouring
    cells, so far pairs are never formed.
    """
    spark = dets.sparkSession
    d = with_class_key(dets, class_match).where(F.col("x_m").isNotNull() & F.col("y_m").isNotNull())
    d = d.select(
        "run_id", "frame", "match_key", "cam_id", "track_id", "det_ord", "ts_s", "x_m", "y_m", "class_key",
        F.floor(F.col("x_m") / max_distance).alias("cx"), F.floor(F.col("y_m") / max_distance).alias("cy"),
    )
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    side_a = (
        d.join(site.overlap_dim(spark).select(F.col("cam_a").alias("cam_id"), "cam_b"), "cam_id")
        .withColumn("_o", F.explode(near))
        .select(
            "run_id", "frame", "match_key", "cam_b",
            (F.col("cx") + F.col("_o.i")).alias("cx"), (F.col("cy") + F.col("_o.j")).alias("cy"),
            *[F.col(c).alias(f"{c}_a") for c in ("cam_id", "track_id", "class_key", "det_ord", "ts_s", "x_m", "y_m")],
        )
        .withColumnRenamed("cam_id_a", "cam_a")
    )
    side_b = d.select(
        "run_id", "frame", "match_key", F.col("cam_id").alias("cam_b"), "cx", "cy",
        *[F.col(c).alias(f"{c}_b") for c in ("track_id", "class_key", "det_ord", "ts_s", "x_m", "y_m")],
    )
    pairs = side_a.join(side_b, ["run_id", "frame", "match_key", "cam_b", "cx", "cy"])
    pairs = pairs.withColumn("distance_m", distance(F.col("x_m_a"), F.col("y_m_a"), F.col("x_m_b"), F.col("y_m_b")))
    return pairs.where(
        (F.col("distance_m") < max_distance) & (F.abs(F.col("ts_s_a") - F.col("ts_s_b")) <= window_s)
    ).select(
        "run_id", "frame", "cam_a", "track_id_a", "class_key_a", "det_ord_a", "cam_b", "track_id_b", "class_key_b",
        "det_ord_b", "distance_m",
    )


def mutual_nearest_links(pairs: DataFrame) -> DataFrame:
    """Pairs that are each other's nearest in their camera pair (an SQL-only approximation of the optimal links)."""
    best_a = Window.partitionBy("run_id", "frame", "det_ord_a", "cam_b").orderBy("distance_m", "det_ord_b")
    best_b = Window.partitionBy("run_id", "frame", "det_ord_b", "cam_a").orderBy("distance_m", "det_ord_a")
    ranked = pairs.withColumn("_ra", F.row_number().over(best_a)).withColumn("_rb", F.row_number().over(best_b))
    return ranked.where((F.col("_ra") == 1) & (F.col("_rb") == 1)).drop("_ra", "_rb")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _pair_up(ax: pd.Series, ay: pd.Series, at: pd.Series, bx: pd.Series, by: pd.Series, bt: pd.Series,
             window: pd.Series) -> pd.Series:
    """Flat (row, column, cost) triples of the optimal pairing of each block; empty blocks stay empty."""
    out: list[np.ndarray] = [np.empty(0)] * len(ax)
    which, costs = [], []
    for k in range(len(ax)):
        if len(ax.iloc[k]):
            xa, ya, ta = (np.asarray(s.iloc[k]) for s in (ax, ay, at))
            xb, yb, tb = (np.asarray(s.iloc[k]) for s in (bx, by, bt))
            cost = np.sqrt((xa[:, None] - xb) ** 2 + (ya[:, None] - yb) ** 2)
            cost[np.abs(ta[:, None] - tb) > window.iloc[k]] = OUT_OF_REACH
            which.append(k)
            costs.append(cost)
    for k, cost, pairs in zip(which, costs, solve_batch(costs)):
        flat = np.column_stack([pairs, cost[pairs[:, 0], pairs[:, 1]]])
        out[k] = flat.ravel()
    return pd.Series(out)


def optimal_links(dets: DataFrame, site: Site, window_s: float = 0.5, class_match: bool = True) -> DataFrame:
    """Minimum-total-cost one-to-one pairing per (run, frame, camera pair), with its cost and *no* distance limit.

    The optimum is taken over the whole block and a limit applied afterwards (``gate``): pruning first would change
    the pairing. Blocks are split by class, which is exact because a class mismatch costs more than any distance. One
    shuffle brings the detections of a (run, frame, room, class) together; a block is what one frame of two cameras
    holds, so its size is set by the detector, not by the data volume. Blocks with a single row or column are
    answered natively, the rest in Arrow batches.
    """
    spark = dets.sparkSession
    d = with_class_key(dets, class_match).where(F.col("x_m").isNotNull() & F.col("y_m").isNotNull())
    member = F.struct("det_ord", "cam_id", "track_id", "class_key", "ts_s", "x_m", "y_m")
    rooms = (
        d.join(site.overlap_rooms(spark), "cam_id")
        .groupBy("run_id", "frame", "room_id", "match_key")
        .agg(F.array_sort(F.collect_list(member)).alias("members"))
    )
    blocks = (
        rooms.join(site.room_pairs(spark), "room_id")
        .select("run_id", "frame", "members", F.explode("pairs").alias("p"))
        .select(
            "run_id", "frame",
            F.filter("members", lambda m: m["cam_id"] == F.col("p.cam_a")).alias("a"),
            F.filter("members", lambda m: m["cam_id"] == F.col("p.cam_b")).alias("b"),
        )
        .where((F.size("a") > 0) & (F.size("b") > 0))
    )

    def cost_of(p: Column, q: Column) -> Column:
        reach = F.abs(p["ts_s"] - q["ts_s"]) <= window_s
        return F.when(reach, distance(p["x_m"], p["y_m"], q["x_m"], q["y_m"])).otherwise(F.lit(OUT_OF_REACH))

    single = F.least(F.size("a"), F.size("b")) == 1
    # one row or one column: the cheapest entry of the block
    one = F.array_min(F.flatten(F.transform("a", lambda p, i: F.transform("b", lambda q, j: F.struct(
        cost_of(p, q).alias("cost"), i.alias("i"), j.alias("j"))))))

    def column(side: str, field: str) -> Column:
        return F.when(single, F.array().cast("array<double>")).otherwise(F.transform(side, lambda m: m[field]))

    flat = _pair_up(
        column("a", "x_m"), column("a", "y_m"), column("a", "ts_s"),
        column("b", "x_m"), column("b", "y_m"), column("b", "ts_s"), F.lit(float(window_s)),
    )
    solved = blocks.withColumn("_flat", flat)
    triples = F.when(single, F.array(F.struct(
        F.element_at("a", one["i"] + 1).alias("a"), F.element_at("b", one["j"] + 1).alias("b"),
        one["cost"].alias("cost"),
    ))).otherwise(F.transform(
        F.sequence(F.lit(0), (F.size("_flat") / 3).cast("int") - 1),
        lambda k: F.struct(
            F.element_at("a", F.col("_flat")[k * 3].cast("int") + 1).alias("a"),
            F.element_at("b", F.col("_flat")[k * 3 + 1].cast("int") + 1).alias("b"),
            F.col("_flat")[k * 3 + 2].alias("cost"),
        ),
    ))
    return solved.select("run_id", "frame", F.explode(triples).alias("l")).select(
        "run_id", "frame",
        F.col("l.a.cam_id").alias("cam_a"), F.col("l.a.track_id").alias("track_id_a"),
        F.col("l.a.class_key").alias("class_key_a"), F.col("l.a.det_ord").alias("det_ord_a"),
        F.col("l.b.cam_id").alias("cam_b"), F.col("l.b.track_id").alias("track_id_b"),
        F.col("l.b.class_key").alias("class_key_b"), F.col("l.b.det_ord").alias("det_ord_b"),
        F.col("l.cost").alias("distance_m"),
    )


def gate(links: DataFrame, max_distance: float) -> DataFrame:
    return links.where(F.col("distance_m") < max_distance)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _components(cams: pd.Series, tracks: pd.Series, classes: pd.Series) -> pd.Series:
    """Flat (node, component) positions per frame, all frames of the batch together.

    A frame lists the left ends of its links and then, in the same order, the right ends; a position points into that
    list. A component is represented by its smallest node.
    """
    counts = cams.map(len).to_numpy()
    frame = np.repeat(np.arange(len(counts)), counts)
    within = np.concatenate([np.arange(n) for n in counts])
    ends = pd.DataFrame({"frame": frame, "cam": np.concatenate(cams.tolist()), "track": np.concatenate(tracks.tolist()),
                         "cls": np.concatenate(classes.tolist())})
    code = ends.groupby(["frame", "cam", "track", "cls"], sort=True).ngroup().to_numpy()
    left = within < np.repeat(counts // 2, counts)
    a, b = code[left], code[~left]
    label = np.arange(code.max() + 1)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for at in (label[a], label[b], a, b):
            np.minimum.at(new, at, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    where, first = np.unique(code, return_index=True)
    flat = np.column_stack([within[first], within[first[label[where]]]])
    bounds = np.cumsum(np.bincount(frame[first], minlength=len(counts)))
    return pd.Series([part.ravel() for part in np.split(flat, bounds[:-1])])


def frame_components(links: DataFrame) -> DataFrame:
    """Connected components of the links of each (run, frame), for the linked nodes.

    A node is (cam_id, track_id, class_key); a component is named by its smallest node (``comp_*`` columns). Unlinked
    detections are their own component and are not listed.
    """
    node_a = F.struct(F.col("cam_a").alias("cam_id"), F.col("track_id_a").alias("track_id"),
                      F.col("class_key_a").alias("class_key"))
    node_b = F.struct(F.col("cam_b").alias("cam_id"), F.col("track_id_b").alias("track_id"),
                      F.col("class_key_b").alias("class_key"))
    frames = links.groupBy("run_id", "frame").agg(F.collect_list(F.struct(node_a.alias("a"), node_b.alias("b"))).alias("e"))
    ends = frames.select("run_id", "frame", F.concat(
        F.transform("e", lambda e: e["a"]), F.transform("e", lambda e: e["b"])).alias("ends"))

    def field(name: str) -> Column:
        return F.transform("ends", lambda n: n[name])

    labelled = ends.withColumn("_flat", _components(field("cam_id"), field("track_id"), field("class_key")))
    at = F.transform(F.sequence(F.lit(0), (F.size("_flat") / 2).cast("int") - 1), lambda k: F.struct(
        F.col("ends")[F.col("_flat")[k * 2].cast("int")].alias("n"),
        F.col("ends")[F.col("_flat")[k * 2 + 1].cast("int")].alias("c")))
    return labelled.select("run_id", "frame", F.explode(at).alias("r")).select(
        "run_id", "frame", "r.n.*", F.col("r.c.cam_id").alias("comp_cam"), F.col("r.c.track_id").alias("comp_track"),
        F.col("r.c.class_key").alias("comp_class"))


def fusion_links(fused: DataFrame) -> DataFrame:
    """One row per pair of cameras that see the same ``global_id`` in a frame, smaller camera id first."""
    side = fused.where(F.col("global_id").isNotNull())
    a = side.select("run_id", "frame", "global_id", F.col("cam_id").alias("cam_a"), F.col("track_id").alias("track_a"),
                    F.col("class_name").alias("class_a"), F.col("ts_s").alias("ts_a"), F.col("x_m").alias("xa"),
                    F.col("y_m").alias("ya"))
    b = side.select("run_id", "frame", "global_id", F.col("cam_id").alias("cam_b"), F.col("track_id").alias("track_b"),
                    F.col("class_name").alias("class_b"), F.col("ts_s").alias("ts_b"), F.col("x_m").alias("xb"),
                    F.col("y_m").alias("yb"))
    j = a.join(b, ["run_id", "frame", "global_id"]).where(F.col("cam_a") < F.col("cam_b"))
    return j.select(
        "run_id", "frame", F.bround("ts_a", 6).alias("timestamp"), "global_id", "cam_a", "track_a", "class_a",
        "cam_b", "track_b", "class_b", F.bround(F.abs(F.col("ts_a") - F.col("ts_b")) * 1000.0, 3).alias("time_delta_ms"),
        F.bround(distance(F.col("xa"), F.col("ya"), F.col("xb"), F.col("yb")), 6).alias("distance_m"),
    )
