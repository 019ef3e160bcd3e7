"""Exact percentiles without gathering a group.

A mergeable sketch gives, per group, a narrow value range around the wanted rank. One counting pass says how many
values lie below and inside that range; only the (few) values inside are then ordered. If the range should miss the
rank it is widened to the whole group, so the answer never depends on the sketch's error bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000
MARGIN = 5.0 / ACCURACY


def exact_percentiles(df: DataFrame, keys: list[str], value: Column, ps: dict[str, tuple[float, str]]) -> DataFrame:
    """Columns ``keys + ["n", "mean", "min", "max"] + list(ps)``.

    ``ps`` maps an output name to (fraction, method); the method is ``linear`` (interpolated) or ``nearest``
    (rank rounded half to even).
    """
    anchor = [] if keys else ["_all"]
    base = df.select(*keys, value.cast("double").alias("_v")).where(F.col("_v").isNotNull())
    if anchor:
        base = base.withColumn("_all", F.lit(0))
    by = [*keys, *anchor]

    probes = [x for p, _ in ps.values() for x in (max(0.0, p - MARGIN), min(1.0, p + MARGIN))]
    sketch = base.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("_v", probes, ACCURACY).alias("_q"),
        F.min("_v").alias("min"), F.max("_v").alias("max"), F.avg("_v").alias("mean"),
    )
    counts = base.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c"))

    joined = counts.join(sketch.select(*by, "_q"), by)
    tallies = []
    for i in range(len(ps)):
        low, high = F.col("_q")[2 * i], F.col("_q")[2 * i + 1]
        tallies.append(F.sum(F.when(F.col("_v") < low, F.col("_c")).otherwise(0)).alias(f"_below{i}"))
        tallies.append(F.sum(F.when(F.col("_v").between(low, high), F.col("_c")).otherwise(0)).alias(f"_in{i}"))
    tally = joined.groupBy(*by).agg(*tallies)

    specs = []
    for i, (p, method) in enumerate(ps.values()):
        at = F.lit(p) * (F.col("n") - 1)
        if method == "nearest":
            low_rank = high_rank = F.bround(at).cast("bigint")
        else:
            low_rank, high_rank = F.floor(at).cast("bigint"), F.ceil(at).cast("bigint")
        below, inside = F.col(f"_below{i}"), F.col(f"_in{i}")
        holds = (below <= low_rank) & (high_rank < below + inside)
        specs.append(F.struct(
            F.lit(i).alias("i"),
            F.when(holds, F.col("_q")[2 * i]).otherwise(F.col("min")).alias("low"),
            F.when(holds, F.col("_q")[2 * i + 1]).otherwise(F.col("max")).alias("high"),
            F.when(holds, below).otherwise(F.lit(0)).cast("bigint").alias("below"),
            low_rank.alias("r0"), high_rank.alias("r1"),
            (at - F.floor(at)).alias("frac"),
        ))
    plan = sketch.join(tally, by).select(*by, "n", "mean", "min", "max", F.array(*specs).alias("_specs"))

    hits = counts.join(plan, by).select(
        *by, "n", "mean", "min", "max", "_v", "_c",
        F.explode(F.filter("_specs", lambda s: F.col("_v").between(s["low"], s["high"]))).alias("_s"),
    )
    upto = Window.partitionBy(*by, "_s.i").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = hits.withColumn("_cum", F.col("_s.below") + F.sum("_c").over(upto))

    def holds_rank(rank: str) -> Column:
        return (F.col("_cum") > F.col(rank)) & (F.col("_cum") - F.col("_c") <= F.col(rank))

    picked = ranked.where(holds_rank("_s.r0") | holds_rank("_s.r1")).groupBy(*by).agg(
        *[F.max(x).alias(x) for x in ("n", "mean", "min", "max")],
        *[
            agg.alias(alias)
            for i in range(len(ps))
            for agg, alias in (
                (F.max(F.when((F.col("_s.i") == i) & holds_rank("_s.r0"), F.col("_v"))), f"_v0_{i}"),
                (F.max(F.when((F.col("_s.i") == i) & holds_rank("_s.r1"), F.col("_v"))), f"_v1_{i}"),
                (F.max(F.when(F.col("_s.i") == i, F.col("_s.frac"))), f"_f_{i}"),
            )
        ],
    )
    outs = [
        (F.col(f"_v0_{i}") if method == "nearest"
         else F.col(f"_v0_{i}") + (F.col(f"_v1_{i}") - F.col(f"_v0_{i}")) * F.col(f"_f_{i}")).alias(name)
        for i, (name, (_, method)) in enumerate(ps.items())
    ]
    return picked.select(*keys, "n", "mean", "min", "max", *outs)


def latency_stats(df: DataFrame, keys: list[str], ms: Column, digits: int = 3, p95: str = "linear",
                  prefix: str = "latency") -> DataFrame:
    """``n`` with mean, median, p95 and max of a duration, rounded; groups without values do not appear."""
    by = keys or ["_all"]
    named = df.withColumn("_all", F.lit(0)).select(*by, ms.cast("double").alias("_ms")).where(F.col("_ms").isNotNull())
    pct = exact_percentiles(named, by, F.col("_ms"), {"_p50": (0.5, "linear"), "_p95": (0.95, p95)})
    return pct.select(
        *keys, "n",
        F.bround("mean", digits).alias(f"{prefix}_mean_ms"), F.bround("_p50", digits).alias(f"{prefix}_median_ms"),
        F.bround("_p95", digits).alias(f"{prefix}_p95_ms"), F.bround("max", digits).alias(f"{prefix}_max_ms"),
    )
