"""Sequential rules over one long, ordered stretch of time, replayed in pieces side by side.

A rule that reads rows in order and keeps a small state (what is open, what is taken) cannot be a window. Here the order is cut
into chunks of a bounded number of rows, and ``STRETCH_CHUNKS`` chunks in a row are a stretch. A task streams a stretch, one chunk
after another, from the state it is believed to start with, at first an empty one. All stretches are replayed at once; where a
stretch's start differs from what the one before it has left, it is replayed again, and only then. When nothing differs any
more, every stretch has started from the true state. A task holds one chunk and a state; a state is handed on only between
stretches. States that forget the past within a stretch settle in two or three rounds, although they may outlive many chunks (a
busy timeline); at worst there are as many rounds as stretches.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightgrid.operators.ordered import split_ordinal
from sightgrid.session import cut_lineage

CHUNK_ROWS = 4096
STRETCH_CHUNKS = 64
Step = Callable[[pd.DataFrame, str | None], tuple[pd.DataFrame, str]]
log = logging.getLogger(__name__)


def in_chunks(rows: DataFrame, keys: list[str], order: list[str], bucket: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``rows`` with ``chunk``: consecutive numbers within the keys, ``chunk_rows`` rows each in the given order."""
    placed = split_ordinal(rows, keys, order, bucket, "_place")
    return placed.withColumn("chunk", F.floor(F.col("_place") / chunk_rows).cast("bigint")).drop("_place", bucket)


def _pieces(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """The rows of one value of ``by`` after another, from sorted batches that may end anywhere."""
    last, held = (), []
    for batch in batches:
        for key, part in batch.groupby(by, sort=False, dropna=False):
            if held and key != last:
                yield last, pd.concat(held, ignore_index=True)
                held = []
            last = key
            held.append(part)
    if held:
        yield last, pd.concat(held, ignore_index=True)


def replay_chunks(rows: DataFrame, keys: list[str], step: Step, out_ddl: str, stretch_chunks: int = STRETCH_CHUNKS) -> DataFrame:
    """What ``step`` gives for every chunk of ``rows`` (with ``chunk``), each started from what the chunk before leaves.

    ``step`` takes a chunk's rows and the state before it (None at the start of a key) and returns its output, with the columns
    of ``out_ddl``, and the state after it, as text that is equal for equal states.
    """
    by = [*keys, "_stretch"]
    rows = cut_lineage(rows.withColumn("_stretch", F.floor(F.col("chunk") / stretch_chunks).cast("bigint")))
    names = [part.strip().split(" ")[0] for part in out_ddl.split(",")]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, pd.DataFrame, str]]:
        state = None
        for (*key, row, _), part in _pieces(batches, [*by, "_row", "chunk"]):
            if row:
                out, state = step(part.drop(columns=["_stretch", "_row", "_before"]), state)
                yield tuple(key), out, state
            else:  # ahead of a stretch's rows
                state = part["_before"].iloc[0]

    def leave(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for key, _, state in walk(batches):
            if last and last[0] != key:
                yield pd.DataFrame([(*last[0], last[1])], columns=[*by, "_new"])
            last = key, state
        if last:
            yield pd.DataFrame([(*last[0], last[1])], columns=[*by, "_new"])

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, out, _ in walk(batches):
            yield out[names]

    # a state travels ahead of its stretch on a copy of one of the stretch's rows, so that no column gets nulls it has not
    copies = cut_lineage(rows.groupBy(*by).agg(F.first(F.struct(*rows.columns)).alias("_copy")))

    def replayed(part: DataFrame, states: DataFrame, run: Callable, ddl: str) -> DataFrame:
        ahead = copies.join(states, by).select("_copy.*", F.lit(0).alias("_row"), F.col("before").alias("_before"))
        both = part.withColumns({"_row": F.lit(1), "_before": F.lit(None).cast("string")}).unionByName(ahead)
        return both.repartition(*by).sortWithinPartitions(*by, "_row", "chunk").mapInPandas(run, ddl)

    types = dict(rows.dtypes)
    state_ddl = ", ".join(f"{k} {types[k]}" for k in by) + ", _new string"
    known = copies.select(*by, F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after"),
                          F.lit(True).alias("stale"))
    rounds = 0
    while not known.where("stale").isEmpty():
        stale = known.where("stale").select(*by, "before")
        fresh = replayed(rows.join(stale.select(*by), by, "left_semi"), stale, leave, state_ddl)
        ends = cut_lineage(known.select(*by, "before", "after").join(fresh, by, "left").select(
            *by, "before", F.coalesce("_new", "after").alias("after")))
        handed = ends.select(*keys, (F.col("_stretch") + 1).alias("_stretch"), F.col("after").alias("_handed"))
        known = cut_lineage(ends.join(handed, by, "left").select(
            *by, F.col("_handed").alias("before"), "after", (~F.col("before").eqNullSafe(F.col("_handed"))).alias("stale")))
        rounds += 1
    log.info("%d rounds of replay", rounds)
    return replayed(rows, known.select(*by, "before"), answer, out_ddl)
