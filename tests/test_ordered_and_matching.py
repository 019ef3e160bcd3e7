"""Split windows, exact percentiles, matchers and groupings against brute force on small random inputs."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sightgrid.operators import labels, matching, replay, reports
from sightgrid.operators import alerts as A
from sightgrid.operators.ordered import gap_sessions, split_lag, split_ordinal, split_running
from sightgrid.operators.quantiles import exact_percentiles
from sightgrid.plans import reporting


@pytest.mark.parametrize("width", [1, 3, 50])
def test_split_windows_equal_plain_windows(spark, width):
    rng = random.Random(width)
    rows = [(rng.choice("aab"), t, rng.randint(0, 99)) for t in rng.sample(range(200), 80)]
    df = spark.createDataFrame(rows, "k string, t bigint, v bigint").withColumn("b", F.floor(F.col("t") / width))
    w = Window.partitionBy("k").orderBy("t")
    want = df.select("k", "t", F.lag("v").over(w).alias("lag"), F.min("v").over(w).alias("low"), F.sum("v").over(w).alias("sum"),
                     (F.row_number().over(w) - 1).cast("bigint").alias("pos")).collect()
    got = split_lag(df, ["k"], ["t"], "b", F.col("v"), "lag")
    got = split_running(got, ["k"], ["t"], "b", F.col("v"), "min", "low")
    got = split_running(got, ["k"], ["t"], "b", F.col("v"), "sum", "sum")
    got = split_ordinal(got, ["k"], ["t"], "b", "pos").select("k", "t", "lag", "low", "sum", "pos").collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_sessions_merge_at_exactly_the_gap(spark):
    df = spark.createDataFrame([("c", 0.0), ("c", 3.0), ("c", 6.0), ("c", 9.001), ("c", 9.001)], "k string, t double")
    got = gap_sessions(df, ["k"], "t", 3.0, width=2.0).groupBy("session_start").count().collect()
    assert sorted((r[0], r[1]) for r in got) == [(0.0, 3), (9.001, 2)]


def test_percentiles_match_numpy_with_ties_and_outliers(spark):
    rng = np.random.default_rng(5)
    values = {"ties": [1.0] * 500 + [2.0] * 3, "heavy": list(rng.lognormal(0, 3, 3000)) + [1e12], "one": [4.5], "two": [1.0, 2.0]}
    df = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs], "k string, v double")
    got = exact_percentiles(df, ["k"], F.col("v"), {"a": (0.5, "linear"), "b": (0.95, "linear"), "c": (0.95, "nearest")}).collect()
    assert len(got) == 4
    for r in got:
        s = np.sort(values[r.k])
        assert r.n == len(s) and r.max == s[-1]
        assert r.a == pytest.approx(np.percentile(s, 50), rel=1e-12)
        assert r.b == pytest.approx(np.percentile(s, 95), rel=1e-12)
        assert r.c == s[round(0.95 * (len(s) - 1))]


def brute_match(truth, alerts, tol, rule):
    free, out = dict(enumerate(alerts)), {}
    if rule == "distance_order":
        pairs = sorted(((abs(a - t), i, j) for i, t in enumerate(truth) for j, a in enumerate(alerts) if abs(a - t) <= tol),
                       key=lambda p: p[0])
        for _, i, j in pairs:
            if i not in out and j in free:
                out[i] = free.pop(j)
        return out
    for i, t in enumerate(truth):
        near = [j for j in sorted(free) if abs(free[j] - t) <= tol]
        if near:
            j = near[0] if rule == "first_free" else min(near, key=lambda j: abs(free[j] - t))
            out[i] = free.pop(j)
    return out


@pytest.mark.parametrize("rule", ["truth_order", "distance_order", "first_free"])
def test_matchers_equal_brute_force(spark, rule):
    rng = random.Random(8)
    truth_rows, alert_rows, want = [], [], {}
    for cam in "abc":
        truth = [round(rng.uniform(0, 120), 2) for _ in range(9)]
        alerts = sorted(round(rng.uniform(0, 140), 2) for _ in range(14))
        alerts += alerts[:2]  # two alerts of one instant
        alerts.sort()
        truth_rows += [(cam, i, t) for i, t in enumerate(truth)]
        alert_rows += [(cam, j, a) for j, a in enumerate(alerts)]
        want.update({(cam, i): v for i, v in brute_match(truth, alerts, 5.0, rule).items()})
    t = spark.createDataFrame(truth_rows, "cam_id string, truth_ord bigint, truth_t double")
    a = spark.createDataFrame(alert_rows, "cam_id string, alert_ord bigint, alert_t double")
    m = matching.match_events(t, a, ["cam_id"], rule, 5.0, width=20.0).collect()
    assert len(m) == 27
    assert {(r.cam_id, r.truth_ord): r.alert_t for r in m if r.alert_t is not None} == want


@pytest.mark.parametrize("rule", ["truth_order", "distance_order", "first_free"])
def test_crowded_stretches_are_cut_anywhere(spark, rule, caplog):
    """Every chunk border falls into one stretch in which all events compete; file order runs against time."""
    rng = random.Random(3)
    truth = [round(rng.uniform(0, 90), 1) for _ in range(120)]  # 120 events for some 70 alerts, a tolerance of 10 s, ties
    alerts = sorted({round(rng.uniform(0, 90), 1) for _ in range(70)})
    t = spark.createDataFrame([("c", i, x) for i, x in enumerate(truth)] + [("c", 999, None), ("quiet", 0, 5.0)],
                              "cam_id string, truth_ord bigint, truth_t double")
    a = spark.createDataFrame([("c", j, x) for j, x in enumerate(alerts)] + [("c", 998, None), ("other", 0, 5.0)],
                              "cam_id string, alert_ord bigint, alert_t double")
    with caplog.at_level("INFO", logger="sightgrid.operators.matching"):
        got = matching.match_events(t, a, ["cam_id"], rule, 10.0, width=20.0, chunk_rows=25).collect()
    assert len(got) == 122 and "rounds over chunks" in caplog.text
    assert {r.truth_ord: r.alert_t for r in got if r.alert_t is not None} == brute_match(truth, alerts, 10.0, rule)


def test_matching_of_empty_tables(spark):
    t = spark.createDataFrame([], "cam_id string, truth_ord bigint, truth_t double")
    a = spark.createDataFrame([], "cam_id string, alert_ord bigint, alert_t double")
    assert matching.match_events(t, a, ["cam_id"]).collect() == []


def test_scores_and_object_rules(spark):
    truth = spark.createDataFrame([("r", "cam_02", 0, 10.0, "téléphone"), ("r", "cam_02", 1, 100.0, "scie")],
                                  "run_id string, cam_id string, truth_ord bigint, truth_t double, class_name string")
    dets = spark.createDataFrame(
        [("r", "cam_02", 39, "telephone", t) for t in (12.0, 50.0, 52.0, 60.0, 60.0)] + [("r", "cam_02", 39, "maillet", 99.0),
         ("r", "cam_02", 0, "scie", 100.0)], "run_id string, cam_id string, class_id bigint, class_name string, ts_s double")
    row = matching.object_score_by_camera(truth, dets, [0]).collect()[0]
    assert (row.n_gt_events, row.tp, row.fn, row.fp) == (2, 1, 1, 2)  # 50+52 merge, 60 is one instant, maillet is not annotated
    assert (row.precision, row.recall, row.delay_median) == (0.3333, 0.5, 2.0)


def test_alert_without_camera_counts_for_all(spark):
    truth = spark.createDataFrame([("r", c, 0, 10.0) for c in ("cam_02", "cam_03")],
                                  "run_id string, cam_id string, truth_ord bigint, truth_t double")
    alerts = spark.createDataFrame([("r", "a", "zone_violation_person", 11.0, []), ("r", "b", "zone_violation_person", 200.0, ["cam_03"])],
                                   "run_id string, alert_id string, alert_type string, ts_s double, cameras array<string>")
    got = {r.cam_id: (r.tp, r.fp) for r in matching.intrusion_score_by_camera(truth, alerts, ["cam_02", "cam_03"]).collect()}
    assert got == {"cam_02": (1, 0), "cam_03": (1, 1)}


def test_truth_grouping_equals_sequential(spark):
    rng = random.Random(4)
    rooms = {"c1": 1, "c2": 1, "c3": 1, "c4": 2}
    rows = [(rng.choice(list(rooms)), rng.choice(["x", "y"]), i, rng.uniform(0, 60_000)) for i in range(70)]
    groups, want, count = [], {}, {1: 1, 2: 1}
    for cam, cls, i, t in sorted(rows, key=lambda r: (r[3], r[2])):
        home = next((g for g in groups if g["room"] == rooms[cam] and g["cls"] == cls and abs(t - g["t"]) <= 5000.0
                     and cam not in g["cams"]), None)
        if home is None:
            home = {"room": rooms[cam], "cls": cls, "t": t, "cams": set(), "id": count[rooms[cam]]}
            count[rooms[cam]] += 1
            groups.append(home)
        home["cams"].add(cam)
        want[i] = (rooms[cam], home["id"])
    df = spark.createDataFrame(rows, "cam_id string, class_name string, ann_ord bigint, t_ms double")
    for chunk_rows in (4096, 12):  # one chunk each, and chunks far shorter than the window
        got = {r.ann_ord: (r.room, r.event_id) for r in reports.group_truth_events(df, rooms, chunk_rows=chunk_rows).collect()}
        assert got == want


def test_replay_hands_states_on_over_empty_gaps_and_keys(spark):
    """A running sum that is reset by a marker: right in every chunk, however long a state lasts."""
    rng = random.Random(8)
    rows = [(k, i, 0 if rng.random() < 0.05 else rng.randrange(1, 9)) for k in ("a", "b") for i in range(60)]
    want, total = {}, {}
    for k, i, v in rows:
        total[k] = 0 if v == 0 else total.get(k, 0) + v
        want[k, i] = total[k]

    def step(chunk, before):
        out, now = [], int(before or 0)
        chunk = chunk.sort_values("i")
        for v in chunk["v"]:
            now = 0 if v == 0 else now + int(v)
            out.append(now)
        return chunk.assign(total=out), str(now)

    df = spark.createDataFrame(rows, "k string, i bigint, v bigint").withColumn("b", F.floor(F.col("i") / 25))
    cut = replay.in_chunks(df, ["k"], ["i"], "b", 20)
    got = replay.replay_chunks(cut, ["k"], step, "k string, i bigint, total bigint").collect()
    assert {(r.k, r.i): r.total for r in got} == want


def test_states_that_outlive_their_chunks_are_handed_on_once_a_stretch(spark, caplog):
    rng = random.Random(3)
    rows = [("ab"[i % 3 == 0], i, rng.randint(0, 9)) for i in range(240)]
    want, last = {}, {}
    for k, i, v in rows:
        last[k] = last.get(k, 0) + v
        want[k, i] = last[k]

    def step(chunk, before):
        chunk = chunk.sort_values("i")
        totals = int(before or 0) + chunk["v"].cumsum()
        return chunk.assign(total=totals), str(int(totals.iloc[-1]))

    df = spark.createDataFrame(rows, "k string, i bigint, v bigint").withColumn("b", F.floor(F.col("i") / 25))
    cut = replay.in_chunks(df, ["k"], ["i"], "b", 10)
    caplog.set_level("INFO")
    for width, most in ((8, 2), (3, 6)):  # 16 chunks of the longer key: 2 and 6 stretches
        caplog.clear()
        got = replay.replay_chunks(cut, ["k"], step, "k string, i bigint, total bigint", width).collect()
        assert {(r.k, r.i): r.total for r in got} == want and len(got) == len(rows)
        assert [r.args[0] <= most for r in caplog.records if "rounds of replay" in r.msg] == [True]


def test_persistence_and_trail_across_buckets(spark):
    flags = [1, 1, 1, 1, 0, 1, 1, 0, 1, 1, 1]
    pos = spark.createDataFrame([("r", "c", i) for i, f in enumerate(flags) if f], "run_id string, cam_id string, ord bigint")
    got = sorted((r.ord, r.episode_start) for r in A.persistence(pos, ["run_id", "cam_id"], 3, width=4).collect())
    assert got == [(2, True), (3, False), (10, True)]
    dets = spark.createDataFrame([("r", "c", 1, f, f) for f in range(30)],
                                 "run_id string, cam_id string, track_id bigint, frame bigint, det_ord bigint").withColumn("foot", F.col("frame"))
    trails = {r.frame: r.trail for r in A.track_trail(dets, 5, width=8).collect()}
    assert trails == {f: list(range(max(0, f - 4), f + 1)) for f in range(30)}


def test_unique_stems_take_the_first_free_number(spark):
    existing = spark.createDataFrame([("a",), ("a__rf2",), ("b__rf1",)], "stem string")
    incoming = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "c")], "file_ord bigint, stem string")
    got = {r.file_ord: r.final_stem for r in labels.unique_stems(incoming, existing).collect()}
    assert got == {1: "a__rf1", 2: "a__rf3", 3: "b", 4: "b__rf2", 5: "c"}


def test_unique_stems_sql_numbers_every_file_of_a_long_stem(spark, tmp_path):
    kinds = ["error" if i % 10 == 0 else "click" for i in range(5000)]
    pq.write_table(pa.table({"event_id": [4 * i for i in range(5000)], "ts": pa.array([1_700_000_000_000_000 + i for i in range(5000)],
                                                                                     pa.timestamp("us")),
                             "user_id": [7] * 5000, "event_type": kinds, "value": [1.0] * 5000, "props": ["{}"] * 5000}),
                   f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet')")
    want = con.execute(reporting.STEMS_SQL).fetchall()
    assert len(want) == kinds.count("click") > 4000
    assert sorted(map(tuple, reporting.unique_stems(spark, str(tmp_path)).collect())) == sorted(want)


def test_tolerant_link_join_takes_the_first_prediction(spark):
    truth = spark.createDataFrame([(0, 10, "p", True), (1, 30, "p", True), (2, 10, "q", False)],
                                  "truth_ord bigint, frame bigint, pair string, expected_same boolean")
    pred = spark.createDataFrame([(0, 12, "p"), (1, 9, "p"), (2, 11, "q"), (3, 99, "z")], "pred_ord bigint, frame bigint, pair string")
    judged = matching.truth_link_join(truth, pred, 2)
    assert sorted((r.truth_ord, r.result, r.matched_frame) for r in judged.collect()) == [(0, "tp", 12), (1, "fn", None), (2, "fp", 11)]
    row = matching.association_quality(judged, pred).collect()[0]
    assert (row.tp, row.fp, row.fn, row.tn, row.ignored_predictions, row.accuracy) == (1, 1, 1, 0, 2, 0.3333)
