"""Folding, trimming, rounding and label rules on cases outside the tables' spellings."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from sightgrid.functions import names
from sightgrid.operators import labels, matching, reports
from sightgrid.sources import run_files

NAMES = ["scie", "\tScie ", "É té", "й", "ά", "ﬁl", "①", "…x", "㎏", "한글", "ﷺ", "𝐀𝐁", "n̂", "ⅷ", "Ǆ", "½", "Å", "日本", "", " x　", "\x1ca\x1f"]


def values(spark, column):
    df = spark.createDataFrame(list(enumerate(NAMES)), "i int, name string")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_folding_covers_all_of_unicode(spark):
    ascii_of = [unicodedata.normalize("NFKD", n).encode("ascii", "ignore").decode() for n in NAMES]
    assert values(spark, names.to_ascii(F.col("name"))) == ascii_of
    plain = ["".join(c for c in unicodedata.normalize("NFKD", n) if not unicodedata.combining(c)) for n in NAMES]
    assert values(spark, names.strip_accents(F.col("name"))) == plain
    assert values(spark, names.normalize_class(F.col("name"))) == [p.lower().strip() for p in plain]


def test_white_space_of_any_kind_is_trimmed(spark):
    assert values(spark, names.alert_class_key(F.col("name"))) == [n.strip().lower() for n in NAMES]


def test_rounding_is_half_to_even(spark):
    df = spark.createDataFrame([(1.0, 5.0, 32.0)], "a double, b double, d double")
    assert tuple(df.select(F.bround(F.col("a") / F.col("d"), 4), F.bround(F.col("b") / F.col("d"), 4)).first()) == (0.0312, 0.1562)
    import inspect

    assert "F.round(" not in inspect.getsource(matching)


def test_label_lines_keep_all_their_fields(spark):
    lines = [("0 .1 .2 .3 .4 .5 .6",), ("\t5  .1 .2 .3 .4",), ("x .1 .2 .3 .4",), ("1 .1 .2",), ("9 1 2 3 4",)]
    parts = run_files.label_line_parts(spark.createDataFrame(lines, "value string").withColumn("f", F.lit("a")))
    kept, report = labels.remap_labels(parts, {0: 6, 5: 2}, ["f"])
    assert sorted(r.line for r in kept.collect()) == ["2 .1 .2 .3 .4", "6 .1 .2 .3 .4 .5 .6"]
    assert tuple(report.select("seen", "mapped", "removed").first()) == (4, 2, 2)


def test_the_first_alert_of_an_id_stays(spark):
    rows = [(3, "a", "late"), (1, "a", "early"), (2, "", "x"), (4, "", "x"), (5, None, "y")]
    got = reports.dedupe_alerts(spark.createDataFrame(rows, "n int, alert_id string, note string"), [F.col("note")], ["n"])
    assert sorted((r.alert_key, r.n) for r in got.collect()) == [("a", 1), ("x", 2), ("y", 5)]


def test_a_camera_without_a_room_is_an_error(spark):
    rows = spark.createDataFrame([(1, "cam_01", "verre", 0.0), (2, "cam_99", "verre", 1.0)], "ann_ord long, cam_id string, class_name string, t_ms double")
    with pytest.raises(Exception, match="camera without a room: cam_99"):
        reports.group_truth_events(rows, {"cam_01": 2}).collect()


def test_publish_series_are_apart(spark):
    from sightgrid.operators.envelopes import publish_intervals

    rows = [("f", 0, 5, 1000.0), ("f", 1, None, 1040.0), ("f", 2, 4, 1080.0), ("f", 3, 6, None), ("g", 0, 9, 10.0)]
    facts = spark.createDataFrame(rows, "file string, line_no long, frame long, created_ms double")
    for bucket in (100, 2, 1):
        got = {(r.file, r.line_no): (r.interval_ms, r.backwards) for r in publish_intervals(facts, bucket).collect()}
        assert got == {("f", 0): (None, False), ("f", 1): (40.0, False), ("f", 2): (40.0, True), ("f", 3): (None, False), ("g", 0): (None, False)}


def test_a_silent_camera_has_a_row(spark):
    truth = spark.createDataFrame([("r", "cam_01", 1, 1.0)], "run_id string, cam_id string, truth_ord long, truth_t double")
    alerts = spark.createDataFrame([("r", ["cam_01"], "zone_violation_person", 1.5)],
                                   "run_id string, cameras array<string>, alert_type string, ts_s double")
    got = {r.cam_id: (r.n_gt_events, r.tp, r.fp, r.f1) for r in matching.intrusion_score_by_camera(truth, alerts, ["cam_01", "cam_02"]).collect()}
    assert got == {"cam_01": (1, 1, 0, 1.0), "cam_02": (0, 0, 0, 0.0)}
