"""Stream operators against their batch twins, fed file by file."""

import itertools
import json
import os
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from sightgrid.operators.fusion import gate, optimal_links
from sightgrid.operators.identity import assign_global_ids
from sightgrid.operators.alerts import AlertRules, alerts, enough_votes, zone_exits, zone_presence
from sightgrid.operators.ordered import frame_ordinals
from sightgrid.sources.site import Site, Zone
from sightgrid.streaming import envelopes as S
from sightgrid.streaming import live as L
from sightgrid.streaming import stateful
from tests.test_fusion import CAMS, SCHEMA, random_rows

SITE = Site([], [("room_1", a, b) for a, b in itertools.combinations(CAMS, 2)], [])


def feed(spark, tmp_path, df, parts):
    """Write ``df`` as one JSON file per value of ``part`` and open the folder as a stream in that order."""
    folder = tmp_path / "in"
    folder.mkdir()
    for i in parts:
        rows = [r.asDict(recursive=True) for r in df.where(F.col("part") == i).drop("part").collect()]
        file = folder / f"{i:04d}.json"
        file.write_text("\n".join(json.dumps(r, default=str) for r in rows))
        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))  # the file source reads in order of age
    schema = df.drop("part").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def moving(rows):
    """Detections as the live chain takes them: two frames a second, each in reach of the next one's file."""
    return rows.withColumns({"event_time": F.timestamp_seconds(F.col("frame") * 0.5 + 1_000_000), "class_id": F.when(
        F.col("class_name") == "person", 0).otherwise(5).cast("bigint"), "confidence": 0.5 + F.col("det_ord") % 7 / 20})


def live_input(spark, tmp_path, rows, files):
    """Rows dealt to files so that borders cut frames in two; a last marker far ahead closes every frame."""
    dets = moving(spark.createDataFrame(rows, SCHEMA))
    end = dets.agg(F.max("frame")).first()[0] + 1000
    n = dets.count()
    place = F.row_number().over(Window.orderBy("frame", F.xxhash64("cam_id", "det_ord"))) - 1
    parted = dets.withColumn("part", F.floor(place * files / n))
    marker = moving(spark.createDataFrame([(rows[0][0], end, *[None] * 8, -1, None)], SCHEMA)).withColumn("part", F.lit(files).cast("long"))
    return dets, feed(spark, tmp_path, parted.unionByName(marker), range(files + 1)), end


def ends():
    return F.timestamp_seconds(F.col("frame") * 0.5 + 1_000_000.4)


def test_live_ids_equal_batch_ids_when_files_cut_frames(spark, tmp_path):
    rows = random_rows(11, frames=9, tracks=3)
    dets, stream, _ = live_input(spark, tmp_path, rows, 5)
    batch = assign_global_ids(dets, gate(optimal_links(dets, SITE), 1.0)).collect()
    want = {(r.frame, r.det_ord): r.global_id for r in batch}
    live = S.run_available(L.live_ids(stream, SITE, ends(), watermark="1 second")).where("cam_id is not null").collect()
    assert {(r.frame, r.det_ord): r.global_id for r in live} == want


def test_live_alerts_equal_batch_alerts(spark, tmp_path):
    rows = [r for r in random_rows(5, frames=12, tracks=3) if r[1] != 6]  # frame 6 is never seen
    site = Site([], SITE.overlaps, [Zone("z1", "door", CAMS[:2], [(0, 0), (2, 0), (2, 2), (0, 2)]),
                                    Zone("z2", "hall", list(CAMS), [(1, 1), (4, 1), (4, 4), (1, 4)])])
    rules = AlertRules(person_ids=(0,), zone_min_ratio=0.5)
    dets, stream, end = live_input(spark, tmp_path, rows, 4)
    spine = frame_ordinals(dets, ["run_id"])
    fused = assign_global_ids(dets, gate(optimal_links(dets, site), 1.0))
    want = alerts(fused, site, rules, spine).collect()
    gone = zone_exits(enough_votes(zone_presence(fused, site, rules), rules), spine).collect()
    edges = S.run_available(L.live_edges(L.live_ids(stream, site, ends(), watermark="1 second"), site, rules))
    assert sorted(map(str, L.as_alerts(edges).collect())) == sorted(map(str, want)) and want
    exits = {(r.frame, r.global_id, r.zone_id, r.ord) for r in edges.where("kind = 'exit'").collect()}
    last = spine.agg(F.max("ord")).first()[0]
    assert {x for x in exits if x[3] <= last} == {(r.frame, r.global_id, r.zone_id, r.resolved_ord) for r in gone}


def test_tracks_out_of_sight_are_forgotten(spark, tmp_path):
    rows = [("r", f, f * 0.5, "cam_02", 1, 0, "person", 0.5, 1.0, 1.0, 0, None) for f in (0, 1, 40, 80, 81)]
    df = moving(spark.createDataFrame(rows, SCHEMA)).withColumn("part", F.col("frame"))
    live = L.live_ids(feed(spark, tmp_path, df, (0, 1, 40, 80, 81)), SITE, ends(), watermark="0 seconds", forget_s=10.0)
    got = {r.frame: r.global_id for r in S.run_available(live).where("cam_id is not null").collect()}
    assert got == {0: 1, 1: 1, 40: 2, 80: 3}


def test_escalation_follows_the_previous_frame(spark, tmp_path):
    levels = ["weak", "confirmed", "confirmed", "weak", "confirmed", None, "weak"]
    rows = [("1", i, lv, i, i) for i, lv in enumerate(levels) if lv]
    df = spark.createDataFrame(rows, "gid string, ord bigint, level string, t bigint, part int").withColumn(
        "event_time", F.timestamp_seconds(F.col("t") + 1_000_000)).drop("t")
    out = S.run_available(stateful.presence_edges(feed(spark, tmp_path, df, [0, 1, 2, 3, 4, 6]), ["gid"], 60_000)).collect()
    starts = sorted((r.ord, r.level) for r in out if r.kind == "start")
    # the weak frame 3 is silent, but the next confirmed one is raised again; frame 6 is a new presence
    assert starts == [(0, "weak"), (1, "confirmed"), (4, "confirmed"), (6, "weak")]
    assert [r.ord for r in out if r.kind == "end"] == [5]


def test_freshness_goes_stale_and_off(spark, tmp_path):
    rows = [("cam_02", 0, 0), ("cam_03", 0, 0), ("cam_03", 3, 1), ("cam_03", 8, 2), ("cam_03", 9, 3)]
    df = spark.createDataFrame(rows, "cam_id string, t bigint, part int").withColumn(
        "event_time", F.timestamp_seconds(F.col("t") + 1_000_000)).drop("t")
    out = S.run_available(stateful.camera_freshness(feed(spark, tmp_path, df, range(4)))).collect()
    states = [r.state for r in out if r.cam_id == "cam_02"]
    assert set(states) == {"live", "stale", "off"}
    assert "off" not in [r.state for r in out if r.cam_id == "cam_03"]


def test_persistence_over_batches(spark, tmp_path):
    rng = random.Random(2)
    flags = [rng.random() < 0.7 for _ in range(30)]
    df = spark.createDataFrame([("c", i, f, i // 7) for i, f in enumerate(flags)],
                               "cam_id string, ord bigint, positive boolean, part int")
    out = S.run_available(stateful.live_persistence(feed(spark, tmp_path, df, range(5)), ["cam_id"])).collect()
    want, n = [], 0
    for i, f in enumerate(flags):
        n = n + 1 if f else 0
        if n >= 3:
            want.append((i, n == 3))
    assert sorted((r.ord, r.episode_start) for r in out) == want


def test_envelope_stream_explodes_and_measures(spark, tmp_path):
    doc = {"schema": "s", "created_epoch_ms": 1000.0, "created_epoch_s": 1.0, "frame": 4, "run_label": "r",
           "model_version": "v", "model": "m", "format": "pt",
           "detections": [{"camera_id": "cam_02", "track_id": 1, "position_m": None, "bbox_px": [1, 2, 3, 4]}],
           "alerts": [{"alert_id": "a1", "cameras": ["cam_02"]}, {"alert_id": "a2", "cameras": []}]}
    (tmp_path / "e.json").write_text(json.dumps(doc) + "\n" + json.dumps({**doc, "frame": 5}))
    env = S.read_envelope_stream(spark, str(tmp_path))
    dets = S.run_available(S.stream_detections(env)).collect()
    assert [(d.frame, d.camera_id, d.bbox_px) for d in sorted(dets, key=lambda d: d.frame)] == [
        (4, "cam_02", [1.0, 2.0, 3.0, 4.0]), (5, "cam_02", [1.0, 2.0, 3.0, 4.0])]
    alerts = S.run_available(S.dedupe_alerts(S.stream_alerts(env)).select(
        "alert_id", S.delivery_latency_ms(F.col("received_epoch_ms"), F.col("created_epoch_ms")).alias("ms"))).collect()
    assert sorted(a.alert_id for a in alerts) == ["a1", "a2"] and all(a.ms > 0 for a in alerts)
