"""Readers and writers on small generated files."""

import json

import pytest
from pyspark.sql import functions as F

from sightgrid import schemas
from sightgrid.functions import names
from sightgrid.operators import audit
from sightgrid.operators import envelopes as E
from sightgrid.operators import health
from sightgrid.sources import run_directories
from sightgrid.sources import run_files as R
from sightgrid.sources import sinks
from sightgrid.sources.tables import DEMO_SITE


def test_run_csv_types_bom_and_defaults(spark, tmp_path):
    head = [n for n, _ in schemas.fields(schemas.RUN_FILES["sync_events"])]
    (tmp_path / "s.csv").write_bytes("﻿".encode() + (",".join(head) + "\nV4,m,pt,3.0,cam_02,7,1.5,iso,,,gst\n").encode())
    row = R.read_run_csv(spark, "sync_events", str(tmp_path / "s.csv")).collect()[0]
    assert (row.model_version, row.campaign_frame, row.elapsed_s, row.recorded_video) == ("V4", 3, None, None)
    assert R.read_run_csv(spark, "sync_events", str(tmp_path / "s.csv"), defaults=True).collect()[0].elapsed_s == 0.0
    short = ["frame", "timestamp", "global_id", "cam_a", "track_a", "cam_b", "track_b", "distance_m"]
    (tmp_path / "l.csv").write_text(",".join(short) + "\n1,0.1,2,cam_02,1,cam_03,2,\n")
    links = R.read_run_csv(spark, "fusion_links", str(tmp_path / "l.csv"), short)
    assert links.collect()[0].distance_m is None and links.columns == short


def test_fixed_header_and_union_header(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", None)], "b bigint, extra string, a double")
    sinks.write_fixed_csv(df, ["a", "b", "c"], str(tmp_path / "o"))
    lines = {line for file in (tmp_path / "o").glob("*.csv") for line in file.read_text().splitlines()}
    assert lines == {"a,b,c", ",1,"}
    other = spark.createDataFrame([("r1", 5)], "run_dir string, z bigint")
    assert sinks.union_header([other, df.withColumn("run_dir", F.lit("r2"))]).columns == ["run_dir", "a", "b", "extra", "z"]


def test_existing_files_only(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,z\n3,4\n")
    df = R.read_existing_csv(spark, [str(tmp_path / n) for n in ("a.csv", "missing.csv", "b.csv")])
    assert df.columns == ["x", "y", "z"] and df.count() == 2
    assert R.read_existing_csv(spark, [str(tmp_path / "none.csv")]) is None


def test_envelopes_strict_and_permissive(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"schema":"s","frame":1,"detections":[]}\n{broken\n')
    rows = R.read_envelopes(spark, str(tmp_path / "e.jsonl")).collect()
    assert [r["_corrupt"] for r in rows] == [None, "{broken"]
    with pytest.raises(Exception):
        R.read_envelopes(spark, str(tmp_path / "e.jsonl"), strict=True).collect()


def test_ground_truth_array(spark, tmp_path):
    (tmp_path / "gt.json").write_text(json.dumps([
        {"id_camera": "cam_03", "id_evenement": 2, "classe_objet": "Téléphone ", "trame_apparition": 50, "horodatage_apparition": 2000.0},
        {"id_camera": "cam_05", "id_evenement": 1, "classe_objet": "scie", "trame_apparition": 5, "horodatage_apparition": 200.0},
        {"id_camera": "cam_03", "id_evenement": 3, "trame_violation": 10, "horodatage_violation": 400.0, "horodatage_sortie": 12.5}]))
    rows = R.read_ground_truth(spark, str(tmp_path / "gt.json"), "cam_03").orderBy("appear_frame").collect()
    assert [(r.event_id, r.appear_frame, r.exit_s, r.class_norm) for r in rows] == [(3, 10, 12.5, None), (2, 50, None, "telephone")]


def test_alert_log_roundtrip_and_audit(spark, tmp_path):
    line = "[ALERT] Alert[ab12cd34] zone_violation_person:confirmed zone=zone_1 gid=3 pos=(7.00m,4.00m) cams=cam_02+cam_03 conf=0.91"
    bare = "[ALERT] Alert[ff] forbidden_object gid=-1 pos=(-1.5m,20m) cams=cam_05 conf=1"
    (tmp_path / "run.log").write_text("\n".join(["[INFO] start", line, line.replace("[ALERT]", "[WARN] Nouvelle :"), bare]))
    rows = R.parse_alert_log(spark, str(tmp_path / "run.log"))
    got = sorted(rows.collect(), key=lambda r: r.line_no)
    assert [(r.line_no, r.alert_level, r.declared_zone, r.global_id, r.x_m, r.cameras) for r in got] == [
        (2, "confirmed", "zone_1", 3, 7.0, ["cam_02", "cam_03"]), (3, "confirmed", "zone_1", 3, 7.0, ["cam_02", "cam_03"]),
        (4, "confirmed", "", -1, -1.5, ["cam_05"])]
    alerts = rows.withColumn("alert_key", F.col("line_no"))
    assert audit.audit_alerts(alerts, DEMO_SITE).count() == 3
    once = audit.audit_alerts(alerts, DEMO_SITE, dedupe=True).orderBy("alert_key").collect()
    assert [(r.alert_key, r.inside_zones, r.expected_zone_ok, r.worst_max_error_cm) for r in once] == [
        (2, "zone_1", True, 20.25), (4, "", True, 3.25)]
    made = rows.limit(1).withColumn("zone_id", F.col("declared_zone")).select(names.alert_log_line({k: F.col(k) for k in (
        "alert_id", "alert_type", "alert_level", "zone_id", "global_id", "x_m", "y_m", "cameras", "confidence")})).collect()[0][0]
    assert made == line.removeprefix("[ALERT] ")


def test_label_files_roundtrip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "cam_01_frame7.txt").write_text("3 0.5 0.5 0.1 0.2\nbad 0 0 0 0\n1 2\n\n0 .1 .2 .3 .4\n")
    rows = R.read_label_files(spark, str(tmp_path / "in"))
    assert sorted((r.stem, r.line_no, r.class_id, r.w) for r in rows.collect()) == [
        ("cam_01_frame7", 1, 3, 0.1), ("cam_01_frame7", 5, 0, 0.3)]
    sinks.write_label_files(rows.select("stem", "line_no", F.format_string("%d %.1f", "class_id", "w").alias("line")), str(tmp_path / "o"))
    file = next((tmp_path / "o" / "stem=cam_01_frame7").glob("*.txt"))
    assert file.read_text() == "3 0.1\n0 0.3\n"


def test_manifests_transport_and_required_columns(spark, tmp_path):
    for run, text in (("r1", "event_id,transport,latency_ms\n1,,2.5\n2,,oops\n"), ("r2", "event_id,transport,latency_ms\n1,mqtt,4\n")):
        (tmp_path / run).mkdir()
        (tmp_path / run / "alert_latency.csv").write_text(text)
        (tmp_path / run / "manifest.json").write_text(json.dumps({"mode": f"live-{run}"}))
    rows = R.read_transport_latency(spark, str(tmp_path / "*" / "alert_latency.csv")).collect()
    assert sorted((r.transport, r.latency_ms) for r in rows) == [("mqtt", 4.0), ("r1", 2.5)]
    runs = {r.run_id.rsplit("/", 1)[1]: r.mode for r in R.read_manifests(spark, str(tmp_path / "*" / "manifest.json")).collect()}
    assert runs == {"r1": "live-r1", "r2": "live-r2"}
    summary = spark.createDataFrame([("r1", 1)], "run_id string, n bigint")
    manifests = spark.createDataFrame([("r1", "live")], "run_id string, mode string")
    assert health.with_manifest(summary, manifests).collect()[0].mode == "live"
    with pytest.raises(ValueError, match="truth_id"):
        R.require_columns(spark.range(1), ["id", "truth_id"])


def test_envelope_validation_counts(spark):
    det = {k: 1 for k in E.DETECTION_FIELDS} | {"bbox_px": [1, 2, 3, 4], "camera_id": "cam_02", "class_name": "person", "timestamp": 9.5}
    alert = {k: "x" for k in E.ALERT_FIELDS} | {"cameras": ["cam_03"], "timestamp": 9.0}
    docs = [
        {**{k: 1 for k in E.ENVELOPE_FIELDS}, "frame": 2, "created_epoch_ms": 1000.0, "created_epoch_s": 10.0, "detections": [det], "alerts": []},
        {"frame": 1, "created_epoch_ms": 1040.0, "created_epoch_s": 10.5, "detections": [{**det, "global_id": None, "bbox_px": [1]}, {"camera_id": "cam_07"}],
         "alerts": [alert, {"alert_id": "a"}]},
    ]
    lines = spark.createDataFrame([("f", i + 1, json.dumps(d)) for i, d in enumerate(docs)] + [("f", 3, " ")],
                                  "file string, line_no bigint, value string")
    facts = E.envelope_facts(lines)
    r = E.validate_envelopes(facts).collect()[0]
    assert (r.envelopes, r.detections, r.alerts, r.bbox_ok, r.global_ids) == (2, 3, 2, 1, 1)
    assert (r.missing_envelope, r.missing_detection, r.missing_alert, r.frame_backwards) == (1, 1, 1, 1)
    assert (r.cameras, r.classes) == ("cam_02, cam_03, cam_07", "person")
    assert (r.publish_interval_mean_ms, r.publish_interval_p95_ms) == (40.0, 40.0)
    assert (r.metadata_lag_mean_ms, r.metadata_lag_p95_ms) == (750.0, 1000.0)
    ex = E.first_example(facts).collect()[0]
    assert (ex.with_detection, ex.with_alert) == (1, 2)


def test_run_directories_of_both_kinds(spark, tmp_path):
    def put(path, text):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)

    put("a/alert_latency.csv", "event_id,transport,latency_ms\n1,mqtt,2\n2,,oops\n3,http,4\n")
    put("a/phase3/summary.csv", "model_version\n")
    put("silent/alert_latency.csv", "event_id,transport,latency_ms\n")
    summary = "model_version,model,format,frames,detections,alerts,fusion_links,unique_global_ids,global_id_switches,latency_mean_ms," \
        "latency_median_ms,latency_p95_ms,latency_max_ms\n"
    sync = "model_version,model,format,campaign_frame,cam_id,video_frame,timestamp_epoch,timestamp_iso,elapsed_s,recorded_video,capture_backend\n"
    links = "model_version,model,format,frame,timestamp,global_id,cam_a,track_a,class_a,cam_b,track_b,class_b,time_delta_ms,distance_m\n"
    put("b/phase3/summary.csv", summary + "V,m,pt,10,40,3,6,2,0,5,5,6,7\nV,m,pt,99,99,9,9,9,9,9,9,9,9\n")
    put("b/phase3/sync_events.csv", sync + "".join(f"V,m,pt,{i},{cam},0,0,,{i / 2},,\n" for cam in ("c1", "c2") for i in range(10)))
    put("b/phase3/fusion_links.csv", links + "V,m,pt,1,0.5,7,c2,1,x,c1,2,x,0,0.1\nV,m,pt,1,0.5,8,c1,1,x,c2,2,x,0,0.1\n")
    put("b/manifest.json", json.dumps({"mode": "live"}))
    put("c/phase3/summary.csv", summary)
    put("notes.txt", "no run")
    got = run_directories.compare_run_directories(spark, str(tmp_path / "*"), ["c1", "c2", "c3"])
    assert got.columns[0] == "run_dir" and got.columns[1:] == sorted(got.columns[1:])
    rows = {r.run_dir.rsplit("/", 1)[1]: r for r in got.collect()}
    assert set(rows) == {"a", "b", "silent"}
    assert (rows["a"].transport, rows["a"].events, rows["a"].latency_mean_ms, rows["a"].latency_max_ms) == ("http", 2, 3.0, 4.0)
    assert (rows["silent"].transport, rows["silent"].events, rows["silent"].latency_p95_ms) == ("silent", 0, 0.0)
    b = rows["b"]
    assert (b.frames, b.detections, b.duration_s, b.fusion_links, b.top_fusion_pair, b.fusion_camera_pairs) == (10, 40, 4.5, 6, "c1+c2", 1)
    assert (b.dropped_cameras, b.camera_count, b.mode, b.frames_with_fusion) == ("c3", 3, "live", 1)
    assert run_directories.compare_run_directories(spark, str(tmp_path / "none" / "*")) is None
