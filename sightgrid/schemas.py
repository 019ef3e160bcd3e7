"""Explicit schemas of the run files. Files are never inferred; an empty cell is NULL."""

from __future__ import annotations

RUN = "model_version string, model string, format string"

# Columns of each run file, in file order.
RUN_FILES = {
    "detections": f"{RUN}, frame bigint, timestamp double, cam_id string, track_id bigint, track_age bigint, "
                  "global_id bigint, class_id bigint, class_name string, confidence double, x1 double, y1 double, "
                  "x2 double, y2 double, foot_u double, foot_v double, x_m double, y_m double, inside_zones string",
    "alerts": f"{RUN}, frame bigint, timestamp double, alert_id string, alert_type string, alert_level string, "
              "global_id bigint, zone_id string, class_name string, x_m double, y_m double, cameras string, "
              "confidence double",
    "fusion_links": f"{RUN}, frame bigint, timestamp double, global_id bigint, cam_a string, track_a bigint, "
                    "class_a string, cam_b string, track_b bigint, class_b string, time_delta_ms double, distance_m double",
    "track_stability": f"{RUN}, cam_id string, track_id bigint, first_frame bigint, last_frame bigint, age bigint, "
                       "global_id_switches bigint, global_ids string",
    "sync_events": f"{RUN}, campaign_frame bigint, cam_id string, video_frame bigint, timestamp_epoch double, "
                   "timestamp_iso string, elapsed_s double, recorded_video string, capture_backend string",
    "latency_trace": f"{RUN}, campaign_frame bigint, cam_id string, capture_backend string, frame_width bigint, "
                     "frame_height bigint, capture_success string, scene_time_epoch_manual double, loop_start_epoch double, "
                     "capture_read_start_epoch double, capture_read_end_epoch double, capture_read_ms double, "
                     "batch_ready_epoch double, frame_timestamp_epoch double, inference_start_epoch double, "
                     "inference_end_epoch double, inference_tracking_ms double, detections_camera bigint, "
                     "fusion_start_epoch double, fusion_end_epoch double, fusion_ms double, fused_detections bigint, "
                     "alerts_start_epoch double, alerts_end_epoch double, alerts_ms double, alerts_count bigint, "
                     "metadata_start_epoch double, metadata_end_epoch double, metadata_ms double, record_write_ms double, "
                     "display_ms double, internal_after_read_ms double, total_loop_ms double",
    "run_summary": f"{RUN}, frames bigint, detections bigint, alerts bigint, fusion_links bigint, unique_global_ids bigint, "
                   "global_id_switches bigint, latency_mean_ms double, latency_median_ms double, latency_p95_ms double, "
                   "latency_max_ms double",
    "trd": f"{RUN}, camera string, gt_camera string, trd_median double, trd_p95 double, trd_mean double, "
           "n_gt_events bigint, n_matched bigint, n_missed bigint, n_faux_positifs bigint, precision double, recall double, "
           "f1 double",
    "tad": f"{RUN}, camera string, gt_camera string, tad_median double, tad_p95 double, tad_mean double, "
           "n_gt_events bigint, n_matched bigint, n_missed bigint, n_faux_positifs bigint, precision double, recall double, "
           "f1 double",
    "labelled_detections": "frame bigint, timestamp double, cam_id string, track_id bigint, x_m double, y_m double, "
                           "truth_id string, confidence double, class_name string",
    "truth_links": "frame bigint, cam_a string, track_a string, cam_b string, track_b string, expected_same string",
    "alert_latency": "event_id bigint, transport string, latency_ms double",
}

DETECTION_DOC = ("camera_id string, track_id bigint, global_id bigint, class_id bigint, class_name string, confidence double, "
                 "bbox_px array<double>, foot_point_px array<double>, position_m array<double>, zones array<string>, "
                 "timestamp double")
ALERT_DOC = ("alert_id string, alert_type string, alert_level string, global_id bigint, zone_id string, class_name string, "
             "position_m array<double>, cameras array<string>, confidence double, timestamp double")
TIMING_DOC = ("camera_count bigint, capture_read_ms_mean double, capture_read_ms_max double, "
              "capture_read_end_epoch_min double, capture_read_end_epoch_max double, batch_ready_epoch double, "
              "inference_start_epoch_min double, inference_end_epoch_max double, inference_tracking_ms_mean double, "
              "inference_tracking_ms_max double, fusion_ms double, alerts_ms double, capture_to_metadata_ms_worst double, "
              "capture_to_metadata_ms_latest double")
ENVELOPE = ("schema string, created_epoch_ms double, created_epoch_s double, frame bigint, run_label string, "
            "model_version string, model string, format string, "
            f"detections array<struct<{DETECTION_DOC}>>, alerts array<struct<{ALERT_DOC}>>, "
            f"timing struct<{TIMING_DOC}>")

TRUTH = ("id_camera string, id_evenement bigint, classe_objet string, zone_id string, trame_apparition bigint, "
         "horodatage_apparition double, trame_violation bigint, horodatage_violation double, horodatage_sortie double, "
         "t_sortie_sec double, temps_sortie double, trame_sortie bigint, frame_sortie bigint, id_salle bigint")


def fields(ddl: str) -> list[tuple[str, str]]:
    """(name, type) pairs of a flat schema text."""
    return [tuple(part.strip().split(" ", 1)) for part in ddl.split(",")]
