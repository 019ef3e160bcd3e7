"""Headline queries on one node: prints one JSON line with the wall time of each.

Every query is computed in full (all rows and columns) through the ``noop`` sink. ``BENCH_SF_DIR`` names the tables,
``BENCH_CPUS`` the number of local threads.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sightgrid.plans import registry  # noqa: E402
from sightgrid.session import build_session  # noqa: E402

HEADLINE = [
    "zone_alert_counts", "alerts", "project_to_floor", "candidate_pairs", "optimal_links", "mutual_nearest_links",
    "frame_components", "global_ids", "fusion_links", "track_stability", "persistence", "event_scores",
    "false_positive_sessions", "truth_link_join", "latency_by_stage", "run_health", "audited_alerts", "validate_envelopes",
    "resampled", "overlay_lookup",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g")})
    spark.sparkContext.setLogLevel("ERROR")
    known = registry()
    known["inside_zones"][0](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start workers, warm the JIT
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.time()
        known[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total wall time of the headline queries", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
