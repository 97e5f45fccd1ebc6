"""Headline queries, timed end to end; prints one JSON line.

    BENCH_SF_DIR   folder of test tables (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores (default 4)

Every query runs to completion into a sink that takes all columns of all rows and stores nothing.
"""

from __future__ import annotations

import json
import os
import time

from rollgrid import session
from rollgrid.plans import registry

HEADLINES = (
    "a1_student_rate", "a2_teacher_rate", "f5_page_deep", "j1_enrich_timetable", "j4_conflicts_teacher",
    "j5_self_conflicts_teacher", "j8_box_overlap", "io3_import_timetable_report", "io7_upsert_attendance",
    "q1_quality_gate_enrol", "v2_knn_join", "v2_knn_join_tiled", "v5_resolve_identity", "s1_rate_limit", "s3_dedup_ttl",
    "s5_replay_guard", "s6_track", "s8_camera_quorum", "s10_verify_attendance", "h1_rank_candidates",
    "h4_plan_substitutions",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = session.build(f"local[{cpus}]")
    spark.sparkContext.setLogLevel("ERROR")
    registry.load()

    def run(name: str) -> float:
        started = time.perf_counter()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - started, 3)

    run("a1_student_rate")  # start the JVM side and
    run("s3_dedup_ttl")  # the Python workers before timing
    took = {name: run(name) for name in HEADLINES}
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
