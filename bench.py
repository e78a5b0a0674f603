"""Time the headline queries: one JSON line on stdout."""

import json
import os
import sys
import time

from suite import QUERIES
from taskscope.session import local_session

HEADLINE = [
    "A1_duration_stats", "A2d_pilot_debug", "A2e_task_debug", "A4_task_state_stats", "A5_session_timing",
    "S1_read_trace", "C2_clean", "C6_close_pairs", "C7_session_trace",
    "M2_progress_task", "M3_progress_pilot", "M4_collapse", "M6_transition_check", "M7_latest_docs",
    "J2_entity_edges", "J4_resource_index_cpu", "J6_feasible", "S4_task_ids",
    "W1_provided_cpu", "W3_task_boxes", "W4_cluster_ranges", "W5_warm_drain_idle_cpu", "W6_consumed",
    "A9_core_time", "W8_usage_timeline", "W9_task_timelines", "W10_occupancy_audit", "W11_order_audit",
    "W12_colocation_audit", "W13_round_robin", "W14_capacity",
    "P13_rejected_tasks", "F12_commands_for_rank", "S5_log_events", "X1_run_func", "X8_run_tasks",
    "T1_progress_stream", "T6_ordered_bags", "T14_live_durations",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    wanted = sys.argv[1:]
    spark = local_session(cores, cores, "16g")
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # warm up
    times = {}
    for name in HEADLINE:
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name:28s} {times[name]:8.2f}", file=sys.stderr)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(scale) if scale.replace(".", "").isdigit() else scale}))
    spark.stop()


if __name__ == "__main__":
    main()
