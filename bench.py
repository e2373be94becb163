"""Headline queries, timed one by one; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from authscope.plans.queries import QUERIES
from authscope.session import session

HEADLINE = [
    "lake", "sessions", "hour_histogram", "rollup", "daily_mart", "dim_identity", "dim_computer", "q1_weekly_fanout", "q2_off_hours", "q3_new_paths",
    "q4_failure_spikes", "q5_evaluation", "stored_mart", "stored_q1_weekly_fanout", "stored_q2_off_hours", "stored_q3_new_paths", "stored_q4_failure_spikes", "stored_q5_evaluation", "graph_edges", "graph_blast_radius", "graph_choke_points", "graph_shortest_paths", "vector_features", "vector_unit",
    "vector_anomalies", "vector_retrieval", "streaming_windows", "weekly_suppliers",
]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": "file:///tmp/checkpoints/bench",
    })
    spark.sparkContext.setLogLevel("ERROR")
    names, took = list(HEADLINE), {}
    QUERIES["lake"](spark, folder).write.format("noop").mode("overwrite").save()  # warm-up
    for name in names:
        began = time.monotonic()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.monotonic() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
