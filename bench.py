"""Seconds per headline query at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; one JSON line.

``python bench.py all`` times every registered query, ``python bench.py slug ...`` some.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from fleetvault.session import local_session
from workload.queries import QUERIES

HEADLINE = [
    "monthly_usage",
    "hourly_usage",
    "running_balance",
    "parse_path",
    "eligibility_counts",
    "list_children",
    "upload_plan",
    "validate_summary",
    "restore_summary",
    "build_manifest",
    "backup_size",
    "latest_backup",
    "purge_files",
    "purge_report",
    "component_intervals",
    "manifest_versions",
    "stream_hourly",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    chosen = sys.argv[1:] or HEADLINE
    if chosen == ["all"]:
        chosen = list(QUERIES)
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    # Start Python-free code paths and the parquet reader once, outside the timings.
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()

    seconds = {}
    for slug in chosen:
        began = time.perf_counter()
        QUERIES[slug](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[slug] = round(time.perf_counter() - began, 3)
        print(f"{slug:24} {seconds[slug]:8.3f}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)$", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )


if __name__ == "__main__":
    main()
