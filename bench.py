"""Headline queries at one scale; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the data and the cores. BENCH_QUERIES may name a comma-separated subset.
"""

from __future__ import annotations

import json
import os
import sys
import time

from latewin import build_session
from latewin.plans.catalog import ENTRIES

HEADLINE = (
    "sliding_window_agg",
    "tumbling_window_agg",
    "canonical_dedup",
    "inject_disorder_heavy",
    "profile_summary",
    "lateness_observations",
    "adaptive_watermark",
    "mechanism_result_cmix",
    "mechanism_result_fixed",
    "mechanism_result_aloa",
    "mechanism_result_full",
    "mechanism_result_earm_agg",
    "run_snapshot",
    "run_snapshot_fixed",
    "tier_timeline",
    "accounting_cycles",
    "compare_verdict",
    "crosscheck",
    "window_features",
    "anomaly_summary",
    "stream_window_full",
    "stream_adaptive_union",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = build_session(
        f"local[{cpus}]",
        app="latewin-bench",
        shuffle_partitions=int(cpus),
        extra={"spark.driver.memory": "12g", "spark.log.level": "ERROR"},
    )
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    # One unmeasured pass so that class loading and code generation do not count.
    ENTRIES["sliding_window_agg"].run(spark, sf_dir).collect()
    ENTRIES["run_snapshot"].run(spark, sf_dir).collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        ENTRIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total seconds over headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "events_per_second": {n: round(events / s) for n, s in seconds.items()},
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
