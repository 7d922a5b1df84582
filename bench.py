"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query runs once to warm up, then three times; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "manifest", "positions", "locations", "record_count", "quality_summary", "extent",
    "available_channels", "decoded_masks", "track_segments", "track_features", "trails",
    "stationary_repeats", "point_features", "shapes_result", "outlines", "shape_validity",
    "connections", "mission_contents", "attachments", "files", "compare_by_id",
    "compare_positions", "recheck_verdict", "package_integrity", "effective_case",
    "lookup_hashes", "window_containment", "verify_chain", "table_hash",
)
RUNS = 3


def main() -> None:
    from pyspark.sql import SparkSession

    from posevidence.plans.catalog import REGISTRY
    from posevidence.sources.adapter import CheckTables

    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        began = time.perf_counter()
        df = REGISTRY[name].build(CheckTables(spark, directory))
        # Computes every row and column without storing or collecting them.
        df.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    wanted = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in wanted:
        run(name)
        seconds[name] = round(statistics.median(run(name) for _ in range(RUNS)), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total seconds of headline queries (median of 3 after warm-up)",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(directory).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
