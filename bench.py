"""Time the headline queries: one JSON line on standard output.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the data, BENCH_CPUS (default 8)
the cores. Every query is written to the noop sink, so all rows and columns count.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from siftlake.plans import catalog  # noqa: E402
from siftlake.session import configure  # noqa: E402

HEADLINE = [
    "static_scan",
    "grep_lines",
    "secret_scan",
    "parse_findings",
    "dashboard_stats",
    "task_list",
    "severity_breakdown",
    "report_overview",
    "report_findings",
    "report_fields",
    "initial_findings",
    "gap_check_merge",
    "finalize_run",
    "read_range",
    "tool_rounds",
    "sanitize_rounds",
    "compression_window",
    "memory_delta",
    "repeated_tool_calls",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("siftlake-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", cpus)
        # The test tables are files of one row group, which a scan can't split.
        .config("spark.siftlake.spread", cpus)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    # The first job pays for class loading and is not a query's time.
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
