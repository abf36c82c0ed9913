"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line, and each figure to stderr as it comes.

A query gets LIMIT seconds: no further run of it begins beyond that, and one that does not end is cancelled and listed as null.
"""

from __future__ import annotations

import json
import os
import sys
import threading
import time

from pyspark.sql import SparkSession

from lorefield.plans import registry

QUERIES = ["agg_type_frequency", "rank_types", "agg_cooccurrence", "agg_canonical_exam", "join_annotation_cascade", "join_course_tasks", "topk_per_group", "pii_redact", "risk_detectors", "agg_affected_lines", "join_section_range", "join_page_asof", "fix_repair_text", "qc_structural", "join_snapshot_diff"]
LIMIT = 90.0


def timed(spark: SparkSession, query, sf_dir: str) -> float | None:
    """The median of up to three runs; none if the first does not end in time."""
    runs: list[float] = []
    began = time.perf_counter()
    while len(runs) < 3 and time.perf_counter() - began < LIMIT:
        stop = threading.Timer(LIMIT, spark.sparkContext.cancelAllJobs)
        stop.start()
        at = time.perf_counter()
        try:
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        except Exception as error:  # noqa: BLE001  the other queries go on
            print(type(error).__name__, str(error)[:200], file=sys.stderr, flush=True)
            break
        finally:
            stop.cancel()
        runs.append(time.perf_counter() - at)
    return round(sorted(runs)[len(runs) // 2], 3) if runs else None


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
    spark = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, taken = registry.queries(), {}
    for name in QUERIES:
        taken[name] = timed(spark, queries[name], sf_dir)
        print(name, taken[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "median seconds of the headline queries", "value": round(sum(t or LIMIT for t in taken.values()), 3), "unit": "sec", "queries": taken, "sf": sf_dir.rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
