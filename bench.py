"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs twice for warmth and then five times, in an order that rotates; a run counts only if its
row count is that of the first. The figure of a query is the median, the metric their sum.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

HERE = os.path.dirname(os.path.abspath(__file__))
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (HERE, os.environ.get("PYTHONPATH", "")) if x)
sys.path.insert(0, HERE)

from sparkloom.plans.registry import QUERIES  # noqa: E402

HEADLINES = (
    "flagship", "agg_group", "agg_year_month", "agg_date", "count_distinct", "count_if_has", "agg_related_nested", "agg_has", "running_sum", "having_between",
    "has_filtered", "has_nested", "has_via", "not_has", "topn_rewritten", "topn_fallback", "count_rewritten", "limit_offset", "seek_mixed",
    "preload_has_many", "preload_via_order", "vector_l2", "vector_cosine", "upsert", "update_many", "orphan_audit", "n_plus_one_analysis",
)


def _calibrate(spark: SparkSession, cpus: int) -> float:
    """Seconds of a fixed computation that reads nothing: times are comparable between machines as multiples of it."""
    began = time.perf_counter()
    spark.range(0, 200_000_000, 1, cpus).selectExpr("sum(id * 7 % 1000003) AS s").collect()
    return time.perf_counter() - began


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    warmups, samples = int(os.environ.get("BENCH_WARMUPS", "2")), int(os.environ.get("BENCH_SAMPLES", "5"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    calibration = [_calibrate(spark, int(cpus)) for _ in range(6)]
    times: dict[str, list[float]] = {n: [] for n in HEADLINES}
    rows: dict[str, int] = {}
    for turn in range(warmups + samples):
        for i in range(len(HEADLINES)):
            name = HEADLINES[(i + turn) % len(HEADLINES)]
            began = time.perf_counter()
            # every column is computed: a count alone would prune them
            n = QUERIES[name](spark, sf_dir)._jdf.queryExecution().toRdd().count()
            seconds = time.perf_counter() - began
            if rows.setdefault(name, n) != n:
                raise AssertionError(f"{name}: {n} rows, first {rows[name]}")
            if turn >= warmups:
                times[name].append(seconds)
    found = {n: round(statistics.median(t), 4) for n, t in times.items()}
    print(json.dumps({"metric": "sum of median query seconds", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "rows": rows, "cores": int(cpus), "calibration": round(min(calibration), 4), "load": round(os.getloadavg()[0], 2)}))
    spark.stop()


if __name__ == "__main__":
    main()
