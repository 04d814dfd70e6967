"""Times the registered queries and prints one JSON line.

Environment: ``BENCH_SF_DIR`` (tables, default sf0.1), ``BENCH_CPUS`` (local cores, default 8), ``BENCH_RUNS`` (runs
per query of which the fastest counts, default 2), ``BENCH_QUERIES`` (comma-separated names, default the 13 KPIs, the
18 analyses and the heaviest audits and look-ups). The views over the tables are defined once per session; every run
reads the files again, no rows are cached.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from seaflow.plans.registry import queries
from seaflow.session import settings

HEADLINE = ("k", "j", "w", "a")
MORE = (
    "d01_shipment_list",
    "d03_event_timeline",
    "d04_shipment_containers",
    "d07_shipment_stops",
    "v02_v18_reference_orphans",
    "v22_commercial_chain",
    "p08_event_pins",
    "p09_kpi_tiles",
    "t02_load_once",
    "t04_constraint_audit",
    "t06_event_chains",
    "t07_check_digits",
    "t08_sql_audit",
    "t10_reply_extraction",
    "t11_recent_messages",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("seaflow-bench")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in settings(shuffle_bytes=0, cores=int(cpus)).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()
    chosen = os.environ.get("BENCH_QUERIES")
    names = (
        chosen.split(",")
        if chosen
        else [n for n in registered if (n.startswith(HEADLINE) and not n.endswith("_split")) or n in MORE]
    )
    seconds: dict[str, float] = {}
    for name in names:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds over all timed queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
                "cpus": int(cpus),
                "runs": runs,
            }
        )
    )


if __name__ == "__main__":
    main()
