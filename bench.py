"""Benchmark: every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query's DataFrame is executed in full through the ``noop`` sink (no
rows are collected), warm (after one untimed pass over all queries), and the
median of $BENCH_REPEAT runs is reported.  Prints one JSON line:

    {"metric": "sum_of_query_medians", "value": N, "unit": "sec",
     "queries": {"name": sec, ...}, "sf": ..., "report": {...}}

``report`` times the full report: all queries from one stored complaints
table (built once from the view) versus each query from the view.

Set ``BENCH_EVENT_LOG_DIR`` to a scratch folder to keep Spark's event log
(stage and task times) of the run.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from redress.plans import report  # noqa: E402
from redress.plans.registry import MIN_YEAR, QUERIES  # noqa: E402
from redress.session import checkpoint_dir, get_session  # noqa: E402


def _run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    only = [x for x in os.environ.get("BENCH_QUERIES", "").split(",") if x]
    conf = {"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")}
    event_log = os.environ.get("BENCH_EVENT_LOG_DIR")  # stage and task times, for analysis
    if event_log:
        conf.update({"spark.eventLog.enabled": "true", "spark.eventLog.dir": event_log})
    spark = get_session(
        f"local[{cpus}]", app_name="redress-bench", shuffle_partitions=int(cpus), conf=conf
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = only or list(QUERIES)

    for name in names:  # warm-up: JIT, file listing caches, Python workers
        _run(QUERIES[name](spark, sf_dir))

    timings: dict[str, float] = {}
    for name in names:
        runs = []
        for _ in range(repeat):
            t0 = time.perf_counter()
            _run(QUERIES[name](spark, sf_dir))
            runs.append(time.perf_counter() - t0)
        timings[name] = round(statistics.median(runs), 4)

    report_times = {}
    if not only:
        base = re.sub(r"^file:", "", checkpoint_dir(spark))
        target = os.path.join(base, f"bench-complaints-{uuid.uuid4().hex}")
        t0 = time.perf_counter()
        report.build_complaints_table(spark, sf_dir, target)
        report_times["build_table"] = round(time.perf_counter() - t0, 4)
        stored = report.read_table(spark, target)
        t0 = time.perf_counter()
        for df in report.run_report(stored, min_year=MIN_YEAR).values():
            _run(df)
        report_times["all_from_table"] = round(time.perf_counter() - t0, 4)

    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "sum_of_query_medians",
                "value": round(sum(timings.values()), 4),
                "unit": "sec",
                "queries": timings,
                "sf": float(sf.group(1)) if sf else sf_dir,
                "cpus": int(cpus),
                "repeat": repeat,
                "report": report_times,
            }
        )
    )


if __name__ == "__main__":
    main()
