"""Execute each registered query and summarise its final (AQE) plan: tables
scanned with the columns read and filters pushed, shuffles, single-partition
exchanges, broadcasts.  ``--markdown`` prints a table for PLANS.md."""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from redress.plans.registry import QUERIES  # noqa: E402
from redress.session import get_session  # noqa: E402

SCAN = re.compile(
    r"FileScan parquet \[([^\]]*)\][^\n]*?Location: [^\n]*?/([\w.-]+?)(?:\.parquet)?\][^\n]*?PushedFilters: \[(.*?)\], ReadSchema"
)


def summarise(df):
    df.collect()  # runs this DataFrame's own plan, so AQE finalises it
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    scans = []
    for cols, table, pushed in SCAN.findall(plan):
        table = "complaints" if table.startswith("plans-") else table
        names = [re.sub(r"#\d+L?", "", x).strip() for x in cols.split(",") if x.strip()]
        filters = [f.strip() for f in re.split(r",(?![^(]*\))", pushed) if f.strip()]
        scans.append((table, names, filters))
    return {
        "scans": scans,
        "shuffles": len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition", plan)),
        "single": plan.count("Exchange SinglePartition"),
        "broadcast": plan.count("BroadcastExchange"),
        "smj": plan.count("SortMergeJoin"),
    }


def main():
    args = [a for a in sys.argv[1:] if not a.startswith("--")]
    markdown = "--markdown" in sys.argv
    sf_dir = args[0] if args else "/root/testdata/sf0.1"
    spark = get_session(
        "local[8]", shuffle_partitions=8, conf={"spark.sql.maxMetadataStringLength": "100000"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    if "--report" in sys.argv:
        # The report path: every result over a stored complaints table.
        import uuid

        from redress.plans import report
        from redress.plans.registry import MIN_YEAR
        from redress.session import checkpoint_dir

        base = re.sub(r"^file:", "", checkpoint_dir(spark))
        path = report.build_complaints_table(spark, sf_dir, os.path.join(base, f"plans-{uuid.uuid4().hex}"))
        results = report.run_report(report.read_table(spark, path), min_year=MIN_YEAR)
        builders = {name: (lambda df: (lambda s, d: df))(df) for name, df in results.items()}
    else:
        builders = QUERIES
    names = args[1:] or list(builders)
    if markdown:
        print("| Query | Tables read (columns) | Shuffles | of which single-partition | Broadcast joins |")
        print("|---|---|---|---|---|")
    for name in names:
        s = summarise(builders[name](spark, sf_dir))
        reads = "; ".join(
            f"{t}({', '.join(c)})" + (f" [{', '.join(f)}]" if f else "") for t, c, f in s["scans"]
        )
        if markdown:
            print(f"| `{name}` | {reads} | {s['shuffles']} | {s['single']} | {s['broadcast']} |")
        else:
            print(f"{name:30s} shuffles={s['shuffles']} single={s['single']} broadcast={s['broadcast']} smj={s['smj']} reads={reads}")


if __name__ == "__main__":
    main()
