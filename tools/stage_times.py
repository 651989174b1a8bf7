"""Summarise a Spark event log: the slowest stages with task count, time and
shuffle bytes.  Usage: python tools/stage_times.py <event log folder or file> [top]"""

from __future__ import annotations

import glob
import io
import json
import os
import sys

import zstandard


def _lines(name: str):
    """Lines of an event log file, zstd-compressed (Spark's default) or plain."""
    if name.endswith(".crc") or os.path.basename(name).startswith("appstatus"):
        return
    with open(name, "rb") as raw:
        if name.endswith(".zstd"):
            stream = zstandard.ZstdDecompressor().stream_reader(raw)
            yield from io.TextIOWrapper(stream, encoding="utf-8")
        else:
            yield from io.TextIOWrapper(raw, encoding="utf-8")


def stages(path: str):
    files = sorted(glob.glob(os.path.join(path, "**", "*"), recursive=True)) if os.path.isdir(path) else [path]
    for name in files:
        if os.path.isdir(name):
            continue
        for line in _lines(name):
            event = json.loads(line)
            if event.get("Event") != "SparkListenerStageCompleted":
                continue
            info = event["Stage Info"]
            acc = {a.get("Name"): a.get("Value") for a in info.get("Accumulables", [])}
            yield {
                "stage": info["Stage ID"],
                "name": info["Stage Name"].split(" at ")[0],
                "tasks": info["Number of Tasks"],
                "ms": info.get("Completion Time", 0) - info.get("Submission Time", 0),
                "shuffle_read": int(acc.get("internal.metrics.shuffle.read.localBytesRead", 0) or 0)
                + int(acc.get("internal.metrics.shuffle.read.remoteBytesRead", 0) or 0),
                "shuffle_write": int(acc.get("internal.metrics.shuffle.write.bytesWritten", 0) or 0),
            }


def main():
    path = sys.argv[1]
    top = int(sys.argv[2]) if len(sys.argv) > 2 else 20
    rows = sorted(stages(path), key=lambda r: -r["ms"])
    total = sum(r["ms"] for r in rows)
    print(f"{len(rows)} stages, {total / 1000:.1f} s of stage time")
    print(f"{'stage':>6} {'tasks':>6} {'ms':>7} {'shuffle read':>13} {'shuffle write':>13}  name")
    for r in rows[:top]:
        print(f"{r['stage']:>6} {r['tasks']:>6} {r['ms']:>7} {r['shuffle_read']:>13} {r['shuffle_write']:>13}  {r['name']}")


if __name__ == "__main__":
    main()
