"""Per-stage task skew from a Spark event log (zstd or plain), grouped by job group.

usage: python tools/stage_skew.py <spark.eventLog.dir> [min_stage_ms]
"""
import collections
import glob
import io
import json
import sys


def lines(path):
    if path.endswith(".zstd"):
        import zstandard
        return io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(open(path, "rb")), encoding="utf-8")
    return open(path, encoding="utf-8")


def main():
    root = sys.argv[1]
    min_ms = int(sys.argv[2]) if len(sys.argv) > 2 else 300
    paths = glob.glob(f"{root}/*/events_*") + glob.glob(f"{root}/local-*") + glob.glob(f"{root}/app-*")
    tasks, group = collections.defaultdict(list), {}
    for path in paths:
        for line in lines(path):
            e = json.loads(line)
            if e["Event"] == "SparkListenerJobStart":
                g = (e.get("Properties") or {}).get("spark.jobGroup.id")
                for sid in e["Stage IDs"]:
                    group[sid] = g
            elif e["Event"] == "SparkListenerTaskEnd":
                ti, m = e["Task Info"], e.get("Task Metrics") or {}
                rows = (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
                tasks[e["Stage ID"]].append((ti["Finish Time"] - ti["Launch Time"], rows))
    for sid in sorted(tasks):
        d = [t for t, _ in tasks[sid]]
        r = [n for _, n in tasks[sid]]
        if sum(d) < min_ms:
            continue
        print(f"{group.get(sid)!s:12s} stage {sid:4d} tasks {len(d):4d} max {max(d):6d}ms "
              f"sum {sum(d):7d}ms max/mean {max(d) / (sum(d) / len(d)):.1f} "
              f"shuffle rows: max task {max(r)} of {sum(r)}")


if __name__ == "__main__":
    main()
