"""bench.py prints exactly one JSON line with the fields the driver records."""
import json
import os
import subprocess
import sys

from conftest import SF001


def test_bench_prints_one_json_line(tmpdir_path):
    """Run from a foreign working directory: the Python workers must still import the
    package (it is shipped with addPyFile), as on a cluster."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = dict(os.environ, BENCH_SF_DIR=SF001, BENCH_CPUS="2")
    proc = subprocess.run([sys.executable, os.path.join(root, "bench.py")], capture_output=True,
                          text=True, timeout=900, env=env, cwd=tmpdir_path)
    lines = [l for l in proc.stdout.splitlines() if l.strip()]
    assert len(lines) == 1, proc.stdout + proc.stderr[-2000:]
    out = json.loads(lines[0])
    assert out["metric"] == "total_sec" and out["unit"] == "sec" and out["sf"] == 0.001
    assert out["predictions"] == 200 and set(out["queries"]) >= {"results", "summary_report", "classify_job"}
    assert abs(out["value"] - sum(out["queries"].values())) < 0.01
