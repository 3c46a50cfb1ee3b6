"""A task that dies on its first attempt is retried; the written table is complete and exact."""
import os
import subprocess
import sys

from conftest import SF001


def test_classify_job_survives_a_failed_task(tmpdir_path):
    script = os.path.join(os.path.dirname(__file__), "fault_job.py")
    out = os.path.join(tmpdir_path, "scored")
    proc = subprocess.run([sys.executable, script, SF001, out], capture_output=True, text=True, timeout=600)
    line = [l for l in proc.stdout.splitlines() if l.startswith("RESULT")]
    assert line, proc.stderr[-2000:]
    assert line[0] == "RESULT rows=200 keys=200 diff=0 failed_attempts=1"
