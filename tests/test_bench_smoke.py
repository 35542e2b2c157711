"""bench.py runs end to end and prints one JSON line (smallest scale, one run per step)."""

import json
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_CPUS="4", BENCH_RUNS="1")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], env=env, capture_output=True,
                         text=True, timeout=900, cwd="/tmp")
    assert out.returncode == 0, out.stderr[-2000:]
    lines = [x for x in out.stdout.splitlines() if x.strip()]
    result = json.loads(lines[-1])
    assert result["unit"] == "sec" and result["sf"] == 0.001 and result["rows"] == 6000
    assert set(result["queries"]) >= {"ingest", "invoice_lines", "top_customers"}
    assert abs(result["value"] - sum(result["queries"].values())) < 0.01
