"""Queries with Python workers run wherever the process starts."""

import os
import subprocess
import sys
from pathlib import Path

SF = "/root/testdata/sf0.001"

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from tidebook.session import build_session
from tidebook.catalog import load
spark = build_session("elsewhere", "local[2]", 4)
known = load().QUERIES
for name in sys.argv[3:]:
    print(name, known[name](spark, sys.argv[2]).count())
"""


def test_runs_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    names = ["opt12_term_structure", "win24_supertrend", "bkt05_monthly_breakout"]
    repo = Path(__file__).parent.parent
    done = subprocess.run([sys.executable, "-c", SCRIPT, str(repo), str(SF), *names], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    counts = dict(line.split() for line in done.stdout.splitlines() if line.split()[:1] and line.split()[0] in names)
    assert set(counts) == set(names)
