"""Command line entry point."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_list_names_every_query():
    r = subprocess.run([sys.executable, "-m", "orderflow", "list"], cwd=REPO, capture_output=True, text=True,
                       timeout=300)
    assert r.returncode == 0, r.stderr[-2000:]
    names = {line.split()[0] for line in r.stdout.splitlines() if line.strip()}
    assert {"daily_kpis", "gate_batch", "gate_stream", "price_density", "stream_slots"} <= names
    assert len(names) == 87
