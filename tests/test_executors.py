"""Tasks must not need this package on the executors' path."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from tallyloom import build_session
from tallyloom.operators import chunks
from tallyloom.sources import readers
spark = build_session("elsewhere", "local[2]", spark__ui__enabled="false")
assert readers.scan_csv(spark, "data.csv").count() == 2
assert chunks.apply_process_fn(spark.range(3), lambda b: b + 1).agg({{"id": "sum"}}).first()[0] == 6
print("fine")
"""


def test_run_from_another_folder(tmp_path):
    (tmp_path / "data.csv").write_text("name,amount\na,1\nb,2\n")
    repo = str(Path(__file__).resolve().parents[1])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(repo=repo)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "fine" in done.stdout, done.stderr[-2000:]
