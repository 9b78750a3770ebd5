"""A session started from another folder, with the package known to the driver alone."""

from __future__ import annotations

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as entry
for name in ("chi_square_uniform", "stream_lead_state"):
    assert len(entry.queries()[name](spark, "/root/testdata/sf0.001").collect()) > 0
print("done")
"""


def test_functions_of_tasks_need_no_installed_package(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(SCRIPT)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    ran = subprocess.run([sys.executable, str(script), root], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert ran.returncode == 0 and "done" in ran.stdout, ran.stderr[-2000:]
