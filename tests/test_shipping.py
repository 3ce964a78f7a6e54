import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

RUN = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__
print("ROWS", len(__spark_entry__.queries()["W2_scene_changes"](spark, {data!r}).collect()))
"""


def test_queries_run_from_any_folder(data, tmp_path):
    """Workers that do not have the package on their path get it sent."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", RUN.format(root=str(ROOT), data=data)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert int(out.stdout.split("ROWS")[1]) > 0, out.stderr[-500:]
