"""Executors need not have this package on their path: what reaches them carries its own code or is plain."""

import os
import subprocess
import sys
from pathlib import Path

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from corpusloom.llm import registry
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[2]).getOrCreate()
for name in ("op1_quality_rules", "op2_line_dedup", "op3_url_filter", "op8_byte_bpe", "op9_pii", "op11_pack", "op12_repair", "op13_periodic_runs"):
    assert len(registry.queries()[name](spark, sys.argv[3]).collect()), name
print("all ran")
"""


def test_queries_run_where_only_the_driver_can_import_the_package(tmp_path):
    root = str(Path(__file__).resolve().parents[2])
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYTHONPATH", "PYSPARK", "SPARK"))} | {"PYTHONPATH": ""}
    run = subprocess.run([sys.executable, "-c", SCRIPT, root, f"file://{tmp_path}/shared", DATA], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert run.returncode == 0 and "all ran" in run.stdout, run.stderr[-3000:]
