"""What runs in Python workers finds the package there, whatever folder the driver is started in."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from rulespan.functions.repo_config import config_rows
from rulespan.plans.engine import prepared, source_facts
from rulespan.sources.repotree import register

what, spark = {what!r}, SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
if what == "config":
    rows = config_rows(spark.createDataFrame([("a", "type: x")], "repo string, content string"), ("x",), ())
elif what == "facts":
    rows = source_facts(prepared(spark.createDataFrame([("a", "src/m/f.py", "def f():\\n    pass\\n")], "repo string, path string, content string")))
else:
    register(spark)
    rows = spark.read.format("repotree").load("file://" + {tree!r})
print("rows", len(rows.collect()))
"""


def test_workers_have_the_package(tmp_path):
    (tmp_path / "tree" / "a").mkdir(parents=True)
    (tmp_path / "tree" / "a" / "x.py").write_text("x = 1")
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_SUBMIT_ARGS")}
    for what in ("config", "facts", "tree"):
        code = CODE.format(root=str(ROOT), what=what, tree=str(tmp_path / "tree"))
        done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
        assert "rows " in done.stdout and "rows 0" not in done.stdout, done.stderr[-2000:]
