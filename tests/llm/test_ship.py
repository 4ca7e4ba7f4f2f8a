"""The operators as functions of the library, in a session that nothing else has prepared."""

import os
import subprocess
import sys
from pathlib import Path

CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from rulespan.llm.exact_dedup import distinct_rows
from rulespan.llm.simhash import near_groups

spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, None)], "doc_id long, text string")
print("rows", (distinct_rows if {what!r} == "exact" else near_groups)(docs).count())
"""


def test_workers_have_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_SUBMIT_ARGS")}
    for what, n in (("exact", 2), ("near", 3)):
        done = subprocess.run([sys.executable, "-c", CODE.format(root=str(Path(__file__).resolve().parents[2]), what=what)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
        assert f"rows {n}" in done.stdout, done.stderr[-2000:]
