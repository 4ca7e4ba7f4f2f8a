"""Makes the package importable in the executors' Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

BATCH = 500
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's own modules through Spark's file server, once for each application.

    Rows may be whole documents, so Arrow batches of this session are of BATCH rows at most: a batch and its copies
    in Python then take a few MB.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    out = Path(tempfile.mkdtemp(prefix="rulespan-")) / "rulespan-package.zip"
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(out))
    _SHIPPED.add(app)
