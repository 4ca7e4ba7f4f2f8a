"""Written tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
def shared_base(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors see.

    Where it is unset, a temporary folder takes its place in local mode (tests in one process); a cluster has no such
    folder that all see, so there this raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="rulespan-")
    return _LOCAL[context.applicationId]


def _store(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. Hadoop's file system removes it when the driver ends."""
    path = f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"
    store, at = _store(spark, path)
    store.mkdirs(at)
    store.deleteOnExit(at)
    return path


#: Weak references to the file listings of written tables, and the folders that go when nothing can read the table any more.
_TABLES: list[tuple[object, list[str]]] = []


def _sweep(spark: SparkSession) -> None:
    """Deletes the folders of tables that no plan holds: what Spark does for its own shuffle files."""
    for entry in [t for t in _TABLES if t[0].refersTo(None)]:
        _TABLES.remove(entry)
        for path in entry[1]:
            store, at = _store(spark, path)
            store.delete(at, True)


def materialise(df: DataFrame, name: str, *folders: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there and its rows no longer change.

    The table, and folders whose files its rows name, are deleted when the driver's JVM has collected all plans that
    read it, or when the driver ends. Plans derived from the table hold it, so whoever has one keeps its files.
    """
    spark = df.sparkSession
    _sweep(spark)
    path = shared_dir(spark, name)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    listing = out._jdf.queryExecution().analyzed().relation().location()
    _TABLES.append((spark.sparkContext._jvm.java.lang.ref.WeakReference(listing), [path, *folders]))
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables of materialise() that nothing reads any more, at once."""
    for t in tables:
        if t is not None and (path := t.__dict__.get("_stored_at")):
            store, at = _store(t.sparkSession, path)
            store.delete(at, True)
