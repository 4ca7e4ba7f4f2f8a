"""Run events: flattening, mapping to findings, batch and Structured Streaming."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import filled

FIELDS = ("flow_run_id", "flow_name", "state_name", "state_type", "start_time", "end_time")
PAYLOAD = ", ".join(f"{f} string" for f in FIELDS) + ", id string, name string, resource struct<" + ",".join(f"{f}:string" for f in (*FIELDS, "id", "name")) + ">"


def flatten(events: DataFrame, payload: str = "payload") -> DataFrame:
    """The fields of a JSON payload, stripped, with defaults.

    A key of the top level wins over the same key of the nested resource, even if its value is empty or null. What
    cannot be parsed has all defaults; see malformed().
    """
    e = events.withColumn("__e", F.from_json(payload, PAYLOAD)).withColumn("__k", F.json_object_keys(payload))
    merged = lambda f: F.nullif(F.when(F.array_contains("__k", f), F.col(f"__e.{f}")).otherwise(F.col(f"__e.resource.{f}")), F.lit(""))
    text = lambda *fields, default="": F.coalesce(filled(F.coalesce(*map(merged, fields))), F.lit(default))
    return e.select(
        *events.columns,
        text("flow_run_id", "id", default="prefect-unknown-run").alias("flow_run_id"),
        text("flow_name", default="unknown-flow").alias("flow_name"),
        text("state_name", default="UNKNOWN").alias("state_name"),
        F.upper(text("state_type", default="UNKNOWN")).alias("state_type"),
        text("start_time").alias("start_time"),
        text("end_time").alias("end_time"),
    )


def malformed(events: DataFrame, payload: str = "payload") -> DataFrame:
    """The events whose payload is no JSON object: the dead letters of a batch or a stream."""
    return events.filter(F.json_object_keys(payload).isNull())


def state_severity(state: Column) -> Column:
    s = F.upper(F.coalesce(state, F.lit("")))
    return F.when(s == "CRASHED", "CRITICAL").when(s == "FAILED", "ERROR").when(s == "CANCELLED", "WARN").otherwise("INFO")


#: States that give a finding at once; all others go to a model's review.
ENDED = ("FAILED", "CRASHED", "CANCELLED")


def branch(state_type: Column) -> Column:
    """`direct` for an event that gives a finding at once, else `review`."""
    return F.when(state_type.isin(*ENDED), "direct").otherwise("review")


def collection_findings(runs: DataFrame, year: Column) -> DataFrame:
    """run, severity, finding of collection updates. runs: run, folders, tabs, sets (numbers), snapshot (boolean), names (array of folder names)."""
    some = F.col("folders") > 0
    rules = (
        ((F.col("tabs") == 0) & some, "WARN", F.format_string("No tabs written despite %d folders processed", "folders")),
        (~F.col("snapshot"), "ERROR", F.lit("JSON snapshot write failed")),
        (~F.exists("names", lambda n: n.contains(year.cast("string"))), "WARN", F.lit("Current year folder missing")),
        ((F.col("sets") == 0) & some, "WARN", F.lit("No sets found across any folder")),
    )
    return _run_findings(runs, rules, F.format_string("%d folders, %d tabs, %d sets", "folders", "tabs", "sets"))


def import_findings(runs: DataFrame) -> DataFrame:
    """run, severity, finding of imports of files. runs: run, attempted, imported, failed, duplicates, unrecognized (numbers, null: 0), labels (array of the failed sets' names), ingested (boolean; null: none was needed).

    Files that were attempted and are neither imported, failed nor duplicates are a gap; so are more results than attempts.
    """
    n = lambda name: F.coalesce(F.col(name), F.lit(0))
    gap = n("attempted") - n("imported") - n("failed") - n("duplicates")
    labels = F.coalesce(F.nullif(F.array_join("labels", ", "), F.lit("")), F.lit("(none)"))
    rules = (
        (gap > 0, "WARN", F.format_string("%d of %d attempted files are neither imported, failed nor duplicates", gap, n("attempted"))),
        (gap < 0, "WARN", F.format_string("%d more files imported, failed or duplicates than the %d attempted", -gap, n("attempted"))),
        (n("failed") > 0, "WARN", F.format_string("%d of %d attempted files failed: %s", n("failed"), n("attempted"), labels)),
        ((n("imported") == 0) & (n("attempted") > 0), "ERROR", F.format_string("No file imported of %d attempted", n("attempted"))),
        (n("duplicates") > 0, "INFO", F.format_string("%d possible duplicates not imported", n("duplicates"))),
        (n("unrecognized") > 0, "INFO", F.format_string("%d files skipped for their names", n("unrecognized"))),
        (~F.coalesce("ingested", F.lit(True)), "ERROR", F.lit("API ingest failed")),
    )
    return _run_findings(runs, rules, F.format_string("%d files imported", n("imported")))


def _run_findings(runs: DataFrame, rules: tuple, fine: Column) -> DataFrame:
    """The findings of the rules (test, severity, text) that hold for a run, or an INFO row where none does."""
    none = F.when(~reduce(lambda a, b: a | b, (t for t, _, _ in rules)), F.struct(F.lit("INFO").alias("severity"), fine.alias("finding")))
    hits = F.array_compact(F.array(*(F.when(t, F.struct(F.lit(s).alias("severity"), x.alias("finding"))) for t, s, x in rules), none))
    return runs.select("run", F.explode(hits).alias("x")).select("run", "x.*")


def with_repo(events: DataFrame, flows: DataFrame) -> DataFrame:
    """repo of the flow by a map (flow_name, repo; Spark broadcasts it if it is small), else `unknown`."""
    return events.join(flows, "flow_name", "left").withColumn("repo", F.coalesce("repo", F.lit("unknown")))


def direct_findings(events: DataFrame, flow: Column, state: Column, failing: tuple[str, ...]) -> DataFrame:
    """A finding for each event that ends in one of the failing states."""
    return events.filter(state.isin(*failing)).withColumn("finding", F.format_string("Flow %s entered %s state", flow, state))


def stream(spark, path: str, schema, transform, sink, checkpoint: str):
    """Reads new files of events, applies transform, gives each micro-batch to sink(df, batch_id); ends when all files are read."""
    events = spark.readStream.schema(schema).parquet(path)
    return transform(events).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
