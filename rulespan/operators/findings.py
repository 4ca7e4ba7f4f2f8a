"""Routing, applicability, exemption and post-processing of findings, as joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ship import ship
from ..functions.text import filled, strip

#: What a rule's row replaces when both are there for a repo. Fixed values.
SUPERSEDES = (("CD-010", "CD-002"), ("CD-010", "CD-009"))


def check_mode(notes: Column) -> Column:
    """`llm` if the first line, blanks on the left cut, starts with LLM CHECK. in any case; else `deterministic`."""
    first = F.split(F.regexp_replace(F.coalesce(notes, F.lit("")), r"^\s+", ""), "\n")[0]
    word = F.upper(F.regexp_extract(first, r"(?i)^\s*(DETERMINISTIC|LLM)\s+CHECK\s*\.", 1))
    return F.when(word == "LLM", "llm").otherwise("deterministic")


def applies(applies_to: Column, *kinds: Column) -> Column:
    """`all` or any of the kinds is in the array."""
    out = F.array_contains(applies_to, "all")
    for k in kinds:
        out = out | F.coalesce(F.array_contains(applies_to, k), F.lit(False))
    return out


def exception_rule(raw: Column) -> Column:
    """The rule id of an exception line, a comment cut; null if nothing is left."""
    return filled(F.split(raw, "#")[0])


def skip_reason(exempt: Column, deferred: Column) -> Column:
    """The reason of a skipped rule's row: the exemption's, else the deferral's with a mark."""
    return F.coalesce(F.nullif(exempt, F.lit("")), F.concat(F.lit("[DEFERRED] "), F.nullif(deferred, F.lit(""))))


def apply_exemptions(findings: DataFrame, skips: DataFrame) -> DataFrame:
    """Rows of skipped rules go; a skipped rule with a reason gives one INFO row. skips: repo, rule_id, reason, at most one row a pair."""
    kept = findings.join(skips, ["repo", "rule_id"], "left_anti")
    rows = skips.filter("reason is not null").select("repo", "rule_id", F.lit("INFO").alias("severity"), F.concat(F.lit("Skipped: "), "reason").alias("finding"))
    return kept.unionByName(rows, allowMissingColumns=True)


def apply_deferrals(findings: DataFrame, deferrals: DataFrame) -> DataFrame:
    """Rows of deferred rules become INFO and are marked. deferrals: repo, rule_id."""
    marks = deferrals.select("repo", "rule_id", F.lit(True).alias("mark")).distinct()
    out = findings.join(marks, ["repo", "rule_id"], "left")
    return out.withColumn("severity", F.when(F.col("mark"), "INFO").otherwise(F.col("severity"))).withColumn("deferred", F.coalesce("mark", F.lit(False))).drop("mark")


def supersede(findings: DataFrame, key: str = "repo", rule: str = "rule_id", pairs=SUPERSEDES) -> DataFrame:
    """Rows of a rule go when the key also has a row of the rule that supersedes it."""
    strong = None
    for s, w in pairs:
        part = findings.filter(F.col(rule) == s).select(key, F.lit(w).alias(rule))
        strong = part if strong is None else strong.union(part)
    return findings.join(strong.distinct(), [key, rule], "left_anti")


def dedup_siblings(findings: DataFrame) -> DataFrame:
    """Within a group, rows of later members equal on (rule_id, finding) to the first member's go; the first one's text names them in order.

    findings: grp, member, pos (order of members, 0 the first), rule_id, finding.
    """
    first = findings.filter("pos = 0")
    also = (
        findings.filter("pos > 0")
        .join(first.select("grp", "rule_id", "finding").distinct(), ["grp", "rule_id", "finding"], "left_semi")
        .groupBy("grp", "rule_id", "finding")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_set(F.struct("pos", "member"))), lambda x: F.concat(F.lit(" (also affects "), x["member"], F.lit(")"))), "").alias("tags"))
    )
    tagged = first.join(also, ["grp", "rule_id", "finding"], "left").withColumn("text", F.concat("finding", F.coalesce("tags", F.lit(""))))
    rest = findings.filter("pos > 0").join(also, ["grp", "rule_id", "finding"], "left_anti").withColumn("text", F.col("finding"))
    cols = ["grp", "member", "pos", "rule_id", F.col("text").alias("finding")]
    return tagged.select(*cols).union(rest.select(*cols))


def status_text(repo: Column, checks: str, version: Column | str) -> Column:
    """The text of a repository without findings. checks: `deterministic`, `conformance`, or `LLM` where only a model's findings are posted."""
    return F.concat(repo, F.lit(f" passed all {checks} checks for standards v"), version if isinstance(version, Column) else F.lit(version), F.lit("."))


def with_status(findings: DataFrame, repos: DataFrame, text: Column | str) -> DataFrame:
    """A SUCCESS row for each repo without findings; text may read the columns of repos."""
    clean = repos.join(findings.select("repo").distinct(), "repo", "left_anti")
    row = clean.select("repo", F.lit("STATUS").alias("rule_id"), F.lit("SUCCESS").alias("severity"), (text if isinstance(text, Column) else F.lit(text)).alias("finding"))
    return findings.unionByName(row, allowMissingColumns=True)


def to_post(checked: DataFrame, reviewed: DataFrame, only_reviewed: bool) -> DataFrame:
    """Findings of checks and of a model's review, or of the review alone."""
    return reviewed if only_reviewed else checked.unionByName(reviewed, allowMissingColumns=True)


def run_id(kind: str, version: Column, flow_run: Column, now: Column) -> Column:
    """kind-version-run, the run being the flow run's id, or the time where there is none."""
    return F.concat_ws("-", F.lit(kind), version, F.coalesce(filled(flow_run), F.date_format(now, "yyyyMMdd'T'HHmmss")))


def standards_version(override: Column, fetched: Column) -> Column:
    """The version that is set, else the one fetched, else `unknown`."""
    return F.coalesce(filled(override), filled(fetched), F.lit("unknown"))


def published_version(package: Column) -> Column:
    """The version field of a package.json's text; where it is absent, empty or no JSON, the query that reads it fails."""
    version = filled(F.try_variant_get(F.try_parse_json(package), "$.version", "string"))
    return F.coalesce(version, F.raise_error(F.lit("no standards version: version field absent from package.json")))


def unmarked_rules(rules: DataFrame) -> DataFrame:
    """rule_id, problem: a row for each rule whose notes do not say how it is checked, however often it is listed."""
    first = F.split(F.regexp_replace(F.coalesce("check_notes", F.lit("")), r"^\s+", ""), "\n")[0]
    problem = F.when(F.trim(first) == "", "no notes").when(~first.rlike(r"(?i)^\s*(DETERMINISTIC|LLM)\s+CHECK\s*\."), "no marker")
    return rules.select(F.coalesce("rule_id", F.lit("<unknown>")).alias("rule_id"), problem.alias("problem")).filter("problem IS NOT NULL").groupBy("rule_id").agg(F.min("problem").alias("problem"))


def severity(raw: Column, default: str = "INFO") -> Column:
    """Upper case, as it is otherwise; WARNING is WARN; what isn't known is the default (INFO in the sink, WARN for direct findings)."""
    s = F.upper(F.coalesce(F.nullif(raw, F.lit("")), F.lit(default)))
    return F.when(s == "WARNING", "WARN").when(s.isin("CRITICAL", "ERROR", "WARN", "INFO", "SUCCESS"), s).otherwise(default)


def severity_counts(rows: DataFrame, group: str, sev: Column) -> DataFrame:
    """error: CRITICAL and ERROR, warn, info: all others; counted before rows are dropped."""
    return rows.groupBy(group).agg(F.count_if(sev.isin("CRITICAL", "ERROR")).alias("error"), F.count_if(sev == "WARN").alias("warn"), F.count_if(~sev.isin("CRITICAL", "ERROR", "WARN")).alias("info"))


def payload(findings: DataFrame) -> DataFrame:
    """The sink's rows: texts are stripped and empty ones go, severity is normalised, empty optional fields are null, the dimension has a default."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return findings.filter(filled(F.col("finding")).isNotNull()).select(
        *(c for c in findings.columns if c not in ("finding", "severity", "dimension", "suggestion", "violation_id")),
        strip(F.col("finding")).alias("finding"), severity(F.col("severity")).alias("severity"), F.coalesce(blank("dimension"), F.lit("pipeline_consistency")).alias("dimension"),
        blank("suggestion").alias("suggestion"), blank("violation_id").alias("violation_id"),
    )


def unsent(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of payload() but those equal to their repository's latest stored row in run, text, severity and dimension. stored: repo, at, run_id, finding, severity, dimension."""
    same = ["run_id", "finding", "severity", "dimension"]
    last = latest(stored.select("repo", "at", *same), "repo", F.struct("at", *same)).select("repo", strip(F.col("run_id")).alias("run_id"), strip(F.col("finding")).alias("finding"), F.upper("severity").alias("severity"), strip(F.col("dimension")).alias("dimension"))
    return rows.join(last, ["repo", *same], "left_anti")


def deliver(rows: DataFrame, post: Callable[[dict], None], folder: str) -> DataFrame:
    """Posts each row by post(row), which raises where it fails, and writes all rows to folder with `error`, null for those delivered.

    The table is what is read afterwards, so no row is posted twice by reading it again; rows with an error are the
    dead letters. A task that is lost after some posts is run again: the sink drops repeats by unsent().
    """

    def send(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            errors = []
            for row in b.to_pylist():
                try:
                    post(row)
                    errors.append(None)
                except Exception as x:
                    errors.append(str(x) or type(x).__name__)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(errors, pa.string())], names=[*b.schema.names, "error"])

    ship(rows.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", error string"
    rows.mapInArrow(send, schema).write.mode("append").parquet(folder)
    return rows.sparkSession.read.schema(schema).parquet(folder)


def latest(rows: DataFrame, group: str, order: Column) -> DataFrame:
    """The latest row of each group, by partial aggregation."""
    return rows.groupBy(group).agg(F.max_by(F.struct(*(c for c in rows.columns if c != group)), order).alias("x")).select(group, "x.*")


def not_stored(new: DataFrame, stored_latest: DataFrame, group: str, same: list[str]) -> DataFrame:
    """New rows but those equal to their group's latest stored row."""
    return new.join(stored_latest, [group, *same], "left_anti")


def distinct_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key; a window, so that no other column is lost."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("__n = 1").drop("__n")


def soft_rules(rules: DataFrame, checked: DataFrame, excepted: DataFrame) -> DataFrame:
    """Rules for review by a model: of mode llm, neither checked nor excepted (one rule never is reviewed)."""
    done = checked.select("rule_id").union(excepted.select("rule_id")).distinct()
    return rules.filter("check_mode = 'llm' AND rule_id <> 'EVAL-002'").join(done, "rule_id", "left_anti")
