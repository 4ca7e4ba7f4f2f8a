"""Texts that ask a language model about runs and repositories: lines from tables in a template.

The wording is a parameter (the templates here are our own); what a text is made of, its order, its limits and what
stands where there is nothing follow the rules of the evaluation.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Paths listed of a repository, characters shown of its README, the rule that no model assesses.
PATHS, README_CHARS, NEVER = 60, 4000, "EVAL-002"

CSV_RUN = """Review run {run_id} of a CSV import under standards v{standards_version}.
Files met {sets_attempted}, imported {sets_imported}, failed {sets_failed}, moved {sets_skipped}, of unknown names {unrecognized_filename_skips}, possible duplicates {duplicate_csv_count}, tracks {total_tracks}.
Failed sets: {failed_set_labels}
All ingest calls succeeded: {api_ingest_success}
"""

COLLECTION_RUN = """Review run {run_id} of a collection update under standards v{standards_version}.
Folders {folders_processed}, tabs {tabs_written}, sets {total_sets}, snapshot written: {json_snapshot_written}, year {current_year}.
Folders: {folder_names}
"""

CONFORMANCE = """Review repository {repo} ({repo_type}, {language}) under standards v{standards_version}.
Excepted rules:
{exceptions}
Files:
{inventory}
README.md:
{readme}
Rules of this type:
{rules}
Findings so far:
{findings}
Assess these rules only:
{soft}
Leave these alone:
{resolved}
"""


def fill(template: str, **values: Column) -> Column:
    """The template with each {name} replaced by its value as text; null is empty. A name without a value raises KeyError."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(F.coalesce(values[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)))


def named(names: Column) -> Column:
    """An array of names in one line; `(none)` if it is empty or null."""
    return F.when(F.size(names) > 0, F.array_join(names, ", ")).otherwise("(none)")


def run_prompts(runs: DataFrame, template: str) -> Column:
    """The prompt of each run from the columns that the template names; arrays are listed by named()."""
    arrays = {n for n, t in runs.dtypes if t.startswith("array")}
    return fill(template, **{n: named(F.col(n)) if n in arrays else F.col(n) for n in runs.columns})


def inventory(files: DataFrame, most: int = PATHS) -> DataFrame:
    """repo, seq, line: the first paths of each repository and how many follow. Paths with a hidden part, __pycache__ or node_modules don't count.

    files: repo, path. Only `most` paths of a repository meet in a task: the window's limit is applied before its shuffle.
    """
    seen = files.filter(~F.col("path").rlike(r"(^|/)(\.|(__pycache__|node_modules)(/|$))")).select("repo", "path")
    first = seen.withColumn("seq", F.row_number().over(Window.partitionBy("repo").orderBy("path")).cast("long")).filter(F.col("seq") <= most)
    rest = seen.groupBy("repo").agg(F.count("*").alias("n")).filter(F.col("n") > most)
    more = rest.select("repo", F.lit(most + 1).cast("long").alias("seq"), F.format_string("  ... (%d more files)", F.col("n") - most).alias("line"))
    return first.select("repo", "seq", F.concat(F.lit("  "), "path").alias("line")).union(more)


def readme(files: DataFrame, most: int = README_CHARS) -> DataFrame:
    """repo, seq, line: the README in a repository's root, its first characters and a mark if it is longer. files: repo, path, content."""
    cut = F.when(F.length("content") > most, F.concat(F.substring("content", 1, most), F.lit("\n...(truncated)"))).otherwise(F.col("content"))
    return files.filter("path = 'README.md'").select("repo", F.lit(0).cast("long").alias("seq"), cut.alias("line"))


def conformance_prompts(repos: DataFrame, rules: DataFrame, findings: DataFrame, checked: DataFrame, skips: DataFrame, files: DataFrame, template: str = CONFORMANCE) -> DataFrame:
    """repo, prompt: one row for each row of repos, whose columns the template may name beside the blocks.

    rules: repo, seq, rule_id, severity, title, check_notes, check_mode; findings: repo, seq, rule_id, severity, finding;
    checked: repo, rule_id; skips: repo, seq, rule_id, reason; files: repo, path, content. A rule is to be assessed if
    its mode is llm and it is neither resolved (checked, found, or NEVER) nor skipped. Lines are in the order of seq,
    ties by their text. A prompt is one text, so a repository's lines meet in one row; files enter by path alone but
    for the README. Empty blocks say so; an empty table of repos gives no rows.
    """
    done = checked.select("repo", "rule_id").union(findings.filter("NOT rule_id <=> 'CHECKER'").select("repo", F.coalesce("rule_id", F.lit("")).alias("rule_id")))
    done = done.union(repos.select("repo", F.lit(NEVER).alias("rule_id"))).distinct()
    out = skips.select("repo", "rule_id").union(done).distinct()
    soft = rules.filter("check_mode = 'llm'").join(out, ["repo", "rule_id"], "left_anti")
    asked = F.format_string("- %s [%s]: %s\n  How to check: %s", "rule_id", "severity", "title", F.coalesce("check_notes", F.lit("")))
    given = F.format_string("- [%s] %s: %s", F.coalesce("severity", F.lit("INFO")), F.coalesce("rule_id", F.lit("?")), F.coalesce("finding", F.lit("")))
    why = F.concat(F.lit("  - "), "rule_id", F.coalesce(F.concat(F.lit(": "), F.nullif("reason", F.lit(""))), F.lit("")))
    seq = F.col("seq").cast("long").alias("seq")
    #: block: its rows, its line, what stands there without one
    blocks = {
        "rules": (rules.filter("check_notes <> ''").select("repo", seq, asked.alias("line")), "(none)"),
        "findings": (findings.select("repo", seq, given.alias("line")), "(none)"),
        "soft": (soft.select("repo", seq, asked.alias("line")), "(none: all rules are covered by checks)"),
        "exceptions": (skips.select("repo", seq, why.alias("line")), "  (none)"),
        "resolved": (done.select("repo", F.lit(0).cast("long").alias("seq"), F.concat(F.lit("  - "), "rule_id").alias("line")), "  (none)"),
        "inventory": (inventory(files), ""),
        "readme": (readme(files), ""),
    }
    rows = reduce(DataFrame.union, (df.select("repo", F.lit(b).alias("block"), "seq", "line") for b, (df, _) in blocks.items()))
    lines = lambda b: F.transform(F.sort_array(F.collect_list(F.when(F.col("block") == b, F.struct("seq", "line")))), lambda x: x["line"])
    texts = rows.groupBy("repo").agg(*(F.array_join(lines(b), "\n").alias(f"__{b}") for b in blocks))
    filled = {b: F.coalesce(F.nullif(F.col(f"__{b}"), F.lit("")), F.lit(none)) for b, (_, none) in blocks.items()}
    return repos.join(texts, "repo", "left").select("repo", fill(template, **{n: F.col(n) for n in repos.columns}, **filled).alias("prompt"))
