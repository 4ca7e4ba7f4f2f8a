"""Rule archetypes over files, as plans: path probes, token tests, corpus flags, first matches, line logic.

files: repo, path, ext, content. Every function gives one plan for all repositories at once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def missing(repos: DataFrame, files: DataFrame, on: Sequence[str] | Column, found: Column | None = None) -> DataFrame:
    """Path probe: the repos that no file (that is found) belongs to."""
    return repos.join(files if found is None else files.filter(found), on, "left_anti")


def with_root(rows: DataFrame, own: Column, root: Column) -> DataFrame:
    """The app's own value first, then the one of the monorepo's root."""
    return rows.withColumn("value", F.coalesce(own, root)).withColumn("origin", F.when(own.isNotNull(), "own").when(root.isNotNull(), "root").otherwise("none"))


def unpivot_rules(files: DataFrame, keys: Sequence[str], tests: dict[str, Column]) -> DataFrame:
    """One projection of all tests, then a row for each rule that fails: keys, rule_id."""
    flags = F.array(*(F.struct(F.lit(r).alias("rule_id"), t.alias("failed")) for r, t in tests.items()))
    return files.select(*keys, F.explode(flags).alias("x")).filter("x.failed").select(*keys, "x.rule_id")


def signals(text: Column, tokens: Sequence[str]) -> Column:
    """How many tokens stand in text."""
    out = F.lit(0)
    for t in tokens:
        out = out + text.contains(t).cast("int")
    return out.cast("long")


def missing_items(files: DataFrame, keys: Sequence[str], text: Column, required: Sequence[str]) -> DataFrame:
    """A row for each required token that text lacks: keys, item. The list is a literal, so this is a projection."""
    items = F.filter(F.array(*(F.lit(r) for r in required)), lambda x: ~text.contains(x))
    return files.select(*keys, F.explode(items).alias("item"))


def corpus_flags(files: DataFrame, group: Sequence[str], tests: dict[str, Column]) -> DataFrame:
    """Whether any file of a group passes each test; equal to tests on the concatenation for tokens within a line."""
    return files.groupBy(*group).agg(*(F.coalesce(F.bool_or(t), F.lit(False)).alias(n) for n, t in tests.items()))


def missing_list(flags: DataFrame, names: dict[str, str], out: str = "missing") -> DataFrame:
    """The labels of the flags that are false, joined in the order of names."""
    return flags.withColumn(out, F.array_join(F.array_compact(F.array(*(F.when(~F.col(c), F.lit(label)) for c, label in names.items()))), ", "))


def first_of_texts(rows: DataFrame, text: str, order: Column, wanted: Sequence[str]) -> DataFrame:
    """The first row, in order, of each text: grouped by SHA-256, so texts are neither shuffled nor sorted."""
    best = F.min_by(F.struct(*wanted), order).alias("best")
    return rows.groupBy(F.sha2(F.col(text).cast("binary"), 256).alias("mark")).agg(best).select("best.*")


def first_per_group(rows: DataFrame, group: Sequence[str], order: Column, wanted: Sequence[str]) -> DataFrame:
    """The first row of each group in order, by partial aggregation."""
    best = F.min_by(F.struct(*wanted), order).alias("best")
    return rows.groupBy(*group).agg(best).select(*group, "best.*")


def first_marker(text: Column, markers: Sequence[str]) -> Column:
    """The first marker of an ordered list that stands in text, else null."""
    return F.coalesce(*(F.when(text.contains(m), F.lit(m)) for m in markers))


def lines(files: DataFrame, keys: Sequence[str], content: str = "content") -> DataFrame:
    """keys, pos (from 1), line."""
    return files.select(*keys, F.posexplode(F.split(content, "\n")).alias("pos", "line")).withColumn("pos", F.col("pos") + 1)


def runs(files: DataFrame, keys: Sequence[str], content: str, test: Callable[[Column], Column], least: int) -> DataFrame:
    """Runs of at least `least` consecutive lines that pass the test: keys, first_line, n.

    All of a file is in its row, so its lines become marks, a character each, and runs are matches in that text: no
    line is a row and nothing is shuffled.
    """
    marks = F.array_join(F.transform(F.split(content, "\n"), lambda x: F.when(test(x), "x").otherwise(".")), "")
    found = F.regexp_extract_all(F.regexp_replace(marks, f"(x{{{least},}})", "$1|"), F.lit(r"[x.]*\|"), F.lit(0))
    at = files.select(*keys, found.alias("parts"))
    # each part ends with a run and a bar; its place is the length of the parts before it
    place = F.transform("parts", lambda p, i: F.struct(F.aggregate(F.slice("parts", F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + F.length(x) - 1).alias("before"), p.alias("part")))
    part = at.select(*keys, F.explode(place).alias("p"))
    n = F.length(F.regexp_extract("p.part", r"(x+)\|$", 1)).cast("long")
    return part.select(*keys, (F.col("p.before") + F.length("p.part") - n).alias("first_line"), n.alias("n"))


def after_state(files: DataFrame, keys: Sequence[str], content: str, kind: Callable[[Column], Column], skip: str, wanted: str, but: str) -> DataFrame:
    """keys, pos (from 1) of the lines of kind `wanted` whose last line before, those of kind `skip` left out, is not of kind `but`.

    kind gives one character a line. A file is in its row: the state is a look back in the text of its lines' kinds.
    """
    kinds = F.array_join(F.transform(F.split(content, "\n"), kind), "")
    bare = files.select(*keys, kinds.alias("kinds"))
    # a line after `but` and any skipped ones is marked in lower case
    marked = F.regexp_replace("kinds", f"({but}{skip}*+){wanted}", f"$1{wanted.lower()}")
    out = bare.select(*keys, F.posexplode(F.split(marked, "")).alias("pos", "k")).filter(F.col("k") == wanted)
    return out.select(*keys, (F.col("pos") + 1).cast("long").alias("pos"))


def top_list(rows: DataFrame, group: Sequence[str], value: Column, k: int) -> DataFrame:
    """Per group: how many distinct values, and the first k in order, joined.

    Distinct values are shuffled once, by group and value; the first k of each are found by a ranked window, of which
    Spark keeps k rows a task before it sorts a group.
    """
    single = rows.select(*group, value.alias("v")).filter("v IS NOT NULL").distinct()
    first = single.withColumn("at", F.row_number().over(Window.partitionBy(*group).orderBy("v"))).filter(F.col("at") <= k)
    heads = first.groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"].cast("string")), ", ").alias("first"))
    counts = single.groupBy(*group).agg(F.count("*").alias("n"))
    return counts.join(heads, list(group)).select(*group, "n", "first")


def pinned(version: Column) -> Column:
    """An exact pin: not empty, `*`, `latest`, a range prefix or an x-range."""
    v = F.regexp_replace(F.trim(version), "^[\"']+|[\"']+$", "")
    return ~(v.isin("", "*", "latest") | v.rlike(r"^[\^~><]") | v.rlike(r"\d+\.[xX](\D|$)"))


def age_days(at: Column, now: Column) -> Column:
    """Whole days between two times."""
    return F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / F.lit(86_400_000_000)).cast("long")
