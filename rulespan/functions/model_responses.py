"""Findings from a language model's answers, as expressions on a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip

#: Keys that may hold a finding's text, in order, and the text where none does.
TEXT_KEYS = ("finding", "message", "description", "detail", "text")
NO_TEXT = "No finding text returned by evaluator."


def body(raw: Column) -> Column:
    """What is within the first fence, wherever it stands, in any case of its mark; the whole text without one."""
    found = F.regexp_extract(raw, r"(?is)```(?:json)?\s*(.*?)\s*```", 1)
    return F.when(F.regexp_like(raw, F.lit(r"(?is)```(?:json)?\s*(.*?)\s*```")), strip(found)).otherwise(strip(raw))


def items(raw: Column) -> Column:
    """The objects of the list `findings`, or of the list that is the whole answer; null where there is no such JSON."""
    answer = F.try_parse_json(body(raw))
    whole = F.schema_of_variant(answer)
    inner = F.when(whole.startswith("OBJECT"), F.try_variant_get(answer, "$.findings", "array<variant>")).when(whole.startswith("ARRAY"), F.try_variant_get(answer, "$", "array<variant>"))
    return F.filter(inner, lambda x: F.schema_of_variant(x).startswith("OBJECT"))


def value(item: Column, key: str) -> Column:
    """The value under key as text; null where it is absent, null, empty, false or zero."""
    text = F.try_variant_get(item, f"$.{key}", "string")
    kind = F.schema_of_variant(F.try_variant_get(item, f"$.{key}", "variant"))
    nothing = (text == "") | ((kind == "BOOLEAN") & (text == "false")) | (kind.rlike("^(BIGINT|DECIMAL|DOUBLE)") & text.rlike(r"^-?0+(\.0+)?$"))
    return F.when(~nothing, text)


def normalised(item: Column) -> Column:
    """finding, rule_id, violation_id, severity, dimension, suggestion of an object. A violation id that is there stays, even if empty; else it is the rule's."""
    finding = F.coalesce(*(value(item, k) for k in TEXT_KEYS), F.lit(NO_TEXT))
    rule = value(item, "rule_id")
    given = F.try_variant_get(item, "$.violation_id", "variant").isNotNull()
    own = F.when(given, F.try_variant_get(item, "$.violation_id", "string")).otherwise(rule)
    more = [value(item, k).alias(k) for k in ("severity", "dimension", "suggestion")]
    return F.struct(finding.alias("finding"), rule.alias("rule_id"), own.alias("violation_id"), *more)


def parsed(answers: DataFrame, raw: str, *keys: str) -> DataFrame:
    """keys, i (place in the answer's list of objects, from 0) and the columns of normalised(); answers without findings give no rows."""
    rows = answers.select(*keys, F.posexplode(items(F.col(raw))).alias("i", "item"))
    return rows.select(*keys, "i", normalised(F.col("item")).alias("x")).select(*keys, "i", "x.*")
