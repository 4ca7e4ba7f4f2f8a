"""A repository's own configuration file, and what stands in for it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ship import ship
from .text import filled, strip

REASONED = "array<struct<rule:string,reason:string>>"
_CONFIG = f"repo string, ok boolean, problem string, type string, traits array<string>, unknown_traits array<string>, exemptions {REASONED}, deferrals {REASONED}"
_PAIRS = pa.list_(pa.struct([("rule", pa.string()), ("reason", pa.string())]))
_OUT = pa.schema([("repo", pa.string()), ("ok", pa.bool_()), ("problem", pa.string()), ("type", pa.string()), ("traits", pa.list_(pa.string())), ("unknown_traits", pa.list_(pa.string())), ("exemptions", _PAIRS), ("deferrals", _PAIRS)])


def _word(x: object) -> str:
    return "" if x is None else str(x).strip()


def _entries(listed: object) -> list[dict]:
    """rule and reason of the mappings in a list; entries of other kinds, and those without a rule, do not count."""
    named = [(_word(x.get("rule", "")), _word(x.get("reason", ""))) for x in (listed or []) if isinstance(x, dict)]
    return [{"rule": r, "reason": why or None} for r, why in named if r]


def read_config(text: str, types: tuple[str, ...], traits: tuple[str, ...]) -> dict:
    """The fields of one file; raises where it is no mapping of a valid type."""
    import yaml

    data = yaml.safe_load(text) or {}
    kind = _word(data.get("type", ""))
    if kind not in types:
        raise ValueError(f"invalid type {kind!r}")
    named = [_word(t) for t in data.get("traits") or []]
    return {
        "type": kind, "traits": [t for t in named if t in traits], "unknown_traits": [t for t in named if t not in traits],
        "exemptions": _entries(data.get("exemptions")), "deferrals": _entries(data.get("deferrals")),
    }


def config_rows(files: DataFrame, types: tuple[str, ...], traits: tuple[str, ...]) -> DataFrame:
    """A row for each configuration file (repo, content): ok and its fields, or the problem. A bad file never ends a run."""

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            rows = []
            for repo, text in zip(b.column("repo").to_pylist(), b.column("content").to_pylist()):
                row = dict.fromkeys(_OUT.names) | {"repo": repo, "ok": True}
                try:
                    row |= read_config(text or "", types, traits)
                except Exception as x:
                    row |= {"ok": False, "problem": str(x) or type(x).__name__}
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=_OUT)

    ship(files.sparkSession)
    return files.select("repo", "content").mapInArrow(read, _CONFIG)


def exception_entries(raw: Column) -> Column:
    """rule and reason of a service's exceptions, array<struct<line, rule, reason>>: a line as it is up to `#`, or the fields of a mapping."""
    entry = lambda x: F.struct(F.coalesce(filled(F.split(x["line"], "#")[0]), filled(x["rule"])).alias("rule"), F.when(x["line"].isNull(), filled(x["reason"])).alias("reason"))
    return F.filter(F.transform(F.coalesce(raw, F.array().cast("array<struct<line:string,rule:string,reason:string>>")), entry), lambda x: x["rule"].isNotNull())


def configured(services: DataFrame, configs: DataFrame, valid: Column) -> DataFrame:
    """Services with repo_type, traits, exemptions, deferrals and config_source: their own file's if it is there and good, else by the service's older type name and exceptions.

    services: repo, type, exceptions (as exception_entries takes them), ...; valid: the type that stands in, from `type`.
    """
    own = configs.filter("ok").select("repo", F.col("type").alias("own_type"), *(F.col(c).alias(f"own_{c}") for c in ("traits", "exemptions", "deferrals")))
    rows = services.join(own, "repo", "left")
    has = F.col("own_type").isNotNull()
    empty = lambda kind: F.array().cast(kind)
    pick = lambda c, other: F.when(has, F.col(f"own_{c}")).otherwise(other).alias(c)
    kept = [c for c in services.columns if c not in ("type", "exceptions")]
    return rows.select(
        *kept, F.when(has, F.col("own_type")).otherwise(valid).alias("repo_type"), pick("traits", empty("array<string>")), pick("exemptions", exception_entries(F.col("exceptions")).cast(REASONED)),
        pick("deferrals", empty(REASONED)), F.when(has, "file").otherwise("service").alias("config_source"),
    )


#: The domains of rules, in order.
DOMAINS = ("python", "testing", "api", "pipeline", "frontend", "delivery", "documentation", "evaluation", "principles", "cross-stack", "monorepo", "meta")


def rules_of_services(services: DataFrame, rules: DataFrame, check_mode: Column) -> DataFrame:
    """repo, rule_id, title, severity, check_notes, check_mode of the checkable rules that apply to each service.

    services: repo, repo_type, dod_type; rules: domain, rule_id, title, severity, check_notes, checkable, applies_to.
    A rule applies to all, to the type, or to the older dod type. The join is on the exploded names.
    """
    numbered = rules.filter(F.col("checkable") & F.col("domain").isin(*DOMAINS)).withColumn("nth", F.monotonically_increasing_id())
    listed = numbered.select(
        F.coalesce("rule_id", F.lit("")).alias("rule_id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("severity", F.lit("INFO")).alias("severity"), strip(F.coalesce("check_notes", F.lit(""))).alias("check_notes"),
        check_mode.alias("check_mode"), "nth", F.explode(F.array_distinct("applies_to")).alias("kind"),
    )
    kinds = services.select("repo", F.explode(F.array_compact(F.array_distinct(F.array(F.lit("all"), "repo_type", "dod_type")))).alias("kind"))
    return kinds.join(listed, "kind").drop("kind").distinct().drop("nth")
