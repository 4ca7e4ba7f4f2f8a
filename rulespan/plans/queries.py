"""Each reference operator as a query on the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import model_responses as mr
from ..functions import prompts as ask
from ..functions import repo_config as rc
from ..functions.store import shared_dir
from ..operators import findings as fd
from ..operators import probes as pr
from ..streaming import events as ev

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """t.documents and so on: the tables of a folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def values(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)


def query(sql: str | None):
    def put(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


c, lit = F.col, F.lit
big = lambda x: x.cast("long")


# --- path probes ------------------------------------------------------------------------------------------------


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def q_p1_missing_label(t):
    return pr.missing(t.documents.select("doc_id", "source"), t.labels.select("doc_id"), ["doc_id"])


@query("SELECT n_nationkey, coalesce(s.v, r.r_name) AS value, CASE WHEN s.v IS NOT NULL THEN 'own' WHEN r.r_name IS NOT NULL THEN 'root' ELSE 'none' END AS origin FROM nation LEFT JOIN (SELECT s_nationkey, min(s_name) v FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s ON s_nationkey = n_nationkey LEFT JOIN region r ON r_regionkey = n_regionkey AND r_name <> 'ASIA'")
def q_p1_root_fallback(t):
    own = t.supplier.filter("s_acctbal > 5000").groupBy("s_nationkey").agg(F.min("s_name").alias("v"))
    rows = t.nation.join(own, c("s_nationkey") == c("n_nationkey"), "left").join(t.region.filter("r_name <> 'ASIA'"), c("r_regionkey") == c("n_regionkey"), "left")
    return pr.with_root(rows, c("v"), c("r_name")).select("n_nationkey", "value", "origin")


@query("SELECT DISTINCT p_type FROM part p WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_type = p.p_type AND q.p_brand IN ('Brand#1', 'Brand#2') AND q.p_size < 3)")
def q_p1_candidates_any(t):
    return pr.missing(t.part.select("p_type").distinct(), t.part.filter("p_size < 3"), ["p_type"], c("p_brand").isin("Brand#1", "Brand#2")).select("p_type")


# --- tokens -----------------------------------------------------------------------------------------------------


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND NOT contains(text, 'License')")
def q_p2_contains_gate(t):
    return t.documents.filter((c("lang") == "en") & ~c("text").contains("License")).select("doc_id")


@query("SELECT doc_id, 'T-1' AS rule_id FROM documents WHERE NOT contains(text, ',') UNION ALL SELECT doc_id, 'T-2' FROM documents WHERE n_chars < 200 UNION ALL SELECT doc_id, 'T-3' FROM documents WHERE contains(text, '###')")
def q_p2_multi_rule_unpivot(t):
    return pr.unpivot_rules(t.documents, ["doc_id"], {"T-1": ~c("text").contains(","), "T-2": c("n_chars") < 200, "T-3": c("text").contains("###")})


@query("SELECT doc_id, n FROM (SELECT doc_id, CAST(contains(lower(text), 'the ') AS BIGINT) + CAST(contains(lower(text), 'license') AS BIGINT) + CAST(contains(lower(text), 'token') AS BIGINT) AS n FROM documents) WHERE n < 2")
def q_p2_signal_count(t):
    return t.documents.select("doc_id", pr.signals(F.lower("text"), ["the ", "license", "token"]).alias("n")).filter("n < 2")


@query("SELECT doc_id, item FROM documents, (VALUES ('License'), ('the '), ('.')) v(item) WHERE NOT contains(text, item)")
def q_p2_missing_items(t):
    return pr.missing_items(t.documents, ["doc_id"], c("text"), ["License", "the ", "."])


@query("SELECT source, coalesce(bool_or(contains(text, 'License')), false) AS license, coalesce(bool_or(contains(text, 'token')), false) AS token, coalesce(bool_or(contains(text, 'AKIA')), false) AS access FROM documents GROUP BY source")
def q_p3_corpus_flags(t):
    return pr.corpus_flags(t.documents, ["source"], {n: c("text").contains(x) for n, x in (("license", "License"), ("token", "token"), ("access", "AKIA"))})


@query("SELECT source, array_to_string(list_filter([CASE WHEN NOT bool_or(contains(text, 'GNU')) THEN 'gnu' END, CASE WHEN NOT bool_or(contains(text, 'AKIA')) THEN 'access' END, CASE WHEN NOT bool_or(contains(text, 'CC BY')) THEN 'cc' END], lambda x: x IS NOT NULL), ', ') AS missing FROM documents GROUP BY source")
def q_p3_missing_list(t):
    flags = pr.corpus_flags(t.documents, ["source"], {"g": c("text").contains("GNU"), "a": c("text").contains("AKIA"), "k": c("text").contains("CC BY")})
    return pr.missing_list(flags, {"g": "gnu", "a": "access", "k": "cc"}).select("source", "missing")


@query("""SELECT doc_id FROM documents WHERE regexp_matches(text, 'token\\s*=\\s*"[0-9a-f]{40}"|AKIA[0-9A-Z]{16}')""")
def q_p4_secret_scan(t):
    return t.documents.filter(c("text").rlike(r'token\s*=\s*"[0-9a-f]{40}"|AKIA[0-9A-Z]{16}')).select("doc_id")


@query("SELECT source, doc_id, n_chars FROM documents WHERE contains(text, 'License') QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1")
def q_p4_first_per_repo(t):
    return pr.first_per_group(t.documents.filter(c("text").contains("License")), ["source"], c("doc_id"), ["doc_id", "n_chars"])


@query("SELECT doc_id, 'dup' AS hit FROM documents WHERE contains(text, '###') UNION ALL SELECT doc_id, 'pipe' FROM documents WHERE contains(text, '|') UNION ALL SELECT doc_id, 'license' FROM documents WHERE contains(text, 'License') AND contains(text, 'MIT')")
def q_p4_independent_preds(t):
    return pr.unpivot_rules(t.documents, ["doc_id"], {"dup": c("text").contains("###"), "pipe": c("text").contains("|"), "license": c("text").contains("License") & c("text").contains("MIT")}).withColumnRenamed("rule_id", "hit")


@query("SELECT doc_id, CASE WHEN NOT contains(text, '.') THEN 'no sentence' WHEN n_chars < 300 THEN 'short' WHEN contains(text, '###') THEN 'marks' ELSE 'ok' END AS state FROM documents")
def q_case_short_circuit(t):
    return t.documents.select("doc_id", F.when(~c("text").contains("."), "no sentence").when(c("n_chars") < 300, "short").when(c("text").contains("###"), "marks").otherwise("ok").alias("state"))


@query("SELECT doc_id, arg_min(m, o) AS marker FROM documents, (VALUES (1, 'Apache'), (2, 'MIT'), (3, 'GNU'), (4, 'CC BY')) v(o, m) WHERE contains(text, m) GROUP BY doc_id")
def q_first_marker(t):
    return t.documents.select("doc_id", pr.first_marker(c("text"), ["Apache", "MIT", "GNU", "CC BY"]).alias("marker")).filter("marker IS NOT NULL")


# --- patterns and markup ----------------------------------------------------------------------------------------

_HREFS = "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS href FROM pages"


def _hrefs(t):
    return t.pages.select("page_id", F.explode(F.regexp_extract_all("html", lit(r'href="([^"]+)"'), lit(1))).alias("href"))


@query(_HREFS)
def q_regex_explode(t):
    return _hrefs(t)


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)<script[\\s\\S]*?</script>')) AS BIGINT) AS scripts, CAST(length(array_to_string(regexp_extract_all(html, '(?i)<script[^>]*>([\\s\\S]*?)</script>', 1), '')) AS BIGINT) AS chars FROM pages")
def q_html_scripts(t):
    bodies = F.regexp_extract_all("html", lit(r"(?is)<script[^>]*>(.*?)</script>"), lit(1))
    return t.pages.select("page_id", big(F.size(F.regexp_extract_all("html", lit(r"(?is)<script.*?</script>"), lit(0)))).alias("scripts"), big(F.length(F.array_join(bodies, ""))).alias("chars"))


@query(f"WITH h AS ({_HREFS}) SELECT DISTINCT page_id, href FROM h WHERE href IN (SELECT href FROM h GROUP BY href HAVING count(DISTINCT page_id) > 1)")
def q_semi_shared_url(t):
    """Links that another page has too."""
    h = _hrefs(t).distinct()
    return h.join(h.groupBy("href").agg(F.count("*").alias("n")).filter("n > 1"), "href", "left_semi").select("page_id", "href")


@query(f"WITH h AS ({_HREFS}), d AS (SELECT DISTINCT unnest(string_split_regex(text, '\\s+')) AS w FROM benchmark) SELECT DISTINCT href FROM h WHERE NOT EXISTS (SELECT 1 FROM d WHERE w = ltrim(href, '/'))")
def q_anti_undocumented(t):
    """Links whose target no text names as a word: words of texts are joined, no text is searched for each link."""
    words = t.benchmark.select(F.explode(F.split("text", r"\s+")).alias("w")).distinct()
    return _hrefs(t).select("href").distinct().join(words, F.expr("ltrim('/', href)") == c("w"), "left_anti")


# --- lines ------------------------------------------------------------------------------------------------------


@query("SELECT source, sum(len(string_split(text, chr(10))))::BIGINT AS loc FROM documents GROUP BY source HAVING sum(len(string_split(text, chr(10)))) >= 50")
def q_loc_threshold(t):
    return t.documents.groupBy("source").agg(F.sum(big(F.size(F.split("text", "\n")))).alias("loc")).filter("loc >= 50")


_LINES = "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)"


@query(_LINES + ", h AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM l WHERE length(line) < 60) SELECT doc_id, min(pos)::BIGINT AS first_line, count(*) AS n FROM h GROUP BY doc_id, island HAVING count(*) >= 3")
def q_comment_runs(t):
    return pr.runs(t.documents, ["doc_id"], "text", lambda x: F.length(x) < 60, 3)


@query(_LINES + ", k AS (SELECT *, CASE WHEN contains(line, 'License') THEN 'M' WHEN length(line) < 40 THEN 'C' WHEN length(line) < 90 THEN 'B' ELSE 'K' END AS kind FROM l), s AS (SELECT *, last_value(CASE WHEN kind <> 'C' THEN kind END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM k) SELECT doc_id, pos::BIGINT AS pos FROM s WHERE kind = 'K' AND prev IS DISTINCT FROM 'M'")
def q_line_state(t):
    kind = lambda x: F.when(x.contains("License"), "M").when(F.length(x) < 40, "C").when(F.length(x) < 90, "B").otherwise("K")
    return pr.after_state(t.documents, ["doc_id"], "text", kind, "C", "K", "M")


# --- sets and lists ---------------------------------------------------------------------------------------------


@query("SELECT DISTINCT user_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id AND c_acctbal > 0)")
def q_kv_anti(t):
    return t.events.select("user_id").distinct().join(t.customer.filter("c_acctbal > 0"), c("user_id") == c("c_custkey"), "left_anti")


@query("SELECT o_orderpriority, count(DISTINCT o_orderkey) AS n, array_to_string(list_sort(list(DISTINCT lpad(o_orderkey::VARCHAR, 9, '0')))[1:5], ', ') AS first FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) GROUP BY 1")
def q_sample_topk_list(t):
    alone = t.orders.join(t.lineitem.select("l_orderkey"), c("l_orderkey") == c("o_orderkey"), "left_anti")
    return pr.top_list(alone, ["o_orderpriority"], F.lpad(c("o_orderkey").cast("string"), 9, "0"), 5)


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def q_json_props(t):
    return t.events.select("event_id", F.from_json("props", "k long").getField("k").alias("k")).filter("k IS NOT NULL")


_VERSIONS = ["^1.{}.0", "~2.{}", "3.{}.x", "{}.X", "latest", ">={}", "*", "", "1.{}.3", "=1.{}", "{}", "workspace:*", " 4.{}.6 "]
_LIST = "[" + ", ".join(f"'{v}'" for v in _VERSIONS) + "]"


@query(f"SELECT p_partkey, v, NOT (trim(v) IN ('', '*', 'latest') OR regexp_matches(trim(v), '^[\\^~><]') OR regexp_matches(trim(v), '\\d+\\.[xX](\\D|$)')) AS pinned FROM (SELECT p_partkey, replace({_LIST}[CAST(p_partkey % 13 AS INT) + 1], '{{}}', CAST(p_size AS VARCHAR)) AS v FROM part)")
def q_pin_classify(t):
    v = F.replace(F.element_at(F.array(*map(lit, _VERSIONS)), (c("p_partkey") % 13 + 1).cast("int")), lit("{}"), c("p_size").cast("string"))
    return t.part.select("p_partkey", v.alias("v")).select("p_partkey", "v", pr.pinned(c("v")).alias("pinned"))


@query("SELECT o_orderkey, days FROM (SELECT o_orderkey, floor((epoch_us(TIMESTAMP '1999-01-01 12:00:00') - epoch_us(o_orderdate)) / 86400000000.0)::BIGINT AS days FROM orders) WHERE days > 90")
def q_age_days(t):
    return t.orders.select("o_orderkey", pr.age_days(c("o_orderdate"), F.to_timestamp(lit("1999-01-01 12:00:00"))).alias("days")).filter("days > 90")


# --- routing, applicability, exemption --------------------------------------------------------------------------

_NOTES = [("A", "LLM CHECK. Read it"), ("B", "  llm check . x"), ("C", "DETERMINISTIC CHECK. y"), ("D", "first line\nLLM CHECK."), ("E", ""), ("F", None), ("G", "LLM  CHECK."), ("H", "LLMCHECK."), ("I", "\n\nLLM CHECK. z")]
_text = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"


def _values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(_text(v) if isinstance(v, str) or v is None else str(v) for v in r) + ")" for r in rows) + ")"


@query("WITH n AS (SELECT * FROM " + _values(_NOTES) + " x(rule_id, notes) UNION ALL SELECT 'b' || item_id, CASE WHEN item_id % 3 = 0 THEN 'LLM CHECK. ' || text ELSE text END FROM benchmark) SELECT rule_id, CASE WHEN regexp_matches(string_split(regexp_replace(coalesce(notes, ''), '^\\s+', ''), chr(10))[1], '(?i)^\\s*LLM\\s+CHECK\\s*\\.') THEN 'llm' ELSE 'deterministic' END AS check_mode FROM n")
def q_routing_mode(t):
    own = t.values(_NOTES, "rule_id string, notes string")
    more = t.benchmark.select(F.concat(lit("b"), c("item_id").cast("string")).alias("rule_id"), F.when(c("item_id") % 3 == 0, F.concat(lit("LLM CHECK. "), c("text"))).otherwise(c("text")).alias("notes"))
    return own.union(more).select("rule_id", fd.check_mode(c("notes")).alias("check_mode"))


@query("SELECT n_nationkey, rule_id FROM nation JOIN region ON n_regionkey = r_regionkey, (VALUES ('R1', ['all']), ('R2', ['ASIA', 'EUROPE']), ('R3', ['NATION_3']), ('R4', ['none'])) r(rule_id, applies_to) WHERE list_contains(applies_to, 'all') OR list_contains(applies_to, r_name) OR list_contains(applies_to, n_name)")
def q_applies_to(t):
    rules = t.values([("R1", ["all"]), ("R2", ["ASIA", "EUROPE"]), ("R3", ["NATION_3"]), ("R4", ["none"])], "rule_id string, applies_to array<string>")
    services = t.nation.join(t.region, c("n_regionkey") == c("r_regionkey"))
    kinds = services.select("n_nationkey", F.explode(F.array(lit("all"), "r_name", "n_name")).alias("kind"))
    return kinds.join(rules.select("rule_id", F.explode("applies_to").alias("kind")), "kind").select("n_nationkey", "rule_id").distinct()


@query("SELECT doc_id, rule, reason FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN nullif(trim(string_split('R-' || n_chars || chr(9) || ' # ' || coalesce(source, ''), '#')[1], ' ' || chr(9)), '') WHEN 1 THEN nullif(trim(string_split('# ' || coalesce(lang, ''), '#')[1]), '') WHEN 2 THEN 'R-' || n_chars END AS rule, CASE WHEN doc_id % 4 = 2 THEN nullif(trim(lang), '') END AS reason FROM documents) WHERE rule IS NOT NULL")
def q_exceptions_parse(t):
    """Lines with comments, comments alone, mappings with a reason, and mappings without a rule."""
    form = c("doc_id") % 4
    line = F.when(form == 0, F.concat(lit("R-"), c("n_chars").cast("string"), lit("\t # "), F.coalesce("source", lit("")))).when(form == 1, F.concat(lit("# "), F.coalesce("lang", lit(""))))
    entry = F.struct(line.alias("line"), F.when(form == 2, F.concat(lit(" R-"), c("n_chars").cast("string"))).when(form == 3, lit(" ")).alias("rule"), F.concat(c("lang"), lit(" \n")).alias("reason"))
    return t.documents.select("doc_id", F.explode(rc.exception_entries(F.array(entry))).alias("x")).select("doc_id", "x.*")


_BY_TYPE, _BY_TRAIT = [("BUILDING", "CD-001"), ("BUILDING", "CD-002"), ("MACHINERY", "FE-001")], [(3, "CD-002"), (3, "API-007"), (7, "FE-001")]


@query(f"SELECT c_custkey AS repo, rule_id FROM customer JOIN {_values(_BY_TYPE)} a(kind, rule_id) ON kind = c_mktsegment UNION SELECT c_custkey, rule_id FROM customer JOIN {_values(_BY_TRAIT)} b(trait, rule_id) ON trait = c_nationkey UNION SELECT c_custkey, 'DOC-001' FROM customer WHERE c_acctbal < 0")
def q_skip_union(t):
    a = t.customer.join(t.values(_BY_TYPE, "c_mktsegment string, rule_id string"), "c_mktsegment")
    b = t.customer.join(t.values(_BY_TRAIT, "c_nationkey int, rule_id string"), "c_nationkey")
    own = t.customer.filter("c_acctbal < 0").select("c_custkey", lit("DOC-001").alias("rule_id"))
    return a.select("c_custkey", "rule_id").union(b.select("c_custkey", "rule_id")).union(own).distinct().withColumnRenamed("c_custkey", "repo")


_DOC_FINDINGS = "(SELECT doc_id AS repo, 'T-' || (doc_id % 3) AS rule_id, 'ERROR' AS severity, 'short text' AS finding FROM documents WHERE n_chars < 1500)"


def _doc_findings(t):
    return t.documents.filter("n_chars < 1500").select(c("doc_id").alias("repo"), F.concat(lit("T-"), (c("doc_id") % 3).cast("string")).alias("rule_id"), lit("ERROR").alias("severity"), lit("short text").alias("finding"))


@query(f"WITH f AS {_DOC_FINDINGS}, s AS (SELECT doc_id AS repo, 'T-1' AS rule_id, CASE WHEN quality = 0 THEN 'low' END AS reason FROM labels) SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.repo = f.repo AND s.rule_id = f.rule_id) UNION ALL SELECT repo, rule_id, 'INFO', 'Skipped: ' || reason FROM s WHERE reason IS NOT NULL")
def q_exempt_skip_rows(t):
    skips = t.labels.select(c("doc_id").alias("repo"), lit("T-1").alias("rule_id"), F.when(c("quality") == 0, "low").alias("reason"))
    return fd.apply_exemptions(_doc_findings(t), skips)


@query(f"WITH f AS {_DOC_FINDINGS} SELECT f.repo, f.rule_id, CASE WHEN l.doc_id IS NOT NULL THEN 'INFO' ELSE severity END AS severity, finding, l.doc_id IS NOT NULL AS deferred FROM f LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) l ON l.doc_id = f.repo AND f.rule_id = 'T-2'")
def q_deferral_downgrade(t):
    return fd.apply_deferrals(_doc_findings(t), t.labels.filter("toxic = 1").select(c("doc_id").alias("repo"), lit("T-2").alias("rule_id")))


@query("SELECT event_id, user_id, event_type FROM events e WHERE NOT (event_type IN ('click', 'view') AND EXISTS (SELECT 1 FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase'))")
def q_supersession(t):
    return fd.supersede(t.events.select("event_id", "user_id", "event_type"), "user_id", "event_type", (("purchase", "click"), ("purchase", "view")))


@query("""WITH f AS (SELECT n_regionkey AS grp, n_name AS member, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS pos, n_nationkey FROM nation),
g AS (SELECT DISTINCT grp, member, pos, 'R-' || (s_suppkey % 3) AS rule_id, 'text ' || (s_suppkey % 2) AS finding FROM f JOIN supplier ON s_nationkey = n_nationkey),
also AS (SELECT g.grp, g.rule_id, g.finding, string_agg(' (also affects ' || g.member || ')', '' ORDER BY g.pos) AS tags FROM g JOIN g p ON p.pos = 0 AND g.pos > 0 AND p.grp = g.grp AND p.rule_id = g.rule_id AND p.finding = g.finding GROUP BY ALL)
SELECT g.grp, member, pos, g.rule_id, CASE WHEN pos = 0 THEN g.finding || coalesce(tags, '') ELSE g.finding END AS finding FROM g LEFT JOIN also USING (grp, rule_id, finding) WHERE pos = 0 OR tags IS NULL""")
def q_sibling_dedup(t):
    from pyspark.sql import Window

    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    f = t.nation.select(c("n_regionkey").alias("grp"), c("n_name").alias("member"), (F.row_number().over(w) - 1).cast("long").alias("pos"), "n_nationkey")
    g = f.join(t.supplier, c("s_nationkey") == c("n_nationkey")).select("grp", "member", "pos", F.concat(lit("R-"), (c("s_suppkey") % 3).cast("string")).alias("rule_id"), F.concat(lit("text "), (c("s_suppkey") % 2).cast("string")).alias("finding")).distinct()
    return fd.dedup_siblings(g)


@query("SELECT o_orderkey AS repo, 'L-' || l_linenumber AS rule_id, 'WARN' AS severity, 'line' AS finding FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 45 UNION ALL SELECT o_orderkey, 'STATUS', 'SUCCESS', 'no findings' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def q_status_rows(t):
    f = t.lineitem.filter("l_quantity > 45").join(t.orders, c("l_orderkey") == c("o_orderkey")).select(c("o_orderkey").alias("repo"), F.concat(lit("L-"), c("l_linenumber").cast("string")).alias("rule_id"), lit("WARN").alias("severity"), lit("line").alias("finding"))
    return fd.with_status(f, t.orders.select(c("o_orderkey").alias("repo")), "no findings")


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def q_distinct_first(t):
    return pr.first_of_texts(t.documents, "text", c("doc_id"), ["doc_id", "source"])


@query("SELECT r_name, array_to_string(list(n_name ORDER BY n_nationkey), ',') AS members FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name")
def q_group_collect(t):
    g = t.nation.join(t.region, c("r_regionkey") == c("n_regionkey")).groupBy("r_name").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("m"))
    return g.select("r_name", F.array_join("m.n_name", ",").alias("members"))


# --- findings and sink ------------------------------------------------------------------------------------------

_SEV = [("warning",), ("WARN",), ("critical",), (" Error ",), ("success",), ("note",), ("",), (None,)]
_SEV_SQL = "CASE upper(s) WHEN 'WARNING' THEN 'WARN' WHEN 'CRITICAL' THEN 'CRITICAL' WHEN 'ERROR' THEN 'ERROR' WHEN 'WARN' THEN 'WARN' WHEN 'INFO' THEN 'INFO' WHEN 'SUCCESS' THEN 'SUCCESS' ELSE '{}' END"


@query("SELECT s, " + _SEV_SQL.format("INFO") + " AS sink, " + _SEV_SQL.format("WARN") + " AS direct FROM (SELECT * FROM " + _values(_SEV) + " v(s) UNION ALL SELECT DISTINCT event_type FROM events)")
def q_severity_normalise(t):
    rows = t.values(_SEV, "s string").union(t.events.select("event_type").distinct())
    return rows.select("s", fd.severity(c("s")).alias("sink"), fd.severity(c("s"), "WARN").alias("direct"))


@query("SELECT user_id, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'purchase') AS warn, count(*) FILTER (event_type NOT IN ('error', 'purchase')) AS info FROM events GROUP BY user_id")
def q_severity_counts(t):
    return fd.severity_counts(t.events, "user_id", F.when(c("event_type") == "error", "ERROR").when(c("event_type") == "purchase", "WARN").otherwise("INFO"))


@query("WITH d AS (SELECT CAST(max(ts) AS DATE) AS day FROM events), l AS (SELECT user_id, event_type FROM events, d WHERE CAST(ts AS DATE) < day QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) SELECT event_id, user_id, event_type FROM events e, d WHERE CAST(ts AS DATE) = day AND NOT EXISTS (SELECT 1 FROM l WHERE l.user_id = e.user_id AND l.event_type = e.event_type)")
def q_dedup_vs_latest(t):
    """Events of the last day but those that repeat their user's latest event before it."""
    day = t.events.select(F.max("ts").cast("date")).scalar()
    e = t.events.select("event_id", "user_id", "event_type", "ts")
    stored = fd.latest(e.filter(c("ts").cast("date") < day), "user_id", F.struct("ts", "event_id")).select("user_id", "event_type")
    return fd.not_stored(e.filter(c("ts").cast("date") == day), stored, "user_id", ["event_type"]).select("event_id", "user_id", "event_type")


@query("WITH p AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN ' ' || chr(9) || event_type || chr(10) WHEN 1 THEN chr(160) || chr(12) WHEN 2 THEN NULL ELSE event_type END AS f, CASE event_id % 3 WHEN 0 THEN 'warning' WHEN 1 THEN ' ERROR ' ELSE event_type END AS s, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN ' d ' END AS d FROM events) SELECT event_id, trim(f, ' ' || chr(9) || chr(10) || chr(12) || chr(160)) AS finding, " + _SEV_SQL.format("INFO") + " AS severity, coalesce(nullif(d, ''), 'pipeline_consistency') AS dimension, nullif(d, '') AS suggestion, nullif(f, '') AS violation_id FROM p WHERE nullif(trim(f, ' ' || chr(9) || chr(10) || chr(12) || chr(160)), '') IS NOT NULL")
def q_payload_defaults(t):
    n = c("event_id")
    f = F.when(n % 5 == 0, F.concat(lit(" \t"), c("event_type"), lit("\n"))).when(n % 5 == 1, lit("\xa0\x0c")).when(n % 5 == 2, lit(None)).otherwise(c("event_type"))
    d = F.when(n % 4 == 0, "").when(n % 4 == 1, " d ")
    rows = t.events.select("event_id", f.alias("finding"), F.when(n % 3 == 0, "warning").when(n % 3 == 1, " ERROR ").otherwise(c("event_type")).alias("severity"), d.alias("dimension"), d.alias("suggestion"), f.alias("violation_id"))
    return fd.payload(rows)


@query("WITH l AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) SELECT event_id, user_id, event_type FROM events e WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.user_id = e.user_id AND l.event_type = e.event_type AND l.props = e.props)")
def q_sink_unsent(t):
    """A retry of all events as findings: what equals the repository's latest stored row in all four fields is not sent again."""
    e = t.events.select("event_id", "user_id", "event_type", c("user_id").cast("string").alias("repo"), lit("run-1").alias("run_id"), F.concat(c("event_type"), lit(" "), c("props")).alias("finding"), lit("warn").alias("severity"), lit("d").alias("dimension"), lit("").alias("suggestion"), lit(None).cast("string").alias("violation_id"), F.struct("ts", "event_id").alias("at"))
    return fd.unsent(fd.payload(e), e.select("repo", "at", "run_id", "finding", "severity", "dimension")).select("event_id", "user_id", "event_type")


@query("SELECT c_custkey AS repo, 'STATUS' AS rule_id, 'SUCCESS' AS severity, c_name || ' passed all ' || k || ' checks for standards v3.1.' AS finding FROM customer, (VALUES ('deterministic'), ('LLM'), ('conformance')) x(k) WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND (k <> 'LLM' OR o_totalprice > 100000))")
def q_status_variants(t):
    """The three texts of a repository without findings; open orders stand for findings, the larger ones for a model's."""
    repos, out = t.customer.select(c("c_custkey").alias("repo"), "c_name"), None
    found = t.orders.filter("o_orderstatus = 'P'").select(c("o_custkey").alias("repo"), "o_totalprice")
    for kind in ("deterministic", "LLM", "conformance"):
        some = fd.to_post(found.filter("o_totalprice <= 100000"), found.filter("o_totalprice > 100000"), kind == "LLM").select("repo", lit("R").alias("rule_id"), lit("WARN").alias("severity"), lit("f").alias("finding"))
        rows = fd.with_status(some, repos, fd.status_text(c("c_name"), kind, "3.1")).filter("rule_id = 'STATUS'")
        out = rows if out is None else out.union(rows)
    return out


@query("SELECT event_id, 'conformance-3.1-' || CASE WHEN event_id % 2 = 0 THEN event_type ELSE strftime(ts, '%Y%m%dT%H%M%S') END AS run_id, CASE event_id % 3 WHEN 0 THEN '9.9' WHEN 1 THEN event_type ELSE 'unknown' END AS version FROM events")
def q_run_ids(t):
    even = c("event_id") % 2 == 0
    version = fd.standards_version(F.when(c("event_id") % 3 == 0, " 9.9\n").otherwise(" "), F.when(c("event_id") % 3 < 2, c("event_type")))
    return t.events.select("event_id", fd.run_id("conformance", lit("3.1"), F.when(even, F.concat(lit(" "), c("event_type"))).otherwise(lit("\t")), c("ts")).alias("run_id"), version.alias("version"))


@query("SELECT 'R' || item_id % 50 AS rule_id, min(CASE WHEN item_id % 4 = 1 THEN 'no notes' ELSE 'no marker' END) AS problem FROM benchmark WHERE item_id % 4 <> 0 GROUP BY 1")
def q_unmarked_rules(t):
    """A row for each rule without a routing marker, once however often it is listed."""
    form = c("item_id") % 4
    notes = F.when(form == 0, F.concat(lit("  llm CHECK. "), c("text"))).when(form == 1, " \n").otherwise(c("text"))
    return fd.unmarked_rules(t.benchmark.select(F.concat(lit("R"), (c("item_id") % 50).cast("string")).alias("rule_id"), notes.alias("check_notes")))


# --- configuration and standards --------------------------------------------------------------------------------

_CONFIGS = (
    "type: api-service\ntraits: [multi-flow, unknown-one]\nexemptions:\n  - rule: ' R-{} '\n    reason: ''\n  - plain text\ndeferrals:\n  - {{rule: D-1, reason: later}}\n",
    "type: no-such-type\n", "type: [broken\n", "- a list\n", "type: static-site\ntraits:\nexemptions: []\n",
)
_OLD_TYPES = ("worker", "api", None, "site", "something", "react-app")


@query(
    "WITH d AS (SELECT doc_id, doc_id % 6 AS f, doc_id % 7 AS g, " + f"[{', '.join('NULL' if x is None else repr(x) for x in _OLD_TYPES)}]" + "[CAST(doc_id % 6 AS INT) + 1] AS old, n_chars FROM documents), r AS (SELECT *, CASE WHEN g = 0 THEN 'api-service' WHEN g = 4 THEN 'static-site' END AS own FROM d) "
    "SELECT doc_id, coalesce(own, CASE f WHEN 0 THEN 'pipeline-cog' WHEN 1 THEN 'api-service' WHEN 2 THEN 'shared-library' WHEN 3 THEN 'static-site' WHEN 4 THEN 'pipeline-cog' ELSE 'react-app' END) AS repo_type, CASE WHEN g = 0 THEN 'multi-flow' ELSE '' END AS traits, CASE WHEN g = 0 THEN 'R-' || n_chars WHEN own IS NULL THEN 'OLD-1' ELSE '' END AS exempt, CASE WHEN g = 0 THEN 'D-1:later' ELSE '' END AS deferred, CASE WHEN own IS NULL THEN 'service' ELSE 'file' END AS config_source FROM r"
)
def q_config_parse(t):
    """Configuration files, good, of an unknown type, broken, no mapping, empty of lists, and absent; the service's own entry stands in."""
    from .engine import REPO_TYPES, TRAITS, repo_type

    g = c("doc_id") % 7
    text = F.element_at(F.array(*(lit(x.replace("{{", "{").replace("}}", "}")) for x in _CONFIGS)), (g + 1).cast("int"))
    d = t.documents.select(c("doc_id").cast("string").alias("repo"), "doc_id", "n_chars", "text")
    files = d.filter(g < len(_CONFIGS)).select("repo", F.replace(text, lit("{}"), c("n_chars").cast("string")).alias("content"))
    old = F.element_at(F.array(*(lit(x) for x in _OLD_TYPES)), (c("doc_id") % 6 + 1).cast("int"))
    services = d.select("repo", "doc_id", old.alias("type"), F.array(F.struct(lit("OLD-1 # why").alias("line"), lit(None).cast("string").alias("rule"), lit(None).cast("string").alias("reason"))).alias("exceptions"))
    rows = rc.configured(services, rc.config_rows(files, REPO_TYPES, TRAITS), repo_type(c("type")))
    joined = lambda x, f: F.array_join(F.transform(x, f), ",")
    return rows.select("doc_id", "repo_type", F.array_join("traits", ",").alias("traits"), joined("exemptions", lambda x: x["rule"]).alias("exempt"), joined("deferrals", lambda x: F.concat(x["rule"], lit(":"), x["reason"])).alias("deferred"), "config_source")


@query(
    "WITH r AS (SELECT 'R-' || item_id AS rule_id, trim(text, ' ' || chr(10)) AS check_notes, item_id % 5 <> 0 AS checkable, CASE item_id % 4 WHEN 0 THEN ['all', 'api-service'] WHEN 1 THEN ['BUILDING'] WHEN 2 THEN ['static-site', 'MACHINERY'] ELSE [] END AS applies_to, CASE WHEN item_id % 7 = 0 THEN 'other' ELSE 'api' END AS domain, item_id FROM benchmark), "
    "s AS (SELECT n_nationkey AS repo, CASE WHEN n_regionkey = 0 THEN 'static-site' END AS repo_type, CASE WHEN n_regionkey = 1 THEN 'BUILDING' ELSE 'MACHINERY' END AS dod FROM nation) "
    "SELECT repo, rule_id, '' AS title, 'INFO' AS severity, check_notes, CASE WHEN item_id % 3 = 0 THEN 'llm' ELSE 'deterministic' END AS check_mode FROM s, r WHERE checkable AND domain = 'api' AND (list_contains(applies_to, 'all') OR list_contains(applies_to, coalesce(repo_type, '-')) OR list_contains(applies_to, dod))"
)
def q_standards_for_service(t):
    """The rules that apply to each service, by type or older type, with their mode of check."""
    i = c("item_id")
    kinds = F.when(i % 4 == 0, F.array(lit("all"), lit("api-service"))).when(i % 4 == 1, F.array(lit("BUILDING"))).when(i % 4 == 2, F.array(lit("static-site"), lit("MACHINERY"))).otherwise(F.array().cast("array<string>"))
    rules = t.benchmark.select(F.when(i % 7 == 0, "other").otherwise("api").alias("domain"), F.concat(lit("R-"), i.cast("string")).alias("rule_id"), lit(None).cast("string").alias("title"), lit(None).cast("string").alias("severity"), "text", i.alias("item_id"), (i % 5 != 0).alias("checkable"), kinds.alias("applies_to"), c("text").alias("check_notes"))
    services = t.nation.select(c("n_nationkey").alias("repo"), F.when(c("n_regionkey") == 0, "static-site").alias("repo_type"), F.when(c("n_regionkey") == 1, "BUILDING").otherwise("MACHINERY").alias("dod_type"))
    return rc.rules_of_services(services, rules, fd.check_mode(F.when(c("item_id") % 3 == 0, lit("LLM CHECK. x")).otherwise(c("check_notes"))))


# --- events -----------------------------------------------------------------------------------------------------

_STATES = {"error": "CRASHED", "purchase": "FAILED", "click": "CANCELLED"}
_STATE_SQL = "CASE event_type WHEN 'error' THEN 'CRASHED' WHEN 'purchase' THEN 'FAILED' WHEN 'click' THEN 'CANCELLED' ELSE 'COMPLETED' END"


def _state():
    out = None
    for k, v in _STATES.items():
        out = F.when(c("event_type") == k, v) if out is None else out.when(c("event_type") == k, v)
    return out.otherwise("COMPLETED")


@query(f"SELECT event_id, CASE {_STATE_SQL} WHEN 'CRASHED' THEN 'CRITICAL' WHEN 'FAILED' THEN 'ERROR' WHEN 'CANCELLED' THEN 'WARN' ELSE 'INFO' END AS severity FROM events")
def q_event_severity(t):
    return t.events.select("event_id", ev.state_severity(_state()).alias("severity"))


_FLOWS = [("signup", "accounts"), ("purchase", "shop"), ("view", "site")]


@query("SELECT event_id, coalesce(repo, 'unknown') AS repo FROM events LEFT JOIN " + _values(_FLOWS) + " f(flow_name, repo) ON flow_name = event_type")
def q_flow_to_repo(t):
    return ev.with_repo(t.events.withColumnRenamed("event_type", "flow_name"), t.values(_FLOWS, "flow_name string, repo string")).select("event_id", "repo")


def _direct(events):
    rows = events.withColumn("state", _state())
    found = ev.direct_findings(rows, c("event_type"), c("state"), ("CRASHED", "FAILED", "CANCELLED"))
    return found.select("event_id", ev.state_severity(c("state")).alias("severity"), "finding")


_DIRECT_SQL = f"SELECT event_id, CASE state WHEN 'CRASHED' THEN 'CRITICAL' WHEN 'FAILED' THEN 'ERROR' ELSE 'WARN' END AS severity, 'Flow ' || event_type || ' entered ' || state || ' state' AS finding FROM (SELECT *, {_STATE_SQL} AS state FROM events) WHERE state <> 'COMPLETED'"


@query(_DIRECT_SQL)
def q_event_direct_finding(t):
    return _direct(t.events)


@query(_DIRECT_SQL)
def stream_events_findings(t):
    """The same findings by Structured Streaming: files as micro-batches, each written once under its batch id."""
    out = shared_dir(t.spark, "stream")
    path = f"{t.folder}/event[s].parquet"  # a pattern: streams take a folder or a pattern, not one file
    schema = t.events.schema
    q = ev.stream(t.spark, path, schema, _direct, lambda df, i: df.write.mode("overwrite").parquet(f"{out}/rows/batch={i}"), f"{out}/progress")
    q.awaitTermination()
    return t.spark.read.parquet(f"{out}/rows").select("event_id", "severity", "finding")


#: Payloads of events by their number: flat, nested, empty at the top, blank, not JSON, an array, both keys.
_SHAPES = (
    '{"flow_run_id": "run-#", "flow_name": " f ", "state_type": "failed"}', '{"resource": {"id": "b#", "flow_name": "g", "state_name": "Crashed", "state_type": "crashed", "name": "n"}}', '{"state_name": "", "resource": {"state_name": "Late", "flow_name": "h"}}',
    "not json #", '{"id": "t#", "resource": {"flow_run_id": "r#"}, "start_time": "2024-01-01"}', '{"flow_run_id": " ", "id": "x", "state_type": null, "resource": {"state_type": "late"}}', '[1, #]', '{"name": "n", "resource": "text", "flow_name": "k\\t"}',
)
_PICK = "replace([" + ", ".join("'" + x + "'" for x in _SHAPES) + "][CAST(event_id % 8 AS INT) + 1], '#', CAST(event_id AS VARCHAR))"


def _merged(f: str) -> str:
    """A key of the top level hides the resource's, whatever its value."""
    return f"nullif(CASE WHEN json_exists(p, '$.{f}') THEN json_extract_string(p, '$.{f}') ELSE json_extract_string(p, '$.resource.{f}') END, '')"


def _stripped(default: str, *fields: str) -> str:
    return "coalesce(nullif(trim(coalesce(" + ", ".join(map(_merged, fields)) + f"), ' ' || chr(9) || chr(10)), ''), '{default}')"


@query(
    f"WITH v AS (SELECT event_id, CASE WHEN json_valid({_PICK}) THEN {_PICK} ELSE '{{}}' END AS p FROM events) SELECT event_id, {_stripped('prefect-unknown-run', 'flow_run_id', 'id')} AS flow_run_id, {_stripped('unknown-flow', 'flow_name')} AS flow_name, "
    f"{_stripped('UNKNOWN', 'state_name')} AS state_name, upper({_stripped('UNKNOWN', 'state_type')}) AS state_type, {_stripped('', 'start_time')} AS start_time, CASE WHEN upper({_stripped('UNKNOWN', 'state_type')}) IN ('FAILED', 'CRASHED', 'CANCELLED') THEN 'direct' ELSE 'review' END AS branch FROM v"
)
def q_payload_flatten(t):
    rows = ev.flatten(_payloads(t))
    return rows.select("event_id", "flow_run_id", "flow_name", "state_name", "state_type", "start_time", ev.branch(c("state_type")).alias("branch"))


def _payloads(t):
    pick = F.element_at(F.array(*map(lit, _SHAPES)), (c("event_id") % 8 + 1).cast("int"))
    return t.events.select("event_id", F.replace(pick, lit("#"), c("event_id").cast("string")).alias("payload"))


@query(f"SELECT event_id FROM events WHERE NOT json_valid({_PICK}) OR json_type({_PICK}) <> 'OBJECT'")
def q_event_dead_letters(t):
    return ev.malformed(_payloads(t)).select("event_id")


@query("WITH m AS (SELECT o_orderkey AS run, count(l_orderkey) AS tabs, CAST(floor(o_totalprice) AS BIGINT) % 4 AS folders, CAST(sum(l_quantity) AS BIGINT) % 3 AS sets, o_orderstatus = 'F' AS snapshot, o_orderdate FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL), n AS (SELECT *, coalesce(sets, 0) AS s, year(o_orderdate) = 1995 AS current FROM m) SELECT run, 'WARN' AS severity, 'No tabs written despite ' || folders || ' folders processed' AS finding FROM n WHERE tabs = 0 AND folders > 0 UNION ALL SELECT run, 'ERROR', 'JSON snapshot write failed' FROM n WHERE NOT snapshot UNION ALL SELECT run, 'WARN', 'Current year folder missing' FROM n WHERE NOT current UNION ALL SELECT run, 'WARN', 'No sets found across any folder' FROM n WHERE s = 0 AND folders > 0 UNION ALL SELECT run, 'INFO', folders || ' folders, ' || tabs || ' tabs, ' || s || ' sets' FROM n WHERE NOT (tabs = 0 AND folders > 0) AND snapshot AND current AND NOT (s = 0 AND folders > 0)")
def q_run_metrics_rules(t):
    n = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("tabs"), (F.sum("l_quantity").cast("long") % 3).alias("sets"))
    m = t.orders.join(n, c("l_orderkey") == c("o_orderkey"), "left")
    runs = m.select(c("o_orderkey").alias("run"), F.coalesce("tabs", lit(0)).alias("tabs"), (F.floor("o_totalprice").cast("long") % 4).alias("folders"), F.coalesce("sets", lit(0)).alias("sets"), (c("o_orderstatus") == "F").alias("snapshot"), F.array(F.concat(lit("sets "), F.year("o_orderdate").cast("string"))).alias("names"))
    return ev.collection_findings(runs, lit(1995))


_IMPORT = "SELECT o_orderkey AS run, count(l_orderkey) AS attempted, count(CASE WHEN l_returnflag = 'N' THEN 1 END) AS imported, count(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 1 END) AS failed, count(CASE WHEN l_returnflag = 'A' AND l_linenumber % 2 = 0 THEN 1 END) + CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END AS duplicates, count(CASE WHEN l_linenumber = 6 THEN 1 END) AS unrecognized, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus = 'F' END AS ingested, {} AS labels FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus, o_orderpriority"


@query(
    "WITH n AS (SELECT *, attempted - imported - failed - duplicates AS gap FROM (" + _IMPORT.format("string_agg(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 's' || l_linenumber END, ', ' ORDER BY 's' || l_linenumber)") + ")), f AS ("
    "SELECT run, 'WARN' AS severity, gap || ' of ' || attempted || ' attempted files are neither imported, failed nor duplicates' AS finding FROM n WHERE gap > 0 UNION ALL SELECT run, 'WARN', (-gap) || ' more files imported, failed or duplicates than the ' || attempted || ' attempted' FROM n WHERE gap < 0 "
    "UNION ALL SELECT run, 'WARN', failed || ' of ' || attempted || ' attempted files failed: ' || labels FROM n WHERE failed > 0 UNION ALL SELECT run, 'ERROR', 'No file imported of ' || attempted || ' attempted' FROM n WHERE imported = 0 AND attempted > 0 UNION ALL SELECT run, 'INFO', duplicates || ' possible duplicates not imported' FROM n WHERE duplicates > 0 "
    "UNION ALL SELECT run, 'INFO', unrecognized || ' files skipped for their names' FROM n WHERE unrecognized > 0 UNION ALL SELECT run, 'ERROR', 'API ingest failed' FROM n WHERE NOT ingested) SELECT * FROM f UNION ALL SELECT run, 'INFO', imported || ' files imported' FROM n WHERE run NOT IN (SELECT run FROM f)"
)
def q_run_import_rules(t):
    """An order is a run and its line items the files."""
    failed = "CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN concat('s', l_linenumber) END"
    sql = _IMPORT.format(f"sort_array(collect_list({failed}))").replace("FROM orders LEFT JOIN lineitem", "FROM {orders} LEFT JOIN {lineitem}")
    return ev.import_findings(t.spark.sql(sql, orders=t.orders, lineitem=t.lineitem))


# --- model responses --------------------------------------------------------------------------------------------

#: Answers made from conversations by their number: a list, prose around a fence, other keys, no list, no JSON, odd values.
_ANSWERS = (
    '[{"finding": "@", "rule_id": "R#"}, 3, {"message": " @ ", "violation_id": ""}]', 'Here it is: ```JSON {"findings": [{"description": "@", "severity": "WARN", "violation_id": "V#"}]} ``` and more', '```\n[{"detail": "@", "text": "no"}, {"finding": "", "rule_id": ""}]\n```',
    '{"findings": "@"}', "@", '{"findings": [{"finding": null, "text": "@", "violation_id": null, "rule_id": "R2"}, {"finding": false, "detail": 0}]}', '{"other": [{"finding": "@"}]}',
)
_ASK = "replace(replace([" + ", ".join("'" + x.replace("\n", "' || chr(10) || '") + "'" for x in _ANSWERS) + "][CAST(conv_id % 7 AS INT) + 1], '@', coalesce(regexp_replace(text, '[^a-zA-Z ]', '', 'g'), '')), '#', CAST(turn AS VARCHAR))"
_ITEMS = (
    f"WITH a AS (SELECT conv_id, turn, {_ASK} AS raw FROM conversations), b AS (SELECT *, CASE WHEN regexp_matches(raw, '(?is)```(?:json)?\\s*(.*?)\\s*```') THEN regexp_extract(raw, '(?is)```(?:json)?\\s*(.*?)\\s*```', 1) ELSE raw END AS body FROM a), "
    "j AS (SELECT conv_id, turn, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS j FROM b), l AS (SELECT conv_id, turn, CASE json_type(j) WHEN 'ARRAY' THEN j WHEN 'OBJECT' THEN CASE WHEN json_type(json_extract(j, '$.findings')) = 'ARRAY' THEN json_extract(j, '$.findings') END END AS l FROM j), "
    "e AS (SELECT conv_id, turn, unnest(CAST(l AS JSON[])) AS item, generate_subscripts(CAST(l AS JSON[]), 1) AS n FROM l WHERE l IS NOT NULL), o AS (SELECT conv_id, turn, item, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY n) - 1 AS INT) AS i FROM e WHERE json_type(item) = 'OBJECT')"
)


def _truthy(k: str) -> str:
    return f"CASE WHEN json_type(item, '$.{k}') IN ('VARCHAR') THEN nullif(json_extract_string(item, '$.{k}'), '') END"


def _answers(t):
    pick = F.element_at(F.array(*map(lit, _ANSWERS)), (c("conv_id") % 7 + 1).cast("int"))
    return t.conversations.select("conv_id", "turn", F.replace(F.replace(pick, lit("@"), F.coalesce(F.regexp_replace("text", "[^a-zA-Z ]", ""), lit(""))), lit("#"), c("turn").cast("string")).alias("raw"))


@query(_ITEMS + " SELECT conv_id, turn, i FROM o")
def q_llm_parse(t):
    return mr.parsed(_answers(t), "raw", "conv_id", "turn").select("conv_id", "turn", "i")


@query(_ITEMS + " SELECT conv_id, turn, i, coalesce(" + ", ".join(map(_truthy, ("finding", "message", "description", "detail", "text"))) + f", 'No finding text returned by evaluator.') AS finding, CASE WHEN json_exists(item, '$.violation_id') THEN json_extract_string(item, '$.violation_id') ELSE {_truthy('rule_id')} END AS violation_id, {_truthy('severity')} AS severity FROM o")
def q_llm_normalise(t):
    return mr.parsed(_answers(t), "raw", "conv_id", "turn").select("conv_id", "turn", "i", "finding", "violation_id", "severity")


@query("SELECT 'b' || item_id AS rule_id FROM benchmark WHERE item_id % 3 = 0 EXCEPT SELECT 'b' || doc_id FROM labels WHERE quality = 1 EXCEPT SELECT 'b' || doc_id FROM labels WHERE toxic = 1")
def q_soft_rules(t):
    rule = lambda col: F.concat(lit("b"), c(col).cast("string")).alias("rule_id")
    rules = t.benchmark.select(rule("item_id"), F.when(c("item_id") % 3 == 0, "llm").otherwise("deterministic").alias("check_mode"))
    return fd.soft_rules(rules, t.labels.filter("quality = 1").select(rule("doc_id")), t.labels.filter("toxic = 1").select(rule("doc_id"))).select("rule_id")


def _filled(template: str, **values: str) -> str:
    """The template as SQL, from the SQL of its values."""
    parts = re.split(r"\{(\w+)\}", template)
    return " || ".join(f"coalesce(CAST({values[p]} AS VARCHAR), '')" if i % 2 else "'" + p.replace("'", "''") + "'" for i, p in enumerate(parts))


def _lines(rows: str, none: str) -> str:
    return f"coalesce((SELECT string_agg(line, chr(10) ORDER BY seq, line) FROM {rows} b WHERE b.repo = p.repo), '{none}')"


_SEEN = "CASE l_linenumber WHEN 1 THEN '.github/' WHEN 2 THEN 'web/node_modules/' WHEN 3 THEN 'src/__pycache__/' ELSE 'src/' END || 'f' || l_orderkey || '-' || l_linenumber || '.py'"


@query(
    "WITH p AS (SELECT 's' || s_suppkey AS repo, 'pipeline-cog' AS repo_type, 'python' AS language, '6.1' AS standards_version FROM supplier), "
    "r AS (SELECT *, 's' || l_suppkey AS repo, l_orderkey AS seq, 'R' || l_partkey AS rule_id, CASE WHEN l_linenumber % 3 > 0 THEN 'N' || l_linenumber END AS notes FROM lineitem), "
    "a AS (SELECT *, '- ' || rule_id || ' [' || l_returnflag || ']: T' || l_linenumber || chr(10) || '  How to check: ' || coalesce(notes, '') AS line FROM r), n AS (SELECT * FROM a WHERE notes IS NOT NULL), "
    "f AS (SELECT repo, seq, CASE l_linenumber WHEN 1 THEN 'CHECKER' WHEN 2 THEN NULL ELSE rule_id END AS rule_id, CASE WHEN l_linenumber <> 4 THEN 'WARN' END AS severity, l_linenumber AS k FROM r WHERE l_returnflag = 'R'), "
    "g AS (SELECT repo, seq, '- [' || coalesce(severity, 'INFO') || '] ' || coalesce(rule_id, '?') || ': F' || k AS line FROM f), x AS (SELECT repo, seq, rule_id, '  - ' || rule_id || CASE WHEN l_tax > 0.03 THEN ': because ' || l_linenumber ELSE '' END AS line FROM r WHERE l_discount > 0.08), "
    "d AS (SELECT repo, rule_id FROM r WHERE l_returnflag = 'A' AND l_linenumber > 4 UNION SELECT repo, coalesce(rule_id, '') FROM f WHERE rule_id IS DISTINCT FROM 'CHECKER' UNION SELECT repo, 'EVAL-002' FROM p), dl AS (SELECT repo, 0 AS seq, '  - ' || rule_id AS line FROM d), "
    "s AS (SELECT * FROM a WHERE l_linestatus = 'O' AND (repo, rule_id) NOT IN (SELECT (repo, rule_id) FROM d) AND (repo, rule_id) NOT IN (SELECT (repo, rule_id) FROM x)), "
    f"w AS (SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY path) AS n, count(*) OVER (PARTITION BY repo) AS total FROM (SELECT repo, {_SEEN} AS path FROM r WHERE l_linenumber > 3 UNION ALL SELECT 's' || doc_id, 'README.md' FROM documents)), "
    "i AS (SELECT repo, n AS seq, '  ' || path AS line FROM w WHERE n <= 60 UNION ALL SELECT repo, 61, '  ... (' || (max(total) - 60) || ' more files)' FROM w GROUP BY repo HAVING max(total) > 60), "
    "h AS (SELECT 's' || doc_id AS repo, 0 AS seq, CASE WHEN length(text) > 4000 THEN substr(text, 1, 4000) || chr(10) || '...(truncated)' ELSE text END AS line FROM documents) "
    "SELECT repo, " + _filled(ask.CONFORMANCE, repo="repo", repo_type="repo_type", language="language", standards_version="standards_version", exceptions=_lines("x", "  (none)"), inventory=_lines("i", ""), readme=_lines("h", ""), rules=_lines("n", "(none)"), findings=_lines("g", "(none)"), soft=_lines("s", "(none: all rules are covered by checks)"), resolved=_lines("dl", "  (none)")) + " AS prompt FROM p"
)
def q_conformance_prompts(t):
    """A supplier is a repository; its rules, findings, exceptions and files are its line items, its README a document."""
    repo, k = lambda x: F.concat(lit("s"), c(x).cast("string")).alias("repo"), c("l_linenumber")
    say = lambda x, n: F.concat(lit(x), c(n).cast("string"))
    rows = t.lineitem.select("*", repo("l_suppkey"), c("l_orderkey").alias("seq"), say("R", "l_partkey").alias("rule_id"))
    rules = rows.select("repo", "seq", "rule_id", c("l_returnflag").alias("severity"), say("T", "l_linenumber").alias("title"), F.when(k % 3 > 0, say("N", "l_linenumber")).alias("check_notes"), F.when(c("l_linestatus") == "O", "llm").otherwise("deterministic").alias("check_mode"))
    findings = rows.filter("l_returnflag = 'R'").select("repo", "seq", F.when(k == 1, "CHECKER").when(k != 2, c("rule_id")).alias("rule_id"), F.when(k != 4, "WARN").alias("severity"), say("F", "l_linenumber").alias("finding"))
    skips = rows.filter("l_discount > 0.08D").select("repo", "seq", "rule_id", F.when(c("l_tax") > 0.03, say("because ", "l_linenumber")).alias("reason"))
    files = rows.select("repo", F.expr(_SEEN).alias("path"), lit(None).cast("string").alias("content")).union(t.documents.select(repo("doc_id"), lit("README.md"), "text"))
    repos = t.supplier.select(repo("s_suppkey"), lit("pipeline-cog").alias("repo_type"), lit("python").alias("language"), lit("6.1").alias("standards_version"))
    return ask.conformance_prompts(repos, rules, findings, rows.filter("l_returnflag = 'A' AND l_linenumber > 4").select("repo", "rule_id"), skips, files)


_RUN = {"run_id": "o_orderkey", "standards_version": "'6.1'", "folders_processed": "o_custkey % 4", "tabs_written": "o_custkey % 3", "total_sets": "o_custkey", "json_snapshot_written": "o_orderstatus = 'F'", "current_year": "1995"}


@query(
    "SELECT o_orderkey AS run, " + _filled(ask.COLLECTION_RUN, **_RUN, folder_names="CASE o_custkey % 3 WHEN 0 THEN '(none)' WHEN 1 THEN o_orderstatus ELSE o_orderstatus || ', ' || o_orderpriority END") + " AS prompt FROM orders"
)
def q_run_prompts(t):
    names = F.expr("CASE o_custkey % 3 WHEN 0 THEN array() WHEN 1 THEN array(o_orderstatus) ELSE array(o_orderstatus, o_orderpriority) END")
    runs = t.orders.select(*(F.expr(x).alias(n) for n, x in _RUN.items()), names.alias("folder_names"))
    return runs.select(c("run_id").alias("run"), ask.run_prompts(runs, ask.COLLECTION_RUN).alias("prompt"))


@query("WITH r AS (SELECT source, lpad(doc_id::VARCHAR, 9, '0') AS path, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, count(*) OVER (PARTITION BY source) AS total FROM documents) SELECT source, n, path AS line FROM r WHERE n <= 60 UNION ALL SELECT source, 61, '... (' || (max(total) - 60) || ' more)' FROM r GROUP BY source HAVING max(total) > 60")
def q_inventory_topk(t):
    paths = t.documents.select("source", F.lpad(c("doc_id").cast("string"), 9, "0").alias("path"))
    from pyspark.sql import Window

    top = paths.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("path")).cast("long")).filter("n <= 60").select("source", "n", c("path").alias("line"))
    more = paths.groupBy("source").agg(F.count("*").alias("total")).filter("total > 60")
    return top.union(more.select("source", lit(61).cast("long"), F.concat(lit("... ("), (c("total") - 60).cast("string"), lit(" more)"))))


# --- archives ---------------------------------------------------------------------------------------------------


def _archives(t, *paths: str) -> DataFrame:
    """The documents as archives of 200 files at most, written and read back. A line ends as in a checked out file."""
    from ..sources import archives as ar

    at = shared_dir(t.spark, "repository-archives")
    number = c("doc_id")
    files = t.documents.select(F.concat(lit("d"), F.floor(number / 200).cast("string")).alias("repo"), F.concat(F.coalesce("lang", lit("und")), lit("/"), number.cast("string"), lit(".md")).alias("path"), c("text").alias("content"))
    ar.write_archives(files, at)
    ar.register(t.spark)
    return t.spark.read.format("repoarchive").option("members", "\n".join(paths)).load(at)


_TEXT = "replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
_MEMBER = f"SELECT 'd' || CAST(floor(doc_id / 200) AS BIGINT) AS repo, coalesce(lang, 'und') || '/' || doc_id || '.md' AS path, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size, sha256({_TEXT}) AS content_sha256 FROM documents"


@query(_MEMBER)
def q_archive_files(t):
    return _archives(t).select("repo", "path", "size", F.sha2("content", 256).alias("content_sha256"))


@query(_MEMBER + " WHERE lang = 'en'")
def q_archive_paths(t):
    """Only members that a pattern matches are inflated."""
    return _archives(t, "en/*").select("repo", "path", "size", F.sha2("content", 256).alias("content_sha256"))


from . import rule_queries  # noqa: E402

QUERIES |= {n: (lambda q: lambda spark, folder: q(Tables(spark, folder)))(q) for n, q in rule_queries.QUERIES.items()}
SQL |= rule_queries.SQL
