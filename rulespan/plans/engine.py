"""All rules over all repositories: files and repositories in, findings and checked rules out.

One pass over contents leaves small rows (file_rows): the bits and tests of each file and the facts that need a parse.
Only the two rules that look for names in tests and docs read those files again. Rules are rows of tables, joined to the
repositories by their gates, so plans do not grow with them. The rows of files, of repositories, findings and checked
rules are written when evaluate() is called, as several rules read them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from ..functions.marks import Marks
from ..functions.ship import ship
from ..functions.source_facts import source_rows
from ..functions.store import materialise
from ..operators import findings as fd
from ..operators import probes as pr
from ..operators import rules as ru
from ..operators.advice import advice
from ..operators.bits import WORD, words

FILES = "repo string, path string, content string"
REPOS = "repo string, name string, language string, repo_type string, root string, traits array<string>, exemptions array<struct<rule:string,reason:string>>, deferrals array<struct<rule:string,reason:string>>, standards_age_days int"

REPO_TYPES = ("pipeline-cog", "trigger-cog", "api-service", "shared-library", "static-site", "react-app", "standards-repo", "evaluator-service")
TRAITS = ("logger-primitive", "cloudflare-pages", "multi-flow", "pipeline-cog-evaluator", "pre-rule")
#: Older names of types; no name is a shared library, an unknown one a pipeline cog.
LEGACY_TYPES = {"worker": "pipeline-cog", "api": "api-service", "library": "shared-library", "site": "static-site", "standards": "standards-repo", "new_cog": "pipeline-cog", "new_fastapi_service": "api-service", "new_hono_service": "api-service", "new_frontend_site": "static-site", "new_react_app": "react-app"}

#: Rules that a type or a trait excepts. Fixed values.
_NO_PIPELINE = {f"PIPE-{n:03d}" for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 12)} | {f"TEST-{n:03d}" for n in (1, 2, 3, 4)} | {"CD-015"}
_NO_RUNTIME = _NO_PIPELINE | {"CD-002", "CD-007", "CD-009", "CD-010", "XSTACK-001"}
TYPE_SKIPS = {
    "shared-library": _NO_RUNTIME | {"PY-006", "PY-012", "PY-013", "PY-014", "TEST-007"},
    "static-site": _NO_RUNTIME | {"XSTACK-003"},
    "react-app": _NO_PIPELINE | {"CD-007"},
    "api-service": _NO_PIPELINE | {"CD-007"},
    "trigger-cog": _NO_PIPELINE - {"PIPE-001"},
    "standards-repo": _NO_RUNTIME | {"PY-006"},
}
TRAIT_SKIPS = {"logger-primitive": {"CD-009", "XSTACK-001"}, "cloudflare-pages": {"VER-003", "VER-005", "VER-006"}, "multi-flow": {"CD-015"}, "pipeline-cog-evaluator": {"PIPE-011"}}

_PYTHON_TYPES = "('pipeline-cog', 'trigger-cog', 'api-service', 'shared-library', 'evaluator-service')"
FLAGS = {
    "has_config": "true",
    "is_library": "repo_type = 'shared-library'",
    "is_pipeline": "repo_type IN ('pipeline-cog', 'evaluator-service')",
    "is_trigger": "repo_type = 'trigger-cog'",
    "is_api": "repo_type = 'api-service'",
    "is_static": "repo_type = 'static-site'",
    "is_react": "repo_type = 'react-app'",
    "is_frontend": "repo_type IN ('static-site', 'react-app')",
    "is_python": f"language = 'python' AND repo_type IN {_PYTHON_TYPES}",
    "is_fastapi": "language = 'python' AND repo_type = 'api-service'",
    "dod": "CASE WHEN repo_type IN ('pipeline-cog', 'trigger-cog', 'evaluator-service') THEN 'new_cog' WHEN repo_type = 'api-service' THEN if(language = 'python', 'new_fastapi_service', 'new_hono_service') WHEN repo_type = 'static-site' THEN 'new_frontend_site' WHEN repo_type = 'react-app' THEN 'new_react_app' END",
}
#: Files whose contents rules read.
READ = "startswith(path, 'src/') OR startswith(path, 'tests/') OR startswith(path, '.github/workflows/') OR path IN ('README.md', 'CHANGELOG.md', 'pyproject.toml', 'package.json', 'requirements.txt', '.releaserc.json', '.env.example', 'index.yaml', 'prefect.yaml')"
_INIT = re.compile(r"src/[^/]+/__init__\.py\Z")
_NAME = r'(?m)^\s*name\s*=\s*"([^"]+)"'


def repo_type(name: Column) -> Column:
    """A valid type as it is, an older name's type, else the default."""
    n = F.trim(name)
    old = F.create_map(*(F.lit(x) for kv in LEGACY_TYPES.items() for x in kv))
    return F.when(name.isNull(), "shared-library").when(n.isin(*REPO_TYPES), n).otherwise(F.coalesce(F.try_element_at(old, n), F.lit("pipeline-cog")))


def prepared(files: DataFrame) -> DataFrame:
    """files with name, ext and content in Unix lines; undecodable (null) content counts as empty."""
    text = F.regexp_replace(F.coalesce("content", F.lit("")), "\r\n?", "\n")
    name = F.element_at(F.split("path", "/"), -1)
    out = files.select("repo", "path", name.alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("ext"), text.alias("content"))
    return out.withColumn("low", F.lower("content")).withColumn("front", F.regexp_extract("content", r"(?s)^---\s*\n(.*?)\n---", 1))


#: Tests of a file by their number: those of rules about files from 0, those whose first path is asked for from here.
FIRST = 500
FILE_ROWS = "repo string, path string, kind string, text string, detail string, marks array<bigint>, hits array<int>, loc bigint, project_name string, src_package string"


def file_rows(files: DataFrame, by_path: tuple) -> DataFrame:
    """One row of kind `file` for each file, and a row for each of its facts; written, from one pass over contents.

    marks: the words of the file's atoms, patterns and paths by SQL, tokens by automata. hits: the numbers of its tests.
    Facts: repo, path, kind, text, detail of what needs a parse, and the texts of READMEs and packages.
    """
    own = [" | ".join(f"if(({scope}) AND ({test}), {1 << i % WORD}L, 0L)" for i, (scope, test) in enumerate(ru.ATOMS) if i // WORD == w and i not in ru.TOKENS) or "0L" for w in range(-(-len(ru.ATOMS) // WORD))]
    scopes = [*dict.fromkeys(scope for scope, _, _ in ru.TOKENS.values())]
    if len(scopes) > WORD:
        raise ValueError("more scopes of tokens than bits of a word")
    tokens = {i: (scopes.index(scope), token, low) for i, (scope, token, low) in ru.TOKENS.items()}
    tests = [*((i, x[4]) for i, x in enumerate(by_path)), *((FIRST + i, t) for i, t in enumerate(ru.FIRST_PATHS.values()))]
    parse = "ext IN ('py', 'ts', 'tsx', 'js', 'jsx', 'astro') OR path IN ('package.json', '.releaserc.json', 'index.yaml', '.env.example')"
    code = "startswith(path, 'src/') AND ext IN ('py', 'ts', 'tsx', 'js', 'mjs') AND content <> ''"
    package = F.regexp_extract("path", r"^src/([^/]+)/", 1)
    source = files.select(
        "repo", "path", F.expr(" | ".join(f"if({x}, {1 << i}L, 0L)" for i, x in enumerate(scopes))).alias("scopes"), F.expr(parse).alias("parse"),
        F.array(*map(F.expr, own)).alias("marks"), F.expr("array_compact(array(" + ", ".join(f"if({t}, {i}, NULL)" for i, t in tests) + "))").alias("hits"),
        F.when(F.expr(code), F.size(F.split(F.regexp_replace("content", r"\n\z", ""), "\n"))).otherwise(0).cast("long").alias("loc"),
        F.when(F.col("path") == "pyproject.toml", F.regexp_extract("content", _NAME, 1)).alias("project_name"), F.when(~package.isin("", "__pycache__"), package).alias("src_package"), "content",
    ).withColumn("content", F.when(F.col("parse") | (F.col("scopes") > 0), F.col("content")))
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in _parse_datatype_string(FILE_ROWS)])
    n_words = len(own)

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = Marks(tokens, WORD, n_words)
        for b in parts:
            rows = []
            for f in b.to_pylist():
                text = f.pop("content") or ""
                in_scopes, parsed = f.pop("scopes"), f.pop("parse")
                rows.append(f | {"kind": "file", "marks": walk.words(text, in_scopes, f["marks"])})
                at = {"repo": f["repo"], "path": f["path"]}
                if f["path"] == "README.md" or _INIT.match(f["path"]):
                    rows.append(at | {"kind": "readme" if f["path"] == "README.md" else "init", "text": text, "src_package": f["src_package"]})
                if parsed:
                    rows += [at | {"kind": k, "text": t, "detail": d} for k, t, d in source_rows(f["path"], text)]
            yield pa.RecordBatch.from_pylist(rows, schema)

    ship(files.sparkSession)
    return materialise(source.mapInArrow(scan, FILE_ROWS), "file-rows")


def repo_facts(rows: DataFrame) -> DataFrame:
    """One row a repository: the bits of all atoms, first paths, lines of code, names. rows: file_rows(); small ones are shuffled."""
    bits = [F.bit_or(F.col("marks")[i]).alias(f"own{i}") for i in range(-(-len(ru.ATOMS) // WORD))]
    firsts = [F.min(F.when(F.array_contains("hits", FIRST + i), F.col("path"))).alias(n) for i, n in enumerate(ru.FIRST_PATHS)]
    any_of = lambda name, *paths: F.bool_or(F.col("path").isin(*paths)).alias(name)
    flavor = [any_of("astro", "astro.config.mjs", "astro.config.ts"), any_of("vite", "vite.config.ts", "vite.config.js", "vite.config.mjs"), any_of("own_release", ".releaserc.json"), F.bool_or(F.col("path").startswith("tests/")).alias("has_tests")]
    return rows.filter("kind = 'file'").groupBy("repo").agg(*bits, *firsts, F.sum("loc").alias("loc"), F.max("project_name").alias("project_name"), F.min("src_package").alias("src_package"), *flavor)


def small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of the library's own rows. It holds rules, not data, so it may be broadcast whatever the input's size."""
    types = _parse_datatype_string(schema)
    arrays = [pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(zip(*rows), types)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=types.names), types)


def _unseen(named: DataFrame, texts: DataFrame, text: str) -> DataFrame:
    """repo, name of the names (repo, name) that no text of their repository contains.

    A repository's names, few and short, go as one array to each of its texts, which gives those that it contains:
    a text is read once, whatever the number of names, and no text is grouped.
    """
    lists = named.groupBy("repo").agg(F.collect_set("name").alias("names"))
    told = texts.join(lists, "repo").select("repo", F.explode(F.filter("names", lambda n: F.contains(F.col(text), n))).alias("name"))
    return named.join(told.distinct(), ["repo", "name"], "left_anti")


def _cross(files: DataFrame, facts: DataFrame, repos: DataFrame, own: DataFrame) -> DataFrame:
    """repo, rule_id, finding of the rules that compare files. own: repo_facts()."""
    kind = lambda k: facts.filter(F.col("kind") == k)
    row = lambda df, rule, text: df.select("repo", F.lit(rule).alias("rule_id"), text.alias("finding"))
    out = []
    fields = kind("settings").select("repo", F.col("text").alias("key"), F.upper("text").alias("upper"), "detail")
    unknown = kind("access").select("repo", F.col("text").alias("key"), F.col("detail").alias("finding")).join(fields.select("repo").distinct(), "repo", "left_semi").join(fields, ["repo", "key"], "left_anti")
    out.append(row(unknown, "CFG-001", F.col("finding")))
    typed = fields.filter("detail = 'typed'").select("repo", "upper").distinct()
    env = kind("env_key").select("repo", F.col("text").alias("key"), F.col("detail").alias("upper"))
    env = env.join(typed.select("repo").distinct(), "repo", "left_semi").join(typed, ["repo", "upper"], "left_anti")
    out.append(row(env, "CFG-002", F.format_string(".env.example key '%s' not declared on Settings.", "key")))

    flags = own.select("repo", "astro", "vite", "own_release", "has_tests")
    routes = kind("route").select("repo", F.col("text").alias("name")).distinct().join(flags.filter("has_tests").select("repo"), "repo", "left_semi")
    top = pr.top_list(_unseen(routes, files.filter(ru.TESTS).select("repo", "content"), "content"), ["repo"], F.col("name"), 5)
    out.append(row(top, "TEST-010", F.concat(F.col("n").cast("string"), F.lit(" route(s) have no contract test referencing them: "), "first", F.when(F.col("n") > 5, " (and others)").otherwise(""), F.lit("."))))

    wrong, right = F.when(F.col("astro"), "VITE_").otherwise("PUBLIC_"), F.when(F.col("astro"), "PUBLIC_").otherwise("VITE_")
    env = kind("client_env").join(flags.filter("astro OR vite"), "repo").filter(F.startswith("text", wrong))
    out.append(row(env, "XSTACK-004", F.concat("detail", F.lit(" uses "), wrong, F.lit(" prefix in a repo expecting "), right, F.lit("."))))

    run = kind("run_url").select("repo", "path", F.col("text").alias("name"), "detail")
    both = run.join(kind("build_url").select("repo", F.col("text").alias("name")).distinct(), ["repo", "name"], "left_semi").select("repo", "path").distinct()
    out.append(row(both, "FE-009", F.format_string("Astro component performs runtime fetch of URL also used in frontmatter (%s).", "path")))
    docs = files.filter("path = 'README.md' OR (startswith(path, 'docs/') AND ext = 'md')").select("repo", "low")
    silent = _unseen(run.select("repo", "name").distinct(), docs, "low")
    first = run.join(silent, ["repo", "name"], "left_semi").groupBy("repo", "path").agg(F.min_by("name", "detail").alias("name"))
    out.append(row(first, "FE-010", F.format_string("Runtime fetch URL not documented in README/docs (%s: %s).", "path", "name")))

    release = kind("VER-008").select(F.col("repo").alias("at"), "text")
    place = repos.join(flags, "repo", "left").select("repo", F.when(F.col("own_release"), F.col("repo")).otherwise(F.col("root")).alias("at"))
    out.append(row(place.join(release, "at"), "VER-008", F.col("text")))
    for rule in ("DOC-008", "FE-008", "META-003"):
        out.append(row(kind(rule), rule, F.col("text")))
    return reduce(DataFrame.unionByName, out)


def evaluate(files: DataFrame, repos: DataFrame, mono_rules: bool = False, names: ru.Names = ru.Names()) -> tuple[DataFrame, DataFrame]:
    """(findings, checked). A check that breaks off on a file gives a row of the rule CHECKER; the others go on. So does
    a file that is not UTF-8, if files say so in a column decode_ok, and then counts as empty.

    findings: repo, seq, rule_id, violation_id, severity, dimension, finding, suggestion (null where a rule was skipped), deferred; seq orders the kinds of rules,
    then their place in the list. checked: repo, rule_id, for every rule that applies, skipped ones too.
    mono_rules: also run the two monorepo rules, which are off by default. names: what belongs to one organisation.
    """
    spark = files.sparkSession
    rules, by_path = ru.repo_rules(names), ru.file_rules(names)
    unread = files.filter(~F.col("decode_ok") & F.expr(READ)).select("repo", F.concat(F.lit("Check of "), "path", F.lit(" raised an unexpected error: not UTF-8")).alias("text")) if "decode_ok" in files.columns else None
    files = prepared(files)
    repos = repos.withColumn("repo_type", repo_type(F.col("repo_type"))).withColumn("mono_rules", F.lit(mono_rules))
    repos = repos.select("*", *(F.expr(e).alias(n) for n, e in FLAGS.items()))
    rows = file_rows(files, by_path)
    facts_rows = rows.filter("kind <> 'file'").select("repo", "path", "kind", "text", "detail")
    facts = materialise(repo_facts(rows), "repo-facts")
    n = -(-len(ru.ATOMS) // WORD)
    roots = facts.select(F.col("repo").alias("root"), *(F.col(f"own{i}").alias(f"root{i}") for i in range(n)))
    init = rows.filter("kind = 'init'").select("repo", "src_package", F.lower("text").alias("init"))
    readme = rows.filter("kind = 'readme'").groupBy("repo").agg(F.max(F.lower("text")).alias("readme"))
    own = repos.join(facts, "repo", "left").join(roots, "root", "left").join(init, ["repo", "src_package"], "left").join(readme, "repo", "left")
    called = [F.coalesce(F.lower(c), F.lit("")) for c in ("project_name", "src_package")]
    texts = [F.coalesce(c, F.lit("")) for c in ("init", "readme")]
    documented = reduce(lambda a, b: a & b, (t.contains(x) for t in texts for x in called))
    split = (called[0] != "") & F.col("src_package").isNotNull() & (F.replace("project_name", F.lit("-"), F.lit("_")) != F.col("src_package"))
    own = own.withColumn("split_identity", F.coalesce(split & ~documented, F.lit(False))).fillna({"project_name": "", "loc": 0})

    under = lambda c: F.replace(c, F.lit("-"), F.lit("_"))
    own = own.withColumns({"under": under(F.col("project_name")), "repo_under": under(F.col("name"))})

    gates = ru.gates_of(rules, by_path)
    sizes = words(len(ru.ATOMS), len(ru.CONDITIONS))
    holds = [f"if({c}, {1 << i % WORD}L, 0L)" for i, c in enumerate(ru.CONDITIONS)]
    cond = [" | ".join(holds[i : i + WORD]) for i in range(0, len(holds), WORD)]
    bits = F.array(*(F.coalesce(F.col(f"{r}{i}"), F.lit(0)) for r in ("own", "root") for i in range(sizes[r])), *map(F.expr, cond)).alias("bits")
    opened = F.explode(F.expr("array_compact(array(" + ", ".join(f"if({g}, {i}, NULL)" for g, i in gates.items()) + "))")).alias("gate")
    shown = F.array(*(F.col(v).cast("string") for v in ru.VALUES)).alias("shown")
    fires = F.expr("exists(clauses, c -> forall(c, x -> (bits[x.word] & x.mask) = x.want))")
    finding = F.expr("format_string(template, " + ", ".join(f"shown[{i}]" for i in range(len(ru.VALUES))) + ")").alias("finding")
    table = small(spark, ru.rule_table(rules, gates), ru.RULE_TABLE)
    behind = small(spark, ru.gate_table(rules, by_path, gates), "gate int, rule_id string, wrapped boolean")
    found = own.select("repo", bits, shown, opened).join(F.broadcast(table), "gate").filter(fires).select("repo", "seq", "rule_id", "severity", "dimension", finding, "wrapped", "always")
    found = materialise(found, "repo-findings")
    checked = materialise(repos.select("repo", "language", opened).join(F.broadcast(behind), "gate").select("repo", "language", "rule_id", "wrapped").distinct(), "checked-rules")

    of_file = small(spark, [(i, 1000 + i, x[0], x[1], x[2], x[5].replace("%s", "%1$s")) for i, x in enumerate(by_path)], "hit int, seq int, rule_id string, severity string, dimension string, template string")
    by_file = rows.filter("kind = 'file'").select("repo", "path", F.explode("hits").alias("hit")).join(F.broadcast(of_file), "hit")
    by_file = by_file.select("repo", "seq", "rule_id", "severity", "dimension", F.expr("format_string(template, path)").alias("finding"))
    kinds = ru.SOURCE_RULES | ru.CROSS_RULES
    about = small(spark, [(k, 2000 + i, v[0], v[1]) for i, (k, v) in enumerate(kinds.items())], "rule_id string, seq int, severity string, dimension string")
    from_source = facts_rows.filter(F.col("kind").isin(*ru.SOURCE_RULES)).select("repo", F.col("kind").alias("rule_id"), F.col("text").alias("finding"), F.col("path").endswith(".py").alias("py"))
    from_cross = _cross(files, facts_rows, repos, facts).select("repo", "rule_id", "finding", F.lit(None).cast("boolean").alias("py"))
    parsed = from_source.union(from_cross).join(F.broadcast(about), "rule_id").select("repo", "seq", "rule_id", "severity", "dimension", "finding", "py")
    some = by_file.withColumn("py", F.lit(None).cast("boolean")).unionByName(parsed)
    some = some.join(checked.filter("wrapped").select("repo", "rule_id", "language"), ["repo", "rule_id"]).filter("rule_id NOT IN ('API-004', 'TEST-013') OR py = (language = 'python')")
    found = found.unionByName(some.select("repo", "seq", "rule_id", "severity", "dimension", "finding", F.lit(True).alias("wrapped"), F.lit(False).alias("always")))

    broke = facts_rows.filter("kind = 'CHECKER'").select("repo", "text")
    broke = (broke if unread is None else broke.union(unread)).join(repos.select("repo"), "repo", "left_semi").distinct()
    found = found.unionByName(broke.select("repo", F.lit(3000).alias("seq"), F.lit("CHECKER").alias("rule_id"), F.lit("WARN").alias("severity"), F.lit(ru.STRUCT).alias("dimension"), F.col("text").alias("finding"), F.lit(False).alias("wrapped"), F.lit(True).alias("always")))

    by_type = small(spark, [(k, x) for k, v in TYPE_SKIPS.items() for x in sorted(v)], "repo_type string, rule_id string")
    by_trait = small(spark, [(k, x) for k, v in TRAIT_SKIPS.items() for x in sorted(v)], "trait string, rule_id string")
    reason = lambda c: F.explode(c).alias("e")
    exempt = repos.select("repo", reason("exemptions")).select("repo", F.trim("e.rule").alias("rule_id"), F.nullif(F.trim("e.reason"), F.lit("")).alias("exempt")).filter("rule_id <> ''")
    defer = repos.select("repo", reason("deferrals")).select("repo", F.trim("e.rule").alias("rule_id"), F.nullif(F.trim("e.reason"), F.lit("")).alias("put_off")).filter("rule_id <> ''").groupBy("repo", "rule_id").agg(F.max("put_off").alias("put_off"))
    auto = repos.join(F.broadcast(by_type), "repo_type").select("repo", "rule_id")
    auto = auto.union(repos.select("repo", F.explode("traits").alias("trait")).join(F.broadcast(by_trait), "trait").select("repo", "rule_id")).withColumn("exempt", F.lit(None).cast("string"))
    skips = auto.unionByName(exempt).groupBy("repo", "rule_id").agg(F.max("exempt").alias("exempt")).join(defer, ["repo", "rule_id"], "left").select("repo", "rule_id", fd.skip_reason(F.col("exempt"), F.col("put_off")).alias("reason"), F.lit(True).alias("skipped"))

    kept = found.join(skips.drop("reason"), ["repo", "rule_id"], "left").filter("always OR skipped IS NULL").drop("skipped")
    told = checked.filter("wrapped").select("repo", "rule_id").join(skips.filter("reason IS NOT NULL"), ["repo", "rule_id"])
    told = told.select("repo", F.lit(0).alias("seq"), "rule_id", F.lit("INFO").alias("severity"), F.lit(ru.STRUCT).alias("dimension"), F.concat(F.lit("Skipped: "), "reason").alias("finding"), F.lit(True).alias("wrapped"), F.lit(False).alias("always"))
    later = defer.join(skips, ["repo", "rule_id"], "left_anti").select("repo", "rule_id", F.lit(True).alias("later"))
    rows = kept.join(later, ["repo", "rule_id"], "left").withColumn("deferred", F.coalesce(F.col("later") & F.col("wrapped"), F.lit(False)))
    rows = rows.withColumn("severity", F.when(F.col("deferred"), "INFO").otherwise(F.col("severity"))).drop("later").withColumn("told", F.lit(False)).unionByName(told.withColumn("deferred", F.lit(False)).withColumn("told", F.lit(True)))
    final = fd.supersede(rows).select("repo", "seq", "rule_id", F.col("rule_id").alias("violation_id"), "severity", "dimension", "finding", F.when(F.col("told"), F.lit(None)).otherwise(advice(F.col("rule_id"))).alias("suggestion"), "deferred")
    return final, checked.select("repo", "rule_id").distinct()
