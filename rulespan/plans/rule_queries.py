"""The rule engine as queries: all rules on trees made from documents, with SQL for all but those that need a parse,
and the rules that need one on the tables' rows as modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .engine import REPO_TYPES, TRAIT_SKIPS, TYPE_SKIPS, evaluate

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

# --- trees ------------------------------------------------------------------------------------------------------
# Each document is a file of a repository, four times: the path follows from its number, the content is the whole text
# and about half of the lines that matter at that path. The same expression makes the files in Spark and in DuckDB.

_TREE = {
    "README.md": ("input source folder", "output /v1/", "uv sync", "pre-commit install", "pre-commit run", "uv run pytest", "prereq", "pnpm install", "pnpm dev", "pnpm test", "pnpm build", ".env.example", "pages.dev", "app other"),
    "CHANGELOG.md": ("## 1.2.3", "## Unreleased"),
    ".releaserc.json": ("{}",),
    ".env.example": ("HEALTHCHECKS_URL_X=1", "PREFECT_API_URL=2", "SENTRY_DSN=3"),
    "pyproject.toml": ("[tool.uv]", "[tool.ruff]", 'requires-python = ">=3.11"', "hatchling", "line-length = 88", "sentry-sdk", 'name = "app"', "common-python-utils", "fastapi", "sqlalchemy", "asyncpg", "respx", "[tool.mypy]", "[tool.pytest.ini_options]", "prefect", "pymysql"),
    "package.json": ("common-typescript-utils", "astro config", '"tailwindcss"', "styled-components", '"typescript"', "webpack", "@radix-ui/", '"react-hook-form"', '"zod"', "hono", '"mysql2"', "drizzle-orm", "@clerk", '"astro"'),
    ".github/workflows/ci.yml": ("semantic-release", "fetch-depth: 0", "npm install --no-save", "pytest --cov", "mypy", "push: main", "alembic upgrade", "drizzle-kit push", "gh-pages", "wrangler pages", "repository_dispatch", "prefect deploy"),
    ".github/workflows/deploy.yaml": ("schedule", "api.prefect.cloud", '"/v1/trigger', "repository_dispatch", "/dispatches curl "),
    "src/app/__init__.py": ("app other",),
    "src/app/main.py": ("import shutil", "except X", "move(", "FAILED_", "dedup", "possible_duplicate_", "HEALTHCHECKS_URL_", "healthchecks.io", "pipeline_eval", "work_pool_name", "prefect.serve(", "run_deployment", "@flow", "apscheduler", "verify_token", "CORSMiddleware", "CORS_ORIGINS", "def health /health", "common_python_utils", "sentry_sdk", "sqlalchemy", "create_engine(", "create_async_engine(", "from sqlalchemy.orm import Session", "AsyncSession"),
    "src/app/auth.py": ("common_python_utils", "import logging", "sk-abcdefghijklmnop0123", 'X-Internal-API-Key', '"/v1/ httpx', "jwt"),
    "src/app/Bad-Name.py": ("session.add(", "merge(", "INSERT INTO t", "ON CONFLICT", "files().delete(", "trashed update files()", "os.remove(input_path)", "http://localhost", ".json()[", "BaseModel", "google-app-script-trigger", "gh workflow run", "@router.get(", "response_model="),
    "src/index.ts": ("cors(", "/health", "Sentry.init", "common-typescript-utils", "console.log(", "c.json(", "success("),
    "src/form.tsx": ("<form", "password = \"x\""),
    "src/page.astro": ("fetch(",),
    "src/components/ui/x.tsx": ("x",),
    "tests/test_app.py": ("normalization", "dedup", "shape", "raises", "persist", "archive", "httpx.get(", "respx.mock"),
    "tests/conftest.py": ("DATABASE_URL", "rollback fixture"),
    "docs/decisions/ADR-001.md": ("x",), "docs/decisions/notes.md": ("x",), "prefect.yaml": ("work_pool",), "requirements.txt": ("prefect", "motor"), "astro.config.mjs": ("@astrojs/tailwind",), "tailwind.config.js": ("x",),
    "index.yaml": ("version: 1", "updated: x"), "uv.lock": ("x",), ".pre-commit-config.yaml": ("x",), "pnpm-lock.yaml": ("x",), "yarn.lock": ("x",), "package-lock.json": ("x",), "vercel.json": ("x",), "netlify.toml": ("x",), "VERSION": ("1",), "evaluator.yaml": ("x",),
    "tsconfig.json": ("x",), "railway.toml": ("x",), ".env.local": ("x",), "setup.py": ("x",),
}
_N = len(_TREE)
_DRAW = "((repo_n * 31 + {j} * 17 + {k} * 7) * 2654435 % 1000003) % {n}"


def _lines(j: int, lines: tuple[str, ...]) -> str:
    return " || ".join(["coalesce(text, '')", *(f"CASE WHEN {_DRAW.format(j=j, k=k, n=2)} = 0 THEN chr(10) || '{x}' ELSE '' END" for k, x in enumerate(lines))])


_PATH = "CASE nth " + " ".join(f"WHEN {j} THEN '{p}'" for j, p in enumerate(_TREE)) + " END"
_CONTENT = "CASE nth " + " ".join(f"WHEN {j} THEN {_lines(j, x)}" for j, x in enumerate(_TREE.values())) + " END"
_THERE = _DRAW.format(j="nth", k=99, n=5) + " <> 0"
_MADE = f"SELECT doc_id, text, doc_id % {_N} AS nth, CAST(floor(doc_id / {_N}) AS BIGINT) * 4 + v AS repo_n FROM documents"
#: repo_n -> the columns of a repository; text of both dialects.
_REPO = {
    "repo": "concat('r', repo_n)", "name": "CASE WHEN repo_n % 3 = 1 THEN 'app' ELSE concat('r', repo_n) END", "language": "CASE WHEN repo_n % 3 = 0 THEN 'typescript' ELSE 'python' END",
    "repo_type": "CASE repo_n % 8 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(REPO_TYPES)) + " END", "root": "CASE WHEN repo_n % 7 = 1 THEN concat('r', repo_n - 1) END", "standards_age_days": "CAST(repo_n % 200 AS INT)",
}


def _tree(t) -> tuple[DataFrame, DataFrame]:
    made = t.documents.select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("v"))
    made = made.selectExpr("text", f"doc_id % {_N} AS nth", f"CAST(floor(doc_id / {_N}) AS BIGINT) * 4 + v AS repo_n")
    files = made.filter(_THERE).selectExpr("concat('r', repo_n) AS repo", f"{_PATH} AS path", f"{_CONTENT} AS content")
    pairs = lambda when, items: F.expr(f"CASE WHEN {when} THEN array({items}) ELSE array() END").cast("array<struct<rule:string,reason:string>>")
    repos = made.select("repo_n").distinct().select(
        *(F.expr(x).alias(n) for n, x in _REPO.items()), F.expr("CASE WHEN repo_n % 5 = 0 THEN array('multi-flow', 'logger-primitive') WHEN repo_n % 5 = 1 THEN array('cloudflare-pages', 'no-such') ELSE array() END").cast("array<string>").alias("traits"),
        pairs("repo_n % 6 = 0", "struct('DOC-001', 'no readers'), struct('DOC-004', '')").alias("exemptions"), pairs("repo_n % 6 = 1", "struct('DOC-003', 'later'), struct('XSTACK-001', 'soon')").alias("deferrals"),
    )
    return files, repos


# --- SQL --------------------------------------------------------------------------------------------------------
# Written from the rules' statements: a column of flags by repository, then a line for each finding.

_FLAGS: list[str] = []
PYP, PKG, RM, ENV, CI = ("path = 'pyproject.toml'", "path = 'package.json'", "path = 'README.md'", "path = '.env.example'", "path = '.github/workflows/ci.yml'")
WF, PY, TS, TEST = "regexp_matches(path, '^[.]github/workflows/.*[.]ya?ml$')", "regexp_matches(path, '^src/.*[.]py$')", "regexp_matches(path, '^src/.*[.]tsx?$')", "regexp_matches(path, '^tests/(.*/)?test_[^/]*[.]py$')"


def _flag(test: str, of: str = "o") -> str:
    if test not in _FLAGS:
        _FLAGS.append(test)
    return f"coalesce({of}.f{_FLAGS.index(test)}, false)"


def _has(*paths: str, of: str = "o") -> str:
    return _flag("path IN (" + ", ".join(f"'{p}'" for p in paths) + ")", of)


def _in(folder: str) -> str:
    return _flag(f"starts_with(path, '{folder}/')")


def _t(scope: str, *words: str, low: bool = False, of: str = "o") -> str:
    return "(" + " OR ".join(_flag(f"{scope} AND contains({'lower(content)' if low else 'content'}, '{w}')", of) for w in words) + ")"


def _re(scope: str, pattern: str) -> str:
    return _flag(f"{scope} AND regexp_matches(content, '{pattern}')")


def _both(make: Callable[[str], str]) -> str:
    return f"({make('o')} OR {make('p')})"


def _first(scope: str, words: tuple[str, ...], text: Callable[[str], str]) -> tuple[str, str]:
    return _t(scope, *words, low=True), "CASE " + " ".join(f"WHEN {_t(scope, w, low=True)} THEN '{text(w)}'" for w in words) + " END"


def _rules() -> list[tuple]:
    """(rule, severity, dimension, gate, test, SQL of the text[, wrapped, always])"""
    st, docs, cd, pipe, test, cover, cross = "structural_conformance", "documentation_coverage", "cd_readiness", "pipeline_consistency", "testing_coverage", "test_coverage", "cross_repo_coherence"
    py, cog, run, apy, ats, pcog = "(is_python AND NOT is_frontend)", "(is_cog OR is_trigger)", "(is_cog OR is_trigger OR is_api)", "(is_api AND language = 'python')", "(is_api AND language <> 'python')", "is_cog"
    q, src, tests, proj, root = lambda s: "'" + s.replace("'", "''") + "'", _in("src"), _in("tests"), _has("pyproject.toml"), "r.root IS NOT NULL"
    any_doc = lambda p: _both(lambda of: _has(p, of=of))
    at_root = lambda make: f"(CASE WHEN {root} THEN {make('p')} ELSE {make('o')} END)"
    out: list[tuple] = []
    add = lambda *a: out.append(a)
    signals = "(" + " + ".join(f"CAST(CASE WHEN {_has('README.md')} THEN {_t(RM, w, low=True)} ELSE {_t(RM, w, low=True, of='p')} END AS INT)" for w in ("input", "output", "source folder", "drive", "endpoint", "produces", "writes to", "openapi", "/v1/")) + ")"
    add("DOC-001", "ERROR", docs, "true", f"NOT {any_doc('README.md')}", q("README.md is absent."))
    add("DOC-002", "WARN", docs, "true", f"{any_doc('README.md')} AND {signals} < 2", q("README does not clearly describe data inputs and outputs."))
    add("DOC-003", "WARN", docs, "true", f"NOT {any_doc('CHANGELOG.md')}", q("CHANGELOG.md is absent."))
    add("VER-003", "ERROR", cd, "true", f"NOT {any_doc('.releaserc.json')}", q(".releaserc.json is absent."))
    add("DOC-009", "WARN", docs, "true", "project <> '' AND o.package IS NOT NULL AND replace(project, '-', '_') <> o.package AND NOT (contains(coalesce(init, ''), lower(project)) AND contains(coalesce(init, ''), lower(o.package)) AND contains(coalesce(o.readme, ''), lower(project)) AND contains(coalesce(o.readme, ''), lower(o.package)))", q("Split package identity is not documented across __init__.py and README."))
    add("DOC-004", "WARN", docs, "repo_type <> 'shared-library'", f"NOT ({_has('.env.example')} OR {_has('.env.example', of='p')})", q(".env.example is absent."))
    add("PY-008", "WARN", st, py, f"NOT {_has('.pre-commit-config.yaml')}", q(".pre-commit-config.yaml is absent."))
    add("PY-005", "ERROR", st, py, f"NOT {src}", q("src/ directory is absent — flat layout detected."))
    for f in ("setup.py", "requirements.txt"):
        add("PY-007", "WARN", st, py, _has(f), q(f"{f} found — pyproject.toml should be the single source of truth."))
    add("PY-007", "ERROR", st, py, f"NOT {proj}", q("pyproject.toml is absent."), False, True)
    for rule, sev, dim, bad, text in (
        ("PY-001", "WARN", st, f"NOT {_has('uv.lock')} AND NOT {_t(PYP, '[tool.uv]')}", "No uv.lock or [tool.uv] found — uv may not be in use."), ("PY-002", "WARN", st, f"NOT {_t(PYP, '[tool.ruff]')}", "[tool.ruff] section absent from pyproject.toml."),
        ("PY-003", "WARN", st, f"""NOT {_t(PYP, 'requires-python = ">=3.11"', '>=3.12')}""", "Python minimum version may be below 3.11."), ("PY-009", "INFO", st, f"NOT {_t(PYP, 'hatchling')}", "hatchling not found as build backend."),
        ("PY-010", "INFO", st, f"NOT {_t(PYP, 'line-length = 88')}", "ruff line-length is not explicitly set to 88."), ("CD-002", "WARN", cd, f"NOT {_t(PYP, 'sentry-sdk')}", "sentry-sdk not found in pyproject.toml."),
    ):
        add(rule, sev, dim, py, f"{proj} AND {bad}", q(text), False, False)
    add("PY-011", "WARN", st, py, "project <> '' AND replace(project, '-', '_') <> replace(r.name, '-', '_')", "'Project name ''' || replace(project, '-', '_') || ''' does not match repo naming ''' || replace(r.name, '-', '_') || '''.'")
    add("PY-011", "WARN", st, py, "project <> '' AND o.package <> replace(project, '-', '_')", "'src package ''' || o.package || ''' does not match project name ''' || replace(project, '-', '_') || '''.'")
    add("PY-012", "WARN", st, py, f"{_t(PY, 'shutil', 'pathlib')} AND {_t(PY, 'except')} AND {_t(PY, 'move(', 'rename(')} AND NOT {_t(PY, 'FAILED_')}", q("File-processing exception paths do not use FAILED_ prefixing."))
    add("PY-013", "WARN", st, py, f"{_t(PY, 'dedup', 'duplicate', 'already exists', low=True)} AND NOT {_t(PY, 'possible_duplicate_', low=True)}", q("Deduplication logic present but possible_duplicate_ prefixing is missing."))
    add("PY-006", "ERROR", st, "(is_python AND repo_type <> 'shared-library')", f"{proj} AND NOT {_t(PYP, 'common-python-utils')}", q("common-python-utils not declared as a dependency."))
    add("CD-007", "WARN", cd, "is_trigger", f"NOT {_t(ENV, 'HEALTHCHECKS_URL_')} OR NOT ({_t(PY, 'HEALTHCHECKS_URL_')} OR {_t(PY, 'healthchecks', low=True)})", q("Trigger cog is missing Healthchecks.io integration signals."), False, True)
    add("VER-004", "ERROR", cd, "true", _re("path = 'CHANGELOG.md'", "(?m)^##\\s+\\d+[.]\\d+[.]\\d+"), q("CHANGELOG.md appears manually edited with non-semantic-release headers."))
    wide = "repo_type <> 'static-site'"
    add("XSTACK-001", "ERROR", cross, f"{wide} AND language = 'python'", f"NOT {_t(PYP, 'common-python-utils', low=True)}", q("common-python-utils is not declared for this Python service."))
    add("XSTACK-001", "ERROR", cross, f"{wide} AND language <> 'python'", f"NOT {_both(lambda of: _t(PKG, 'common-typescript-utils', low=True, of=of))}", q("common-typescript-utils is not declared for this TypeScript service."))
    std = "repo_type = 'standards-repo'"
    add("PRIN-009", "WARN", "standards_currency", std, "standards_age_days > 90", "'Standards repo appears stale (' || standards_age_days || ' days since last commit).'")
    add("META-001", "WARN", st, std, f"NOT {_t(WF, 'semantic-release', 'semantic_release', low=True)}", q("No GitHub Actions workflow references semantic-release."))
    add("META-001", "WARN", st, std, f"NOT {_has('.releaserc.json', '.releaserc.cjs', '.releaserc.yaml')}", q("Missing .releaserc.* configuration alongside semantic-release."))
    add("META-001", "WARN", st, std, "true", q("package.json lacks semantic-release wiring (script or dependency)."))  # no package.json here is JSON
    add("META-001", "WARN", st, std, f"NOT ({_t(WF, 'push:', low=True)} AND {_t(WF, 'main', low=True)})", q("No workflow appears to trigger on push to main."))
    for w in ("version", "updated"):
        add("META-002", "WARN", st, std, _re("path = 'index.yaml'", f"(?m)^{w}\\s*:"), q(f"index.yaml still declares a top-level {w}: field."))
    add("META-002", "WARN", st, std, _has("VERSION.txt", "VERSION", "version.txt"), q("Stray plaintext version file exists at repo root (VERSION)."))
    ci, in_ci = at_root(lambda of: _has(".github/workflows/ci.yml", of=of)), lambda *w: at_root(lambda of: _t(CI, *w, of=of))
    add("VER-003", "ERROR", cd, "true", f"NOT {ci}", q("ci.yml not found at .github/workflows/ci.yml."), False, True)
    for rule, words, text in (("VER-003", ("semantic-release",), "semantic-release not found in ci.yml."), ("VER-005", ("fetch-depth: 0",), "fetch-depth: 0 absent from ci.yml checkout step."), ("VER-006", ("npm install --no-save", "pnpm exec semantic-release", "pnpm run semantic-release", "pnpm add"), "npm install --no-save step absent from release job.")):
        add(rule, "ERROR", cd, "true", f"{ci} AND NOT {in_ci(*words)}", q(text), False, False)
    add("TEST-006", "WARN", test, "is_python", f"{_has('.github/workflows/ci.yml')} AND NOT {_t(CI, 'pytest --cov', 'pytest-cov')}", q("Coverage not measured in CI — pytest --cov not found in ci.yml."))
    add("TEST-007", "ERROR", test, "is_python", f"NOT {_t(PYP, 'respx', low=True)}", q("respx is absent from development dependencies."))
    add("TEST-007", "ERROR", test, "is_python", "raw_http IS NOT NULL", "'Raw HTTP calls found without respx.mock in ' || raw_http || '.'")
    add("TEST-012", "WARN", test, "is_python", f"{_t(PYP, '[tool.mypy]')} AND NOT {_t(WF, 'mypy', low=True)}", q("[tool.mypy] is configured but mypy is not run in CI workflows."))
    add("TEST-003", "ERROR", test, "is_python", f"NOT {tests}", q("tests/ directory is absent."), False, False)
    failing = ("malform", "failure", "fail", "error", "exception", "invalid", "raises", "bad_input", "boom", "continues", "loop_continues", "does_not_abort", "does_not_raise")
    add("TEST-003", "ERROR", test, "is_python", f"{tests} AND NOT {_t(TEST, *failing, low=True)}", q("No failure path test found."), False, False)
    add("TEST-005", "WARN", test, "is_python", f"{tests} AND {proj} AND NOT {_t(PYP, '[tool.pytest.ini_options]')}", q("[tool.pytest.ini_options] absent from pyproject.toml."), False, False)
    py_dod, hono, web = "((is_cog OR is_trigger) OR (is_api AND language = 'python'))", "(is_api AND language <> 'python')", "is_frontend"
    for gate, item, words in (
        *((py_dod, w, (w,)) for w in ("uv sync", "pre-commit install", "pre-commit run", "uv run pytest")), (py_dod, "python/uv prerequisites", ("prereq", "python", "uv")), *((hono, w, (w,)) for w in ("pnpm install", "pnpm dev", "pnpm test", "node")),
        (web, "pnpm install or npm install", ("pnpm install", "npm install")), (web, "pnpm build or npm run build", ("pnpm build", "npm run build")), (web, "pnpm dev or npm run dev or astro dev", ("pnpm dev", "npm run dev", "astro dev")), (web, ".env.example", (".env.example",)),
    ):
        add("DOC-013", "WARN", docs, gate, f"{_has('README.md')} AND NOT {_t(RM, *words, low=True)}", q(f"README Running locally is missing: {item}."), False, False)
    pkg = lambda *w: _t(PKG, *w, low=True)
    tw = _t("path IN ('astro.config.mjs', 'astro.config.ts')", "@astrojs/tailwind", low=True)
    add("FE-003", "WARN", st, web, f"""NOT ({pkg('"tailwindcss"')} OR {tw}) OR NOT ({_has('tailwind.config.js', 'tailwind.config.ts', 'tailwind.config.mjs')} OR {tw})""", q("Tailwind CSS setup is incomplete or absent."))
    add("FE-003", "WARN", st, web, pkg("styled-components", "emotion"), q("Alternative CSS-in-JS stack detected alongside/instead of Tailwind."))
    add("FE-001", "WARN", st, "repo_type = 'static-site'", f"""NOT {pkg('"astro"')} OR NOT {_has('astro.config.mjs', 'astro.config.ts')}""", q("Astro framework signals are missing for frontend site."))
    add("FE-002", "ERROR", st, "repo_type = 'react-app'", f"""NOT {pkg('"typescript"')} OR NOT {_has('tsconfig.json')}""", q("TypeScript setup missing for React web app."))
    add("FE-002", "ERROR", st, "repo_type = 'react-app'", *_first(PKG, ("webpack", "create-react-app", '"next"'), lambda w: f"Forbidden frontend stack signal found: {w}."))
    add("FE-004", "WARN", st, "repo_type = 'react-app'", f"NOT {pkg('@radix-ui/')} AND NOT {_in('src/components/ui')}", q("shadcn/ui signals not detected (no Radix deps and no src/components/ui)."))
    tsx = "regexp_matches(path, '^src/.*[.]tsx$')"
    add("FE-005", "WARN", st, "repo_type = 'react-app'", f"""{_t(tsx, '<form', '<Form')} AND NOT ({pkg('"react-hook-form"')} AND {pkg('"zod"')})""", q("Form components exist but react-hook-form and/or zod is missing."))
    for rule, w, text in (("TEST-001", "normalization", "No normalization test found."), ("TEST-002", "dedup", "No deduplication test found."), ("TEST-004", "shape", "No output shape test found.")):
        add(rule, "WARN", test, pcog, f"{tests} AND NOT {_t(TEST, w, low=True)}", q(text), False, False)
    evals = ("pipeline_eval", "post_evaluation", "/v1/evaluations", "evaluate_pipeline_run")
    add("PIPE-009", "WARN", pipe, pcog, f"{src} AND NOT {_t(PY, *evals)}", q("Pipeline cog source has no clear evaluation-step signal."))
    add("CD-015", "ERROR", cd, pcog, f"{src} AND {_t(PY, 'flow.deploy(', 'work_pool_name')}", q("work pool pattern detected — flow.deploy() or work_pool_name found."))
    add("CD-015", "ERROR", cd, pcog, f"""{src} AND {_t("path = 'prefect.yaml'", 'work_pool')}""", q("work_pool configuration found in prefect.yaml."))
    add("CD-015", "WARN", cd, pcog, f"{src} AND NOT {_t(PY, 'prefect.serve(', 'flow.serve(')}", q("No prefect.serve() call found in source — flow registration pattern missing or unverifiable."))
    prefect = _t("path IN ('pyproject.toml', 'requirements.txt', 'requirements/base.txt')", "prefect", low=True)
    add("PIPE-001", "WARN", pipe, cog, f"NOT {prefect}", q("Prefect is not declared as a dependency."))
    add("PIPE-001", "WARN", pipe, cog, f"{prefect} AND NOT {src}", q("src/ tree missing — cannot verify Prefect usage in application code."))
    add("PIPE-001", "WARN", pipe, "is_trigger", f"{prefect} AND {src} AND NOT {_t(PY, 'run_deployment')}", q("Trigger cog source does not reference run_deployment (Prefect deployment API)."))
    add("PIPE-001", "WARN", pipe, pcog, f"{prefect} AND {src} AND NOT {_t(PY, '@flow')}", q("Pipeline cog source has no @flow-decorated Prefect flow."))
    add("CD-005", "WARN", cd, cog, f"{prefect} AND NOT {_t(ENV, 'prefect_api_url', 'prefect_api_key', 'api.prefect.cloud', 'prefect_cloud', low=True)}", q("Prefect Cloud connection is not documented in .env.example (expected PREFECT_API_URL or equivalent)."))
    add("CD-005", "INFO", cd, cog, f"{prefect} AND {_t(PY, 'apscheduler', low=True)}", q("APScheduler is referenced — confirm it is only a local dev fallback, not the primary scheduler."))
    add("API-001", "WARN", st, "is_api", f"NOT {_has('railway.toml', 'railway.json', 'nixpacks.toml')}", q("Railway deployment configuration is missing (expected railway.toml, railway.json, or nixpacks.toml at repo root)."))
    req = "path IN ('pyproject.toml', 'requirements.txt')"
    add("API-001", "WARN", st, apy, f"NOT {_t(req, 'fastapi', low=True)}", q("FastAPI is not declared for this Python API service."))
    add("API-001", "WARN", st, ats, f"NOT {pkg('hono')}", q("Hono is not declared for this TypeScript API service."))
    stores = ("mysql", "mysqlclient", "pymysql", "aiosqlite", "sqlite3", "sqlalchemy[sqlite]", "mongodb", "motor", "pymongo", "dynamodb", "boto3")
    add("API-002", "ERROR", st, apy, *_first("path IN ('pyproject.toml', 'requirements.txt', 'requirements/base.txt', 'requirements/prod.txt')", stores, lambda w: f"Non-Postgres data-store client or driver signal detected (''{w}'')."))
    stores = ('"mysql"', '"mysql2"', '"sqlite3"', '"better-sqlite3"', '"mongodb"', '"mongoose"', '"redis"', '"ioredis"', '"dynamodb"')
    add("API-002", "ERROR", st, ats, *_first(PKG, stores, lambda w: f"Non-Postgres data-store dependency present ({w})."))
    big = f"({run} OR repo_type IN ('shared-library', 'standards-repo'))"
    add("DOC-005", "WARN", docs, big, f"loc >= 50 AND NOT {_in('docs/decisions')}", q("docs/decisions/ directory is missing for a non-trivial codebase."))
    add("DOC-005", "WARN", docs, big, f"""loc >= 50 AND {_in('docs/decisions')} AND NOT {_flag("regexp_matches(path, '^docs/decisions/ADR-[^/]*[.]md$')")}""", q("docs/decisions/ exists but no ADR-NNN-*.md files were found."))
    add("API-003", "WARN", st, apy, f"NOT {_t(PYP, 'sqlalchemy', low=True)}", q("api-service (Python) does not declare sqlalchemy in pyproject.toml."))
    add("API-003", "WARN", st, ats, f"NOT {pkg('drizzle-orm', 'prisma')}", q("api-service (TypeScript) does not declare drizzle-orm or prisma."))
    add("API-007", "WARN", st, apy, f"{src} AND NOT ({_t(PY, 'verify_token')} OR {_t(PY, 'clerk', low=True)})", q("api-service (Python) has no visible Clerk or verify_token usage."))
    add("API-007", "WARN", st, ats, f"NOT {_t(PKG, '@clerk', 'common-typescript-utils')}", q("api-service (TypeScript) has no Clerk SDK or common-typescript-utils dep."))
    add("API-009", "ERROR", st, apy, f"NOT {_t(PY, 'CORSMiddleware')}", q("api-service (Python) has no CORSMiddleware configuration."))
    add("API-009", "WARN", st, apy, f"{_t(PY, 'CORSMiddleware')} AND NOT {_t(PY, 'CORS_ORIGINS')}", q("api-service (Python) uses CORSMiddleware but CORS_ORIGINS env var is not referenced."))
    add("API-009", "ERROR", st, ats, f"""NOT {_t(TS, 'cors(', "from ''hono/cors''", 'from "hono/cors"')}""", q("api-service (TypeScript) has no cors() middleware import."))
    for gate, scope in ((apy, PY), (ats, TS)):
        add("API-010", "WARN", st, gate, f"""{src} AND NOT {_flag(f"{scope} AND contains(content, '/health') AND regexp_matches(content, 'def health|\"/health\"|''/health''')")}""", q("api-service has no visible GET /health endpoint."))
    any_ci, words_ci = any_doc(".github/workflows/ci.yml"), lambda *w: _both(lambda of: _t(CI, *w, of=of))
    add("API-011", "ERROR", st, "is_api", f"NOT {any_ci}", q("api-service has no .github/workflows/ci.yml — migration steps cannot be verified."))
    add("API-011", "ERROR", st, apy, f"{any_ci} AND NOT {words_ci('alembic upgrade')}", q("ci.yml has no 'alembic upgrade head' step."))
    add("API-011", "ERROR", st, ats, f"{any_ci} AND NOT {words_ci('drizzle-kit push', 'drizzle-kit migrate')}", q("ci.yml has no 'drizzle-kit push' or 'drizzle-kit migrate' step."))
    add("CD-010", "ERROR", st, cog, f"NOT {_t(ENV, 'HEALTHCHECKS_URL')} OR NOT {_t(PY, 'healthchecks.io', low=True)}", q("Layer 1 missing: no HEALTHCHECKS_URL env var or healthchecks.io ping in source."))
    add("CD-010", "ERROR", st, run, f"NOT {_t(PY, 'common_python_utils')}", q("Layer 2 missing: no common-python-utils logger usage."))
    add("CD-010", "ERROR", st, run, f"NOT {_t(PY, 'sentry_sdk')} OR NOT {_t(ENV, 'SENTRY_DSN')}", q("Layer 3 missing: no sentry_sdk.init() or SENTRY_DSN in .env.example."))
    static, gh = "repo_type = 'static-site'", _t(CI, "gh-pages")
    add("CD-014", "WARN", st, static, _has("netlify.toml"), q("Static site has netlify.toml — expected Cloudflare Pages deployment."))
    add("CD-014", "WARN", st, static, _has("vercel.json"), q("Static site has vercel.json — expected Cloudflare Pages deployment."))
    add("CD-014", "WARN", st, static, gh, q("Static site uses GitHub Pages deploy — expected Cloudflare Pages."))
    add("CD-014", "WARN", st, static, f"NOT ({_t(CI, 'cloudflare/pages-action', 'wrangler pages')} OR {_t(RM, 'pages.dev', 'Cloudflare Pages')}) AND NOT {_has('netlify.toml')} AND NOT {_has('vercel.json')} AND NOT {gh}", q("No deployment target detected (no Cloudflare Pages markers in ci.yml or README)."))
    add("MONO-001", "ERROR", cross, f"language = 'typescript' AND {root}", f"NOT {_both(lambda of: _t(PKG, 'common-typescript-utils', of=of))}", q("Monorepo: common-typescript-utils absent from both workspace root and per-app package.json."))
    add("MONO-002", "WARN", st, root, f"NOT {_has('.github/workflows/ci.yml', of='p')}", q("Monorepo root missing .github/workflows/ci.yml."))
    add("PIPE-011", "WARN", pipe, pcog, f"{src} AND NOT {_t(PY, 'pipeline_eval', 'evaluation_client', '/v1/evaluations', '/v1/pipeline_evaluations', 'PipelineEvaluator')}", q("No AI evaluation task found in pipeline-cog source."))
    for lang, a, b, lib in (("= 'python'", _t(PY, "sentry_sdk"), _t(PY, "common_python_utils"), "common-python-utils"), ("<> 'python'", _t(TS, "@sentry/", "Sentry.init"), _t(TS, "common-typescript-utils"), "common-typescript-utils")):
        add("PRIN-005", "ERROR", "principles", f"{run} AND language {lang}", f"{src} AND NOT ({a} AND {b})", f"'Production service missing: ' || concat_ws(', ', CASE WHEN NOT {a} THEN 'Sentry' END, CASE WHEN NOT {b} THEN 'structured logging ({lib})' END) || '.'")
    sql = f"{src} AND ({_t(PY, 'sqlalchemy', low=True)} OR {_t(PYP, 'sqlalchemy', low=True)})"
    add("PY-015", "ERROR", st, apy, f"{sql} AND {_t(PY, 'from sqlalchemy.orm import Session', 'from sqlalchemy.orm import sessionmaker')} AND NOT {_t(PY, 'AsyncSession', 'async_sessionmaker')}", q("Sync Session/sessionmaker imported without AsyncSession/async_sessionmaker counterpart."))
    add("PY-015", "ERROR", st, apy, f"{sql} AND {_t(PY, 'create_engine(')} AND NOT {_t(PY, 'create_async_engine(')}", q("Sync create_engine() used without create_async_engine() counterpart."))
    add("PY-015", "ERROR", st, apy, f"{sql} AND {_t(PYP, 'sqlalchemy', low=True)} AND NOT {_t(PYP, 'asyncpg', low=True)}", q("sqlalchemy declared without asyncpg in pyproject.toml."))
    conf = "regexp_matches(path, '^tests/(.*/)?conftest[.]py$')"
    db = f"{src} AND {tests} AND {_t(PY, 'sqlalchemy', low=True)}"
    add("TEST-009", "ERROR", cover, apy, f"{db} AND NOT {_flag(conf)}", q("SQLAlchemy repo has no conftest.py with DB test fixtures."))
    add("TEST-009", "ERROR", cover, apy, f"{db} AND {_flag(conf)} AND NOT ({_t(conf, 'DATABASE_URL', 'sqlite:///:memory:')} OR ({_t(conf, 'rollback', low=True)} AND {_t(conf, 'fixture', low=True)}))", q("conftest.py has no DB test fixture pattern (DATABASE_URL override, in-memory SQLite, or rollback fixture)."))
    gaps = [(_t(TEST, *w, low=True), label) for label, w in (("TEST-001 (normalization)", ("normalize", "normalise", "normalization")), ("TEST-002 (deduplication)", ("dedup", "deduplication")), ("TEST-003 (persistence)", ("persist", "upsert", "session.commit")), ("TEST-004 (archival)", ("archive", "archival", "move")))]
    add("TEST-GAP-001", "INFO", cover, "(is_cog OR is_api)", f"{tests} AND NOT ({' AND '.join(g for g, _ in gaps)})", "'Missing critical-path tests: ' || concat_ws(', ', " + ", ".join(f"CASE WHEN NOT {g} THEN '{x}' END" for g, x in gaps) + ") || '.'")
    pnpm, lock = "(repo_type = 'react-app' OR (is_api AND language = 'typescript'))", lambda f: at_root(lambda of: _has(f, of=of))
    add("XSTACK-003", "ERROR", st, pnpm, lock("package-lock.json"), q("package-lock.json found — npm is not the approved package manager for TypeScript projects."))
    add("XSTACK-003", "ERROR", st, pnpm, lock("yarn.lock"), q("yarn.lock found — yarn is not the approved package manager for TypeScript projects."))
    add("XSTACK-003", "WARN", st, pnpm, f"NOT {lock('pnpm-lock.yaml')}", q("pnpm-lock.yaml not found — pnpm may not be in use."))
    for rule, sev, dim, col, text, gate in (("CD-009", "WARN", cd, "hand_logging", "Hand-rolled logging detected in %.", "true"), ("CD-009", "WARN", cd, "console_log", "console.log used as primary logger in %.", "true"), ("CD-011", "ERROR", cd, "env_file", "Committed env file detected: %.", "true"), ("CD-011", "ERROR", cd, "secret_file", "Potential hardcoded secret in %.", "true"), ("XSTACK-002", "WARN", st, "bare_route", "FastAPI route missing response_model= in %.", apy), ("XSTACK-002", "WARN", st, "bare_json", "Hono handler uses raw c.json without success()/error() helper (%).", ats)):
        add(rule, sev, dim, gate, f"{col} IS NOT NULL", f"replace('{text}', '%', {col})")
    add("EVAL-008", "WARN", st, "true", f"NOT {_has('evaluator.yaml')}", q("evaluator.yaml is absent from repo root."), False, True)
    return out


def _file_rules() -> list[tuple[str, str, str, str, str, str]]:
    st, cd, pipe, cross, run, low = "structural_conformance", "cd_readiness", "pipeline_consistency", "cross_repo_coherence", "(is_cog OR is_trigger OR is_api)", "lower(content)"
    has = lambda *w, t="content": "(" + " OR ".join(f"contains({t}, '{x}')" for x in w) + ")"
    relay = f"({has('prefect deployment run', 'prefect deploy', 'run_deployment(', 'npx prefect', t=low)} OR ({has('/dispatches')} AND {has('curl ', 'httpx.', 'requests.', t=low)}))"
    sends = "regexp_matches(content, '(?i)(httpx|requests)[.](post|put)[(][^)]*api[.]github[.]com/[^\"'')]+/dispatches')"
    src, code = "regexp_matches(path, '^src/.*[.](py|ts)$')", "regexp_matches(path, '[.](py|tsx?|js)$') AND NOT contains(path, 'tests/') AND NOT contains(path, '.github/workflows/')"
    return [
        ("FE-007", "ERROR", st, "true", f"{PY} AND regexp_matches(content, 'https?://(localhost|[^\\n]*railway[.]app|[^\\n]*up[.]railway[.]app)')", "Hardcoded API URL found in %."),
        ("PY-011", "WARN", st, "(is_python AND NOT is_frontend)", f"{PY} AND NOT regexp_matches(path, '/[a-z0-9_]+[.]py$')", "Non-snake_case Python module filename: %."),
        ("CD-006", "WARN", st, run, f"{WF} AND {has('repository_dispatch', t=low)} AND {relay}", "repository_dispatch workflow appears to relay into automation (%)."),
        ("CD-006", "WARN", st, run, f"{WF} AND {has('schedule', 'cron:', t=low)} AND {has('api.prefect.cloud', t=low)}", "Scheduled workflow references Prefect Cloud API (%)."),
        ("CD-006", "WARN", st, run, f"{WF} AND regexp_matches(content, '[''\"]/v1/(trigger|runs)')", "Workflow references internal trigger HTTP path (%)."),
        ("CD-006", "WARN", st, run, f"{PY} AND NOT contains(path, 'tests/') AND {sends}", "Python source posts to GitHub dispatches API (%)."),
        ("PIPE-008", "WARN", st, "is_cog", f"{WF} AND {has('repository_dispatch', t=low)} AND {relay}", "repository_dispatch in GitHub workflow with app-triggering steps (%)."),
        ("PIPE-008", "WARN", st, "is_cog", f"{code} AND {sends}", "Active HTTP client call to GitHub dispatches API (%)."),
        ("PIPE-008", "WARN", st, "is_cog", f"{code} AND {has('google-app-script-trigger')}", "Retired google-app-script-trigger reference in %."),
        ("PIPE-008", "WARN", st, "is_cog", f"{code} AND regexp_matches({low}, '\\bgh\\s+workflow\\s+run\\b')", "gh workflow run invocation in %."),
        ("CD-012", "WARN", cd, f"({run} AND language = 'python')", f"{PY} AND {has('X-Internal-API-Key')}", "X-Internal-API-Key header referenced in %."),
        ("CD-012", "WARN", cd, f"({run} AND language = 'python')", f"""{PY} AND NOT {has('X-Internal-API-Key')} AND {has('"/v1/')} AND {has('httpx')} AND NOT regexp_matches({low}, 'clerk|jwt|get_token|authenticate')""", "Internal HTTP client without Clerk/JWT acquisition pattern (%)."),
        ("PIPE-002", "WARN", pipe, "is_cog", f"{PY} AND {has('session.add(')} AND NOT {has('on_conflict', t=low)} AND NOT {has('merge(')}", "session.add() without merge()/on_conflict in %."),
        ("PIPE-002", "WARN", pipe, "is_cog", f"{PY} AND regexp_matches(content, '(?i)\\bINSERT\\s+INTO\\b') AND NOT {has('on conflict', t=low)}", "Raw INSERT without ON CONFLICT in %."),
        ("PIPE-005", "WARN", pipe, "is_cog", f"{src} AND {has('files().delete(')}", "Drive files().delete() referenced in %."),
        ("PIPE-005", "WARN", pipe, "is_cog", f"{src} AND {has('trashed', t=low)} AND {has('update', t=low)} AND {has('files()')}", "Potential Drive trash update on input file in %."),
        ("PIPE-005", "WARN", pipe, "is_cog", f"{src} AND regexp_matches(content, 'os[.](remove|unlink)[(]|shutil[.]rmtree[(]') AND regexp_matches(content, '\\b(input_path|input_file|source_path|src_path|local_path)\\b')", "os.remove/unlink/rmtree may target input paths (%)."),
        ("AUTH-002", "WARN", cross, "(is_api AND language = 'python')", f"regexp_matches(path, '^src/(.*/)?auth[.]py$') AND NOT {has('common-python-utils', 'common_python_utils')}", "%: auth.py has no reference to common-python-utils."),
        ("PY-004", "WARN", st, "(language = 'python' AND (is_cog OR is_api OR repo_type = 'shared-library'))", f"{PY} AND regexp_matches(content, '[.]json[(][)]\\[|csv[.]DictReader|csv[.]reader') AND NOT {has('BaseModel')}", "%: accesses external data (JSON/CSV) without a Pydantic BaseModel."),
    ]


def _engine_sql() -> str:
    rules, by_file = _rules(), _file_rules()
    firsts = {
        "hand_logging": f"{PY} AND (contains(content, 'import logging') OR contains(content, 'logging.basicConfig') OR contains(content, 'logging.getLogger'))", "console_log": f"{TS} AND contains(content, 'console.log(')", "env_file": "regexp_matches(path, '(^|/)[.]env[^/]*$') AND NOT regexp_matches(path, '(^|/)[.]env[.]example$')",
        "secret_file": "regexp_matches(path, '^src/.*[.](py|tsx?)$') AND regexp_matches(content, 'sk-[A-Za-z0-9]{16,}|Bearer\\s+[A-Za-z0-9]{20,}|(?i:password\\s*=\\s*[''\"][^''\"]+[''\"])|(?i:api[_-]?key\\s*=\\s*[''\"][^''\"]+[''\"])')",
        "bare_route": f"{PY} AND regexp_matches(content, '@(?:router|app)[.](get|post|put|delete|patch)\\s*[(]') AND NOT contains(content, 'response_model=')", "bare_json": f"{TS} AND regexp_matches(content, '\\bc[.]json\\s*[(]') AND NOT contains(content, 'success(') AND NOT regexp_matches(content, '(?i)from\\s+[''\"][^''\"]*success')",
        "raw_http": f"{TEST} AND (contains(content, 'httpx.get(') OR contains(content, 'httpx.post(') OR contains(content, 'requests.get(') OR contains(content, 'requests.post(')) AND NOT contains(content, 'respx.mock')",
    }
    line = lambda r: (r[6] if len(r) > 6 else True, r[7] if len(r) > 7 else False)
    # one pass over repositories, and one over files: a list of the rows that hold, not a branch of a union for each
    held = lambda cases: "unnest(list_filter([" + ", ".join(cases) + "], lambda x: x IS NOT NULL), recursive := true)"
    row = lambda when, rule, sev, dim, text, wrap, always: f"CASE WHEN {when} THEN {{'rule_id': '{rule}', 'severity': '{sev}', 'dimension': '{dim}', 'finding': {text}, 'wrapped': {wrap}, 'always': {always}}} END"
    found = f"SELECT repo, {held([row(f'({r[3]}) AND ({r[4]})', r[0], r[1], r[2], f'CAST({r[5]} AS VARCHAR)', *line(r)) for r in rules])} FROM j r"
    quote = "replace('{}', '%', path)".format
    of_file = f"SELECT repo, {held([row(f'({gate}) AND {test}', rule, sev, dim, quote(text), True, False) for rule, sev, dim, gate, test, text in by_file])} FROM f JOIN r USING (repo)"
    wrapped: dict[str, list[str]] = {}
    for rule, gate in [*((r[0], r[3]) for r in rules if line(r)[0]), *((r[0], r[3]) for r in by_file)]:
        wrapped.setdefault(rule, []).append(f"({gate})")
    cases = [f"CASE WHEN {' OR '.join(dict.fromkeys(gates))} THEN '{rule}' END" for rule, gates in wrapped.items()]
    checked = f"SELECT repo, unnest(list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL)) AS rule_id FROM r"
    table = lambda d: "(VALUES " + ", ".join(f"('{k}', '{x}')" for k, v in d.items() for x in sorted(v)) + ")"
    return (
        f"WITH m AS (SELECT doc_id, text, doc_id % {_N} AS nth, CAST(floor(doc_id / {_N}) AS BIGINT) * 4 + v AS repo_n FROM documents, range(4) g(v)), f AS MATERIALIZED (SELECT concat('r', repo_n) AS repo, {_PATH} AS path, {_CONTENT} AS content FROM m WHERE {_THERE}), "
        f"r AS MATERIALIZED (SELECT *, repo_type IN ('pipeline-cog', 'evaluator-service') AS is_cog, repo_type = 'trigger-cog' AS is_trigger, repo_type = 'api-service' AS is_api, repo_type IN ('static-site', 'react-app') AS is_frontend, language = 'python' AND repo_type IN ('pipeline-cog', 'trigger-cog', 'api-service', 'shared-library', 'evaluator-service') AS is_python FROM (SELECT repo_n, {', '.join(f'{x} AS {n}' for n, x in _REPO.items())} FROM (SELECT DISTINCT repo_n FROM m))), "
        f"a AS MATERIALIZED (SELECT repo, {', '.join(f'bool_or({t}) AS f{i}' for i, t in enumerate(_FLAGS))}, {', '.join(f'min(path) FILTER ({t}) AS {n}' for n, t in firsts.items())}, max(regexp_extract(content, '(?m)^\\s*name\\s*=\\s*\"([^\"]+)\"', 1)) FILTER (path = 'pyproject.toml') AS project, max(lower(content)) FILTER (path = 'README.md') AS readme, min(regexp_extract(path, '^src/([^/]+)/', 1)) FILTER (regexp_matches(path, '^src/[^/]+/')) AS package, "
        "CAST(sum(len(string_split(regexp_replace(content, '\\n$', ''), chr(10)))) FILTER (regexp_matches(path, '^src/.*[.](py|tsx?|m?js)$')) AS BIGINT) AS loc FROM f GROUP BY repo), "
        "i AS MATERIALIZED (SELECT repo, regexp_extract(path, '^src/([^/]+)/', 1) AS package, lower(content) AS init FROM f WHERE regexp_matches(path, '^src/[^/]+/__init__[.]py$')), "
        f"j AS MATERIALIZED (SELECT r.*, o, p, coalesce(o.project, '') AS project, coalesce(o.loc, 0) AS loc, i.init AS init, {', '.join(f'o.{c} AS {c}' for c in firsts)} FROM r LEFT JOIN a o ON o.repo = r.repo LEFT JOIN a p ON p.repo = r.root LEFT JOIN i ON i.repo = r.repo AND i.package = o.package), "
        f"found AS MATERIALIZED ({found} UNION ALL {of_file}), checked AS ({checked}), ex AS (SELECT repo, x.rule, x.reason FROM r, (VALUES ('DOC-001', 'no readers'), ('DOC-004', NULL)) x(rule, reason) WHERE repo_n % 6 = 0), de AS (SELECT repo, x.rule, x.reason FROM r, (VALUES ('DOC-003', 'later'), ('XSTACK-001', 'soon')) x(rule, reason) WHERE repo_n % 6 = 1), "
        f"skip AS MATERIALIZED (SELECT repo, rule_id, max(reason) AS reason FROM (SELECT repo, rule_id, NULL AS reason FROM r JOIN {table(TYPE_SKIPS)} s(kind, rule_id) ON kind = repo_type UNION ALL SELECT repo, rule_id, NULL FROM r JOIN {table(TRAIT_SKIPS)} s(trait, rule_id) ON (repo_n % 5 = 0 AND trait IN ('multi-flow', 'logger-primitive')) OR (repo_n % 5 = 1 AND trait = 'cloudflare-pages') UNION ALL SELECT * FROM ex) GROUP BY ALL), "
        "kept AS (SELECT found.* FROM found LEFT JOIN skip USING (repo, rule_id) WHERE always OR skip.repo IS NULL), later AS (SELECT de.* FROM de LEFT JOIN skip ON skip.repo = de.repo AND skip.rule_id = de.rule WHERE skip.repo IS NULL), "
        "told AS (SELECT checked.repo, checked.rule_id, 'INFO' AS severity, 'structural_conformance' AS dimension, 'Skipped: ' || coalesce(skip.reason, '[DEFERRED] ' || de.reason) AS finding, false AS deferred FROM checked JOIN skip USING (repo, rule_id) LEFT JOIN de ON de.repo = checked.repo AND de.rule = checked.rule_id WHERE coalesce(skip.reason, de.reason) IS NOT NULL), "
        "rows_ AS MATERIALIZED (SELECT kept.repo, rule_id, CASE WHEN wrapped AND later.repo IS NOT NULL THEN 'INFO' ELSE severity END AS severity, dimension, finding, wrapped AND later.repo IS NOT NULL AS deferred FROM kept LEFT JOIN later ON later.repo = kept.repo AND later.rule = rule_id UNION ALL SELECT * FROM told) "
        "SELECT repo, rule_id, severity, dimension, finding, deferred FROM rows_ x WHERE NOT (rule_id IN ('CD-002', 'CD-009') AND EXISTS (SELECT 1 FROM rows_ y WHERE y.repo = x.repo AND y.rule_id = 'CD-010'))"
    )


def q_rules_engine(t) -> DataFrame:
    """All rules on all trees; the rows of those that need a parse are in the queries q_ast_*."""
    from ..operators import rules as ru

    files, repos = _tree(t)
    parsed = [*ru.SOURCE_RULES, *ru.CROSS_RULES, "FE-006", "CHECKER"]
    return evaluate(files, repos, mono_rules=True)[0].filter(~F.col("rule_id").isin(*parsed)).select("repo", "rule_id", "severity", "dimension", "finding", "deferred")


QUERIES["q_rules_engine"] = q_rules_engine
SQL["q_rules_engine"] = _engine_sql()


# --- rules that need a parse ------------------------------------------------------------------------------------

#: type of repository, source of its module, findings: (rule, severity, dimension, text with % for the path).
_MODULES = (
    ("api-service", '@router.get("/v1/x", summary="s")\nasync def a():\n    """Doc."""\n', (("API-005", "ERROR", "structural_conformance", "%::a: endpoint missing response_model=."), ("DOC-010", "ERROR", "documentation_coverage", "%::a: route decorator missing: description, response_model."), ("API-008", "ERROR", "structural_conformance", "%::a: route '/v1/x' has no Depends(...) auth."), ("DOC-011", "WARN", "documentation_coverage", "%::a: unauthenticated route '/v1/x' lacks public-intent marker."))),
    ("api-service", '@router.get("/v1/x", summary="s", description="d", response_model=M)\ndef a(u=Depends(f)):\n    """Doc."""\n', ()),
    ("api-service", '@app.post("/x", summary="s", description="Intentionally public", response_model=M)\ndef a():\n    """Doc."""\n', (("API-004", "ERROR", "structural_conformance", "%::a: route '/x' missing /v1/ prefix."), ("API-008", "ERROR", "structural_conformance", "%::a: route '/x' has no Depends(...) auth."))),
    ("api-service", 'class Row(DeclarativeBase):\n    """Doc."""\n    id: int\nclass Other(DeclarativeBase):\n    """Doc."""\n    owner_id: int\n', (("API-006", "WARN", "structural_conformance", "%::Row: SQLAlchemy model missing owner_id column."),)),
    ("pipeline-cog", 'class Out(BaseModel):\n    """Doc."""\n    x: int\n    y: int = Field(description="y")\n    _z: int\n', (("DOC-007", "WARN", "documentation_coverage", "%::Out.x: Pydantic field missing Field(description=...)."),)),
    ("pipeline-cog", '@flow\ndef run():\n    """Doc."""\n    for i in items:\n        session.add(i)\n', (("PIPE-004", "ERROR", "pipeline_consistency", "%::run: flow writes to shared resource without concurrency guard."), ("PIPE-006", "WARN", "pipeline_consistency", "%::run: flow does not call get_run_logger()."), ("PRIN-002", "ERROR", "principles", "%::run: loop body has no try/except — one bad item aborts the full run."))),
    ("pipeline-cog", '@flow(name="x")\ndef run():\n    """Doc."""\n    log = get_run_logger()\n    for i in items:\n        try:\n            work(i)\n        except Exception:\n            log.error("bad")\n', ()),
    ("pipeline-cog", '@task\ndef get():\n    """Doc."""\n    return httpx.get("u")\n@task(retries=2)\ndef again():\n    """Doc."""\n    return httpx.get("u")\n', (("PIPE-007", "WARN", "pipeline_consistency", "External-calling task missing retries= in %::get."),)),
    ("pipeline-cog", '@task(retries=1)\ndef t():\n    """Doc."""\n    out.append(1)\n    rebuild()\n', (("PIPE-003", "WARN", "pipeline_consistency", "%::t: task mixes per-item processing with collection rebuild."),)),
    ("pipeline-cog", 'def f():\n    print("x")\n    tempfile.mkdtemp()\n', (("DOC-006", "WARN", "documentation_coverage", "%::f: public function missing docstring."), ("CD-003", "WARN", "cd_readiness", "print() statement found in %."), ("PY-014", "WARN", "structural_conformance", "Temporary resource created without with/finally cleanup: %."))),
    ("pipeline-cog", 'def _p():\n    with tempfile.TemporaryDirectory() as d:\n        tempfile.mkdtemp()\n', ()),
    ("pipeline-cog", 'task.with_options(retry_delay_seconds=5)\nlogger.error("file not found: x")\ntime.sleep(3)\n', (("PIPE-012", "WARN", "pipeline_consistency", "%: retry_delay_seconds=5 hardcoded without PYTEST_CURRENT_TEST guard."), ("CD-008", "WARN", "structural_conformance", "%: logger.error used for expected outcome: 'file not found: x'."), ("TEST-013", "INFO", "principles", "%: hardcoded numeric value 3 in time/retry/timeout call."), ("TEST-013", "INFO", "principles", "%: hardcoded numeric value 5 in time/retry/timeout call."))),
    ("pipeline-cog", "# x = 1\n# y = 2\n# import z\nx = 1\n", (("DOC-008", "WARN", "documentation_coverage", "Potential dead/commented-out code in % near line 3."),)),
    ("pipeline-cog", "def f(:\n", ()),
    ("pipeline-cog", 'class AppSettings(BaseSettings):\n    """Doc."""\n    KEY: str\nz = settings.KEY, settings.gone, getattr(settings, "lost"), settings._x\n', (("CFG-001", "WARN", "configuration_consistency", "%: settings.gone access but not declared on Settings."), ("CFG-001", "WARN", "configuration_consistency", "%: getattr(settings, 'lost') but lost not declared on Settings."))),
)


def q_ast_rules(t) -> DataFrame:
    """Each part is a repository with one module, whose path and source follow from the part."""
    from ..operators import rules as ru

    i, n = F.col("p_partkey"), len(_MODULES)
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (i % n + 1).cast("int"))
    repo, path = F.concat(F.lit("p"), i.cast("string")), F.concat(F.lit("src/m/f"), F.col("p_size").cast("string"), F.lit(".py"))
    files = t.part.select(repo.alias("repo"), path.alias("path"), pick([m[1] for m in _MODULES]).alias("content"))
    none = F.array().cast("array<struct<rule:string,reason:string>>")
    repos = t.part.select(repo.alias("repo"), repo.alias("name"), F.lit("python").alias("language"), pick([m[0] for m in _MODULES]).alias("repo_type"), F.lit(None).cast("string").alias("root"), F.array().cast("array<string>").alias("traits"), none.alias("exemptions"), none.alias("deferrals"), F.lit(None).cast("int").alias("standards_age_days"))
    found = evaluate(files, repos)[0]
    return found.filter(F.col("rule_id").isin(*ru.SOURCE_RULES, *ru.CROSS_RULES, "CHECKER")).select("repo", "rule_id", "severity", "dimension", "finding")


QUERIES["q_ast_rules"] = q_ast_rules
_FOUND = ", ".join("(" + ", ".join([str(i), *("'" + x.replace("'", "''") + "'" for x in f)]) + ")" for i, m in enumerate(_MODULES) for f in m[2])
SQL["q_ast_rules"] = f"SELECT 'p' || p_partkey AS repo, rule_id, severity, dimension, replace(finding, '%', 'src/m/f' || p_size || '.py') AS finding FROM part JOIN (VALUES {_FOUND}) x(nth, rule_id, severity, dimension, finding) ON nth = p_partkey % {len(_MODULES)}"


# --- rules that compare files -----------------------------------------------------------------------------------
# Each part is a repository whose type, names, routes, keys, versions and files follow from its brand (b) and size (s);
# the SQL states from the same columns what each rule must find. Texts of both dialects.

_PARTS = "SELECT p_partkey AS k, CAST(substr(p_brand, 7) AS INT) AS b, CAST(p_size AS INT) AS s FROM part"
_API, _SITE, _COG, _STD = (f"b % 4 = {i}" for i in range(4))
_BODY = "' client.get(\"/v1/a' || s || '\")' || chr(10) || ' m = MagicMock()' || chr(10) || CASE WHEN s % 5 = 0 THEN ' m.assert_called_once()' || chr(10) ELSE '' END || CASE WHEN s % 7 = 0 THEN ' client.get(\"/v1/b' || b || '\")' || chr(10) ELSE '' END"
_ROUTE = "'@router.{0}(\"/v1/{1}' || {2} || '\", summary=\"s\", description=\"d\", response_model=M)' || chr(10) || 'async def {1}(u=Depends(f)):' || chr(10) || '    \"\"\"Doc.\"\"\"' || chr(10)"
_PIN = "CASE s % 4 WHEN 0 THEN '4.1.' || s WHEN 1 THEN '^4.1.' || s WHEN 2 THEN 'latest' ELSE '4.x' END"
#: path -> (where it is, its content)
_PART_FILES = {
    "src/m/settings.py": (f"{_API} OR {_COG}", "'class AppSettings(BaseSettings):' || chr(10) || '    \"\"\"Doc.\"\"\"' || chr(10) || '    KEY_' || s || ': str' || chr(10)"),
    ".env.example": (f"{_API} OR {_COG}", "'KEY_' || s || '=1' || chr(10) || CASE WHEN s % 3 <> 0 THEN 'EXTRA_' || b || '=2' || chr(10) ELSE '' END || CASE WHEN s % 2 = 0 THEN '# external' || chr(10) || 'TOOL=3' || chr(10) ELSE '' END"),
    "src/m/main.py": (_API, _ROUTE.format("get", "a", "s") + " || " + _ROUTE.format("post", "b", "b")),
    "tests/test_a.py": (f"{_API} OR {_COG}", "CASE WHEN s % 2 = 0 THEN 'from x import TestClient' || chr(10) ELSE '' END || 'def test_a():' || chr(10) || " + _BODY),
    "src/page.astro": (_SITE, "'---' || chr(10) || CASE WHEN s % 2 = 0 THEN 'try { x } catch { y }' ELSE 'x' END || chr(10) || 'const a = await fetch(\"/u' || s || '\");' || chr(10) || '---' || chr(10)"),
    "src/run.astro": (_SITE, "'<script>fetch(\"/' || CASE WHEN s % 3 = 0 THEN 'u' || s ELSE 'x' END || '\"); fetch(\"/w' || b || '\")</script>'"),
    "README.md": (_SITE, "'Site /u' || s || ' /x' || CASE WHEN s % 4 = 0 THEN ' /W' || b ELSE '' END"),
    "package.json": (_SITE, "'{\"dependencies\": {\"astro\": \"' || " + _PIN + " || '\", \"@astrojs/x\": 3, \"other\": \"*\"}}'"),
    "src/c.ts": (_SITE, "'import.meta.env.VITE_A' || b || '; import.meta.env.PUBLIC_B'"),
    "astro.config.mjs": (_SITE, "'x'"),
    "index.yaml": (_STD, "CASE s % 3 WHEN 0 THEN 'schema:' || chr(10) || '  traits: [a]' || chr(10) || '  dod_types: {a: 1}' WHEN 1 THEN 'schema:' || chr(10) || '  repo_types: [a, b]' || chr(10) || '  rule_severities: [x]' ELSE 'a: [' END"),
    ".releaserc.json": ("s % 6 <> 0", "'{\"plugins\": [[\"@semantic-release/exec\", {\"prepareCmd\": \"sed pyproject.toml\"}], [\"@semantic-release/git\", {\"assets\": [' || CASE WHEN b % 3 = 0 THEN '\"README.md\"' ELSE '\"CHANGELOG.md\"' END || CASE WHEN s % 2 = 0 THEN ', \"pyproject.toml\"' ELSE '' END || ']}]]}'"),
    "src/m/bad.py": ("s % 10 = 0", "NULL"),
}
#: rule, severity, dimension, where it is found, SQL of the finding's text
_PART_FOUND = (
    ("CFG-002", "WARN", "configuration_consistency", f"({_API} OR {_COG}) AND s % 3 <> 0", "'.env.example key ''EXTRA_' || b || ''' not declared on Settings.'"),
    ("TEST-008", "WARN", "test_coverage", f"{_API} AND s % 2 = 1", "'tests/test_a.py::test_a: references /v1/ without TestClient/AsyncClient.'"),
    ("TEST-011", "ERROR", "test_coverage", f"({_API} OR {_COG}) AND s % 5 <> 0", "'tests/test_a.py::test_a: creates mocks but has no assert_called* assertion.'"),
    ("TEST-010", "ERROR", "test_coverage", f"{_API} AND s % 7 <> 0", "'1 route(s) have no contract test referencing them: /v1/b' || b || '.'"),
    ("FE-006", "ERROR", "structural_conformance", f"{_SITE} AND s % 2 = 1", "'src/page.astro: frontmatter fetch() without try/catch error handling.'"),
    ("FE-008", "WARN", "structural_conformance", _SITE, "'dependencies: @astrojs/x version must be a string semver for FE-008 scanning.'"),
    ("FE-008", "WARN", "structural_conformance", f"{_SITE} AND s % 4 <> 0", f"'dependencies: astro is not pinned to an exact version (''' || {_PIN} || ''').'"),
    ("FE-009", "WARN", "structural_conformance", f"{_SITE} AND s % 3 = 0", "'Astro component performs runtime fetch of URL also used in frontmatter (src/run.astro).'"),
    ("FE-010", "WARN", "structural_conformance", f"{_SITE} AND s % 4 <> 0", "'Runtime fetch URL not documented in README/docs (src/run.astro: /w' || b || ').'"),
    ("XSTACK-004", "WARN", "structural_conformance", _SITE, "'src/c.ts: env var VITE_A' || b || ' uses VITE_ prefix in a repo expecting PUBLIC_.'"),
    ("META-003", "WARN", "structural_conformance", f"{_STD} AND s % 3 < 2", "'schema.' || CASE s % 3 WHEN 0 THEN 'traits' ELSE 'repo_types' END || ' is a YAML list — canonical enums must be dict maps.'"),
    ("META-003", "WARN", "structural_conformance", f"{_STD} AND s % 3 = 1", "'schema.rule_severities is a YAML list — canonical enums must be dict maps.'"),
    ("META-003", "WARN", "structural_conformance", f"{_STD} AND s % 3 = 2", "'index.yaml is not parseable YAML — cannot validate canonical enum dict shapes.'"),
    ("VER-008", "ERROR", "cd_readiness", "s % 6 <> 0 AND b % 3 = 0", "'CHANGELOG.md is absent from @semantic-release/git assets.'"),
    ("VER-008", "ERROR", "cd_readiness", "s % 6 <> 0 AND s % 2 = 1", "'pyproject.toml is written by prepareCmd but absent from @semantic-release/git assets.'"),
    ("CHECKER", "WARN", "structural_conformance", "s % 10 = 0", "'Check of src/m/bad.py raised an unexpected error: not UTF-8'"),
)


def q_cross_rules(t) -> DataFrame:
    """The rules that compare files or read data files, and the rows of files that cannot be checked."""
    parts = t.part.selectExpr("p_partkey", "p_brand", "p_size")
    parts = parts.selectExpr("p_partkey AS k", "CAST(substr(p_brand, 7) AS INT) AS b", "CAST(p_size AS INT) AS s")
    made = ", ".join(f"if({there}, struct('{path}' AS path, CAST({text} AS STRING) AS content), NULL)" for path, (there, text) in _PART_FILES.items())
    files = parts.selectExpr("concat('c', k) AS repo", f"inline(array_compact(array({made})))").withColumn("decode_ok", F.col("content").isNotNull())
    kind = f"CASE WHEN {_API} THEN 'api-service' WHEN {_SITE} THEN 'static-site' WHEN {_COG} THEN 'pipeline-cog' ELSE 'standards-repo' END"
    none = "CAST(array() AS array<struct<rule:string,reason:string>>)"
    repos = parts.selectExpr("concat('c', k) AS repo", "concat('c', k) AS name", f"if({_SITE}, 'typescript', 'python') AS language", f"{kind} AS repo_type", "CAST(NULL AS STRING) AS root", "CAST(array() AS array<string>) AS traits", f"{none} AS exemptions", f"{none} AS deferrals", "CAST(NULL AS INT) AS standards_age_days")
    return evaluate(files, repos)[0].filter(F.col("rule_id").isin(*{r[0] for r in _PART_FOUND})).select("repo", "rule_id", "severity", "dimension", "finding")


QUERIES["q_cross_rules"] = q_cross_rules
SQL["q_cross_rules"] = f"WITH p AS ({_PARTS}) " + " UNION ALL ".join(f"SELECT 'c' || k AS repo, '{rule}' AS rule_id, '{sev}' AS severity, '{dim}' AS dimension, {text} AS finding FROM p WHERE {where}" for rule, sev, dim, where, text in _PART_FOUND)
