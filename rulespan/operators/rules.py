"""The rule checks, as data over three kinds of facts.

Atoms are tests of one file (a path, a token, a pattern). One pass over all files sets an atom's bit, and bit_or by
repository gives all of them in a few longs: rules about a repository are then rows of a table, a gate's number and
the bits wanted, that are joined to the repositories (bits.py). Rules about single files are expressions on the file's row. What needs a parse comes from
functions/source_facts.py, a file at a time.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from .bits import NEVER, Test, bit, choose, compiled, fewer_than_two, in_turn, listed, words

PYPROJECT, PKG, README, ENV = "path = 'pyproject.toml'", "path = 'package.json'", "path = 'README.md'", "path = '.env.example'"
CI = "path = '.github/workflows/ci.yml'"
WORKFLOWS = "path LIKE '.github/workflows/%' AND ext IN ('yml', 'yaml')"
SRC_PY, SRC_TS = "path LIKE 'src/%' AND ext = 'py'", "path LIKE 'src/%' AND ext IN ('ts', 'tsx')"
TESTS = "path LIKE 'tests/%' AND ext = 'py' AND startswith(name, 'test_')"
MANIFESTS = "path IN ('pyproject.toml', 'requirements.txt', 'requirements/base.txt')"
ASTRO_CONFIG = "path IN ('astro.config.mjs', 'astro.config.ts')"

#: (files in scope, test of such a file) by SQL text, in the order of their bits.
ATOMS: list[tuple[str, str]] = []
#: The atoms that ask for a token: their bit -> (scope, token, whether in lower case). Automata find these (functions/marks.py).
TOKENS: dict[int, tuple[str, str, bool]] = {}


def _bit(scope: str, test: str) -> int:
    if (scope, test) not in ATOMS:
        ATOMS.append((scope, test))
    return ATOMS.index((scope, test))


#: Conditions on a repository's other columns, by SQL text, in the order of their bits; null counts as false.
CONDITIONS: list[str] = []


def condition(test: str) -> Test:
    if test not in CONDITIONS:
        CONDITIONS.append(test)
    return bit("cond", CONDITIONS.index(test))


def atom(test: str, row: str = "own", scope: str = "true") -> Test:
    """Whether a file of the repository in scope passes the test; row `root`: of its monorepo's root."""
    return bit(row, _bit(scope, test))


def has(*paths: str, row: str = "own") -> Test:
    return atom("path IN (" + ", ".join(f"'{p}'" for p in paths) + ")", row)


def folder(prefix: str) -> Test:
    return atom(f"startswith(path, '{prefix}/') OR path = '{prefix}'")


def tok(scope: str, *tokens: str, low: bool = False, row: str = "own") -> Test:
    """Whether a file in scope holds any of the tokens."""
    tests = []
    for t in tokens:
        i = _bit(scope, f"contains({'low' if low else 'content'}, {_quote(t)})")
        TOKENS[i] = (scope, t, low)
        tests.append(bit(row, i))
    return _any(tests)


def rx(scope: str, pattern: str) -> Test:
    return atom(f"content RLIKE {_quote(pattern)}", scope=scope)


def _quote(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def either(make) -> Test:
    """The repository's own or its root's."""
    return make("own") | make("root")


@dataclass(frozen=True)
class Rule:
    rule_id: str
    severity: str
    dimension: str
    gate: str
    test: Test
    #: `{column}` stands for a value of the repository, one of VALUES
    text: str
    #: run in the wrapper: an exemption's reason gives a row, a deferral lowers the severity
    wrapped: bool = True
    #: emitted even where the rule is exempt
    always: bool = False


STRUCT, DOCS, CD, PIPE, TEST, COVER, CROSS = "structural_conformance", "documentation_coverage", "cd_readiness", "pipeline_consistency", "testing_coverage", "test_coverage", "cross_repo_coherence"
#: Gates on a repository's flags.
ANY, PY = "true", "is_python AND NOT is_frontend"
COG, RUNTIME = "is_pipeline OR is_trigger", "is_pipeline OR is_trigger OR is_api"
API_PY, API_TS = "is_api AND language = 'python'", "is_api AND language <> 'python'"
PY_LIKE = "language = 'python' AND (is_pipeline OR is_api OR is_library)"
ENV_PLACES = (".env.example", "apps/api/.env.example", "apps/app/.env.example", "app/.env.example", "backend/.env.example", "server/.env.example")
#: Words and markers of the rules.
IO_SIGNALS = ("input", "output", "source folder", "drive", "endpoint", "produces", "writes to", "openapi", "/v1/")
PY_STORES = ("mysql", "mysqlclient", "pymysql", "aiosqlite", "sqlite3", "sqlalchemy[sqlite]", "mongodb", "motor", "pymongo", "dynamodb", "boto3")
NODE_STORES = ('"mysql"', '"mysql2"', '"sqlite3"', '"better-sqlite3"', '"mongodb"', '"mongoose"', '"redis"', '"ioredis"', '"dynamodb"')
FAILURE_WORDS = ("malform", "failure", "fail", "error", "exception", "invalid", "raises", "bad_input", "boom", "continues", "loop_continues", "does_not_abort", "does_not_raise")
CRITICAL = (("TEST-001 (normalization)", ("normalize", "normalise", "normalization")), ("TEST-002 (deduplication)", ("dedup", "deduplication")), ("TEST-003 (persistence)", ("persist", "upsert", "session.commit")), ("TEST-004 (archival)", ("archive", "archival", "move")))
RELAYS = ("prefect deployment run", "prefect deploy", "run_deployment(", "npx prefect")


#: Columns that texts show.
VALUES = ("under", "repo_under", "src_package", "standards_age_days", "hand_logging", "console_log", "env_file", "secret_file", "bare_route", "bare_json", "raw_http")


def _any(tests) -> Test:
    return reduce(Test.__or__, tests)


def _first(markers: tuple[str, ...], scope: str, shown) -> list[tuple[Test, str]]:
    """A case for each marker in scope that no marker before it precedes."""
    return in_turn([(tok(scope, m, low=True), shown(m)) for m in markers])


@dataclass(frozen=True)
class Names:
    """Names that belong to one organisation: its checker's repository, module names of its shared Python library, hosts of its own API."""

    checker: str = ""
    shared_modules: tuple[str, ...] = ("common_python_utils",)
    api_hosts: tuple[str, ...] = ()


def repo_rules(names: Names = Names()) -> list[Rule]:
    """Rules about a repository, in the order of the findings."""
    r: list[Rule] = []
    add = lambda *a, **k: r.append(Rule(*a, **k))
    doc = lambda p: either(lambda row: has(p, row=row))
    src, tests = folder("src"), folder("tests")
    own_readme = has("README.md")
    signal = lambda s: choose(own_readme, tok(README, s, low=True), tok(README, s, low=True, row="root"))
    in_root = condition("root IS NOT NULL")
    add("DOC-001", "ERROR", DOCS, ANY, ~doc("README.md"), "README.md is absent.")
    add("DOC-002", "WARN", DOCS, ANY, doc("README.md") & fewer_than_two([signal(s) for s in IO_SIGNALS]), "README does not clearly describe data inputs and outputs.")
    add("DOC-003", "WARN", DOCS, ANY, ~doc("CHANGELOG.md"), "CHANGELOG.md is absent.")
    add("VER-003", "ERROR", CD, ANY, ~doc(".releaserc.json"), ".releaserc.json is absent.")
    add("DOC-009", "WARN", DOCS, ANY, condition("split_identity"), "Split package identity is not documented across __init__.py and README.")
    add("DOC-004", "WARN", DOCS, "NOT is_library", ~(has(*ENV_PLACES) | has(".env.example", row="root")), ".env.example is absent.")
    add("PY-008", "WARN", STRUCT, PY, ~has(".pre-commit-config.yaml"), ".pre-commit-config.yaml is absent.")
    add("PY-005", "ERROR", STRUCT, PY, ~src, "src/ directory is absent — flat layout detected.")
    for bad in ("setup.py", "requirements.txt"):
        add("PY-007", "WARN", STRUCT, PY, has(bad), f"{bad} found — pyproject.toml should be the single source of truth.")
    proj = has("pyproject.toml")
    add("PY-007", "ERROR", STRUCT, PY, ~proj, "pyproject.toml is absent.", wrapped=False, always=True)
    for rule, sev, dim, bad, text in (
        ("PY-001", "WARN", STRUCT, ~has("uv.lock") & ~tok(PYPROJECT, "[tool.uv]"), "No uv.lock or [tool.uv] found — uv may not be in use."),
        ("PY-002", "WARN", STRUCT, ~tok(PYPROJECT, "[tool.ruff]"), "[tool.ruff] section absent from pyproject.toml."),
        ("PY-003", "WARN", STRUCT, ~tok(PYPROJECT, 'requires-python = ">=3.11"', ">=3.12"), "Python minimum version may be below 3.11."),
        ("PY-009", "INFO", STRUCT, ~tok(PYPROJECT, "hatchling"), "hatchling not found as build backend."),
        ("PY-010", "INFO", STRUCT, ~tok(PYPROJECT, "line-length = 88"), "ruff line-length is not explicitly set to 88."),
        ("CD-002", "WARN", CD, ~tok(PYPROJECT, "sentry-sdk"), "sentry-sdk not found in pyproject.toml."),
    ):
        add(rule, sev, dim, PY, proj & bad, text, wrapped=False)
    add("PY-011", "WARN", STRUCT, PY, condition("project_name <> '' AND under <> repo_under"), "Project name '{under}' does not match repo naming '{repo_under}'.")
    add("PY-011", "WARN", STRUCT, PY, condition("project_name <> '' AND src_package <> under"), "src package '{src_package}' does not match project name '{under}'.")
    moves = tok(SRC_PY, "shutil", "pathlib") & tok(SRC_PY, "except") & tok(SRC_PY, "move(", "rename(")
    add("PY-012", "WARN", STRUCT, PY, moves & ~tok(SRC_PY, "FAILED_"), "File-processing exception paths do not use FAILED_ prefixing.")
    add("PY-013", "WARN", STRUCT, PY, tok(SRC_PY, "dedup", "duplicate", "already exists", low=True) & ~tok(SRC_PY, "possible_duplicate_", low=True), "Deduplication logic present but possible_duplicate_ prefixing is missing.")
    add("PY-006", "ERROR", STRUCT, "(is_python OR is_fastapi) AND NOT is_library AND NOT is_frontend", proj & ~tok(PYPROJECT, "common-python-utils"), "common-python-utils not declared as a dependency.")
    pings = tok(SRC_PY, "HEALTHCHECKS_URL_") | tok(SRC_PY, "healthchecks", low=True)
    add("CD-007", "WARN", CD, "is_trigger", ~tok(ENV, "HEALTHCHECKS_URL_") | ~pings, "Trigger cog is missing Healthchecks.io integration signals.", wrapped=False, always=True)
    add("VER-004", "ERROR", CD, ANY, rx("path = 'CHANGELOG.md'", r"(?m)^##\s+\d+\.\d+\.\d+"), "CHANGELOG.md appears manually edited with non-semantic-release headers.")
    shared_ts = tok(PKG, "common-typescript-utils", low=True)
    wide = "(NOT is_frontend OR (has_config AND repo_type <> 'static-site'))"
    add("XSTACK-001", "ERROR", CROSS, f"{wide} AND language = 'python'", ~tok(PYPROJECT, "common-python-utils", low=True), "common-python-utils is not declared for this Python service.")
    add("XSTACK-001", "ERROR", CROSS, f"{wide} AND language <> 'python'", ~(shared_ts | tok(PKG, "common-typescript-utils", low=True, row="root")), "common-typescript-utils is not declared for this TypeScript service.")
    add("PRIN-009", "WARN", "standards_currency", "repo_type = 'standards-repo'", condition("standards_age_days > 90"), "Standards repo appears stale ({standards_age_days} days since last commit).")
    std = "repo_type = 'standards-repo'"
    add("META-001", "WARN", STRUCT, std, ~tok(WORKFLOWS, "semantic-release", "semantic_release", low=True), "No GitHub Actions workflow references semantic-release.")
    add("META-001", "WARN", STRUCT, std, ~has(".releaserc.json", ".releaserc.cjs", ".releaserc.yaml"), "Missing .releaserc.* configuration alongside semantic-release.")
    wired = atom("(contains(lower(get_json_object(content, '$.scripts')), 'semantic-release') OR exists(array_union(coalesce(json_object_keys(get_json_object(content, '$.dependencies')), array()), coalesce(json_object_keys(get_json_object(content, '$.devDependencies')), array())), k -> contains(lower(k), 'semantic-release')))", scope=PKG)
    add("META-001", "WARN", STRUCT, std, ~wired, "package.json lacks semantic-release wiring (script or dependency).")
    add("META-001", "WARN", STRUCT, std, ~(tok(WORKFLOWS, "push:", low=True) & tok(WORKFLOWS, "main", low=True)), "No workflow appears to trigger on push to main.")
    for word in ("version", "updated"):
        add("META-002", "WARN", STRUCT, std, rx("path = 'index.yaml'", rf"(?m)^{word}\s*:"), f"index.yaml still declares a top-level {word}: field.")
    stray = ("VERSION.txt", "VERSION", "version.txt")
    for t, text in in_turn([(has(x), f"Stray plaintext version file exists at repo root ({x}).") for x in stray]):
        add("META-002", "WARN", STRUCT, std, t, text)
    ci = choose(in_root, has(".github/workflows/ci.yml", row="root"), has(".github/workflows/ci.yml"))
    in_ci = lambda *x: choose(in_root, tok(CI, *x, row="root"), tok(CI, *x))
    add("VER-003", "ERROR", CD, ANY, ~ci, "ci.yml not found at .github/workflows/ci.yml.", wrapped=False, always=True)
    add("VER-003", "ERROR", CD, ANY, ci & ~in_ci("semantic-release"), "semantic-release not found in ci.yml.", wrapped=False)
    add("VER-005", "ERROR", CD, ANY, ci & ~in_ci("fetch-depth: 0"), "fetch-depth: 0 absent from ci.yml checkout step.", wrapped=False)
    add("VER-006", "ERROR", CD, ANY, ci & ~in_ci("npm install --no-save", "pnpm exec semantic-release", "pnpm run semantic-release", "pnpm add"), "npm install --no-save step absent from release job.", wrapped=False)
    add("TEST-006", "WARN", TEST, "is_python", has(".github/workflows/ci.yml") & ~tok(CI, "pytest --cov", "pytest-cov"), "Coverage not measured in CI — pytest --cov not found in ci.yml.")
    add("TEST-007", "ERROR", TEST, "is_python", ~tok(PYPROJECT, "respx", low=True), "respx is absent from development dependencies.")
    add("TEST-007", "ERROR", TEST, "is_python", condition("raw_http IS NOT NULL"), "Raw HTTP calls found without respx.mock in {raw_http}.")
    add("TEST-012", "WARN", TEST, "is_python", tok(PYPROJECT, "[tool.mypy]") & ~tok(WORKFLOWS, "mypy", low=True), "[tool.mypy] is configured but mypy is not run in CI workflows.")
    add("TEST-003", "ERROR", TEST, "is_python", ~tests, "tests/ directory is absent.", wrapped=False)
    add("TEST-003", "ERROR", TEST, "is_python", tests & ~tok(TESTS, *FAILURE_WORDS, low=True), "No failure path test found.", wrapped=False)
    add("TEST-005", "WARN", TEST, "is_python", tests & proj & ~tok(PYPROJECT, "[tool.pytest.ini_options]"), "[tool.pytest.ini_options] absent from pyproject.toml.", wrapped=False)
    lacks = lambda *x: own_readme & ~tok(README, *x, low=True)
    local = [("dod IN ('new_cog', 'new_fastapi_service')", x, (x,)) for x in ("uv sync", "pre-commit install", "pre-commit run", "uv run pytest")]
    local += [("dod IN ('new_cog', 'new_fastapi_service')", "python/uv prerequisites", ("prereq", "python", "uv"))]
    local += [("dod = 'new_hono_service'", x, (x,)) for x in ("pnpm install", "pnpm dev", "pnpm test", "node")]
    web = "dod IN ('new_frontend_site', 'new_react_app')"
    local += [(web, "pnpm install or npm install", ("pnpm install", "npm install")), (web, "pnpm build or npm run build", ("pnpm build", "npm run build")), (web, "pnpm dev or npm run dev or astro dev", ("pnpm dev", "npm run dev", "astro dev")), (web, ".env.example", (".env.example",))]
    for gate, item, words in local:
        add("DOC-013", "WARN", DOCS, gate, lacks(*words), f"README Running locally is missing: {item}.", wrapped=False)
    pkg_low = lambda *x: tok(PKG, *x, low=True)
    astro_tw = tok(ASTRO_CONFIG, "@astrojs/tailwind", low=True)
    add("FE-003", "WARN", STRUCT, "is_frontend", ~(pkg_low('"tailwindcss"') | astro_tw) | ~(has("tailwind.config.js", "tailwind.config.ts", "tailwind.config.mjs") | astro_tw), "Tailwind CSS setup is incomplete or absent.")
    add("FE-003", "WARN", STRUCT, "is_frontend", pkg_low("styled-components", "emotion"), "Alternative CSS-in-JS stack detected alongside/instead of Tailwind.")
    add("FE-001", "WARN", STRUCT, "is_static", ~pkg_low('"astro"') | ~has("astro.config.mjs", "astro.config.ts"), "Astro framework signals are missing for frontend site.")
    add("FE-002", "ERROR", STRUCT, "is_react", ~pkg_low('"typescript"') | ~has("tsconfig.json"), "TypeScript setup missing for React web app.")
    for hit, text in _first(("webpack", "create-react-app", '"next"'), PKG, lambda m: f"Forbidden frontend stack signal found: {m}."):
        add("FE-002", "ERROR", STRUCT, "is_react", hit, text)
    add("FE-004", "WARN", STRUCT, "is_react", ~pkg_low("@radix-ui/") & ~folder("src/components/ui"), "shadcn/ui signals not detected (no Radix deps and no src/components/ui).")
    add("FE-005", "WARN", STRUCT, "is_react", tok("path LIKE 'src/%' AND ext = 'tsx'", "<form", "<Form") & ~(pkg_low('"react-hook-form"') & pkg_low('"zod"')), "Form components exist but react-hook-form and/or zod is missing.")
    for rule, word, text in (("TEST-001", "normalization", "No normalization test found."), ("TEST-002", "dedup", "No deduplication test found."), ("TEST-004", "shape", "No output shape test found.")):
        add(rule, "WARN", TEST, "is_pipeline", tests & ~tok(TESTS, word, low=True), text, wrapped=False)
    add("PIPE-009", "WARN", PIPE, f"is_pipeline AND name <> {_quote(names.checker)}", src & ~tok(SRC_PY, "pipeline_eval", "post_evaluation", "/v1/evaluations", "evaluate_pipeline_run"), "Pipeline cog source has no clear evaluation-step signal.")
    add("CD-015", "ERROR", CD, "is_pipeline", src & tok(SRC_PY, "flow.deploy(", "work_pool_name"), "work pool pattern detected — flow.deploy() or work_pool_name found.")
    add("CD-015", "ERROR", CD, "is_pipeline", src & tok("path = 'prefect.yaml'", "work_pool"), "work_pool configuration found in prefect.yaml.")
    add("CD-015", "WARN", CD, "is_pipeline", src & ~tok(SRC_PY, "prefect.serve(", "flow.serve("), "No prefect.serve() call found in source — flow registration pattern missing or unverifiable.")
    prefect = tok(MANIFESTS, "prefect", low=True)
    add("PIPE-001", "WARN", PIPE, COG, ~prefect, "Prefect is not declared as a dependency.")
    add("PIPE-001", "WARN", PIPE, COG, prefect & ~src, "src/ tree missing — cannot verify Prefect usage in application code.")
    add("PIPE-001", "WARN", PIPE, "is_trigger", prefect & src & ~tok(SRC_PY, "run_deployment"), "Trigger cog source does not reference run_deployment (Prefect deployment API).")
    add("PIPE-001", "WARN", PIPE, "is_pipeline AND NOT is_trigger", prefect & src & ~tok(SRC_PY, "@flow"), "Pipeline cog source has no @flow-decorated Prefect flow.")
    add("CD-005", "WARN", CD, COG, prefect & ~tok(ENV, "prefect_api_url", "prefect_api_key", "api.prefect.cloud", "prefect_cloud", low=True), "Prefect Cloud connection is not documented in .env.example (expected PREFECT_API_URL or equivalent).")
    add("CD-005", "INFO", CD, COG, prefect & tok(SRC_PY, "apscheduler", low=True), "APScheduler is referenced — confirm it is only a local dev fallback, not the primary scheduler.")
    add("API-001", "WARN", STRUCT, "is_api", ~has("railway.toml", "railway.json", "nixpacks.toml"), "Railway deployment configuration is missing (expected railway.toml, railway.json, or nixpacks.toml at repo root).")
    add("API-001", "WARN", STRUCT, API_PY, ~tok("path IN ('pyproject.toml', 'requirements.txt')", "fastapi", low=True), "FastAPI is not declared for this Python API service.")
    add("API-001", "WARN", STRUCT, API_TS, ~pkg_low("hono"), "Hono is not declared for this TypeScript API service.")
    for hit, text in _first(PY_STORES, "path IN ('pyproject.toml', 'requirements.txt', 'requirements/base.txt', 'requirements/prod.txt')", lambda m: f"Non-Postgres data-store client or driver signal detected ({m!r})."):
        add("API-002", "ERROR", STRUCT, API_PY, hit, text)
    for hit, text in _first(NODE_STORES, PKG, lambda m: f"Non-Postgres data-store dependency present ({m})."):
        add("API-002", "ERROR", STRUCT, API_TS, hit, text)
    dec = "docs/decisions"
    add("DOC-005", "WARN", DOCS, f"{RUNTIME} OR is_library OR repo_type = 'standards-repo'", condition("loc >= 50") & ~folder(dec), "docs/decisions/ directory is missing for a non-trivial codebase.")
    add("DOC-005", "WARN", DOCS, f"{RUNTIME} OR is_library OR repo_type = 'standards-repo'", condition("loc >= 50") & folder(dec) & ~atom(f"path RLIKE '^{dec}/ADR-[^/]*\\\\.md$'"), "docs/decisions/ exists but no ADR-NNN-*.md files were found.")
    add("API-003", "WARN", STRUCT, API_PY, ~tok(PYPROJECT, "sqlalchemy", low=True), "api-service (Python) does not declare sqlalchemy in pyproject.toml.")
    add("API-003", "WARN", STRUCT, API_TS, ~pkg_low("drizzle-orm", "prisma"), "api-service (TypeScript) does not declare drizzle-orm or prisma.")
    add("API-007", "WARN", STRUCT, API_PY, src & ~(tok(SRC_PY, "verify_token") | tok(SRC_PY, "clerk", low=True)), "api-service (Python) has no visible Clerk or verify_token usage.")
    add("API-007", "WARN", STRUCT, API_TS, ~tok(PKG, "@clerk", "common-typescript-utils"), "api-service (TypeScript) has no Clerk SDK or common-typescript-utils dep.")
    cors = tok(SRC_PY, "CORSMiddleware")
    add("API-009", "ERROR", STRUCT, API_PY, ~cors, "api-service (Python) has no CORSMiddleware configuration.")
    add("API-009", "WARN", STRUCT, API_PY, cors & ~tok(SRC_PY, "CORS_ORIGINS"), "api-service (Python) uses CORSMiddleware but CORS_ORIGINS env var is not referenced.")
    add("API-009", "ERROR", STRUCT, API_TS, ~tok(SRC_TS, "cors(", "from 'hono/cors'", 'from "hono/cors"'), "api-service (TypeScript) has no cors() middleware import.")
    for gate, scope in ((API_PY, SRC_PY), (API_TS, SRC_TS)):
        add("API-010", "WARN", STRUCT, gate, src & ~rx(scope + " AND contains(content, '/health')", "def health|\"/health\"|'/health'"), "api-service has no visible GET /health endpoint.")
    any_ci = either(lambda row: has(".github/workflows/ci.yml", row=row))
    both_ci = lambda *x: either(lambda row: tok(CI, *x, row=row))
    add("API-011", "ERROR", STRUCT, "is_api", ~any_ci, "api-service has no .github/workflows/ci.yml — migration steps cannot be verified.")
    add("API-011", "ERROR", STRUCT, API_PY, any_ci & ~both_ci("alembic upgrade"), "ci.yml has no 'alembic upgrade head' step.")
    add("API-011", "ERROR", STRUCT, API_TS, any_ci & ~both_ci("drizzle-kit push", "drizzle-kit migrate"), "ci.yml has no 'drizzle-kit push' or 'drizzle-kit migrate' step.")
    shared_py = tok(SRC_PY, *names.shared_modules)
    add("CD-010", "ERROR", STRUCT, COG, ~tok(ENV, "HEALTHCHECKS_URL") | ~tok(SRC_PY, "healthchecks.io", low=True), "Layer 1 missing: no HEALTHCHECKS_URL env var or healthchecks.io ping in source.")
    add("CD-010", "ERROR", STRUCT, RUNTIME, ~shared_py, "Layer 2 missing: no common-python-utils logger usage.")
    add("CD-010", "ERROR", STRUCT, RUNTIME, ~tok(SRC_PY, "sentry_sdk") | ~tok(ENV, "SENTRY_DSN"), "Layer 3 missing: no sentry_sdk.init() or SENTRY_DSN in .env.example.")
    netlify, vercel, gh = has("netlify.toml"), has("vercel.json"), tok(CI, "gh-pages")
    add("CD-014", "WARN", STRUCT, "is_static", netlify, "Static site has netlify.toml — expected Cloudflare Pages deployment.")
    add("CD-014", "WARN", STRUCT, "is_static", vercel, "Static site has vercel.json — expected Cloudflare Pages deployment.")
    add("CD-014", "WARN", STRUCT, "is_static", gh, "Static site uses GitHub Pages deploy — expected Cloudflare Pages.")
    pages = tok(CI, "cloudflare/pages-action", "wrangler pages") | tok(README, "pages.dev", "Cloudflare Pages")
    add("CD-014", "WARN", STRUCT, "is_static", ~pages & ~netlify & ~vercel & ~gh, "No deployment target detected (no Cloudflare Pages markers in ci.yml or README).")
    add("MONO-001", "ERROR", CROSS, "mono_rules AND language = 'typescript' AND root IS NOT NULL", ~tok(PKG, "common-typescript-utils") & ~tok(PKG, "common-typescript-utils", row="root"), "Monorepo: common-typescript-utils absent from both workspace root and per-app package.json.")
    add("MONO-002", "WARN", STRUCT, "mono_rules AND root IS NOT NULL", ~has(".github/workflows/ci.yml", row="root"), "Monorepo root missing .github/workflows/ci.yml.")
    add("PIPE-011", "WARN", PIPE, "is_pipeline AND NOT is_trigger", src & ~(folder("src/" + names.checker.replace("-", "_")) if names.checker else NEVER) & ~tok(SRC_PY, "pipeline_eval", "evaluation_client", "/v1/evaluations", "/v1/pipeline_evaluations", "PipelineEvaluator"), "No AI evaluation task found in pipeline-cog source.")
    for gate, items in (
        (f"({RUNTIME}) AND language = 'python'", [(~tok(SRC_PY, "sentry_sdk"), "Sentry"), (~shared_py, "structured logging (common-python-utils)")]),
        (f"({RUNTIME}) AND language <> 'python'", [(~tok(SRC_TS, "@sentry/", "Sentry.init"), "Sentry"), (~tok(SRC_TS, "common-typescript-utils"), "structured logging (common-typescript-utils)")]),
    ):
        for t, text in listed(items):
            add("PRIN-005", "ERROR", "principles", gate, src & t, f"Production service missing: {text}.")
    sql = src & (tok(SRC_PY, "sqlalchemy", low=True) | tok(PYPROJECT, "sqlalchemy", low=True))
    sync = tok(SRC_PY, "from sqlalchemy.orm import Session", "from sqlalchemy.orm import sessionmaker") & ~tok(SRC_PY, "AsyncSession", "async_sessionmaker")
    add("PY-015", "ERROR", STRUCT, API_PY, sql & sync, "Sync Session/sessionmaker imported without AsyncSession/async_sessionmaker counterpart.")
    add("PY-015", "ERROR", STRUCT, API_PY, sql & tok(SRC_PY, "create_engine(") & ~tok(SRC_PY, "create_async_engine("), "Sync create_engine() used without create_async_engine() counterpart.")
    add("PY-015", "ERROR", STRUCT, API_PY, sql & tok(PYPROJECT, "sqlalchemy", low=True) & ~tok(PYPROJECT, "asyncpg", low=True), "sqlalchemy declared without asyncpg in pyproject.toml.")
    conf = "path LIKE 'tests/%' AND name = 'conftest.py'"
    db = src & tests & tok(SRC_PY, "sqlalchemy", low=True)
    add("TEST-009", "ERROR", COVER, API_PY, db & ~atom(conf), "SQLAlchemy repo has no conftest.py with DB test fixtures.")
    fixture = tok(conf, "DATABASE_URL", "sqlite:///:memory:") | (tok(conf, "rollback", low=True) & tok(conf, "fixture", low=True))
    add("TEST-009", "ERROR", COVER, API_PY, db & atom(conf) & ~fixture, "conftest.py has no DB test fixture pattern (DATABASE_URL override, in-memory SQLite, or rollback fixture).")
    gaps = [(~tok(TESTS, *words, low=True), label) for label, words in CRITICAL]
    for t, text in listed(gaps):
        add("TEST-GAP-001", "INFO", COVER, "is_pipeline OR is_api", tests & t, f"Missing critical-path tests: {text}.")
    at = lambda p: choose(in_root, has(p, row="root"), has(p))
    pnpm = "is_react OR (is_api AND language = 'typescript')"
    add("XSTACK-003", "ERROR", STRUCT, pnpm, at("package-lock.json"), "package-lock.json found — npm is not the approved package manager for TypeScript projects.")
    add("XSTACK-003", "ERROR", STRUCT, pnpm, at("yarn.lock"), "yarn.lock found — yarn is not the approved package manager for TypeScript projects.")
    add("XSTACK-003", "WARN", STRUCT, pnpm, ~at("pnpm-lock.yaml"), "pnpm-lock.yaml not found — pnpm may not be in use.")
    for rule, sev, col, text, gate in (
        ("CD-009", "WARN", "hand_logging", "Hand-rolled logging detected in {}.", ANY),
        ("CD-009", "WARN", "console_log", "console.log used as primary logger in {}.", ANY),
        ("CD-011", "ERROR", "env_file", "Committed env file detected: {}.", ANY),
        ("CD-011", "ERROR", "secret_file", "Potential hardcoded secret in {}.", ANY),
        ("XSTACK-002", "WARN", "bare_route", "FastAPI route missing response_model= in {}.", API_PY),
        ("XSTACK-002", "WARN", "bare_json", "Hono handler uses raw c.json without success()/error() helper ({}).", API_TS),
    ):
        add(rule, sev, CD if rule.startswith("CD") else STRUCT, gate, condition(f"{col} IS NOT NULL"), text.replace("{}", f"{{{col}}}"))
    add("EVAL-008", "WARN", STRUCT, ANY, ~has("evaluator.yaml"), "evaluator.yaml is absent from repo root.", wrapped=False, always=True)
    return r


#: The first path, in order, of a repository's files that pass a test.
FIRST_PATHS = {
    "hand_logging": f"{SRC_PY} AND (contains(content, 'import logging') OR contains(content, 'logging.basicConfig') OR contains(content, 'logging.getLogger'))",
    "console_log": f"{SRC_TS} AND contains(content, 'console.log(')",
    "env_file": "startswith(name, '.env') AND name <> '.env.example'",
    "secret_file": r"path LIKE 'src/%' AND ext IN ('py', 'ts', 'tsx') AND content RLIKE 'sk-[A-Za-z0-9]{16,}|Bearer\\s+[A-Za-z0-9]{20,}|(?i:password\\s*=\\s*[\'\"][^\'\"]+[\'\"])|(?i:api[_-]?key\\s*=\\s*[\'\"][^\'\"]+[\'\"])'",
    "bare_route": rf"{SRC_PY} AND NOT contains(path, 'tests/') AND content RLIKE '@(?:router|app)\\.(get|post|put|delete|patch)\\s*\\(' AND NOT contains(content, 'response_model=')",
    "bare_json": rf"{SRC_TS} AND NOT contains(path, 'tests/') AND content RLIKE '\\bc\\.json\\s*\\(' AND NOT contains(content, 'success(') AND NOT content RLIKE '(?i)from\\s+[\'\"][^\'\"]*success'",
    "raw_http": f"{TESTS} AND (contains(content, 'httpx.get(') OR contains(content, 'httpx.post(') OR contains(content, 'requests.get(') OR contains(content, 'requests.post(')) AND NOT contains(content, 'respx.mock')",
}

_NO_TESTS = "NOT contains(path, 'tests/')"
_RELAY = "(contains(low, '{}')".format("') OR contains(low, '".join(RELAYS)) + " OR (contains(content, '/dispatches') AND (contains(low, 'curl ') OR contains(low, 'httpx.') OR contains(low, 'requests.'))))"
_DISPATCH = r"content RLIKE '(?i)(httpx|requests)\\.(post|put)\\([^\\)]*api\\.github\\.com/[^\"\'\\)]+/dispatches'"
_CODE = f"ext IN ('py', 'ts', 'tsx', 'js') AND {_NO_TESTS} AND NOT contains(path, '.github/workflows/')"

def file_rules(names: Names = Names()) -> tuple[tuple[str, str, str, str, str, str], ...]:
    hosts = "".join(f"contains(content, {_quote(h)}) OR " for h in names.api_hosts)
    return FILE_RULES + (
        ("CD-012", "WARN", CD, f"({RUNTIME}) AND language = 'python'", f"{SRC_PY} AND {_NO_TESTS} AND NOT contains(content, 'X-Internal-API-Key') AND ({hosts}contains(content, '\"/v1/')) AND contains(content, 'httpx') AND NOT low RLIKE 'clerk|jwt|get_token|authenticate'", "Internal HTTP client without Clerk/JWT acquisition pattern (%s)."),
    )


#: Rules about a file: rule, severity, dimension, gate, test (low: the content in lower case), text with the path in place of %s.
FILE_RULES = (
    ("FE-007", "ERROR", STRUCT, ANY, SRC_PY + r" AND content RLIKE 'https?://(localhost|[^\n]*railway\\.app|[^\n]*up\\.railway\\.app)'", "Hardcoded API URL found in %s."),
    ("PY-011", "WARN", STRUCT, PY, SRC_PY + r" AND NOT regexp_replace(name, '\\.py$', '') RLIKE '^[a-z0-9_]+$'", "Non-snake_case Python module filename: %s."),
    ("CD-006", "WARN", STRUCT, RUNTIME, f"{WORKFLOWS} AND contains(low, 'repository_dispatch') AND {_RELAY}", "repository_dispatch workflow appears to relay into automation (%s)."),
    ("CD-006", "WARN", STRUCT, RUNTIME, f"{WORKFLOWS} AND (contains(low, 'schedule') OR contains(low, 'cron:')) AND contains(low, 'api.prefect.cloud')", "Scheduled workflow references Prefect Cloud API (%s)."),
    ("CD-006", "WARN", STRUCT, RUNTIME, WORKFLOWS + r" AND content RLIKE '[\'\"]/v1/(trigger|runs)'", "Workflow references internal trigger HTTP path (%s)."),
    ("CD-006", "WARN", STRUCT, RUNTIME, f"{SRC_PY} AND {_NO_TESTS} AND {_DISPATCH}", "Python source posts to GitHub dispatches API (%s)."),
    ("PIPE-008", "WARN", STRUCT, "is_pipeline", f"{WORKFLOWS} AND contains(low, 'repository_dispatch') AND {_RELAY}", "repository_dispatch in GitHub workflow with app-triggering steps (%s)."),
    ("PIPE-008", "WARN", STRUCT, "is_pipeline", f"{_CODE} AND {_DISPATCH}", "Active HTTP client call to GitHub dispatches API (%s)."),
    ("PIPE-008", "WARN", STRUCT, "is_pipeline", f"{_CODE} AND contains(content, 'google-app-script-trigger')", "Retired google-app-script-trigger reference in %s."),
    ("PIPE-008", "WARN", STRUCT, "is_pipeline", _CODE + r" AND low RLIKE '\\bgh\\s+workflow\\s+run\\b'", "gh workflow run invocation in %s."),
    ("PIPE-008", "WARN", STRUCT, "is_pipeline", _CODE + r" AND content RLIKE '\\[\\s*[\'\"]gh[\'\"]\\s*,\\s*[\'\"]workflow[\'\"]\\s*,\\s*[\'\"]run[\'\"]'", "gh workflow run argv-style invocation in %s."),
    ("CD-012", "WARN", CD, f"({RUNTIME}) AND language = 'python'", f"{SRC_PY} AND {_NO_TESTS} AND contains(content, 'X-Internal-API-Key')", "X-Internal-API-Key header referenced in %s."),
    ("PIPE-002", "WARN", PIPE, "is_pipeline", f"{SRC_PY} AND {_NO_TESTS} AND contains(content, 'session.add(') AND NOT contains(low, 'on_conflict') AND NOT contains(content, 'merge(')", "session.add() without merge()/on_conflict in %s."),
    ("PIPE-002", "WARN", PIPE, "is_pipeline", f"{SRC_PY} AND {_NO_TESTS}" + r" AND content RLIKE '(?i)\\bINSERT\\s+INTO\\b' AND NOT contains(low, 'on conflict')", "Raw INSERT without ON CONFLICT in %s."),
    ("PIPE-005", "WARN", PIPE, "is_pipeline", f"path LIKE 'src/%' AND ext IN ('py', 'ts') AND {_NO_TESTS} AND contains(content, 'files().delete(')", "Drive files().delete() referenced in %s."),
    ("PIPE-005", "WARN", PIPE, "is_pipeline", f"path LIKE 'src/%' AND ext IN ('py', 'ts') AND {_NO_TESTS} AND contains(low, 'trashed') AND contains(low, 'update') AND contains(content, 'files()')", "Potential Drive trash update on input file in %s."),
    ("PIPE-005", "WARN", PIPE, "is_pipeline", f"path LIKE 'src/%' AND ext IN ('py', 'ts') AND {_NO_TESTS}" + r" AND content RLIKE 'os\\.(remove|unlink)\\(|shutil\\.rmtree\\(' AND content RLIKE '\\b(input_path|input_file|source_path|src_path|local_path)\\b'", "os.remove/unlink/rmtree may target input paths (%s)."),
    ("AUTH-002", "WARN", CROSS, API_PY, "path LIKE 'src/%' AND name = 'auth.py' AND NOT contains(content, 'common-python-utils') AND NOT contains(content, 'common_python_utils')", "%s: auth.py has no reference to common-python-utils."),
    ("FE-006", "ERROR", STRUCT, "is_static OR is_react", r"path LIKE 'src/%' AND ext = 'astro' AND contains(front, 'fetch(') AND NOT (contains(front, 'try') AND contains(front, 'catch'))", "%s: frontmatter fetch() without try/catch error handling."),
    ("PY-004", "WARN", STRUCT, PY_LIKE, SRC_PY + r" AND content RLIKE '\\.json\\(\\)\\[|csv\\.DictReader|csv\\.reader' AND NOT contains(content, 'BaseModel')", "%s: accesses external data (JSON/CSV) without a Pydantic BaseModel."),
)

#: Rules whose rows come from source facts: severity, dimension, gate.
SOURCE_RULES = {
    "CD-003": ("WARN", CD, PY), "PY-014": ("WARN", STRUCT, PY), "API-004": ("ERROR", STRUCT, "is_api"), "API-005": ("ERROR", STRUCT, "is_api"), "API-006": ("WARN", STRUCT, API_PY), "API-008": ("ERROR", STRUCT, API_PY),
    "DOC-006": ("WARN", DOCS, "language = 'python'"), "DOC-007": ("WARN", DOCS, "language = 'python' AND (is_pipeline OR is_api)"), "DOC-010": ("ERROR", DOCS, API_PY), "DOC-011": ("WARN", DOCS, API_PY), "CD-008": ("WARN", STRUCT, "language = 'python'"),
    "PIPE-003": ("WARN", PIPE, COG), "PIPE-004": ("ERROR", PIPE, COG), "PIPE-006": ("WARN", PIPE, COG), "PIPE-007": ("WARN", PIPE, "is_pipeline"), "PIPE-012": ("WARN", PIPE, COG), "PRIN-002": ("ERROR", "principles", COG),
    "TEST-008": ("WARN", COVER, "is_api"), "TEST-011": ("ERROR", COVER, "is_pipeline OR is_api"), "TEST-013": ("INFO", "principles", "is_pipeline OR is_api OR is_react"),
}

#: Rules that plans/engine.py computes from several files: severity, dimension, gate.
CROSS_RULES = {
    "DOC-008": ("WARN", DOCS, ANY), "CFG-001": ("WARN", "configuration_consistency", PY_LIKE), "CFG-002": ("WARN", "configuration_consistency", PY_LIKE), "TEST-010": ("ERROR", COVER, API_PY), "XSTACK-004": ("WARN", STRUCT, "is_static OR is_react OR is_api"),
    "FE-008": ("WARN", STRUCT, "is_static"), "FE-009": ("WARN", STRUCT, "is_static"), "FE-010": ("WARN", STRUCT, "is_static"), "VER-008": ("ERROR", CD, ANY), "META-003": ("WARN", STRUCT, "repo_type = 'standards-repo'"),
}


def gates_of(rules: list[Rule], by_path: tuple) -> dict[str, int]:
    """Every gate and its number."""
    every = [*(r.gate for r in rules), *(x[3] for x in by_path), *(v[2] for v in (SOURCE_RULES | CROSS_RULES).values())]
    return {g: i for i, g in enumerate(dict.fromkeys(every))}


RULE_TABLE = "gate int, seq int, rule_id string, severity string, dimension string, wrapped boolean, always boolean, template string, clauses array<array<struct<word:int,mask:bigint,want:bigint>>>"


def rule_table(rules: list[Rule], gates: dict[str, int]) -> list[tuple]:
    """Rows of RULE_TABLE. A template is a format whose arguments are VALUES, in their order."""
    sizes = words(len(ATOMS), len(CONDITIONS))
    template = lambda text: re.sub(r"\{(\w+)\}", lambda m: f"%{VALUES.index(m[1]) + 1}$s", text.replace("%", "%%"))
    return [(gates[r.gate], i, r.rule_id, r.severity, r.dimension, r.wrapped, r.always, template(r.text), compiled(r.test, sizes)) for i, r in enumerate(rules)]


def gate_table(rules: list[Rule], by_path: tuple, gates: dict[str, int]) -> list[tuple[int, str, bool]]:
    """gate, rule_id, wrapped: the rules behind each gate; a rule counts as wrapped behind all of its gates if any part of it is."""
    kinds = (SOURCE_RULES | CROSS_RULES).items()
    behind = [*((r.gate, r.rule_id, r.wrapped) for r in rules), *((x[3], x[0], True) for x in by_path), *((v[2], k, True) for k, v in kinds)]
    wrapped = {rule for _, rule, w in behind if w}
    return [*dict.fromkeys((gates[g], rule, rule in wrapped) for g, rule, _ in behind)]
