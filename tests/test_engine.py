"""Rules on small repositories: what is found and what is not."""

import pytest

from rulespan.plans.engine import FILES, REPOS, evaluate


@pytest.fixture(scope="module")
def run(spark):
    """All cases at once: one plan for all repositories."""
    files, repos = [], []
    for repo, kind, language, tree, more in CASES:
        files += [(repo, p, t) for p, t in tree.items()]
        repos.append((repo, more.get("name", repo), language, kind, more.get("root"), more.get("traits"), more.get("exempt"), more.get("defer"), more.get("age")))
    found, checked = evaluate(spark.createDataFrame(files, FILES), spark.createDataFrame(repos, REPOS))
    out = {}
    for r in found.collect():
        out.setdefault(r["repo"], []).append(r)
    rules = {}
    for r in checked.collect():
        rules.setdefault(r["repo"], set()).add(r["rule_id"])
    return out, rules


ROUTES = '''
"""Doc."""
@router.get("/v1/a", summary="s")
async def a(x=Depends(verify)):
    """Doc."""
@app.post("/b", description="Intentionally public", response_model=M)
def b():
    """Doc."""
@router.get("/health")
def health(): pass
class Row(DeclarativeBase):
    """Doc."""
    id: int
class Out(BaseModel):
    """Doc."""
    x: int
    y: int = Field(description="y")
class AppSettings(BaseSettings):
    """Doc."""
    KEY: str
    other = 1
z = settings.KEY, settings.gone, getattr(settings, "lost"), settings._x
'''
FLOW = '''
import shutil
@flow(name="x")
def run():
    for i in items:
        session.add(i)
@task
def get():
    return httpx.get("u")
@task(retries=2)
def ok():
    return httpx.get("u")
def main():
    t = tempfile.mkdtemp()
    print("x")
    with a:
        tempfile.mkdtemp()
    g.with_options(retry_delay_seconds=5)
    logger.error("file not found: x")
    time.sleep(3)
'''
CASES = [
    ("empty", "pipeline-cog", "python", {}, {}),
    ("exempt", "pipeline-cog", "python", {}, {"exempt": [("DOC-001", "no readers"), ("PY-007", "why"), ("DOC-003", "")], "defer": [("DOC-004", "later"), ("DOC-001", "x")]}),
    ("api-x", "api-service", "python", {"src/api_x/main.py": ROUTES, "src/api_x/auth.py": "x", "tests/test_a.py": 'def test_a():\n    client.get("/v1/a")\n    m = MagicMock()\n', "pyproject.toml": '[project]\nname = "api-x"\nsqlalchemy pymysql', ".env.example": "# external\nA=1\nB=2\nKEY=3\n# note\n", ".env.local": "", "README.md": "input output"}, {}),
    ("cog", "pipeline-cog", "python", {"src/cog/main.py": FLOW, "src/cog/Bad-Name.py": "# x = 1\n# y = 2\n# def f\nx = 1\n", ".github/workflows/ci.yml": "on: repository_dispatch\r\nrun: prefect deploy\r\n", "pyproject.toml": 'name = "other"\nprefect'}, {}),
    ("site", "static-site", "typescript", {"package.json": '{"dependencies": {"astro": "^1.0.0", "@astrojs/x": "1.2.3", "astro-y": 3}}', "astro.config.mjs": "", "src/a.astro": "---\nconst a = await fetch('/u');\n---\n<p/>", "src/b.astro": "<script>fetch('/u'); fetch('/w')</script>", "src/c.ts": "import.meta.env.VITE_A", "README.md": "/u"}, {}),
    ("std", "standards-repo", "python", {"index.yaml": "version: 1\nschema:\n  traits: [a]\n  dod_types: {a: 1}\n", "VERSION": "1"}, {"age": 91}),
    ("mono", None, "python", {"README.md": "input output", ".releaserc.json": '{"plugins": [["@semantic-release/exec", {"prepareCmd": "sed pyproject.toml"}], ["@semantic-release/git", {"assets": ["CHANGELOG.md"]}]]}'}, {}),
    ("app", "react-app", "typescript", {"package.json": '{"a": "webpack"}'}, {"root": "mono", "traits": ["cloudflare-pages", "unknown"]}),
]


def texts(run, repo, rule):
    return sorted(r["finding"] for r in run[0].get(repo, []) if r["rule_id"] == rule)


def test_empty_repository(run):
    for rule in ("DOC-001", "DOC-003", "PY-005", "PY-007", "EVAL-008", "TEST-003", "PIPE-001"):
        assert texts(run, "empty", rule), rule
    assert texts(run, "empty", "PIPE-001") == ["Prefect is not declared as a dependency."]
    assert not texts(run, "empty", "CD-009") and not texts(run, "empty", "PY-001")


def test_exemptions_and_deferrals(run):
    rows = {(r["rule_id"], r["finding"]): r for r in run[0]["exempt"]}
    skipped = rows["DOC-001", "Skipped: no readers"]
    assert skipped["severity"] == "INFO" and skipped["suggestion"] is None
    assert texts(run, "exempt", "DOC-003") == []
    assert texts(run, "exempt", "PY-007") == ["Skipped: why", "pyproject.toml is absent."]
    put_off = rows["DOC-004", ".env.example is absent."]
    assert put_off["deferred"] and put_off["severity"] == "INFO"
    assert {"DOC-001", "DOC-003", "PY-007"} <= run[1]["exempt"]


def test_routes_and_models(run):
    at = "src/api_x/main.py"
    assert texts(run, "api-x", "API-004") == [f"{at}::b: route '/b' missing /v1/ prefix."]
    assert texts(run, "api-x", "API-005") == [f"{at}::a: endpoint missing response_model=.", f"{at}::health: endpoint missing response_model=."]
    assert texts(run, "api-x", "API-008") == [f"{at}::b: route '/b' has no Depends(...) auth."]
    assert texts(run, "api-x", "DOC-011") == []
    assert f"{at}::a: route decorator missing: description, response_model." in texts(run, "api-x", "DOC-010")
    assert texts(run, "api-x", "API-006") == [f"{at}::Row: SQLAlchemy model missing owner_id column."]
    assert texts(run, "api-x", "DOC-007") == [f"{at}::Out.x: Pydantic field missing Field(description=...)."]
    assert texts(run, "api-x", "DOC-006") == [f"{at}::health: public function missing docstring."]
    assert texts(run, "api-x", "CFG-001") == [f"{at}: getattr(settings, 'lost') but lost not declared on Settings.", f"{at}: settings.gone access but not declared on Settings."]
    assert texts(run, "api-x", "CFG-002") == [".env.example key 'B' not declared on Settings."]
    assert texts(run, "api-x", "TEST-010") == ["2 route(s) have no contract test referencing them: /b, /health."]
    assert texts(run, "api-x", "TEST-008") == ["tests/test_a.py::test_a: references /v1/ without TestClient/AsyncClient."]
    assert texts(run, "api-x", "TEST-011") == ["tests/test_a.py::test_a: creates mocks but has no assert_called* assertion."]
    assert texts(run, "api-x", "API-002") == ["Non-Postgres data-store client or driver signal detected ('mysql')."]
    assert texts(run, "api-x", "CD-011") == ["Committed env file detected: .env.local."]
    assert texts(run, "api-x", "AUTH-002") == ["src/api_x/auth.py: auth.py has no reference to common-python-utils."]
    assert texts(run, "api-x", "CD-002") == [] and len(texts(run, "api-x", "CD-010")) == 2  # superseded
    assert texts(run, "api-x", "PY-015") == ["sqlalchemy declared without asyncpg in pyproject.toml."]
    assert texts(run, "api-x", "DOC-002") == [] and texts(run, "api-x", "PIPE-001") == []


def test_flows(run):
    at = "src/cog/main.py"
    assert texts(run, "cog", "PIPE-004") == [f"{at}::run: flow writes to shared resource without concurrency guard."]
    assert texts(run, "cog", "PRIN-002") and texts(run, "cog", "PIPE-006")
    assert texts(run, "cog", "PIPE-007") == [f"External-calling task missing retries= in {at}::get."]
    assert texts(run, "cog", "PY-014") == [f"Temporary resource created without with/finally cleanup: {at}."]
    assert texts(run, "cog", "CD-003") == [f"print() statement found in {at}."]
    assert texts(run, "cog", "PIPE-012") == [f"{at}: retry_delay_seconds=5 hardcoded without PYTEST_CURRENT_TEST guard."]
    assert texts(run, "cog", "CD-008") == [f"{at}: logger.error used for expected outcome: 'file not found: x'."]
    assert texts(run, "cog", "TEST-013") == [f"{at}: hardcoded numeric value 3 in time/retry/timeout call.", f"{at}: hardcoded numeric value 5 in time/retry/timeout call."]
    assert texts(run, "cog", "DOC-008") == ["Potential dead/commented-out code in src/cog/Bad-Name.py near line 3."]
    assert "Non-snake_case Python module filename: src/cog/Bad-Name.py." in texts(run, "cog", "PY-011")
    assert "Project name 'other' does not match repo naming 'cog'." in texts(run, "cog", "PY-011")
    assert texts(run, "cog", "CD-006") == ["repository_dispatch workflow appears to relay into automation (.github/workflows/ci.yml)."]
    assert texts(run, "cog", "PIPE-002") == [f"session.add() without merge()/on_conflict in {at}."]
    assert texts(run, "cog", "DOC-009") and texts(run, "cog", "CD-015")
    assert not texts(run, "cog", "PIPE-001")


def test_sites(run):
    assert texts(run, "site", "FE-008") == ["dependencies: astro is not pinned to an exact version ('^1.0.0').", "dependencies: astro-y version must be a string semver for FE-008 scanning."]
    assert texts(run, "site", "FE-009") == ["Astro component performs runtime fetch of URL also used in frontmatter (src/b.astro)."]
    assert texts(run, "site", "FE-010") == ["Runtime fetch URL not documented in README/docs (src/b.astro: /w)."]
    assert texts(run, "site", "FE-006") == ["src/a.astro: frontmatter fetch() without try/catch error handling."]
    assert texts(run, "site", "XSTACK-004") == ["src/c.ts: env var VITE_A uses VITE_ prefix in a repo expecting PUBLIC_."]
    assert not texts(run, "site", "FE-001") and not texts(run, "site", "XSTACK-001") and not texts(run, "site", "FE-002")


def test_standards(run):
    assert texts(run, "std", "META-002") == ["Stray plaintext version file exists at repo root (VERSION).", "index.yaml still declares a top-level version: field."]
    assert texts(run, "std", "PRIN-009") == ["Standards repo appears stale (91 days since last commit)."]
    pytest.importorskip("yaml")
    assert texts(run, "std", "META-003") == ["schema.traits is a YAML list — canonical enums must be dict maps."]


def test_monorepo_root(run):
    assert not texts(run, "app", "DOC-001") and texts(run, "app", "DOC-003")
    assert texts(run, "app", "VER-008") == ["pyproject.toml is written by prepareCmd but absent from @semantic-release/git assets."]
    assert texts(run, "app", "FE-002") == ["Forbidden frontend stack signal found: webpack.", "TypeScript setup missing for React web app."]
    assert texts(run, "app", "VER-005") == [] and texts(run, "app", "MONO-002") == []


def test_every_rule_is_wired():
    from rulespan.operators import rules as ru

    ids = {r.rule_id for r in ru.repo_rules()} | {x[0] for x in ru.file_rules()} | set(ru.SOURCE_RULES) | set(ru.CROSS_RULES)
    assert len(ids) == 106


def test_every_rule_has_a_suggestion(run):
    from rulespan.operators import rules as ru
    from rulespan.operators.advice import ADVICE

    assert set(ADVICE) - {"CHECKER"} == {r.rule_id for r in ru.repo_rules()} | {x[0] for x in ru.file_rules()} | set(ru.SOURCE_RULES) | set(ru.CROSS_RULES)
    for rows in run[0].values():
        for r in rows:
            assert (r["suggestion"] is None) == r["finding"].startswith("Skipped: "), r


CRASHES = {
    "src/deep.py": "x = " + "-" * 200_000 + "1\n",
    "src/sum.py": "@flow\ndef run():\n    return " + " + ".join(["a"] * 3000) + "\n",
    "src/chain.py": "@task\ndef run():\n    return a" + ".b" * 3000 + "\n",
    "src/null.py": "x = '\0'\n",
    "index.yaml": "schema: [a]\n",
    ".releaserc.json": '{"plugins": [["@semantic-release/git", {"assets": false}], ["@semantic-release/exec", {"prepareCmd": null}]]}',
    "package.json": "[" * 100_000,
}


def test_no_file_ends_a_run(spark):
    """What makes a parser give up is a row of that file; rows of other checks and files stay."""
    from rulespan.functions.source_facts import source_rows

    rows = {p: list(source_rows(p, t)) for p, t in CRASHES.items()}
    for p in ("src/deep.py", "src/sum.py", "src/chain.py", "package.json"):
        assert [r[0] for r in rows[p]].count("CHECKER") == 1, (p, rows[p])
    assert ("DOC-006", "src/chain.py::run: public function missing docstring.", "") in rows["src/chain.py"]
    assert rows["index.yaml"] == [] and rows["src/null.py"] == []
    assert [r[:2] for r in rows[".releaserc.json"]] == [("VER-008", "CHANGELOG.md is absent from @semantic-release/git assets.")]
    assert [r[0] for r in source_rows(".releaserc.json", '{"plugins": null}')] == ["VER-008"]
    files = spark.createDataFrame([("r", p, t) for p, t in [*CRASHES.items(), ("src/fine.py", "print(1)\n")]], FILES)
    repos = spark.createDataFrame([("r", "r", "python", "pipeline-cog", None, None, None, None, None)], REPOS)
    found = evaluate(files, repos)[0].collect()
    broken = [r for r in found if r["rule_id"] == "CHECKER"]
    assert len(broken) == 4 and {(r["severity"], r["dimension"]) for r in broken} == {("WARN", "structural_conformance")}
    assert "print() statement found in src/fine.py." in [r["finding"] for r in found]


MORE = [
    ("std2", "standards-repo", "python", {"index.yaml": "schema:\n  traits: {a: 1}\n", ".releaserc.json": "{}", "package.json": '{"devDependencies": {"semantic-release": "1"}}', ".github/workflows/ci.yml": "push: [main]\nsemantic-release"}, {"age": 3}),
    ("app2", "react-app", "typescript", {"pnpm-lock.yaml": ""}, {}),
    ("api2", "api-service", "python", {"src/a/main.py": "x = 1\n", "tests/test_a.py": "def test_a():\n    pass\n", ".env.example": "A=1\n"}, {}),
    ("site2", "static-site", "typescript", {"package.json": '{"dependencies": {"astro": "1.2.3"}}', "astro.config.mjs": "", "src/a.astro": "---\ntry { const a = await fetch('/u'); } catch {}\n---\n", "src/b.astro": "<script>fetch('/w')</script>", "src/c.ts": "import.meta.env.PUBLIC_A", "README.md": "/w pages.dev", ".releaserc.json": '{"plugins": [["@semantic-release/git", {"assets": ["CHANGELOG.md"]}]]}'}, {}),
]


def test_every_rule_is_found_and_not_found(spark, run):
    """Each of the 106 rules has a repository with a finding and one, to which it applies, without."""
    from rulespan.operators import rules as ru
    from rulespan.plans.queries import Tables
    from rulespan.plans.rule_queries import _tree, q_ast_rules

    t = Tables(spark, "/root/testdata/sf0.01")
    hits = {(repo, r["rule_id"]) for repo, rows in run[0].items() for r in rows if not r["finding"].startswith("Skipped")}
    applied = {(repo, r) for repo, ids in run[1].items() for r in ids}
    for files, repos in (_tree(t), (spark.createDataFrame([(r, p, x) for r, _, _, tree, _ in MORE for p, x in tree.items()], FILES), spark.createDataFrame([(r, r, lang, kind, None, None, None, None, more.get("age")) for r, kind, lang, _, more in MORE], REPOS))):
        found, checked = evaluate(files, repos, mono_rules=True)
        hits |= {tuple(r) for r in found.filter("NOT startswith(finding, 'Skipped')").select("repo", "rule_id").collect()}
        applied |= {tuple(r) for r in checked.collect()}
    hits |= {(r["repo"], r["rule_id"]) for r in q_ast_rules(Tables(spark, "/root/testdata/sf0.001")).collect()}
    ids = {r.rule_id for r in ru.repo_rules()} | {x[0] for x in ru.file_rules()} | set(ru.SOURCE_RULES) | set(ru.CROSS_RULES)
    assert ids - {r for _, r in hits} == set()
    assert ids - {r for _, r in applied - hits} == set()


def test_engine_plan_parses_once(spark):
    """Files are parsed in one written pass; the plan that is left has no Python."""
    from rulespan.plans.queries import QUERIES

    df = QUERIES["q_rules_engine"](spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 0


def test_delivery_keeps_dead_letters(spark, tmp_path):
    from rulespan.operators.findings import deliver

    def post(row):
        if row["finding"] == "bad":
            raise OSError("refused")

    rows = spark.createDataFrame([("a", "good"), ("b", "bad")], "repo string, finding string")
    out = deliver(rows, post, f"file://{tmp_path}/sent")
    assert sorted((r["repo"], r["error"]) for r in out.collect()) == [("a", None), ("b", "refused")]


def test_undecodable_file_is_told(spark):
    files = spark.createDataFrame([("r", "src/a.py", None, False), ("r", "src/b.py", "print(1)\n", True), ("r", "logo.png", None, False)], FILES + ", decode_ok boolean")
    repos = spark.createDataFrame([("r", "r", "python", "pipeline-cog", None, None, None, None, None)], REPOS)
    found = [(r["rule_id"], r["finding"]) for r in evaluate(files, repos)[0].collect()]
    assert [f for r, f in found if r == "CHECKER"] == ["Check of src/a.py raised an unexpected error: not UTF-8"]
    assert ("CD-003", "print() statement found in src/b.py.") in found


def test_version_that_is_absent_raises(spark):
    from pyspark.sql import functions as F

    from rulespan.operators.findings import published_version

    read = lambda text: spark.range(1).select(published_version(F.lit(text)).alias("v")).first()["v"]
    assert read('{"version": " 6.1.0 ", "name": "x"}') == "6.1.0"
    for bad in ('{"name": "x"}', '{"version": ""}', '{"version": null}', "no json", None):
        with pytest.raises(Exception, match="no standards version"):
            read(bad)


def test_import_runs(spark):
    from rulespan.streaming.events import import_findings

    rows = [("fine", 3, 3, 0, 0, 0, [], None), ("empty", None, None, None, None, None, None, None), ("more", 1, 2, 0, 0, 0, [], True), ("bad", 4, 0, 2, 1, 1, ["a", "b"], False)]
    runs = spark.createDataFrame(rows, "run string, attempted int, imported int, failed int, duplicates int, unrecognized int, labels array<string>, ingested boolean")
    got = {}
    for r in import_findings(runs).collect():
        got.setdefault(r["run"], []).append((r["severity"], r["finding"]))
    assert got["fine"] == [("INFO", "3 files imported")] and got["empty"] == [("INFO", "0 files imported")]
    assert got["more"] == [("WARN", "1 more files imported, failed or duplicates than the 1 attempted")]
    assert got["bad"] == [
        ("WARN", "1 of 4 attempted files are neither imported, failed nor duplicates"), ("WARN", "2 of 4 attempted files failed: a, b"), ("ERROR", "No file imported of 4 attempted"),
        ("INFO", "1 possible duplicates not imported"), ("INFO", "1 files skipped for their names"), ("ERROR", "API ingest failed"),
    ]
