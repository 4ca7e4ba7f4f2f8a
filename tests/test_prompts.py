"""Prompts: what they are made of, and what stands where there is nothing."""

import pytest

from rulespan.functions import prompts as ask

RULE = "repo string, seq long, rule_id string, severity string, title string, check_notes string, check_mode string"
FINDING = "repo string, seq long, rule_id string, severity string, finding string"
TEMPLATE = "{repo}|{exceptions}|{inventory}|{readme}|{rules}|{findings}|{soft}|{resolved}"


def test_conformance(spark):
    rules = [("a", 2, "R2", "WARN", "two", "look", "llm"), ("a", 1, "R1", "ERROR", "one", "see", "deterministic"), ("a", 3, "R3", "INFO", "three", None, "llm"), ("a", 4, "R4", "INFO", "four", "n", "llm"), ("a", 5, "EVAL-002", "INFO", "never", "", "llm"), ("a", 6, "R6", "INFO", "six", "n", "llm")]
    findings = [("a", 2, "R4", "WARN", "bad"), ("a", 1, "CHECKER", None, "broke"), ("a", 3, None, "INFO", None)]
    files = [("a", f"src/f{i:03}.py", None) for i in range(63)] + [("a", "README.md", "x" * 4001), ("a", ".github/x", None), ("a", "web/node_modules/y", None), ("a", "z/.hid", None), ("a", "src/__pycache__/c", None), ("a", "docs/README.md", "no")]
    repos = spark.createDataFrame([("a",), ("b",)], "repo string")
    got = ask.conformance_prompts(
        repos, spark.createDataFrame(rules, RULE), spark.createDataFrame(findings, FINDING), spark.createDataFrame([("a", "R1")], "repo string, rule_id string"),
        spark.createDataFrame([("a", 2, "R6", ""), ("a", 1, "X", "why")], "repo string, seq long, rule_id string, reason string"), spark.createDataFrame(files, "repo string, path string, content string"), TEMPLATE,
    )
    got = {r["repo"]: r["prompt"].split("|") for r in got.collect()}
    _, exceptions, inventory, readme, listed, found, soft, resolved = got["a"]
    assert exceptions == "  - X: why\n  - R6"
    lines = inventory.split("\n")
    assert lines[0] == "  README.md" and lines[1] == "  docs/README.md" and lines[59] == "  src/f057.py" and lines[60:] == ["  ... (5 more files)"]
    assert readme == "x" * 4000 + "\n...(truncated)"
    assert listed.split("\n")[:4] == ["- R1 [ERROR]: one", "  How to check: see", "- R2 [WARN]: two", "  How to check: look"] and "R3" not in listed and "EVAL-002" not in listed
    assert found == "- [INFO] CHECKER: broke\n- [WARN] R4: bad\n- [INFO] ?: "
    assert soft == "- R2 [WARN]: two\n  How to check: look\n- R3 [INFO]: three\n  How to check: "
    assert resolved == "  - \n  - EVAL-002\n  - R1\n  - R4"
    assert got["b"] == ["b", "  (none)", "", "", "(none)", "(none)", "(none: all rules are covered by checks)", "  - EVAL-002"]


def test_runs(spark):
    runs = spark.createDataFrame([("r", 3, None, True), (None, 0, [], False), ("s", 1, ["x", "y"], None)], "run_id string, tabs long, names array<string>, ok boolean")
    got = [r[0] for r in runs.select(ask.run_prompts(runs, '{run_id}:{tabs}:{names}:{ok} {"findings": []}')).collect()]
    assert got == ['r:3:(none):true {"findings": []}', ':0:(none):false {"findings": []}', 's:1:x, y: {"findings": []}']
    with pytest.raises(KeyError):
        ask.run_prompts(runs, "{unknown}")
    columns = {n: "string" for n in ("run_id", "standards_version", "sets_attempted", "sets_imported", "sets_failed", "sets_skipped", "unrecognized_filename_skips", "duplicate_csv_count", "total_tracks", "api_ingest_success")}
    one = spark.createDataFrame([(*["1"] * len(columns), ["a", "b"])], ", ".join(f"{n} {t}" for n, t in columns.items()) + ", failed_set_labels array<string>")
    assert "Failed sets: a, b\n" in one.select(ask.run_prompts(one, ask.CSV_RUN)).head()[0]
