"""Rules as rows of bits, and tokens by automata, against plain evaluation."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rulespan.functions.marks import Marks
from rulespan.operators import bits as bt
from rulespan.operators import rules as ru
from rulespan.plans import engine

_LEAF = st.tuples(st.sampled_from(["own", "root", "cond"]), st.integers(0, 3)).map(lambda x: ("bit", *x))
_TREES = st.recursive(_LEAF, lambda t: st.one_of(st.tuples(st.just("not"), t), st.tuples(st.sampled_from(["and", "or"]), t, t), st.tuples(st.just("choose"), t, t, t)), max_leaves=8)


def build(tree):
    op, *args = tree
    if op == "bit":
        return bt.bit(*args)
    a = [build(x) for x in args]
    return {"not": lambda: ~a[0], "and": lambda: a[0] & a[1], "or": lambda: a[0] | a[1], "choose": lambda: bt.choose(*a)}[op]()


def plain(tree, on):
    op, *args = tree
    if op == "bit":
        return tuple(args) in on
    a = [plain(x, on) for x in args]
    return {"not": lambda: not a[0], "and": lambda: a[0] and a[1], "or": lambda: a[0] or a[1], "choose": lambda: a[1] if a[0] else a[2]}[op]()


def by_rows(test, on, sizes):
    """What the join does: words against masks."""
    start = {r: sum(sizes[x] for x in bt.ROWS[:k]) for k, r in enumerate(bt.ROWS)}
    values = [0] * sum(sizes.values())
    for r, i in on:
        values[start[r] + i // bt.WORD] |= 1 << i % bt.WORD
    return any(all(values[x["word"]] & x["mask"] == x["want"] for x in c) for c in bt.compiled(test, sizes))


@settings(max_examples=300, deadline=None)
@given(_TREES, st.sets(st.tuples(st.sampled_from(["own", "root", "cond"]), st.integers(0, 3))))
def test_clauses_are_the_expression(tree, on):
    test = build(tree)
    assert test.holds(on) == plain(tree, on) == by_rows(test, on, bt.words(4, 4))


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 200), max_size=12), st.integers(1, 5))
def test_helpers_and_wide_words(on, n):
    tests = [bt.bit("own", 40 * i) for i in range(n)]
    bits, sizes = {("own", i) for i in on}, bt.words(201, 1)
    held = [40 * i in on for i in range(n)]
    assert bt.fewer_than_two(tests).holds(bits) == by_rows(bt.fewer_than_two(tests), bits, sizes) == (sum(held) < 2)
    cases = [(t, str(i)) for i, t in enumerate(tests)]
    assert [x for t, x in bt.in_turn(cases) if by_rows(t, bits, sizes)] == [str(i) for i, h in enumerate(held) if h][:1]
    told = [x for t, x in bt.listed(cases) if by_rows(t, bits, sizes)]
    assert told == ([", ".join(str(i) for i, h in enumerate(held) if h)] if any(held) else [])


def test_constants():
    assert bt.ALWAYS.holds(set()) and not bt.NEVER.holds({("own", 1)}) and ~bt.ALWAYS == bt.NEVER and ~bt.NEVER == bt.ALWAYS
    assert bt.compiled(bt.NEVER, bt.words(1, 1)) == [] and bt.compiled(bt.ALWAYS, bt.words(1, 1)) == [[]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abAİ ", min_size=1, max_size=4), min_size=1, max_size=70, unique=True), st.text("abABİ \n", max_size=60), st.integers(0, 3), st.randoms(use_true_random=False))
def test_marks_are_contains(words, text, scopes, rnd):
    tokens = {i: (rnd.randrange(2), w, rnd.random() < 0.5) for i, w in enumerate(words)}
    got = Marks(tokens, 60, 2).words(text, scopes)
    want = [0, 0]
    for i, (scope, w, low) in tokens.items():
        if scopes >> scope & 1 and w in (text.lower() if low else text):
            want[i // 60] |= 1 << i % 60
    assert got == want


def test_marks_keep_what_is_set():
    assert Marks({1: (0, "x", False)}, 60, 1).words("x", 1, [4]) == [6] and Marks({}, 60, 2).words("x", 1) == [0, 0]


def test_file_rows_are_the_atoms(spark):
    """The bits of the one pass against each atom's own SQL, on texts of tokens; null and long texts, and paths beyond all scopes."""
    ru.repo_rules(ru.Names(checker="a-b", api_hosts=("h.example",)))
    rnd = random.Random(7)
    tokens = [t for _, t, _ in ru.TOKENS.values()]
    paths = ["README.md", "CHANGELOG.md", "pyproject.toml", "package.json", ".env.example", ".github/workflows/ci.yml", ".github/workflows/x.yaml", "src/a/__init__.py", "src/a/b.py", "src/a.tsx", "src/a.ts", "tests/test_a.py", "tests/conftest.py", "prefect.yaml", "requirements.txt", "requirements/prod.txt", "astro.config.mjs", "index.yaml", "docs/decisions/ADR-1.md", "other.bin"]
    word = lambda: rnd.choice([str.upper, str.lower, str.title, str])(rnd.choice(tokens)) if rnd.random() < 0.6 else rnd.choice(["İK", "x", "\n## 1.2.3", "\nversion :", "def health /health"])
    rows = [(f"r{i}", p, " ".join(word() for _ in range(rnd.choice([0, 3, 30])))) for i in range(12) for p in paths]
    rows += [("n", p, None) for p in paths] + [("long", "src/a/b.py", "x" * 300_000 + "CORSMiddleware")]
    files = engine.prepared(spark.createDataFrame(rows, engine.FILES))
    got = engine.file_rows(files, ru.file_rules()).filter("kind = 'file'")
    size = bt.WORD
    own = [F.expr(" | ".join(f"if(({s}) AND ({t}), {1 << j}L, 0L)" for j, (s, t) in enumerate(ru.ATOMS[i : i + size]))) for i in range(0, len(ru.ATOMS), size)]
    want = files.select("repo", "path", F.array(*own).alias("marks"))
    a, b = ({(r["repo"], r["path"]): list(r["marks"]) for r in d.select("repo", "path", "marks").collect()} for d in (got, want))
    assert a == b
    assert len(a) == len(rows)
    assert len({tuple(x) for x in a.values()}) > 40


def test_plan_does_not_grow_with_rules(spark):
    """A rule more is a row more: the joined plan has as many nodes for a hundred times the rules."""
    rules = ru.repo_rules()
    nodes = []
    for n in (1, 100):
        table = engine.small(spark, ru.rule_table(rules * n, ru.gates_of(rules, ru.file_rules())), ru.RULE_TABLE)
        plan = spark.range(3).withColumnRenamed("id", "gate").join(F.broadcast(table), "gate").select("rule_id")
        nodes.append(plan._jdf.queryExecution().executedPlan().treeString().count("\n"))
    assert nodes[0] == nodes[1]


def test_every_rule_can_hold_and_fail():
    for r in ru.repo_rules():
        assert r.test.clauses and r.test != bt.ALWAYS, r.rule_id
        assert "{" not in r.text or any(f"{{{v}}}" in r.text for v in ru.VALUES), r.text
