"""Tests of a repository as data: clauses over its bits, which rows of a table hold and a join compares.

A test is a disjunction of clauses; a clause wants some bits set and others clear. compiled() turns each clause into
(word, mask, wanted) triples, so a rule is a row, and the plan that evaluates rules does not grow with their number.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

#: Bits of a word; a long has a few more, and its sign stays out of it.
WORD = 60
#: Rows of bits: of the repository, of its root, and conditions on its other columns.
ROWS = ("own", "root", "cond")

Literal = tuple[str, int, bool]


def _absorbed(clauses: Iterable[frozenset[Literal]]) -> frozenset[frozenset[Literal]]:
    """Without clauses that another one implies or that want a bit both ways."""
    able = sorted({c for c in clauses if not any((r, i, not on) in c for r, i, on in c)}, key=len)
    kept: list[frozenset[Literal]] = []
    for c in able:
        if not any(k <= c for k in kept):
            kept.append(c)
    return frozenset(kept)


@dataclass(frozen=True)
class Test:
    """Some clause holds: every literal (row, bit, wanted) of it is as wanted."""

    __test__ = False  # not a test case

    clauses: frozenset[frozenset[Literal]]

    def __or__(self, other: Test) -> Test:
        return Test(_absorbed(self.clauses | other.clauses))

    def __and__(self, other: Test) -> Test:
        return Test(_absorbed(a | b for a in self.clauses for b in other.clauses))

    def __invert__(self) -> Test:
        return reduce(Test.__and__, (Test(frozenset(frozenset({(r, i, not on)}) for r, i, on in c)) for c in self.clauses), ALWAYS)

    def holds(self, bits: set[tuple[str, int]]) -> bool:
        """Whether it holds where just these bits are set."""
        return any(all(((r, i) in bits) == on for r, i, on in c) for c in self.clauses)


ALWAYS, NEVER = Test(frozenset({frozenset()})), Test(frozenset())


def bit(row: str, i: int) -> Test:
    return Test(frozenset({frozenset({(row, i, True)})}))


def choose(condition: Test, then: Test, other: Test) -> Test:
    return (condition & then) | (~condition & other)


def fewer_than_two(tests: list[Test]) -> Test:
    """At most one holds: all but some one do not."""
    off = [~t for t in tests]
    return reduce(Test.__or__, (reduce(Test.__and__, (o for j, o in enumerate(off) if j != i), ALWAYS) for i in range(len(off))))


def in_turn(cases: list[tuple[Test, str]]) -> list[tuple[Test, str]]:
    """Each case where none before it holds: the first that holds, one row a case."""
    out, before = [], NEVER
    for t, text in cases:
        out.append((t & ~before, text))
        before |= t
    return out


def listed(cases: list[tuple[Test, str]]) -> list[tuple[Test, str]]:
    """The texts of those that hold, comma-joined, for each set of cases but the empty one."""
    out = []
    for n in range(1, 1 << len(cases)):
        on = [n >> i & 1 for i in range(len(cases))]
        out.append((reduce(Test.__and__, (t if k else ~t for k, (t, _) in zip(on, cases))), ", ".join(text for k, (_, text) in zip(on, cases) if k)))
    return out


def words(n_atoms: int, n_conditions: int) -> dict[str, int]:
    """The number of words of each row of bits."""
    sizes = {"own": n_atoms, "root": n_atoms, "cond": n_conditions}
    return {r: -(-sizes[r] // WORD) for r in ROWS}


def compiled(test: Test, sizes: dict[str, int]) -> list[list[dict[str, int]]]:
    """The clauses as lists of {word, mask, want}; words are counted over all rows of bits, in their order."""
    start = {r: sum(sizes[x] for x in ROWS[:k]) for k, r in enumerate(ROWS)}
    out = []
    for clause in sorted(test.clauses, key=lambda c: (len(c), sorted(c))):
        triples: dict[int, list[int]] = {}
        for r, i, on in clause:
            t = triples.setdefault(start[r] + i // WORD, [0, 0])
            t[0] |= 1 << i % WORD
            t[1] |= on << i % WORD
        out.append([{"word": w, "mask": m, "want": x} for w, (m, x) in sorted(triples.items())])
    return out
