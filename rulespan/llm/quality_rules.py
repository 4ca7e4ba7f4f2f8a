"""Quality rules as a learned decision list.

Sequential covering: rules for the positive class (low quality) are learned one after another. A rule is grown, on
two thirds of the labelled statistics that no rule covers yet, by the threshold condition of the largest information
gain until it covers no negative; then its last conditions are cut as long as that doesn't lower
(p - n) / (p + n) on the other third. Learning ends when a rule is wrong in over half of what it covers there.
The list becomes one ordered Spark conditional expression.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import calm, key_text, raw, word_chunks

SYMBOLS = b"#*$%&|<>"
#: Bytes that begin a character in UTF-8.
_HEADS = bytes([*range(0x80), *range(0xC0, 0x100)])
#: Counts of each text, and what is derived from them.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks")
FEATURES = {
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbols_a_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "marks_a_word": "n_marks / greatest(n_words, 1)",
    "n_words": "cast(n_words as double)",
}
#: Labelled rows that rules are learned from, at most about: those whose hash lies below a bound.
TRAIN_ROWS = 20_000


def _lines(text: bytes) -> Iterator[bytes]:
    at = 0
    while (end := text.find(b"\n", at)) >= 0:
        yield text[at:end]
        at = end + 1
    yield text[at:]


def text_counts(text: bytes) -> tuple[int, ...]:
    """Words by ASCII white space; the counts in the order of COUNTS.

    Memory: 8 bytes a word and a line with a word. Windows and lines are told apart by 64-bit hashes.
    """
    windows, last, n = array("q"), [], 0
    for chunk in word_chunks(text):
        words = chunk.split()
        n += len(words)
        last += words
        windows.extend(map(hash, zip(last, last[1:], last[2:])))
        last = last[-2:]
    spaces = sum(text.count(c) for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))
    # code points: all bytes but those that continue one
    points = len(text) if text.isascii() else len(text) - len(text.translate(None, _HEADS))
    seen = array("q", (hash(line) for line in _lines(text) if line and not line.isspace()))
    lines = len(seen)
    dup = lines - len(np.unique(np.frombuffer(seen, dtype=np.int64))) if lines > 1 else 0
    repeat = 0
    if len(windows) > 1:
        w = np.frombuffer(windows, dtype=np.int64)
        order = np.argsort(w)
        same = w[order[1:]] == w[order[:-1]]
        if same.any():
            twice = np.zeros(n, dtype=bool)
            for at in (order[1:][same], order[:-1][same]):
                for i in range(3):
                    twice[at + i] = True
            repeat = int(twice.sum())
    upper = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(text) - len(text.translate(None, b"0123456789"))
    return n, points - spaces, sum(text.count(bytes([c])) for c in SYMBOLS), dup, repeat, lines, upper, digits, text.count(b"!") + text.count(b"?")


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, COUNTS and FEATURES of each row. Null text has no words; all its counts are 0.

    Each row gives one row, repeated ones and null keys too; very long texts are read part by part; an empty table
    gives no rows; other columns, whatever their names, change nothing.
    """

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            rows = [text_counts(t) for t in raw(b.column("text"))]
            made = zip(*rows) if rows else ((),) * len(COUNTS)
            yield pa.RecordBatch.from_arrays([b.column("key"), *(pa.array(c, pa.int64()) for c in made)], names=["key", *COUNTS])

    counts = key_text(docs, key, text).mapInArrow(calm(count), "key long, " + ", ".join(f"{c} long" for c in COUNTS))
    return counts.select("key", *COUNTS, *(F.expr(e).cast("double").alias(f"f_{c}") for c, e in FEATURES.items()))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] < self.threshold

    def sql(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold!r}D"


Rule = tuple[Condition, ...]


def covers(rule: Sequence[Condition], x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), dtype=bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _best(x: dict[str, np.ndarray], y: np.ndarray) -> Condition | None:
    """The condition of the largest information gain p1 (log p1 / (p1 + n1) - log p / (p + n)); ties to the first feature and lowest threshold."""
    p, n = y.sum(), (~y).sum()
    best, gain = None, 1e-9
    for f, v in x.items():
        order = np.argsort(v, kind="stable")
        s, ys = v[order], y[order]
        cut = np.flatnonzero(s[1:] > s[:-1]) + 1
        if not len(cut):
            continue
        below = np.concatenate([[0], np.cumsum(ys)])[cut]
        for above, p1, all1 in ((False, below, cut), (True, p - below, len(s) - cut)):
            with np.errstate(divide="ignore", invalid="ignore"):
                g = np.where(p1 > 0, p1 * (np.log2(p1 / all1) - np.log2(p / (p + n))), -1.0)
            i = int(np.argmax(g))
            if g[i] > gain:
                best, gain = Condition(f, above, float((s[cut[i] - 1] + s[cut[i]]) / 2)), g[i]
    return best


def learn(x: dict[str, np.ndarray], positive: np.ndarray, seed: int = 42, least: int = 5) -> list[Rule]:
    """Rules for the positive class, in order. x: a column of each feature.

    Neither rules nor their conditions are limited in number: only the error on the pruning part, fewer than `least`
    positives left and conditions without gain end them. Fewer positives than that: no rules.
    """
    rules: list[Rule] = []
    left = np.ones(len(positive), dtype=bool)
    rng = np.random.default_rng(seed)
    grow_part = rng.random(len(positive)) < 2 / 3
    while (left & positive).sum() >= least:
        g, q = left & grow_part, left & ~grow_part
        if not positive[g].any():
            break
        gx, gy, rule = {f: v[g] for f, v in x.items()}, positive[g], []
        while not gy.all() and (c := _best(gx, gy)):
            hit = c.holds(gx)
            rule.append(c)
            gx, gy = {f: v[hit] for f, v in gx.items()}, gy[hit]
        qx = {f: v[q] for f, v in x.items()}

        def worth(r: list[Condition]) -> float:
            hit = covers(r, qx)
            p, n = (hit & positive[q]).sum(), (hit & ~positive[q]).sum()
            return (p - n) / (p + n) if p + n else -1.0

        best = rule
        for i in range(len(rule) - 1, 0, -1):
            if worth(rule[:i]) >= worth(best):
                best = rule[:i]
        if not best or worth(best) <= 0:
            break
        rules.append(tuple(best))
        hit = covers(best, x)
        if not (hit & left).any():
            break
        left &= ~hit
    return rules


def verdict(rules: Sequence[Rule]) -> Column:
    """The list as one conditional expression: the number of the first rule that holds, from 1, else 0 (the default: kept)."""
    out = None
    for i, r in enumerate(rules, 1):
        test = F.expr(" AND ".join(c.sql() for c in r))
        out = F.when(test, F.lit(i)) if out is None else out.when(test, F.lit(i))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def fit_rules(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", rows: int = TRAIN_ROWS) -> list[Rule]:
    """Rules for label 0, from statistics() and a table of labels. Null labels don't count; of a key's labels the smallest does.

    About `rows` labelled rows at most (by a hash of the key) come to the driver. Without labels of both kinds, and
    for empty tables: no rules. Repeated rows count as often as they are there.
    """
    one = labels.select(labels[key].cast("long").alias("key"), labels[label].alias("label")).filter("key is not null and label is not null").groupBy("key").agg(F.min("label").alias("label"))
    n = one.count()
    bound = int(min(1.0, rows / max(1, n)) * (1 << 32))
    names = [f"f_{c}" for c in FEATURES]
    got = stats.join(one.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 32)) < bound), "key").select("key", "label", *names).toPandas().sort_values(["key", *names])
    if not len(got) or got["label"].nunique() < 2:
        return []
    return learn({f: got[f].to_numpy(dtype=float) for f in names}, (got["label"] == 0).to_numpy())
