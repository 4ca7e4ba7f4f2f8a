"""Language identification as mixture inference.

A model holds, for each learned language, log likelihoods of hashed character trigrams. A document's trigrams are
taken as drawn from a mixture of languages; expectation-maximisation estimates its proportions. The set of languages
is selected by penalised likelihood: of the sets of the 1, 2, ... most frequent languages the one whose log
likelihood, less a penalty for each further language, is largest. No number of languages and no least share bounds it.
Trigrams enter by their buckets' counts, so memory is bounded by buckets x languages however long a text is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, calm, key_text, raw

#: Buckets of trigrams, at most; with many languages fewer, so that a model has at most NUMBERS numbers.
BUCKETS, NUMBERS = 1 << 16, 1 << 26
#: Characters that are counted at a time.
PART = 1 << 20
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
#: Labelled rows of each language that the model is fitted on, about: rows whose hash lies below a bound by language.
TRAIN_ROWS = 3000
#: Different labels beyond which a column holds no languages: fitting refuses, as a model of them has no bound.
MAX_LANGUAGES = 1 << 14


@dataclass
class Model:
    languages: list[str]
    logp: np.ndarray  # buckets x languages, float32; buckets are a power of two


def trigrams(text: str, first: int = 0, last: int | None = None) -> np.ndarray:
    """Hashes of the character trigrams of a text in lower case, what is no letter being a space; of those around characters first to last."""
    c = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "replace"), dtype=np.uint32).copy()
    c[(c < 97) | ((c > 122) & (c < 170))] = 32
    space = c == 32
    h = c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA77) ^ c[2:] * np.uint32(0xC2B2AE3D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    kept = ~(space[1:-1] & (space[:-2] | space[2:]))
    return (h >> np.uint32(16))[first:last][kept[first:last]]


def trigram_counts(text: str, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the whole text's trigrams, ascending, and how often each is there."""
    if len(text) <= PART:
        grams = trigrams(text) & np.uint32(buckets - 1)
        if len(grams) < buckets >> 4:
            return np.unique(grams, return_counts=True)
        n = np.bincount(grams, minlength=buckets)
    else:
        n = np.zeros(buckets, dtype=np.int64)
        # each part has a neighbour's character at either side, whose own trigrams are left to the neighbour
        for i in range(0, len(text), PART):
            grams = trigrams(text[max(0, i - 1) : i + PART + 1], min(i, 1), -1 if i + PART < len(text) else None)
            n += np.bincount(grams & np.uint32(buckets - 1), minlength=buckets)
    at = np.flatnonzero(n)
    return at, n[at]


def has_letter(text: str) -> bool:
    # the pattern also takes numbers that are no digits, such as fractions
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def _em(p: np.ndarray, n: np.ndarray, pi: np.ndarray, rounds: int, tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """Proportions after EM from pi, and the log likelihood; p: likelihoods of each bucket (rows) by language, n: its trigrams."""
    total = n.sum()
    for _ in range(rounds):
        # the responsibilities' column means are p.T @ (n / mix) * pi / total
        new = pi * (p.T @ (n / (p @ pi))) / total
        done = np.abs(new - pi).max() < tolerance
        pi = new
        if done:
            break
    return pi, float(n @ np.log(p @ pi))


def infer(model: Model, text: str, penalty: float = 3.0, rounds: int = 12) -> tuple[str, float, dict[str, float]]:
    """(language, its proportion, proportions of the selected set)."""
    if not model.languages or not has_letter(text):
        return UNKNOWN, 0.0, {}
    at, count = trigram_counts(text, len(model.logp))
    if not len(at):
        return UNKNOWN, 0.0, {}
    n, total = count.astype(np.float64), int(count.sum())
    logp = model.logp[at]
    # by trigram relative to the likeliest language, so that nothing underflows
    p = np.exp((logp - logp.max(axis=1, keepdims=True)).astype(np.float64))
    pi, whole = _em(p, n, np.full(p.shape[1], 1.0 / p.shape[1]), rounds)
    # by concavity no proportions, of whatever set, are likelier than this
    bound = whole + total * float(np.log(max(1.0, float((p.T @ (n / (p @ pi))).max()) / total)))
    order = np.argsort(-pi, kind="stable")
    order = order[pi[order] > 0]
    cost = penalty * np.log(total + 1.0)
    best, chosen, shares = -np.inf, order[:1], np.ones(1)
    for k in range(1, len(order) + 1):
        if bound - cost * (k - 1) <= best:
            break
        some = order[:k]
        if k == 1:
            got, like = np.ones(1), float(n @ np.log(p[:, some[0]]))
        else:
            got, like = _em(np.ascontiguousarray(p[:, some]), n, pi[some] / pi[some].sum(), rounds)
        if like - cost * (k - 1) > best:
            best, chosen, shares = like - cost * (k - 1), some, got
    mix = {model.languages[i]: float(s) for i, s in zip(chosen, shares)}
    language = max(mix, key=lambda x: (mix[x], x))
    return language, min(1.0, max(0.0, mix[language])), mix


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = TRAIN_ROWS, smooth: float = 0.5) -> Model:
    """Trigram likelihoods by language, of about `rows` rows a language chosen by a hash of the key; rows of null text or language don't count.

    Only counts reach the driver: buckets x languages numbers, at most NUMBERS (half a GB), whatever the input. An
    empty table, or one without labels, gives a model of no language.
    """
    known = labelled.select(labelled[key].cast("long").alias("key"), labelled[text].cast("string").alias("text"), labelled[lang].cast("string").alias("lang")).filter("text is not null and lang is not null")
    totals = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(totals) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} labels: not a column of languages")
    languages = sorted(totals)
    buckets = min(BUCKETS, 1 << (NUMBERS // max(1, len(languages))).bit_length() - 1)
    if not languages:
        return Model([], np.zeros((buckets, 0), dtype=np.float32))
    place = {x: i for i, x in enumerate(languages)}
    bound = F.create_map(*(F.lit(v) for x in languages for v in (x, int(min(1.0, rows / totals[x]) * (1 << 32)))))
    sample = known.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 32)) < bound[F.col("lang")])

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, np.ndarray] = {}
        for b in parts:
            for t, x in zip(raw(b.column("text")), b.column("lang").to_pylist()):
                at, c = trigram_counts(t.decode("utf-8", "replace"), buckets)
                if x not in n:
                    n[x] = np.zeros(buckets, dtype=np.int64)
                n[x][at] += c
        for x, c in n.items():
            j = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), place[x], dtype=np.int64)), pa.array(j.astype(np.int64)), pa.array(c[j])], names=["i", "j", "n"])

    counts = np.full((buckets, len(languages)), smooth, dtype=np.float32)
    got = sample.select("text", "lang").mapInArrow(calm(count), "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).toPandas()
    counts[got["j"].to_numpy(dtype=np.int64), got["i"].to_numpy(dtype=np.int64)] += got["n"].to_numpy(dtype=np.float32)
    return Model(languages, np.log(counts / counts.sum(axis=0, dtype=np.float64)).astype(np.float32))


_OUT = pa.schema([("key", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("mixture", pa.map_(pa.string(), pa.float64()))])


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: key, lang_pred, score (that language's proportion), mixture (language -> proportion).

    Null text, and text without a letter: `und`, score 0, no mixture; so is every row if nothing was learned.
    The model is broadcast: buckets x languages floats, at most 4 x NUMBERS bytes (1 MB for 4 languages). Each row
    gives one row, repeated rows equal ones; very long texts are counted part by part; other columns, whatever their
    names, change nothing; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.logp))

    def predict(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)

        def rows():
            for b in parts:
                for k, t in zip(b.column("key").to_pylist(), raw(b.column("text"))):
                    language, score, mix = infer(m, t.decode("utf-8", "replace"))
                    yield k, language, score, list(mix.items())

        yield from batches(rows(), _OUT)

    return key_text(docs, key, text).mapInArrow(calm(predict), "key long, lang_pred string, score double, mixture map<string,double>")
