"""Spelling variants: words that differ by one code point, by a rare-first q-gram prefix filter.

A word's bigrams stand at positions; all bigrams are ordered by how many words' places have them, rarest first. One
edit destroys two of a word's bigrams at most and leaves the others in order, at the same or the next position. So of
the bigrams that two near words share, the rarest is among the three rarest of each: only those three are joined.
The edit does not touch that bigram, so either everything up to it or everything from it on is equal in both words,
and of what is left on the other side, either the first or the last half. Both go into the join key, where they take
the place of a limit on positions (which follows from them). Pairs that meet are verified by edit distance.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import calm, materialise, raw, word_chunks

#: Least code points and occurrences of a word, and how many times as often as a word its form must occur.
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
#: A run of a document is taken as misspelt if this divides the checksum of document and run.
EVERY = 199
#: Words that a task holds before it passes its counts on.
HELD = 400_000
#: Bigrams that the rarest of one edit's survivors must be among: 2 x 1 + 1.
PREFIX = 3
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ASCII, _LATIN = re.compile(rb"[a-z]+"), re.compile("[a-zÀ-ÿ]+")


def without(word: bytes, i: int) -> bytes:
    """A word less its i-th code point."""
    s = word.decode("utf-8")
    return (s[:i] + s[i + 1 :]).encode()


def code_points(word: bytes) -> int:
    """Code points of a run: letters beyond ASCII are two bytes here, the first always 0xC3."""
    return len(word) - word.count(b"\xc3")


def runs(text: bytes) -> Iterator[tuple[bytes, int]]:
    """Distinct runs of a text's part, A-Z lowered, and how often each stands there."""
    text = text.translate(_LOWER)
    if text.isascii():
        yield from Counter(_ASCII.findall(text)).items()
    else:
        for run, n in Counter(_LATIN.findall(text.decode("utf-8", "replace"))).items():
            yield run.encode(), n


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = EVERY) -> DataFrame:
    """word, n: occurrences over all rows of the runs [A-Za-z\\u00C0-\\u00FF]+ of whole texts, A-Z lowered, of LEAST_LENGTH code points or more.

    In a document whose key is k, a run r whose crc32 of `k:r` is divisible by `every` loses the code point at that
    checksum modulo its length. Null texts have no runs; a null key stands as nothing before the colon; repeated rows
    count each. Counts leave a task once HELD words are held, so its memory is bounded; very long texts are read in
    parts, which no run crosses.
    """

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def emit() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for b in parts:
            for k, t in zip(b.column("key").to_pylist(), raw(b.column("text"))):
                base = zlib.crc32(b"%s:" % (b"" if k is None else str(k).encode()))
                for part in word_chunks(t or b""):
                    for run, n in runs(part):
                        h = zlib.crc32(run, base)
                        if not h % every:
                            run = without(run, h % code_points(run))
                        if len(run) >= LEAST_LENGTH and code_points(run) >= LEAST_LENGTH:
                            held[run] += n
                if len(held) >= HELD:
                    yield emit()
        if held:
            yield emit()

    src = docs.select(docs[key].cast("string").alias("key"), docs[text].cast("string").alias("text"))
    return src.mapInArrow(calm(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame) -> DataFrame:
    """gram, n: how many places of distinct words have a bigram. At most 8,100 rows: the alphabet has 26 + 64 code points."""
    return words.select(F.explode(F.expr("transform(sequence(1, char_length(word) - 1), p -> substring(word, p, 2))")).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


def rarest(word: str, order: dict[str, int]) -> list[int]:
    """Positions of the PREFIX rarest bigrams, ties by the bigram and then by the position."""
    return sorted(range(len(word) - 1), key=lambda p: (order[word[p : p + 2]], word[p : p + 2], p))[:PREFIX]


def sides(word: str, p: int, short: int) -> list[tuple[str, str, str]]:
    """What a near word that keeps the bigram at p has too: what stands up to it or from it on, and half of the other side.

    short is the length of the shorter word of the pair, so that both cut the other side at the same place.
    """
    out = []
    for side, same, other in (("<", word[: p + 2], word[p + 2 :]), (">", word[p:], word[:p])):
        left = short - len(same)
        if left >= 0:
            half = left // 2
            out += [(side, same, f"{left}<{other[:half]}"), (side, same, f"{left}>{other[len(other) - (left - half) :]}")]
    return out


def prefix_keys(words: DataFrame, order: dict[str, int]) -> DataFrame:
    """meet, word, n, short: the join keys of each word, as the shorter (or equal) of a pair and as the longer."""

    def make(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            keys, words_, ns, shorts = [], [], [], []
            for word, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist()):
                for short in (len(word), len(word) - 1):
                    found = {k for p in rarest(word, order) for k in sides(word, p, short)}
                    keys += [xxhash.xxh64_intdigest(f"{short}{side}{same}|{half}") - (1 << 63) for side, same, half in found]
                    words_ += [word] * len(found)
                    ns += [n] * len(found)
                    shorts += [short == len(word)] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(words_, pa.string()), pa.array(ns, pa.int64()), pa.array(shorts, pa.bool_())], names=["meet", "word", "n", "short"])

    return words.select("word", "n").mapInArrow(calm(make), "meet long, word string, n long, short boolean")


def near_words(words: DataFrame) -> DataFrame:
    """word, n, other, other_n: all ordered pairs of words (word, n; distinct) that differ by exactly one code point."""
    order = {r.gram: r.n for r in gram_counts(words).collect()}
    keys = materialise(prefix_keys(words, order), "spelling-keys")
    a = keys.filter("short").select("meet", F.col("word").alias("a"), F.col("n").alias("an"))
    b = keys.select("meet", F.col("word").alias("b"), F.col("n").alias("bn"), F.col("short").alias("same"))
    near = (a["meet"] == b["meet"]) & (~b["same"] | (a["a"] < b["b"])) & (F.levenshtein("a", "b", 1) == 1)
    pairs = a.join(b, near).select("a", "an", "b", "bn").distinct()
    ends = F.array(F.struct(F.col("a").alias("word"), F.col("an").alias("n"), F.col("b").alias("other"), F.col("bn").alias("other_n")), F.struct(F.col("b").alias("word"), F.col("bn").alias("n"), F.col("a").alias("other"), F.col("an").alias("other_n")))
    return pairs.select(F.inline(ends))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the forms of words end. forms: word, form, each form at least TIMES as frequent as its word.

    So counts bound the length of every chain: 64-bit counts allow 27 steps, which five doublings pass.
    """
    out = materialise(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(5):
        further = out.select(F.col("word").alias("root"), F.col("root").alias("last"))
        out = materialise(out.join(further, "root", "left").select("word", F.coalesce("last", "root").alias("root")), "spelling-roots")
    return out


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = EVERY) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of LEAST_LENGTH code points that occurs LEAST_COUNT times or more.

    form: of the words at one edit the most frequent, ties to the smallest in code-point order, if it occurs TIMES as
    often; root: the last word that forms lead to. Rows, texts and keys: as in word_counts(). An empty table, or one
    without such words, gives no rows; other columns, whatever their names, change nothing. What is sent to the driver
    are counts of bigrams, 8,100 at most.
    """
    words = materialise(word_counts(docs, key, text, every).filter(F.col("n") >= LEAST_COUNT), "spelling-words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("word")))
    near = near_words(words).groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    enough = -F.col("best.less") >= TIMES * F.col("n")
    near = materialise(near.select("word", "n_near", F.when(enough, F.col("best.word")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")), "spelling-near")
    ends = roots(near.filter("form IS NOT NULL"))
    out = words.join(near, "word", "left").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
