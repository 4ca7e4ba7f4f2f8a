"""Frequent phrases and their collocation scores, mined from compressed position bitmaps.

Documents of a language become shards: a list of words by position, with a gap between pieces. In a shard each word
has a bitmap of its positions, stored as the blocks that are not empty. A phrase's bitmap holds the positions of its
last word; shifted by one and ANDed with a word's bitmap it is that of the phrase extended by the word, and its popcount
the number of occurrences. No shift leads over a gap, so phrases stay in their piece. Phrases are extended depth
first, a class of first words at a time, all members of a class at once in array operations.

A phrase that is frequent over all shards may be rare in each, so a shard can't prune by its own counts. Three rounds
tell it what is frequent: words, pairs, then all phrases whose pairs are frequent. After each round the popcounts are
summed over shards and only what is frequent returns, to the shards that have it, by shuffles alone. Pairs and phrases
are dealt to parts by their hashes, and a shard sends a part what it has in one packed row: ordered hashes as their
differences, or joined texts, and counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import calm, materialise, raw, relax, word_chunks
from .set_join import mixed

#: Words of the longest phrase, least occurrences, and phrases reported for each language.
LONGEST, LEAST, TOP = 5, 100, 2000
#: Positions of a shard; positions that all languages of a task hold together before the largest leaves.
SHARD, HELD = 1 << 20, 4 << 20
#: Bits of a bitmap's block, and blocks of a class of phrases that are extended at once.
BLOCK = np.uint8
CLASS = 1 << 18
#: Positions whose pairs or phrases one part sums, about, and parts at least; bits of a pair's hash in its part.
PART, PARTS, HASH = 1 << 23, 32, 31
_GAP = b"\xff"
_TABLE = bytes(10 if chr(c) in ".,;:!?" or 10 <= c <= 13 else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


class _Ids(dict):
    """Numbers of words as they appear; the gap is 0."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class _Shard:
    def __init__(self) -> None:
        self.ids, self.parts, self.size = _Ids({_GAP: 0}), [], 0

    def add(self, words: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def row(self, number: int, lang: str, tail: list[bytes]) -> dict:
        """tail: words that follow the shard in the same text; phrases may end in them and none begins there."""
        limit = self.size
        self.add(tail)
        ids = np.concatenate(self.parts)
        counts = np.bincount(ids[:limit], minlength=len(self.ids))
        counts[0] = 0
        order = np.r_[0, 1 + np.argsort(-counts[1:], kind="stable")]  # frequent words get small numbers, which pack well
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        words = list(self.ids)
        return {"shard": number, "lang": lang, "words": [words[i].decode("utf-8", "replace") for i in order], "counts": counts[order], "positions": packed(rank[ids]), "starts": limit}


def packed(ids: np.ndarray) -> bytes:
    """int32 numbers as compressed planes of bytes, the lowest first."""
    return zstandard.compress(np.ascontiguousarray(ids.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").reshape(-1)


_SHARDS = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("positions", pa.binary()), ("starts", pa.int64())])


def tokens(text: bytes) -> list[bytes]:
    """Words of a part of a text, A-Z lowered, and gaps where pieces end."""
    return text.translate(_TABLE).replace(b"\n", b" \xff ").split()


def shards(docs: DataFrame, text: str, lang: str, size: int = SHARD, held: int = HELD) -> DataFrame:
    """shard, lang, words (by number, the gap first), counts, positions (the numbers, packed()), starts (positions where phrases may begin).

    A task holds `held` positions at most, with what its last document's part brings; then its largest shard is
    written. A text longer than a shard goes on in the next: the shard gets LONGEST - 1 words more, in which phrases end.
    """

    def make(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        open_: dict[str, _Shard] = {}

        def close(name: str, tail: list[bytes]) -> pa.RecordBatch:
            nonlocal number
            number += 1
            return pa.RecordBatch.from_pylist([open_.pop(name).row(number, name, tail)], schema=_SHARDS)

        def add(name: str, words: list[bytes], following: list[bytes]) -> Iterator[pa.RecordBatch]:
            at = 0
            while at < len(words):
                s = open_.setdefault(name, _Shard())
                here = words[at : at + size - s.size]
                s.add(here)
                at += len(here)
                if s.size >= size:
                    yield close(name, (words[at : at + LONGEST - 1] + following)[: LONGEST - 1])

        for b in parts:
            for name, t in zip(b.column("lang").to_pylist(), raw(b.column("text"))):
                if not t:
                    continue
                rest: list[bytes] = []
                for chunk in word_chunks(t):
                    rest += tokens(chunk)
                    rest, words = rest[-(LONGEST - 1) :], rest[: -(LONGEST - 1)]
                    yield from add(name, words, rest)
                yield from add(name, [*rest, _GAP], [])
                while sum(s.size for s in open_.values()) >= held:
                    yield close(max(open_, key=lambda n: open_[n].size), [])
        for name in list(open_):
            yield close(name, [])

    src = docs.select(F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("lang"), docs[text].cast("string").alias("text"))
    return src.mapInArrow(calm(make), "shard long, lang string, words array<string>, counts array<long>, positions binary, starts long")


class Bitmaps:
    """Position bitmaps of a shard's words as blocks that are not empty, in the order of blocks: word, bits; first has each block's first entry."""

    def __init__(self, ids: np.ndarray, at: np.ndarray) -> None:
        """ids: words by position; at: the positions that count, ascending."""
        self.width = BLOCK(0).itemsize * 8
        block, word = at // self.width, ids[at].astype(np.int64)
        bit = (np.int64(1) << (at % self.width)).astype(BLOCK)
        order = np.lexsort((word, block))
        block, word, bit = block[order], word[order], bit[order]
        new = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (word[1:] != word[:-1])][: len(at)])
        self.block, self.word = block[new], word[new]
        self.bits = np.bitwise_or.reduceat(bit, new) if len(new) else bit
        self.first = np.searchsorted(self.block, np.arange(len(ids) // self.width + 3))

    def shifted(self, phrase: np.ndarray, block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bitmaps one position on; what leaves a block opens the next one."""
        over, stay = bits >> BLOCK(self.width - 1), bits << BLOCK(1)
        a, b = np.flatnonzero(stay), np.flatnonzero(over)
        return np.r_[phrase[a], phrase[b]], np.r_[block[a], block[b] + 1], np.r_[stay[a], over[b]]

    def extended(self, phrase: np.ndarray, block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """phrase, word, block, bits of all phrases extended by all words: the shifted bitmaps AND the words' in the same blocks."""
        phrase, block, bits = self.shifted(phrase, block, bits)
        n = self.first[block + 1] - self.first[block]
        source = np.repeat(np.arange(len(phrase)), n)
        entry = np.arange(len(source)) - np.repeat(np.cumsum(n) - n, n) + self.first[block][source]
        both = bits[source] & self.bits[entry]
        hit = np.flatnonzero(both)
        source, entry = source[hit], entry[hit]
        return phrase[source], self.word[entry], block[source], both[hit]


def within(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Whether each value is in the ordered ones."""
    if not len(ordered):
        return np.zeros(len(values), dtype=bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def mine(ids: np.ndarray, starts: int, words: np.ndarray, pairs: np.ndarray | None, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Phrases (a row of word numbers each) of two to `longest` words and their counts, a class and length at a time.

    words: the ordered numbers of words that phrases may have; pairs: the ordered first * 2^32 + second of neighbours
    that they may have, or None for all. Phrases begin before the position starts.
    """
    fit = within(ids.astype(np.int64), words) & (ids > 0)
    if pairs is not None:
        both = within((ids[:-1].astype(np.int64) << 32) | ids[1:], pairs) & fit[:-1] & fit[1:]
        fit = np.r_[both, False] | np.r_[False, both] if len(ids) else fit
    maps = Bitmaps(ids, np.flatnonzero(fit))
    own = Bitmaps(ids, np.flatnonzero(fit[:starts]))
    order = np.argsort(own.word, kind="stable")
    first, block, bits = own.word[order], own.block[order], own.bits[order]
    at = 0
    while at < len(first):
        end = int(np.searchsorted(first, first[min(at + CLASS, len(first)) - 1], "right"))
        names, phrase = np.unique(first[at:end], return_inverse=True)
        yield from _deepen(maps, names[:, None], phrase, block[at:end], bits[at:end], pairs, longest)
        at = end


def _deepen(maps: Bitmaps, names: np.ndarray, phrase: np.ndarray, block: np.ndarray, bits: np.ndarray, pairs: np.ndarray | None, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    phrase, word, block, bits = maps.extended(phrase, block, bits)
    if pairs is not None:
        keep = within((names[phrase, -1] << 32) | word, pairs)
        phrase, word, block, bits = phrase[keep], word[keep], block[keep], bits[keep]
    if not len(phrase):
        return
    key, child = np.unique((phrase << 32) | word, return_inverse=True)
    found = np.c_[names[key >> 32], key & 0xFFFFFFFF]
    yield found, np.bincount(child, weights=np.bitwise_count(bits), minlength=len(key)).astype(np.int64)
    if found.shape[1] < longest:
        yield from _deepen(maps, found, child, block, bits, pairs, longest)


def _columns(table: pa.Table) -> tuple[np.ndarray, int]:
    return unpacked(table.column("positions")[0].as_py()), table.column("starts")[0].as_py()


def hashed(words: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of phrases, from their words' hashes in order."""
    h = words[0]
    for w in words[1:]:
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + w)
    return h


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def pair_keys(first: np.ndarray, second: np.ndarray, parts: int) -> np.ndarray:
    """part * 2^HASH + the pair's hash in its part, from the words' hashes."""
    h = hashed([first, second])
    return (part_of(h, parts) << HASH) | (h & np.uint64((1 << HASH) - 1)).astype(np.int64)


def ascending(hashes: np.ndarray) -> bytes:
    return packed(np.diff(hashes, prepend=0))


def from_ascending(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=np.int64)


def runs(ordered: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, first, end) of each run of equal values."""
    ends = np.flatnonzero(np.diff(ordered)) + 1
    for lo, hi in zip(np.r_[0, ends], np.r_[ends, len(ordered)]) if len(ordered) else ():
        yield int(ordered[lo]), int(lo), int(hi)


_PAIRS = pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])
_MET = pa.schema([("shard", pa.int64()), ("part", pa.int64()), ("hashes", pa.binary())])
_PHRASES = pa.schema([("part", pa.int64()), ("lang", pa.string()), ("phrases", pa.binary()), ("counts", pa.binary())])


def pair_counts(left: pa.Table, right: pa.Table, parts: int) -> pa.Table:
    """part, shard, hashes, counts: all pairs of a shard's frequent words, a row a part; the count is 0 for those of its tail. right: shard, word, hash of its frequent words."""
    rows = []
    word = right.column("word").to_numpy()
    if left.num_rows and len(word):
        order = np.argsort(word)
        word, hashes = word[order], right.column("hash").to_numpy()[order].view(np.uint64)
        ids, starts = _columns(left)
        out = [*mine(ids, starts, word, None, 2)]
        # pairs that begin behind the shard count there, but phrases of this shard may end in them
        tail = np.stack([ids[starts:-1], ids[starts + 1 :]], axis=1).astype(np.int64) if len(ids) > starts + 1 else np.empty((0, 2), np.int64)
        tail = tail[within(tail[:, 0], word) & within(tail[:, 1], word)]
        out.append((tail, np.zeros(len(tail), np.int64)))
        found, n = np.concatenate([f for f, _ in out]), np.concatenate([c for _, c in out])
        key, same = np.unique(pair_keys(*(hashes[np.searchsorted(word, found[:, i])] for i in (0, 1)), parts), return_inverse=True)
        n = np.bincount(same, weights=n, minlength=len(key)).astype(np.int64)
        shard = left.column("shard")[0].as_py()
        rows = [(part, shard, ascending(key[lo:hi] & ((1 << HASH) - 1)), packed(n[lo:hi])) for part, lo, hi in runs(key >> HASH)]
    relax()
    return pa.Table.from_pylist([dict(zip(_PAIRS.names, r)) for r in rows], schema=_PAIRS)


def frequent_pairs(group: pa.Table, least: int) -> pa.Table:
    """shard, part, hashes: those of a part's pairs that occur `least` times in all shards together, for each shard that has them. group: rows of pair_counts() of one part."""
    each = [from_ascending(x) for x in group.column("hashes").to_pylist()]
    key, same = np.unique(np.concatenate(each), return_inverse=True)
    often = key[np.bincount(same, weights=np.concatenate([unpacked(x) for x in group.column("counts").to_pylist()])) >= least]
    rows = [(shard, part, h[within(h, often)]) for shard, part, h in zip(group.column("shard").to_pylist(), group.column("part").to_pylist(), each)]
    relax()
    return pa.Table.from_pylist([dict(zip(_MET.names, (shard, part, ascending(h)))) for shard, part, h in rows if len(h)], schema=_MET)


def phrase_counts(left: pa.Table, right: pa.Table, parts: int) -> pa.Table:
    """part, lang, phrases, counts: all phrases of a shard whose pairs are frequent, a row a part. right: rows of frequent_pairs()."""
    rows = []
    if left.num_rows and right.num_rows:
        names, lang = left.column("words")[0].values, left.column("lang")[0].as_py()
        ids, starts = _columns(left)
        often = np.sort(np.concatenate([(part << HASH) | from_ascending(x) for part, x in zip(right.column("part").to_pylist(), right.column("hashes").to_pylist())]))
        seed = xxhash.xxh64_intdigest(lang, 42)  # Spark's xxhash64(lang, word)
        own = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in names.to_pylist()), np.uint64, len(names))
        first, second = ids[:-1].astype(np.int64), ids[1:].astype(np.int64)
        fit = (first > 0) & (second > 0) & within(pair_keys(own[first], own[second], parts), often)
        pairs = np.unique((first[fit] << 32) | second[fit])
        texts, of, counts = [pa.array([], pa.string())], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for found, n in mine(ids, starts, np.unique(np.r_[pairs >> 32, pairs & 0xFFFFFFFF]), pairs, LONGEST):
            texts.append(pc.binary_join_element_wise(*(names.take(pa.array(c)) for c in found.T), " "))
            of.append(part_of(hashed([own[c] for c in found.T]), parts))
            counts.append(n)
        part, n = np.concatenate(of), np.concatenate(counts)
        order = np.argsort(part, kind="stable")
        phrases = pa.concat_arrays(texts).take(pa.array(order))
        for p, lo, hi in runs(part[order]):
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), phrases[lo:hi]), "\n")[0].as_py()
            rows.append((p, lang, zstandard.compress(text.encode(), 3), packed(n[order[lo:hi]])))
    relax()
    return pa.Table.from_pylist([dict(zip(_PHRASES.names, r)) for r in rows], schema=_PHRASES)


def summed_phrases(group: pa.Table, least: int) -> pa.Table:
    """lang, phrase, size, a of a part's phrases that occur `least` times. group: rows of phrase_counts() of one language and part."""
    texts = [pc.split_pattern(pa.array([zstandard.decompress(x).decode()]), "\n").flatten() for x in group.column("phrases").to_pylist()]
    counts = [pa.array(unpacked(x).astype(np.int64)) for x in group.column("counts").to_pylist()]
    sums = pa.table({"phrase": pa.chunked_array(texts), "n": pa.chunked_array(counts)}).group_by("phrase", use_threads=False).aggregate([("n", "sum")])
    sums = sums.filter(pc.greater_equal(sums.column("n_sum"), least))
    phrase, a = sums.column("phrase"), sums.column("n_sum")
    size = pc.add(pc.count_substring(phrase, " "), 1).cast(pa.int64())
    lang = pa.array([group.column("lang")[0].as_py()] * len(phrase), pa.string())
    del texts, counts
    relax()
    return pa.table({"lang": lang, "phrase": phrase, "size": size, "a": a})


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, size: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, a of all phrases of 1 to LONGEST words that occur `least` times or more; lang, n of all languages).

    Of three rounds the first two return to each shard what of its words and pairs is frequent: a window sums the
    popcounts of a word over shards, a group those of a part of the pairs. A window's group has a row a shard, whatever
    the number of occurrences; a part has about PART positions' pairs or phrases, so there are more on larger tables.
    Pairs meet by a hash in their part; if two fall together a pair passes that is not frequent, which the last round's
    counts, by the phrases themselves, mend. A count of positions, one number, is sent to the driver.
    """
    parts = materialise(shards(docs, text, lang, size), "phrase-shards")
    n_parts = max(PARTS, -(-(parts.agg(F.sum("starts")).first()[0] or 0) // PART))
    in_shard = parts.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("number", "of")).select("shard", "lang", F.col("number").cast("long").alias("number"), F.col("of.words").alias("phrase"), F.col("of.counts").alias("n")).filter("number > 0")  # words of the tail alone too, with n = 0
    totals = parts.select("lang", F.expr("aggregate(counts, 0L, (s, x) -> s + x)").alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    over = in_shard.withColumn("a", F.sum("n").over(Window.partitionBy("lang", "phrase"))).filter(F.col("a") >= least)
    words = materialise(over, "phrase-words")
    known = words.select("shard", F.col("number").alias("word"), F.xxhash64("lang", "phrase").alias("hash"))
    made = parts.select("shard", "positions", "starts").groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(lambda left, right: pair_counts(left, right, n_parts), "part long, shard long, hashes binary, counts binary")
    pairs = materialise(made.groupBy("part").applyInArrow(lambda group: frequent_pairs(group, least), "shard long, part long, hashes binary"), "phrase-pairs")
    found = parts.select("shard", "lang", "words", "positions", "starts").groupBy("shard").cogroup(pairs.groupBy("shard")).applyInArrow(lambda left, right: phrase_counts(left, right, n_parts), "part long, lang string, phrases binary, counts binary")
    longer = found.groupBy("lang", "part").applyInArrow(lambda group: summed_phrases(group, least), "lang string, phrase string, size long, a long")
    single = words.groupBy("lang", "phrase").agg(F.max("a").alias("a")).select("lang", "phrase", F.lit(1).cast("long").alias("size"), "a")
    return materialise(single.union(longer), "phrases"), totals


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, size: int = SHARD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` best phrases of each language.

    A-Z are lowered, pieces end at `[.,;:!?\\x0A-\\x0D]`, words at space and tab. Phrases have 2 to LONGEST words and
    occur a >= least times within pieces. Score: the least over all cuts of floor(1000 a n / (l r)) in exact decimals, l
    and r being the counts of both sides, ties to the shorter first part. A phrase is dropped if a longer one that
    holds it occurs as often; it is enough to look one word further, as all phrases between have the same count.
    Best: score, then a, then the phrase's bytes. Null texts are empty, null languages are `und`, texts of any length are
    mined whole, repeated rows count each, other columns change nothing. No phrase that frequent, or an empty table: no rows.
    """
    phrases, totals = frequent_phrases(docs, text, lang, least, size)
    words = F.split("phrase", " ")
    long = phrases.filter("size > 1")
    inner = long.filter("size > 2").select("lang", F.explode(F.array(F.array_join(F.slice(words, F.lit(1), F.col("size").cast("int") - 1), " "), F.array_join(F.slice(words, F.lit(2), F.col("size").cast("int") - 1), " "))).alias("phrase"), "a")
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = long.join(inner, ["lang", "phrase"], "left").filter("around IS NULL OR 100 * around < 100 * a").drop("around")
    cut = kept.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("size").cast("int") - 1)).alias("k"), "size", words.alias("w"))
    cut = cut.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.col("size").cast("int") - F.col("k")), " ").alias("rest"))
    f = phrases.select("lang", "phrase", "a")
    cut = cut.join(f.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), ["lang", "first"]).join(f.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"])
    scored = cut.join(totals, "lang").withColumn("score", F.expr("cast((1000 * cast(a as decimal(16,0)) * cast(n as decimal(18,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0))) as long)"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    # a language's best are among the best of its parts, so no task sorts a whole language
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(256))).orderBy(*order)
    some = best.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
