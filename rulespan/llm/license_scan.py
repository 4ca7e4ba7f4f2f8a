"""License scan: exact phrases by words, and short notices with a bounded number of edits.

Method: each notice of k permitted edits is split into k + 1 pieces. By the pigeonhole principle a
text within k edits holds one piece unchanged, so an Aho-Corasick pass over the pieces finds every
candidate place. At each word that can start the notice there, the regex library's bounded-error matching decides: one
match, anchored at that word and at any later word end, says whether the notice can be there at all, and if so a best
match for every word end gives its errors. Of the spans within k errors that hold the needed words, those of the
fewest errors that do not overlap are reported, so no place is lost to a better one beside it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import batches, calm, key_text, raw, word_chunks

#: Phrases that stand word for word, and their labels. Fixed values.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: label, notice, edits permitted in it, words that must stand unchanged in the match (they tell labels apart).
NOTICES = (
    ("mit", "released under the mit license", 4, ("mit",)),
    ("mit", "licensed under the mit license", 4, ("mit",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", 8, ()),
    ("apache-2", "licensed under the apache license version 2", 5, ("2",)),
    ("gpl-3", "licensed under the gnu general public license version 3", 6, ("3",)),
    ("gpl-2", "licensed under the gnu general public license version 2", 6, ("2",)),
    ("lgpl", "licensed under the gnu lesser general public license", 5, ()),
    ("agpl-3", "licensed under the gnu affero general public license version 3", 6, ("3",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 8, ()),
    ("mpl-2", "subject to the terms of the mozilla public license", 5, ()),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", 7, ()),
    ("unlicense", "this is free and unencumbered software released into the public domain", 6, ()),
    ("cc-by-nc", "licensed under cc by nc", 2, ("cc", "by", "nc")),
    ("cc-by-sa", "licensed under cc by sa", 2, ("cc", "by", "sa")),
    ("cc0", "dedicated to the public domain under cc0", 4, ("cc0",)),
    ("cc-by-nc", "creative commons attribution noncommercial", 4, ()),
    ("cc-by-sa", "creative commons attribution sharealike", 4, ()),
)

_OUT = pa.schema(
    [
        ("key", pa.int64()),
        ("n_words", pa.int64()),
        ("base", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))),
        ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("errors", pa.int64()), ("score", pa.float64())]))),
    ]
)
SCHEMA = "key long, n_words long, base array<struct<label:string,start:long>>, spans array<struct<label:string,start:long,end:long,errors:long,score:double>>"


def _table() -> bytes:
    """A-Z to lower case, other ASCII but letters and digits to a space."""
    out = bytearray(range(256))
    for b in range(128):
        c = chr(b)
        out[b] = ord(c.lower()) if c.isalnum() else 32
    return bytes(out)


_SEPARATE = _table()


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """The notice cut into edits + 1 pieces of nearly equal length, with their offsets."""
    n = edits + 1
    cuts = [len(notice) * i // n for i in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


@lru_cache(2)
def _matcher(notices: tuple):
    import ahocorasick
    at: dict[str, list[tuple[int, int]]] = {}
    for i, (_, notice, edits, _) in enumerate(notices):
        for offset, piece in pieces(notice, edits):
            at.setdefault(piece, []).append((i, offset))
    seeds = ahocorasick.Automaton()
    for piece, where in at.items():
        seeds.add_word(piece, (len(piece), where))
    seeds.make_automaton()
    return seeds, [(regex.compile(rf"(?:{regex.escape(n)}){{e<={k}}}(?= )"), regex.compile(rf"(?b)(?:{regex.escape(n)}){{e<={k}}}")) for _, n, k, _ in notices]


@lru_cache(1 << 14)
def word_ends(window: str, notices: tuple, i: int) -> list[tuple[int, int]]:
    """(errors, length) of each span from the window's start to the end of a word that is within the edits of the i-th notice.

    Notices stand in many texts in the same words, so what windows gave is kept.
    """
    (_, notice, edits, _), (some, best) = notices[i], _matcher(notices)[1][i]
    if not some.match(window):
        return []
    found = []
    at = window.find(" ", max(1, len(notice) - edits))
    while at >= 0:
        if m := best.fullmatch(window, 0, at):
            found.append((sum(m.fuzzy_counts), at))
        at = window.find(" ", at + 1)
    return found


def notice_spans(line: str, notices: tuple = NOTICES) -> list[tuple[str, int, int, int, float]]:
    """(label, first word, word after the last, errors, score) in line, words joined and framed by single spaces."""
    seeds, _ = _matcher(notices)
    starts: dict[int, set[int]] = {}
    for end, (size, where) in seeds.iter(line):
        for i, offset in where:
            edits, first = notices[i][2], end + 1 - size - offset
            at = line.find(" ", max(0, first - edits - 1), max(0, first + edits))
            while at >= 0:
                starts.setdefault(i, set()).add(at + 1)
                at = line.find(" ", at + 1, max(0, first + edits))
    found = []
    for i, places in starts.items():
        label, notice, edits, needed = notices[i]
        ends = ((a, word_ends(line[a : a + len(notice) + edits + 1], notices, i)) for a in places)
        spans = [(errors, a, a + n) for a, found_ in ends for errors, n in found_ if set(needed) <= set(line[a : a + n].split())]
        taken: list[tuple[int, int, int]] = []
        for errors, a, b in sorted(spans):
            # spans taken are apart, so only the neighbours of a place can overlap
            j = bisect_left(taken, (a, b, errors))
            if not (j and taken[j - 1][1] > a or j < len(taken) and taken[j][0] < b):
                taken.insert(j, (a, b, errors))
        word = counted = 0
        for a, b, errors in taken:
            word += line.count(" ", counted, a)
            counted = a
            found.append((label, word - 1, word - 1 + len(line[a:b].split()), errors, 1.0 - errors / len(notice)))
    return sorted(set(found), key=lambda x: (x[1], x[2], x[0], x[3]))


def scan_text(text: bytes, notices: tuple = NOTICES) -> tuple[int, list[tuple[str, int]], list[tuple]]:
    body = b" ".join(b" ".join(w) for c in word_chunks(text.translate(_SEPARATE)) if (w := c.split()))
    n, joined = body.count(b" ") + 1 if body else 0, b" " + body + b" "
    base = []
    for phrase, label in PHRASES:
        wanted = f" {phrase} ".encode()
        at, word, counted = joined.find(wanted), 0, 0
        while at >= 0:
            word += joined.count(b" ", counted, at)
            base.append((label, word))
            counted, at = at, joined.find(wanted, at + 1)
    return n, base, notice_spans(joined.decode("utf-8", "replace"), notices)


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text", notices: tuple = NOTICES) -> DataFrame:
    """Per row of docs: key, n_words, base (label and word of each exact phrase), spans (notices within their edits).

    One narrow pass without a shuffle. Null text: as empty (no words, no spans). Null keys, repeated rows and
    other columns, whatever their names, change nothing: each row gives one row, and an empty table none. Of a very
    long text memory holds the words joined, never a list of them all.
    """

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for part in parts:
                for k, t in zip(part.column("key").to_pylist(), raw(part.column("text"))):
                    n, base, spans = scan_text(t, notices)
                    yield k, n, [{"label": a, "start": b} for a, b in base], [dict(zip(("label", "start", "end", "errors", "score"), s)) for s in spans]

        yield from batches(rows(), _OUT)

    return key_text(docs, key, text).mapInArrow(calm(scan), SCHEMA)
