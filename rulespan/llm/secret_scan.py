"""Secret scan: Aho-Corasick keyword prefilter, anchored patterns at its hits, embedded checksums."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches, calm, key_text, raw

#: Kinds in their order: three of the base, then those with a checksum in the secret.
KINDS = ("assign", "access", "hex", "github", "npm", "xprv")
#: Keywords by kind, in lower case. Fixed values.
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "xprv": ("xprv",),
}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"

_ASSIGN = re.compile(rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{16,}")
_GITHUB = re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
_NPM = re.compile(rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
_XPRV = re.compile(rb"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])")

SCHEMA = "key long, spans array<struct<kind:string,start:long,end:long>>"
_OUT = pa.schema([("key", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])


def crc_holds(token: bytes) -> bool:
    """The last six of a prefixed token's characters are the CRC-32 of those between prefix and them, in base 62."""
    body, tail = token[4:-6], token[-6:].decode()
    n, digits = zlib.crc32(body), ""
    while n:
        n, d = divmod(n, 62)
        digits = BASE62[d] + digits
    return digits.rjust(6, "0") == tail


def base58_holds(token: bytes) -> bool:
    """Base58Check: the last four bytes are the start of the doubled SHA-256 of the others."""
    n = 0
    for c in token.decode():
        n = n * 58 + BASE58.index(c)
    whole = n.to_bytes(82, "big") if n < 1 << 656 else b""
    return len(whole) == 82 and hashlib.sha256(hashlib.sha256(whole[:-4]).digest()).digest()[:4] == whole[-4:]


#: kind -> pattern at the hit, test of the match
_RULES = {
    "assign": (_ASSIGN, lambda m: len(m[1]) >= 12),
    "access": (_ACCESS, lambda m: len(m[0]) >= 18),
    "github": (_GITHUB, lambda m: crc_holds(m[0])),
    "npm": (_NPM, lambda m: crc_holds(m[0])),
    "xprv": (_XPRV, lambda m: base58_holds(m[0])),
}


@lru_cache(1)
def _keywords():
    import ahocorasick

    words = ahocorasick.Automaton()
    for kind, keys in KEYWORDS.items():
        for k in keys:
            words.add_word(k, (len(k), kind))
    words.make_automaton()
    return words


def find_secrets(text: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind in the order of KINDS.

    Per kind the matches are those of a scan from the left without overlaps; a match that then fails its test
    is dropped but has consumed its characters.
    """
    found: list[tuple[int, int, int]] = []
    past = dict.fromkeys(KEYWORDS, 0)
    # bytes as latin-1: one character a byte, so that offsets are those of the bytes
    for end, (size, kind) in _keywords().iter(text.lower().decode("latin-1")):
        at = end + 1 - size
        if at < past[kind]:
            continue
        pattern, holds = _RULES[kind]
        if m := pattern.match(text, at):
            past[kind] = m.end()
            if holds(m):
                found.append((at, KINDS.index(kind), m.end()))
    found += [(m.start(), KINDS.index("hex"), m.end()) for m in _HEX.finditer(text)]
    found.sort()
    if text.isascii():
        return [(KINDS[k], a, b) for a, k, b in found]
    # every offset once, in order: matches are ASCII, so a cut at one never splits a character
    point, past_byte, n = {}, 0, 0
    for x in sorted({x for a, _, b in found for x in (a, b)}):
        n += len(text[past_byte:x].decode("utf-8", "replace"))
        point[x], past_byte = n, x
    return [(KINDS[k], point[a], point[b]) for a, k, b in found]


def secret_scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: key and its spans. One narrow pass without a shuffle.

    Null text: as empty (no spans). Null keys, repeated rows and other columns, whatever their names, change nothing: each
    row gives one row, and an empty table none. Very long texts are walked once; memory holds the text and its hits.
    """

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for part in parts:
                for k, t in zip(part.column("key").to_pylist(), raw(part.column("text"))):
                    yield k, [{"kind": a, "start": b, "end": c} for a, b, c in find_secrets(t)]

        yield from batches(rows(), _OUT)

    return key_text(docs, key, text).mapInArrow(calm(scan), SCHEMA)
