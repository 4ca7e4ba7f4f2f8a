"""Token ids of texts by the tokenizers library, with a cache of pieces."""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from functools import lru_cache

#: Entries of the caches of pieces and of words; what finds no room is encoded each time. Bounds memory, not results.
PIECES, WORDS = 300_000, 300_000
#: ASCII that is neither letter, digit, space nor control.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _latin(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == kind)


def _byte_letters() -> list[str]:
    """The letter that a byte-level vocabulary has for each byte: printable ones themselves, others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Encoder:
    """ids(text) as little-endian unsigned 32-bit integers, equal to encode(text, add_special_tokens=False).

    Where the tokenizer drops white space and splits words from other characters (as its own file says), no token
    spans a space or line feed, so a text's ids are those of its pieces; these are kept in a cache. A piece is
    split into words only where the rules are plain: Latin characters in composed form. Others go whole through
    encode(), as do all texts with any other tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [s.get("type") for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        pattern = (split[0].get("pattern") or {}).get("Regex", "")
        self.by_piece = (
            steps == ["NFC", "Replace", "Lowercase"]
            and split[0].get("behavior") == "Removed"
            and pattern.endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
            and [s.get("type") for s in split] == ["Split", "ByteLevel"]
            and not spec.get("post_processor")
        )
        if self.by_piece:
            letters, numbers = _latin("L"), _latin("N")
            head = pattern[: -len(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")]
            self.words = re.compile(rf"{head}[{letters}]+|[{numbers}]|[^\s{letters}{numbers}]+")
            self.odd = re.compile("[^\t-\r -~\xa0-ɏ]|<\\|")
            self.letter = _byte_letters()
            self.model = self.tokenizer.model
            self.pieces = _Cache(self._piece, PIECES)
            self.cached_words = _Cache(self._word, WORDS)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        plain = word if word.isascii() and word.isprintable() else "".join(map(self.letter.__getitem__, word.encode()))
        return array("I", [t.id for t in self.model.tokenize(plain)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        if piece.isascii():
            low = piece.lower()
            if low.isalpha():
                return self.cached_words[low]
            core = low.rstrip(PUNCTUATION)
            if core.isalpha():
                return self.cached_words[core] + self.cached_words[low[len(core) :]]
        if self.odd.search(piece) or not unicodedata.is_normalized("NFC", piece):
            return self._whole(piece)
        words = self.cached_words
        return b"".join([words[w] for w in self.words.findall(piece.lower())])

    def ids(self, text: str) -> bytes:
        if not self.by_piece:
            return self._whole(text)
        return b"".join(map(self.pieces.__getitem__, text.replace("\n", " ").split(" ")))


class _Cache(dict):
    def __init__(self, make, most: int) -> None:
        self.make, self.most = make, most

    def __missing__(self, k: str) -> bytes:
        v = self.make(k)
        if len(self) < self.most and len(k) < 100:
            self[k] = v
        return v


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
