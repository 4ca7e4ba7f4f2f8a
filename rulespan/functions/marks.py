"""Which of many tokens a text holds, by automata that walk it once, whatever their number."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

import ahocorasick


class Marks:
    """Token tests as bits. tokens: bit -> (number of its scope, token, whether the text in lower case is meant)."""

    def __init__(self, tokens: Mapping[int, tuple[int, str, bool]], width: int, n_words: int) -> None:
        self.width, self.n_words = width, n_words
        #: for either case: the scopes' mask, token -> [(scope's mask, bit)], automaton
        self.walks = []
        for low in (False, True):
            behind: dict[str, list[tuple[int, int]]] = {}
            for i, (scope, token, lower) in tokens.items():
                if lower == low:
                    behind.setdefault(token, []).append((1 << scope, i))
            if behind:
                automaton = ahocorasick.Automaton()
                for token in behind:
                    automaton.add_word(token, token)
                automaton.make_automaton()
                mask = 0
                for places in behind.values():
                    for scope, _ in places:
                        mask |= scope
                self.walks.append((low, mask, behind, automaton))

    def words(self, text: str, scopes: int, start: Iterable[int] = ()) -> list[int]:
        """start, or zeros, with the bits of the tokens that text holds; scopes: mask of the scopes that the text is in."""
        out = list(start) or [0] * self.n_words
        for low, mask, behind, automaton in self.walks:
            if scopes & mask:
                for token in {t for _, t in automaton.iter(text.lower() if low else text)}:
                    for scope, i in behind[token]:
                        if scopes & scope:
                            out[i // self.width] |= 1 << i % self.width
        return out
