"""All phrases of a table in one walk over a text: an automaton, and where its matches stand in their lines.

``spans`` looks for each phrase by itself, which costs a pass for each; here a text is walked
once, whatever the number of phrases, and matches, lines and citations are found by binary
search, so that a text costs its length and its matches.  Phrases have the same meaning as
there: short alphabetic ones are whole words in capitals, others are found whatever their
case, letter by letter; matches of one phrase do not overlap.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import lru_cache
from itertools import accumulate


class _Fold(dict):
    """str.translate's table of lower case, as lower() has it; letters without a single counterpart stay."""

    def __missing__(self, code: int) -> int:
        low = chr(code).lower()
        self[code] = ord(low) if len(low) == 1 else code
        return self[code]


_FOLD = _Fold()


def folded(text: str) -> str:
    """The text in one case, of the same length."""
    return text.lower() if text.isascii() else text.translate(_FOLD)


class Phrases:
    """An automaton over (phrase, whether it is a whole word in capitals); what ends a word as spans.phrase_regex has it."""

    def __init__(self, phrases: tuple[tuple[str, bool], ...], ascii_edges: bool = False):
        self.ascii_edges = ascii_edges
        self.any, self.whole = self._built([(k, folded(p)) for k, (p, w) in enumerate(phrases) if not w]), self._built([(k, p.upper()) for k, (p, w) in enumerate(phrases) if w])

    @staticmethod
    def _built(words: list[tuple[int, str]]):
        import ahocorasick

        at: dict[str, list[int]] = {}
        for k, word in words:
            if word:
                at.setdefault(word, []).append(k)
        if not at:
            return None
        out = ahocorasick.Automaton()
        for word, ks in at.items():
            out.add_word(word, (len(word), ks))
        out.make_automaton()
        return out

    def found(self, text: str) -> dict[int, list[tuple[int, int]]]:
        """Start and end, in code points, of each phrase's matches, from left to right; phrases that do not occur are left out."""
        out: dict[int, list[tuple[int, int]]] = {}

        def add(ks, a, b):
            for k in ks:
                seen = out.setdefault(k, [])
                if not seen or seen[-1][1] <= a:
                    seen.append((a, b))

        if self.any is not None:
            for last, (n, ks) in self.any.iter(folded(text)):
                add(ks, last + 1 - n, last + 1)
        if self.whole is not None:
            word = lambda c: (c.isalnum() and (c.isascii() or not self.ascii_edges)) or c == "_"
            for last, (n, ks) in self.whole.iter(text):
                a, b = last + 1 - n, last + 1
                if not (a and word(text[a - 1])) and not (b < len(text) and word(text[b])):
                    add(ks, a, b)
        return out


class Lines:
    """The lines of a text, each looked at once."""

    def __init__(self, text: str):
        self.text, self.breaks, self.known = text, None, {}

    def width(self, a: int, b: int) -> int:
        """Characters of the line, or lines, that a match lies in, blanks at the ends left out."""
        if self.breaks is None:
            self.breaks = [-1, *(m.start() for m in re.finditer("\n", self.text)), len(self.text)]
        key = bisect_right(self.breaks, a - 1) - 1, bisect_left(self.breaks, b, 1)
        if key not in self.known:
            self.known[key] = len(self.text[self.breaks[key[0]] + 1 : self.breaks[key[1]]].strip(" "))
        return self.known[key]


class Covered:
    """Whether a place lies in one of some spans."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(spans)
        self.starts, self.reach = [a for a, _ in spans], list(accumulate((b for _, b in spans), max))

    def holds(self, at: int) -> bool:
        k = bisect_right(self.starts, at)
        return k > 0 and self.reach[k - 1] > at


def in_title_position(text: str, lines: Lines, a: int, b: int, head_chars: int, short_max: int) -> bool:
    """Near the top, in capitals, or most of a short line of its own."""
    if a < head_chars:
        return True
    own = text[a:b]
    if b - a > short_max and own == own.upper() and own != own.lower():
        return True
    width = lines.width(a, b)
    return width <= 80 and b - a >= 0.6 * max(1, width)


@lru_cache(8)
def automaton(phrases: tuple[tuple[str, bool], ...], ascii_edges: bool = False) -> Phrases:
    return Phrases(phrases, ascii_edges)
