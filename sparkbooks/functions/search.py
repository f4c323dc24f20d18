"""Many strings sought in a text in one pass, and places in a text whose spelling has been made uniform."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable

import ahocorasick

CURLY = str.maketrans("’‘“”", "''\"\"")
white = re.compile(r"\s+")


class Uniform:
    """A text with straight quotes, one space for each run of white space and lower case, that knows where its characters stood.

    Places are held for runs of white space only, so that a text takes as much memory as it has of those.
    """

    def __init__(self, raw: str):
        flat = raw.translate(CURLY)
        parts, self.begin, self.place, n, at = [], [], [], 0, 0
        for m in white.finditer(flat):
            self._add(parts, flat[at : m.start()], n, at)
            n += m.start() - at
            self._add(parts, " ", n, m.start())
            n, at = n + 1, m.end()
        self._add(parts, flat[at:], n, at)
        self.text = "".join(parts)

    def _add(self, parts: list[str], piece: str, n: int, at: int) -> None:
        if piece:
            # a character whose lower case is longer stays, so that places keep their distances
            low = piece.lower()
            parts.append(low if len(low) == len(piece) else "".join(x if len(x := c.lower()) == 1 else c for c in piece))
            self.begin.append(n)
            self.place.append(at)

    def raw(self, at: int) -> int:
        """Where the character at a place of the uniform text stands in the raw one."""
        k = bisect_right(self.begin, at) - 1
        return self.place[k] + at - self.begin[k]


def every_place(text: str, wanted: Iterable[str]) -> list[tuple[int, str]]:
    """(place, string) of all places of wanted strings, overlapping ones too, by where they end: one pass over the text, however many are sought. Empty strings are not found."""
    machine = ahocorasick.Automaton()
    for w in set(wanted):
        if w:
            machine.add_word(w, w)
    if not len(machine) or not text:
        return []
    machine.make_automaton()
    return [(end + 1 - len(w), w) for end, w in machine.iter(text)]


def first_places(text: str, wanted: Iterable[str]) -> dict[str, int]:
    """The first place of each wanted string that text holds."""
    found: dict[str, int] = {}
    for at, w in every_place(text, wanted):
        found.setdefault(w, at)
    return found
