"""Names in texts: all names of a roster are found in one pass over a text, by an Aho-Corasick automaton."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The verbs that make a name beside them the speaker.
BESIDE = ("said", "asked", "replied", "shouted", "whispered")
verb_after = re.compile(rf"\s+(?:{'|'.join(BESIDE)})\b", re.IGNORECASE).match
verb_before = re.compile(rf"\b(?:{'|'.join(BESIDE)})\s+\Z", re.IGNORECASE).search

MENTIONS = "array<struct<name:string,begin:int,end:int,whole:boolean,beside:boolean>>"


def lowered(text: str) -> str:
    """text in lower case with each character in its place; those whose lower case is longer stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


class Names:
    """An automaton over names, found whatever their case. Empty names are left out."""

    def __init__(self, names: Iterable[str]):
        self.machine = ahocorasick.Automaton()
        by_key: dict[str, list[str]] = {}
        for name in names:
            if name:
                by_key.setdefault(lowered(name), []).append(name)
        for key, own in by_key.items():
            self.machine.add_word(key, (len(key), own))
        if by_key:
            self.machine.make_automaton()
        self.some = bool(by_key)

    def hits(self, text: str) -> Iterator[tuple[str, int, int]]:
        """(name, begin, end) of each place where a name stands, overlapping ones too, by end."""
        if self.some and text:
            for last, (n, own) in self.machine.iter(lowered(text)):
                for name in own:
                    yield name, last + 1 - n, last + 1


@lru_cache(maxsize=256)
def automaton(names: tuple[str, ...]) -> Names:
    """A worker's automaton for the names of a book: rows of one book come together, so it is seldom built again."""
    return Names(names)


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def bounded(text: str, at: int) -> bool:
    """Whether a word begins or ends at a place of text."""
    return (at > 0 and _word(text[at - 1])) != (at < len(text) and _word(text[at]))


def _mentions(text: str | None, names: Iterable[str] | None) -> list[dict]:
    out = []
    for name, begin, end in automaton(tuple(names) if names is not None else ()).hits(text or ""):
        left, right = bounded(text, begin), bounded(text, end)
        gap = begin
        while gap and text[gap - 1].isspace():
            gap -= 1
        after = verb_after(text, end) is not None
        before = right and gap < begin and verb_before(text, max(0, gap - 16), begin) is not None
        out.append({"name": name, "begin": begin, "end": end, "whole": left and right, "beside": after or before})
    return out


def mentions(text: Column, names: Column) -> Column:
    """The places of names, an array of strings, in text: name, begin and end in characters, whether it is a whole word or several, and whether it stands
    beside a verb of speech (after one and white space, or before white space and one). Nulls have no mentions."""

    @F.pandas_udf(MENTIONS)
    def found(texts: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([_mentions(t, n) for t, n in zip(texts, names, strict=True)])

    return found(text, names)


def with_names(rows: DataFrame, roster: DataFrame, *keys: str) -> DataFrame:
    """rows with __names, the names of roster(*keys, name) for their keys, longest first."""
    listed = roster.groupBy(*keys).agg(F.collect_set("name").alias("__names"))
    longest = F.array_sort("__names", lambda a, b: F.coalesce(F.nullif(F.length(b) - F.length(a), F.lit(0)), F.when(a < b, -1).when(a > b, 1).otherwise(0)))
    return rows.join(listed.withColumn("__names", longest), list(keys), "left")
