"""Column functions for manuscripts' text. Regular expressions are Java's, with Unicode classes where the rule is about letters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Quote characters and what they become.
DOUBLE_QUOTES = "“”„«»"
SINGLE_QUOTES = "‘’‚‹›"


def strip(c: Column) -> Column:
    """Without white space, of Unicode's kinds, at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def words(c: Column) -> Column:
    """The number of runs of anything but white space."""
    return F.coalesce(F.regexp_count(c, F.lit(r"\S+")), F.lit(0)).cast("long")


def straight_quotes(c: Column) -> Column:
    return F.translate(c, DOUBLE_QUOTES + SINGLE_QUOTES, '"' * len(DOUBLE_QUOTES) + "'" * len(SINGLE_QUOTES))


def normalize_typography(c: Column, full: bool = False) -> Column:
    """Straight quotes and line feeds. `full` also makes [Illustration] a gap, strips lines and leaves one empty line at most."""
    out = F.regexp_replace(straight_quotes(F.coalesce(c, F.lit(""))), "\r\n?", "\n")
    if full:
        out = F.regexp_replace(out, r"\[Illustration\]", "\n\n")
        out = F.regexp_replace(out, r"(?m)^[ \t\x0B\f]+|[ \t\x0B\f]+$", "")
        out = strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))
    return out


def slug(c: Column) -> Column:
    """Lower case, with runs of anything but letters and digits as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def safe_filename(c: Column) -> Column:
    """The last part of a path, with characters that are not safe in names as underscores."""
    name = F.regexp_replace(F.regexp_replace(c, r"^.*[/\\]", ""), r"[^A-Za-z0-9._-]+", "_")
    return F.when(name == "", "upload").otherwise(name)


def printable_ratio(c: Column, first: int = 20_000) -> Column:
    """The share of the first characters that are no control, format or unassigned characters; line ends and tabs count as printable."""
    head = F.substring(c, 1, first)
    bad = F.regexp_count(head, F.lit(r"[\p{C}&&[^\n\r\t]]"))
    return F.when(F.length(head) > 0, 1 - bad / F.length(head)).otherwise(F.lit(0.0))


def is_play(c: Column, first: int = 60_000) -> Column:
    """Whether the head has at least ten lines that begin with a speaker in capitals and a full stop, and an ACT I line."""
    head = F.substring(c, 1, first)
    speakers = F.regexp_count(head, F.lit(r"(?dm)^[A-Z][A-Z ]{2,}\.")) >= 10
    return speakers & head.rlike(r"(?dm)^\s*ACT I\b")


# What marks a paragraph as clutter.
CLUTTER = (
    "frederick warne", "first published", "printed and bound", "william clowes", "gutenberg", "ebook", "isbn", "all rights reserved",
    "http://", "https://", "www.gutenberg", "sam'l gabriel", "copyright", "public domain", "project gutenberg", "illustrated by",
    "author:", "title:", "illustrator:", "release date:",
)
TITLE_TERMS = ("the tale of", "peter rabbit", "beatrix potter", "by beatrix potter")


def is_clutter(c: Column) -> Column:
    """Empty, an illustration tag, front matter by its words, or a bare title."""
    t = F.lower(strip(F.coalesce(c, F.lit(""))))
    found = (t == "") | t.startswith("[illustration") | t.endswith("illustration]") | t.isin(*TITLE_TERMS)
    for word in CLUTTER:
        found = found | t.contains(word)
    return found


def double_quote_style(c: Column) -> Column:
    """struct(text, style): where single quotes at word borders outnumber double quotes, and are over two pairs, they become double ones."""
    before, after = r"(^|[\s(\[-])['‘]", r"['’]($|[\s.,!?;)\]-])"
    singles = (F.regexp_count(c, F.lit(before)) + F.regexp_count(c, F.lit(after))) / 2
    single = (singles > 2) & (singles > F.regexp_count(c, F.lit('["“]')))
    doubled = F.regexp_replace(F.regexp_replace(c, before, '$1"'), after, '"$1')
    return F.struct(F.when(single, doubled).otherwise(c).alias("text"), F.when(single, "single").otherwise("double").alias("style"))


# Words in a title and the content type that they tell, in order of precedence.
CONTENT_TYPES = (
    ("appendix", "appendix"), ("epilogue", "epilogue"), ("prologue", "prologue"), ("preface", "preface"), ("foreword", "foreword"),
    ("introduction", "introduction"), ("letter", "letter"), ("chapter", "chapter"),
)


def content_type(title: Column, otherwise: str = "chapter") -> Column:
    t, out = F.lower(F.coalesce(title, F.lit(""))), F.lit(otherwise)
    for word, kind in reversed(CONTENT_TYPES):
        out = F.when(t.contains(word), kind).otherwise(out)
    return out


# Keywords of the emotions, in order of precedence.
EMOTIONS = (
    ("Joy", ("happy", "laugh", "smile", "joy", "glad", "excellent", "wonderful", "perfect")),
    ("Sadness", ("sad", "cry", "weep", "tears", "mourn", "gloomy", "depressed")),
    ("Tension", ("afraid", "scared", "terror", "danger", "panic", "angry", "shout", "scream")),
)


def emotion(c: Column) -> Column:
    out, text = F.lit("Neutral"), F.lower(F.coalesce(c, F.lit("")))
    for name, keywords in reversed(EMOTIONS):
        out = F.when(text.rlike("|".join(keywords)), name).otherwise(out)
    return out


def normalized(c: Column) -> Column:
    """For grounding: lower case, letters and digits with single spaces between."""
    return F.trim(F.regexp_replace(F.lower(straight_quotes(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", " "))
