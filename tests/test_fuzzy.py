"""Alignment and merges of similar names against comparing all pairs."""

import difflib
import random
import re

from pyspark.sql import functions as F

from sparkbooks.operators import attribution as at
from sparkbooks.operators import fuzzy


def plain(text):
    return re.sub(r"[^a-z0-9]+", " ", (text or "").lower()).strip(" ")


def changed(rng, text):
    """text with some characters or words left out, put in or exchanged."""
    out = list(text)
    for _ in range(rng.randrange(0, max(1, len(out) // 3))):
        k = rng.randrange(len(out)) if out else 0
        out[k : k + rng.choice([0, 1, 1, 4])] = rng.choice(["", "x", "e", " and ", "q"])
    return "".join(out)


def gold_and_lines(rng, n):
    words = ["".join(rng.choice("abcdeinorst") for _ in range(rng.randrange(1, 8))) for _ in range(150)]
    lines, gold = [], []
    for book in ("one", "two"):
        for scene in range(4):
            for k in range(n // 8):
                text = " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 5, 12, 40])))
                lines.append((book, scene, k, f"{book}{scene}-{k}", text if rng.random() < 0.97 else None))
                # the second book's gold script has one scene only
                gold.append((book, scene if book == "one" else 0, k + 1000 * scene, changed(rng, text) if rng.random() < 0.7 else rng.choice([text, text.upper(), "zzz", "", None])))
    return gold, lines


def aligned(gold, lines, threshold):
    out = {}
    for book, scene, pos, text in gold:
        whole = len({g[1] for g in gold if g[0] == book}) != len({p[1] for p in lines if p[0] == book})
        best, found = -1.0, None
        for p in sorted(p for p in lines if p[0] == book and (whole or p[1] == scene)):
            ratio = difflib.SequenceMatcher(None, plain(text), plain(p[4])).ratio()
            if ratio > best:
                best, found = ratio, p[3]
        out[book, scene, pos] = (found, round(best, 9)) if best >= threshold else (None, None)
    return out


def test_align_gold(spark):
    gold, lines = gold_and_lines(random.Random(6), 480)
    g = spark.createDataFrame([(*r, "Ann") for r in gold], "book_id string, scene long, pos long, text string, speaker string")
    p = spark.createDataFrame(lines, "book_id string, scene long, line_number long, line_id string, text string")
    rows = at.align_gold(g, p).collect()
    want = aligned(gold, [(b, s, k, i, t) for b, s, k, i, t in lines], 0.5)
    assert {(r.book_id, r.scene, r.pos): (r.line_id, r.ratio and round(r.ratio, 9)) for r in rows} == want
    assert len(rows) == len(gold)
    every = sum(sum(1 for p in lines if p[0] == b and (b == "two" or p[1] == s)) for b, s, _, _ in gold)
    assert sum(r.compared for r in rows) < 0.5 * every
    assert at.align_gold(g.limit(0), p).count() == 0 and at.align_gold(g, p.limit(0)).where("line_id IS NOT NULL").count() == 0


def test_bound():
    """Texts that are alike have at least the pairs of characters in common that the bound says."""
    rng = random.Random(1)
    for _ in range(3000):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 20)))
        b = changed(rng, a)
        ratio = difflib.SequenceMatcher(None, a, b).ratio()
        pairs = [a[i : i + 2] for i in range(len(a) - 1)]
        left = [b[i : i + 2] for i in range(len(b) - 1)]
        shared = sum(min(pairs.count(x), left.count(x)) for x in set(pairs))
        m = ratio * (len(a) + len(b)) / 2
        assert shared >= 3 * m - (len(a) + len(b)) - 1 - 1e-9


def test_consolidate(spark):
    rng = random.Random(2)
    parts = ["Ann", "Anna", "Mr", "Mrs", "Lee", "Leigh", "O'Hara", "Bo", "B", "Maximilian", "Maximillian", "Fox", "Foxx", "!", "Jo-Ann"]
    names = sorted({" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(60)})
    books = [("b", n) for n in names] + [("c", n) for n in names[::3]]
    frame = spark.createDataFrame(books, "book_id string, name string")
    none = spark.createDataFrame([], "book_id string, original string, canonical string, yes boolean, confidence double")
    got = sorted((r.book_id, r.original, r.canonical, r.confidence) for r in at.consolidate_characters(frame, none).collect())
    want = []
    for book in "bc":
        own = sorted((n for b, n in books if b == book), key=lambda n: (-len(n), n))
        flat = {n: re.sub(r"[^\w\s]", "", n.lower()).strip(" ") for n in own}
        titles = {n: tuple(t in flat[n].split() for t in ("mr", "mrs")) for n in own}
        taken = set()
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                if a in taken or b in taken or titles[a] != titles[b]:
                    continue
                ratio = 1.0 if flat[b] in flat[a] else difflib.SequenceMatcher(None, flat[a], flat[b]).ratio()
                if ratio >= 0.8:
                    taken.add(b)
                    want.append((book, b, a, round(ratio, 2)))
    assert got == sorted(want)


def test_pairs_of(spark):
    frame = spark.createDataFrame([("abca",), ("a",), ("",), ("ü\n😀",)], "t string")
    assert [r.p for r in frame.select(fuzzy.pairs_of(F.col("t")).alias("p")).collect()] == [["ab", "bc", "ca"], [], [], ["ü\n", "\n😀"]]
