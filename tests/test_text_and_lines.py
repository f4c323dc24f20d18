"""Text functions, quotes and lines, on literal rows and on random paragraphs against a plain restatement."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sparkbooks.functions import text as t
from sparkbooks.operators import lines as ln


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


def by_hand(p):
    """Walks a paragraph and flips at each delimiter."""
    apart = [i for i, c in enumerate(p) if c == "'" and not (i and p[i - 1].isalpha() and i + 1 < len(p) and p[i + 1].isalpha())]
    if '"' in p:
        cuts = [i for i, c in enumerate(p) if c == '"']
    elif apart and len(apart) % 2 == 0:
        cuts = apart
    else:
        return [("narrative", p)] if p.strip() else []
    out, last = [], 0
    for n, at in enumerate([*cuts, len(p)]):
        piece = p[last:at].strip().lstrip(" \n\t-").rstrip(" \n\t-")
        if piece:
            out.append(("dialogue" if n % 2 else "narrative", piece))
        last = at + 1
    return out


def test_quote_segments(spark):
    rng = random.Random(1)
    fixed = ["", "  ", "plain - text -", "'Hello,' she said. 'It's me.'", 'He said "no', "the dogs' house", '"A" - "B"', "l'été 'oui' d'un"]
    rows = fixed + ["".join(rng.choice("ab '\"-é.") for _ in range(rng.randrange(1, 40))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, text string")
    got = {}
    for r in ln.quote_segments(df).orderBy("i", "seg").collect():
        got.setdefault(r.i, []).append((r.segment_type, r.segment))
    for i, p in enumerate(rows):
        assert got.get(i, []) == by_hand(p), p


def test_parse_lines(spark):
    text = 'He came.\nLate. "Hi!" she said, "go"\n\n\nThe end'
    scenes = spark.createDataFrame([("b", 2, 3, text)], "book_id string, chapter int, scene int, text string")
    rows = ln.parse_lines(scenes).orderBy("line_number").collect()
    assert [(r.segment_type, r.text, r.post_padding_ms) for r in rows] == [
        ("narrative", "He came. Late.", 200), ("dialogue", "Hi!", 200), ("narrative", "she said,", 50), ("dialogue", "go", 600), ("narrative", "The end", 600),
    ]
    assert rows[1].line_id == hashlib.sha256(b"p1_c2_s3_l2_Hi!").hexdigest()[:16]
    assert {r.character for r in rows} == {"Narrator"}


def test_typography(spark):
    assert one(spark, t.normalize_typography, "“a” ‘b’\r\nc\rd") == "\"a\" 'b'\nc\nd"
    assert one(spark, lambda c: t.normalize_typography(c, full=True), " a \n\n\n\n b[Illustration]c ") == "a\n\nb\n\nc"
    assert one(spark, t.slug, "  Héllo, World!! ") == "h_llo_world"
    assert one(spark, t.words, None) == 0


def test_quote_style(spark):
    single = "'One,' he said. 'Two,' she said. 'Three.'"
    style = one(spark, lambda c: t.double_quote_style(c)["style"], single)
    changed = one(spark, lambda c: t.double_quote_style(c)["text"], single)
    assert style == "single" and changed.count('"') == 6
    assert one(spark, lambda c: t.double_quote_style(c)["style"], 'It\'s "so".') == "double"


@pytest.mark.parametrize("text,want", [("Copyright 1902", True), ("[Illustration: a dog]", True), ("", True), (None, True), ("A fine day.", False)])
def test_clutter(spark, text, want):
    assert one(spark, t.is_clutter, text) is want


def test_play(spark):
    play = "ACT I\n" + "\n".join(f"HAMLET. line {i}" for i in range(10))
    assert one(spark, t.is_play, play) is True and one(spark, t.is_play, play[6:]) is False


def test_gold_script(spark):
    raw = ['"before"', "[Scene 1 - start]", '"told"', "Mr. X:", '"said one"', "note", '"said two"', "[Scene 2]", '"again"']
    df = spark.createDataFrame([("b", i, x) for i, x in enumerate(raw)], "book_id string, pos int, line string")
    rows = [(r.scene, r.speaker, r.text) for r in ln.read_gold_script(df).orderBy("pos").collect()]
    assert rows == [(1, "Narrator", "before"), (1, "Narrator", "told"), (1, "Mr. X", "said one"), (1, "Mr. X", "said two"), (2, "Narrator", "again")]


def test_chunks(spark):
    df = spark.createDataFrame([(1, "x" * 25), (2, "ab"), (3, "")], "i int, text string")
    rows = ln.fixed_overlap_chunks(df, size=10, overlap=2).orderBy("i", "chunk").collect()
    assert [(r.i, r.start, len(r.text), r.position) for r in rows] == [
        (1, 0, 10, "first"), (1, 8, 10, "middle"), (1, 16, 9, "last"), (2, 0, 2, "only"), (3, 0, 0, "only"),
    ]
