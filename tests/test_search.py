"""Snippets, anchors and edit distances against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sparkbooks.functions.search import Uniform, first_places
from sparkbooks.operators import attribution as at
from sparkbooks.operators import production as pr
from sparkbooks.operators import proposals as pp
from sparkbooks.operators import segments as sg


def flat(text):
    return re.sub(r"\s+", " ", text.translate(str.maketrans("’‘“”", "''\"\"")).lower())


def raw_place(text, place):
    """The raw place of a uniform place, character by character."""
    n, i = -1, -1
    for i, c in enumerate(text):
        if not (c.isspace() and i and text[i - 1].isspace()):
            n += 1
        if n == place:
            return i


def test_uniform():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("aB ’“ \n\t　é") for _ in range(rng.randrange(0, 30)))
        u = Uniform(text)
        assert u.text == flat(text)
        assert [u.raw(k) for k in range(len(u.text))] == [raw_place(text, k) for k in range(len(u.text))]
    assert len(Uniform("İİ x").text) == 4


def test_first_places():
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice("ab") for _ in range(rng.randrange(0, 40)))
        wanted = {"".join(rng.choice("ab") for _ in range(rng.randrange(0, 6))) for _ in range(8)}
        assert first_places(text, wanted) == {w: text.find(w) for w in wanted if w and w in text}


def cut(text, snippets):
    norm, places = flat(text), []
    for s in snippets:
        s = flat(s)[:80]
        if len(s) >= 15 and norm.find(s) > 200:
            places.append(norm.find(s))
    last, at_ = 0, {0}
    for p in sorted(places):
        if p - last >= 400:
            last, raw = p, raw_place(text, p)
            paragraph = text.rfind("\n\n", 0, raw)
            at_.add(raw if paragraph < 0 else paragraph + 2)
    at_ = [*sorted(at_), len(text)]
    return [b for b in (text[x:y].strip() for x, y in zip(at_, at_[1:], strict=False)) if b]


def test_split_at_snippets(spark):
    rng, chapters, snippets, want = random.Random(5), [("none", None), ("empty", "")], [("none", "x" * 20), ("b0", None), ("b1", "")], {"none": [], "empty": []}
    for i in range(25):
        words = ["".join(rng.choice("aAbé’") for _ in range(rng.randrange(1, 5))) for _ in range(900)]
        text = "".join(w + rng.choice([" ", " ", " ", "\n", "\n\n", "  \t"]) for w in words)
        own = [text[k : k + rng.choice([5, 16, 40, 100])].upper() for k in (rng.randrange(len(text)) for _ in range(9))] + ["nowhere in this text at all"]
        own += [own[0], own[1][:20]]  # repeats and overlaps
        chapters.append((f"b{i}", text))
        snippets += [(f"b{i}", s) for s in own]
        want[f"b{i}"] = cut(text, own)
    got: dict = {key: [] for key in want}
    frame = spark.createDataFrame(chapters, "key string, text string")
    for r in sorted(sg.split_at_snippets(frame, spark.createDataFrame(snippets, "key string, snippet string"), "key").collect(), key=lambda r: r.n):
        got[r.key].append(r.text)
    assert got == want and any(len(b) > 2 for b in want.values())


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edits():
    rng = random.Random(6)
    for _ in range(500):
        a, b = ([rng.choice("abcde") for _ in range(rng.choice([0, 1, 3, 20, 64, 65, 150]))] for _ in range(2))
        assert at.edits(a, b) == plain_edits(a, b)
        assert at.edits(a, a) == 0


def test_corpus_word_error_rate(spark):
    rows = [("x", "a b c", "a c"), ("x", "A", "a b"), ("x", None, "q"), ("y", "", ""), ("y", None, None)]
    got = {r.k: r for r in at.corpus_word_error_rate(spark.createDataFrame(rows, "k string, reference string, hypothesis string"), "k").collect()}
    assert (got["x"].pairs, got["x"].errors, got["x"].words, got["x"].wer) == (3, 3, 4, 0.75)
    assert (got["y"].errors, got["y"].words, got["y"].wer) == (0, 0, None)


def test_anchored_by_text(spark):
    lines = [("s", 1, "dialogue", "The door  SLAMS shut", 1.0), ("s", 2, "narrative", "a door slams\nsomewhere", 2.0), ("s", 3, "narrative", None, 3.0), ("t", 1, "narrative", "Bang", 4.0)]
    cues = [("s", "spoken", "door slams"), ("s", "longer", "a door slams somewhere else in the house"), ("s", "no", "zebra"), ("s", "one", "z"), ("s", "null", None), ("t", "whole", "bang"), ("u", "lost", "bang")]
    timed = spark.createDataFrame(lines, "scene string, line_number long, segment_type string, text string, end double")
    frame = spark.createDataFrame([(*c, -6.0) for c in cues], "scene string, key string, sound_text string, gain_db double")
    got = {r.key: (r.line_number, r.start) for r in pr.anchored_by_text(frame, timed, ["scene"], first=12).collect()}
    # what a line of dialogue holds whole is speech, as is the empty text
    assert got == {"longer": (2, 2.0), "no": (None, 0.0), "one": (None, 0.0), "whole": (1, 4.0), "lost": (None, 0.0)}


def test_with_answers(spark, tmp_path):
    """A second run asks for what has no good answer; a request that never gets one is asked for `tries` times a run."""
    asked = tmp_path / "asked"
    asked.mkdir()

    def fn(frames):
        for f in frames:
            for key in f["request_id"]:
                n = len(list(asked.glob(f"{key}-*")))
                (asked / f"{key}-{n}").touch()
                raw = {"good": '```json\n{"speaker": "Ann"}\n```', "late": '{"speaker": "Bo"}' if n >= 2 else "{"}.get(key, "no")
                if key != "silent":
                    yield f[f["request_id"] == key][["request_id"]].assign(raw=raw)

    rows = [("good", 1), ("good", 1), ("late", 2), ("bad", 3), ("silent", 4), (None, 5)]
    requests = spark.createDataFrame(rows, "request_id string, raw_text int")
    got = {r.request_id: r for r in at.with_answers(requests, fn, str(tmp_path / "store"), tries=2).collect()}
    assert {k: (r.status, r.tries) for k, r in got.items()} == {
        "good": ("success", 1), "late": ("failed_retry_required", 2), "bad": ("failed_retry_required", 2), "silent": ("failed_retry_required", 0), None: ("failed_retry_required", 0)
    }
    got = {r.request_id: r for r in at.with_answers(requests, fn, str(tmp_path / "store"), tries=2).collect()}
    assert got["late"].answer.speaker == "Bo" and got["late"].tries == 3 and got["good"].answer.speaker == "Ann" and got["bad"].tries == 4
    count = lambda key: len(list(asked.glob(f"{key}-*")))
    assert (count("good"), count("late"), count("bad"), count("silent")) == (1, 3, 4, 4)
    assert at.with_answers(requests.limit(0), fn, str(tmp_path / "none")).count() == 0


def test_resplit_at_headings(spark):
    body = lambda c, n=300: c * n
    text = body("f", 250) + "\nCHAPTER I\n" + body("a") + "\n CHAPTER II the\n" + body("b") + " CHAPTER II\n" + body("c") + "\nchapter III\n" + body("d") + "\nCHAPTER IV\n" + body("e", 50) + "\nCHAPTER V\n" + body("g")
    books = spark.createDataFrame([("x", text), ("one", "CHAPTER I\n" + body("z")), ("null", None), ("none", text)], "key string, text string")
    heads = spark.createDataFrame([(k, h) for k in ("x", "one", "null") for h in ("CHAPTER I", "CHAPTER II", " CHAPTER V ", "IV", None, "CHAPTER IX")], "key string, heading string")
    cut = lambda **more: [(r.key, r.n, r.heading, r.text[0], len(r.text)) for r in sg.resplit_at_headings(books, heads, "key", gap=200, **more).orderBy("key", "n").collect()]
    # of two headings at one place the longer counts; one within a line does not; CHAPTER IV begins with CHAPTER I, and CHAPTER V follows it too closely
    assert cut() == [("x", 0, "Prologue", "f", 250), ("x", 1, "CHAPTER I", "a", 300), ("x", 2, "CHAPTER II", "t", 929), ("x", 3, "CHAPTER I", "V", 363)]
    found = cut(siblings=True, least=40)
    assert [x[2] for x in found] == ["Prologue", "CHAPTER I", "CHAPTER II the", "chapter III", "CHAPTER IV"]
    most = spark.createDataFrame([("x", 3)], "key string, most int")
    assert cut(most=most) == [] and cut(most=most.withColumn("most", F.lit(4))) == cut()


def test_filter_inserts_levels(spark):
    texts = spark.createDataFrame([("s", "The rain fell upon the house and Ann ran home.")], "scene string, text string")
    lines = spark.createDataFrame([("s", i) for i in range(4)], "scene string, line_number int")
    rows = [(1, "Ann", "performance_vocal"), (2, "Old Teapot", "performance_vocal"), (3, "Cook", "line"), (4, "Narrator", "line"), (5, "Ghost", "line"), (6, "Bed", "line")]
    inserts = spark.createDataFrame([("s", n, 1, "the rain fell", k, c, f"Oh dear {c}!") for n, c, k in rows], "scene string, n int, anchor int, source_text string, kind string, character string, text string")
    cast = spark.createDataFrame([("s", "Ann")], "scene string, character string")
    declared = spark.createDataFrame([("s", n) for n in ("Cook", "Old Teapot", "Bed", None)], "scene string, name string")
    who = lambda **more: sorted(r.character for r in pp.filter_inserts(inserts, lines, texts, cast, ["scene"], **more).collect())
    assert who() == ["Ann", "Narrator"] and who(declared=declared) == ["Ann", "Cook", "Narrator"] and who(declared=declared, level="enhanced") == ["Ann"]
    with pytest.raises(ValueError):
        who(level="none")


def test_dialogue_sentences(spark):
    text = """He said "Come on, all". 'Well, Then'. "The Old Man" and 'not so, no' and "it". It's Ann's day."""
    found = [(r.pos, r.n, r.quote, r.spoken) for r in at.dialogue_sentences(spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string")).collect()]
    assert found == [(0, 0, "Come on, all", True), (2, 0, "not so, no", False), (3, 0, "s Ann", False)]
    assert all(not r[2].istitle() for r in found)


def test_min_gap_of_large_keys(spark):
    rng, rows, want = random.Random(7), [(None, 1.0), ("a", None)], []
    for key, n in (("a", 400), ("b", 30), ("c", 1), ("dense", 300)):
        own = [float(rng.randrange(60)) if key == "dense" else rng.choice([rng.uniform(-50, 900), float(rng.randrange(900))]) for _ in range(n)]
        rows += [(key, x) for x in own]
        last = None
        for x in sorted(own):
            if last is None or x - last >= 7:
                last = x
                want.append((key, x))
    frame = spark.createDataFrame(rows, "key string, at double")
    for hot in (0, 100, 10**6):
        assert sorted((r.key, r.at) for r in sg.min_gap_rows(frame, "key", "at", 7, hot=hot).collect()) == sorted(want)
    assert sg.min_gap_rows(frame.limit(0), "key", "at", 7).count() == 0


def test_min_gap_of_a_million(spark):
    """One key has a million places; each fourth is kept."""
    frame = spark.range(1_000_000).selectExpr("1 AS key", "id * 2 AS at")
    got = sg.min_gap_rows(frame, "key", "at", 7, hot=1000)
    assert got.agg(F.count("*"), F.sum("at"), F.max(F.col("at") % 8)).first() == (250_000, sum(range(0, 2_000_000, 8)), 0)
