"""Rows on which queries once differed from their SQL."""

import difflib
import random
import re
import time

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from sparkbooks.operators import attribution as at
from sparkbooks.operators import fuzzy
from sparkbooks.operators import neighbours as nb
from sparkbooks.operators import segments as sg
from sparkbooks.operators import stats as st
from sparkbooks.queries import QUERIES, SQL
from sparkbooks.sources import files as fl


def both(spark, tmp_path, query, table, **columns):
    """The query's rows over a table of these columns, and its SQL's."""
    pq.write_table(pa.table(columns), tmp_path / f"{table}.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    got, want = QUERIES[query](spark, str(tmp_path)), con.sql(SQL[query])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    at_ = {c: i for i, c in enumerate(want.columns)}
    return sorted(tuple(str(r[c]) for c in order) for r in got.collect()), sorted(tuple(str(r[at_[c]]) for c in order) for r in want.fetchall())


PAGE = "<html><body><h1>This &amp; that &quot;cut&amp</h1><p>" + "some words of a page " * 20 + "&copy; &unknown; R&ampD</p></body></html>"


def test_f1_open_references_in_pages(spark, tmp_path):
    got, want = both(spark, tmp_path, "P8_html_to_text", "pages", page_id=[1], url=["http://a/b"], html=[PAGE])
    assert got == want and 'This & that "cut&amp' in got[0]
    page = spark.createDataFrame([("<p>a&amp b &#65; &#x42; &nbsp;c</p>",)], "html string")
    assert sg.html_to_text(page).first().text == "a& b A B \xa0c" and sg.html_to_text(page, closed=True).first().text == "a&amp b A B \xa0c"


def test_f2_open_references_in_spine_items(spark, tmp_path):
    got, want = both(spark, tmp_path, "P9_filter_spine_items", "pages", page_id=[1], url=["http://a/b"], html=[PAGE])
    assert got == want and len(got) == 1


def test_f3_sections_that_begin_like_headings(spark, tmp_path):
    """Chapters whose first words look like a heading, as 'Vi. Le' does."""
    convs = [c for c in range(40) for _ in (0, 1)]
    texts = [f"Vi. Le pa {c}" if c % 10 == 5 and t == 0 else f"words of {c} and of turn {t}" for c in range(40) for t in (0, 1)]
    got, want = both(spark, tmp_path, "G3_split_bare_roman_sections", "conversations", conv_id=convs, turn=[0, 1] * 40, role=["user", "assistant"] * 40, text=texts)
    assert got == want and len(got) == 8


def test_f4_merges_of_as_many_lines(spark, tmp_path):
    """Ada and Cora have a line each."""
    got, want = both(spark, tmp_path, "J6_composed_name_merges", "conversations", conv_id=[3, 3, 3], turn=[0, 1, 2], role=["user", "assistant", "user"], text=["a", "b", "c"])
    assert got == want == [("Ada", "book0", "Cora", "Miss Ada Cora")]
    speakers = spark.createDataFrame([("b", "Ann", 2), ("b", "Lee", 1)], "book_id string, name string, n long")
    roster = spark.createDataFrame([("b", "Ann Lee")], "book_id string, name string")
    assert at.composed_name_merges(speakers, roster).first().canonical == "Ann"


@pytest.mark.parametrize("length", [19, 20, 24, 29, 30, 31, 45])
def test_f5_moments_of_short_lines(spark, tmp_path, length):
    text = ("Ansh of eror inble esly and more of these words"[: length - 1]).strip().ljust(length - 1, "x") + "y"
    got, want = both(spark, tmp_path, "V12_filter_moments", "conversations", conv_id=[1] * 5, turn=[0, 1, 2, 3, 4], role=["user"] * 5, text=["Some line.", "Two", "... 3", text, text + "."])
    assert got == want


def test_f6_names_before_other_letters(spark, tmp_path):
    text = "Ergeü met Ergeß, and Ann Lee met éAnn Lee; Bobby9 and Bobby9"
    got, want = both(spark, tmp_path, "A2_scene_candidate_roster", "conversations", conv_id=[1], turn=[0], role=["user"], text=[text])
    assert got == want and {r[2] for r in got} == {"Ann Lee", "Erge"}
    lines = spark.createDataFrame([("b", "s", "narrative", text + " Ann Lee")], "book_id string, scene_id string, segment_type string, text string")
    assert [(r.name, r.n) for r in st.scene_roster(lines).collect()] == [("Ann Lee", 2)]


def test_f8_f13_f14_blocks_of_one_vector_a_row(spark, monkeypatch):
    """Listings reach Python as rows of one vector and in groups of a fixed size, and the nearest are found in steps, equal ones by id."""
    monkeypatch.setattr(nb, "BLOCK", 16)
    rows = spark.range(400).selectExpr("id AS vec_id", "array(sin(id), cos(id), sin(id * id)) AS embedding")
    index = nb.Index(rows, pivots=3)
    assert index.blocks.columns == ["block", "i", "v"] and index.blocks.count() == 400
    assert max(r["count"] for r in index.blocks.groupBy("block").count().collect()) < 40
    x = np.random.default_rng(1).integers(-2, 3, (500, 4)) + [0.5, 0, 0, 0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    monkeypatch.setattr(nb, "HELD", 50)
    ids = np.arange(500)[::-1].copy()
    row, best, near = nb.nearest_of(x[:9], ids, x, 7)
    want = [sorted((-round(float(q @ v), 12), int(i)) for i, v in zip(ids, x, strict=True))[:7] for q in x[:9]]
    assert [(r, i) for r, i in zip(row.tolist(), best.tolist(), strict=True)] == [(n, i) for n, w in enumerate(want) for _, i in w]


def test_f9_chunks_are_found_once(spark):
    """A long chapter's paragraphs go by once, not once for each of its scenes."""
    text = "\n\n".join(f"Meanwhile, {i} words" for i in range(5000))
    rows = spark.createDataFrame([("b", "c", text)], "book_id string, chapter_id string, text string")
    begin = time.monotonic()
    scenes = sg.split_scenes(rows).collect()
    assert len(scenes) == 2500 and scenes[-1].text == "Meanwhile, 4998 words\n\nMeanwhile, 4999 words"
    windows = sg.paragraph_windows(rows.select("book_id", "text"), most_chars=30).collect()
    assert len(windows) == 2500 and time.monotonic() - begin < 40


def test_f10_packages_in_small_batches(spark):
    """Packages go to Python some hundred at a time, and many small ones come back as one table."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        files = spark.range(600).selectExpr("concat('/files/', id, '.epub') AS path", "cast('no package' AS binary) AS content")
        rows = fl.epub_spines(files, "/files").collect()
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "256"
        assert sorted(int(r.book_id) for r in rows) == list(range(600)) and {r.status for r in rows} == {"broken"} and {r.spine_index for r in rows} == {None}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def scenes_of_prose(n):
    rng = random.Random(4)
    words = ["".join(rng.choices("aeinorst", k=rng.randrange(1, 8))) for _ in range(60)]
    lines = [("b", k // 40, k, f"l{k}", " ".join(rng.choices(words, k=rng.choice([2, 9, 60, 200])))) for k in range(n)]
    return [(b, s, k, t[: len(t) * 4 // 5] if k % 7 else t[::-1]) for b, s, k, _, t in lines], lines


def test_f11_f12_scenes_are_held_by_a_task(spark, monkeypatch):
    """The same lines, ratios and numbers compared, whether a task holds a scene, holds it for a deal of its gold lines, or the index is a table; a held scene makes no row for a pair."""
    gold, lines = scenes_of_prose(120)
    g = spark.createDataFrame(gold, "book_id string, scene long, pos long, text string")
    p = spark.createDataFrame(lines, "book_id string, scene long, line_number long, line_id string, text string")
    rows = lambda: sorted((r.pos, r.line_id, r.ratio, r.compared) for r in at.align_gold(g, p).collect())
    monkeypatch.setattr(fuzzy, "indexed", None)
    held = rows()
    monkeypatch.setattr(fuzzy, "DEAL", 100)
    assert rows() == held
    monkeypatch.undo()
    monkeypatch.setattr(fuzzy, "TEXTS", 10)
    assert rows() == held


def test_f11_f12_common_bounds_the_ratio():
    rng = random.Random(3)
    for n in (0, 1, 5, 40, 300):
        for _ in range(40):
            a, b = ("".join(rng.choices("abcde ", k=rng.randrange(n + 1))) for _ in "ab")
            m = difflib.SequenceMatcher(None, a, b)
            assert 2 * fuzzy.common(a, b) >= m.ratio() * (len(a) + len(b)) - 1e-9 or not a + b
            assert fuzzy.ratio_from(m, 0.6) == (m.ratio() if m.ratio() >= 0.6 else 0.0)
    assert fuzzy.common("abcbdab", "bdcaba") == 4


def test_f15_cues_lose_no_sound(spark):
    """The same sounds whether the patterns have cues or, as others, none."""
    assert list(at.FOLEY_CUES) == [p for p, _ in at.FOLEY]
    rng = random.Random(5)
    words = sorted(set(" ".join(re.sub(r"\\[bw]|\[\^\.\]|\{[^}]*\}|[^A-Za-z ]", " ", p) for p, _ in at.FOLEY).lower().split()) | {"a", "in", "into", "down", "his", "the", "opened", "entered", "walking", "pouring", "stairs", "doors"})
    phrases = ["came in", "cam into", "shown in", "left the room", "departed office", "crossed the room", "walked over", "sat down", "seated herself", "sank into", "rose to his feet", "stood up", "sprang to", "struck a match", "lit the lamp"]
    texts = [". ".join(" ".join(rng.choice([str.upper, str.title, str.lower])(rng.choice(words + phrases)) for _ in range(rng.randrange(1, 9))) for _ in range(6)) for _ in range(800)]
    lines = spark.createDataFrame([(i, 1, "narrative", t) for i, t in enumerate(texts)], "scene_id int, line_number int, segment_type string, text string")
    rows = lambda patterns: sorted(tuple(r) for r in at.spot_foley(lines, patterns, k=20).collect())
    got = rows(at.FOLEY)
    assert got == rows(tuple((f"(?:{p})", idea) for p, idea in at.FOLEY)) and {r[3] for r in got} == {idea for _, idea in at.FOLEY}
