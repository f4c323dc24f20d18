"""Section edits, segmentation, readers and writers, streams."""

import hashlib
import io
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from sparkbooks.operators import attribution as at
from sparkbooks.operators import production as pr
from sparkbooks.operators import segments as sg
from sparkbooks.operators import structure as sx
from sparkbooks.sources import files as fl

SECTIONS = """section_id string, parent_id string, book_id string, kind string, position long, title string, content_type string, text_hash string, status string,
analysis_valid boolean, audio_valid boolean, render_valid boolean, approval string, structure_version long"""


@pytest.fixture
def tree(spark):
    rows = [("p1", None, "part", 1), ("p1_c1", "p1", "chapter", 1), ("p1_c2", "p1", "chapter", 2), ("p1_c3", "p1", "chapter", 3)]
    rows += [(f"p1_c{c}_s{s}", f"p1_c{c}", "scene", s) for c in (1, 2, 3) for s in (1, 2)]
    return spark.createDataFrame([(i, p, b, k, n, i, k, f"h{i}", "active", True, True, True, "approved", 1) for b in ("b", "other") for i, p, k, n in rows], SECTIONS)


def active(sections):
    return {r.section_id: r for r in sections.collect() if r.status == "active" and r.book_id == "b"}


def book(sections):
    """The sections of the edited book, which has a new version, while the other stays as it was."""
    rows = sections.collect()
    assert {(r.book_id, r.structure_version) for r in rows} == {("b", 2), ("other", 1)}
    assert all(r.approval == "approved" and r.render_valid for r in rows if r.book_id == "other")
    return {r.section_id: r for r in rows if r.book_id == "b"}


def state(row):
    return (row.status, row.analysis_valid, row.audio_valid, row.render_valid, row.approval)


def orders_hold(sections):
    by = {}
    for r in sections.collect():
        if r.status == "active":
            by.setdefault((r.book_id, r.parent_id), []).append(r.position)
    return all(sorted(x) == list(range(1, len(x) + 1)) for x in by.values())


def edits_of(spark, rows, rest):
    return spark.createDataFrame(rows, f"book_id string, section_id string, {rest}")


def test_rename(spark, tree):
    rows = book(sx.rename_sections(tree, edits_of(spark, [("b", "p1_c1", "Letter One"), ("other", "nowhere", "x")], "title string")))
    assert rows["p1_c1"].title == "Letter One" and rows["p1_c1"].text_hash == "hp1_c1"
    assert state(rows["p1_c1"]) == ("active", True, True, False, "stale") and state(rows["p1_c2"]) == ("active", True, True, True, "approved")


def test_change_content_type(spark, tree):
    edits = edits_of(spark, [("b", "p1_c3", "prologue"), ("other", "p1_c3", "nonsense")], "content_type string")
    rows = book(sx.change_content_type(tree, edits, ["prologue", "chapter"]))
    assert rows["p1_c3"].content_type == "prologue" and state(rows["p1_c3"]) == ("active", True, True, True, "stale")


def test_reorder(spark, tree):
    out = sx.reorder_sections(tree, edits_of(spark, [("b", "p1_c3", 1)], "order int"))
    rows = book(out)
    assert [rows[f"p1_c{i}"].position for i in (1, 2, 3)] == [2, 3, 1] and orders_hold(out)
    assert {state(rows[f"p1_c{i}"]) for i in (1, 2, 3)} == {("active", True, True, False, "stale")} and state(rows["p1_c1_s1"])[-1] == "approved"


def test_remove(spark, tree):
    out = sx.remove_sections(tree, spark.createDataFrame([("b", "p1_c1")], "book_id string, section_id string"))
    assert set(active(out)) == {"p1", "p1_c2", "p1_c3", "p1_c2_s1", "p1_c2_s2", "p1_c3_s1", "p1_c3_s2"} and orders_hold(out)
    assert {state(book(out)[i]) for i in ("p1_c1", "p1_c1_s1", "p1_c1_s2")} == {("deleted", False, False, False, "stale")}


def test_merge(spark, tree):
    edits = spark.createDataFrame([("b", ["p1_c1", "p1_c2"], None), ("other", ["p1_c3", "p1_c1"], "no")], "book_id string, section_ids array<string>, title string")
    out = sx.merge_sections(tree, edits)
    rows = active(out)
    new = next(r for r in rows.values() if r.title == "p1_c1 / p1_c2")
    assert new.section_id.startswith("sec_merge_v2_") and new.position == 1 and rows["p1_c3"].position == 2
    assert new.text_hash == "sha256:" + hashlib.sha256(b"hp1_c1|hp1_c2").hexdigest() and state(new) == ("active", False, False, False, "stale")
    assert sorted((r.position, r.section_id) for r in rows.values() if r.parent_id == new.section_id) == list(enumerate(["p1_c1_s1", "p1_c2_s1", "p1_c1_s2", "p1_c2_s2"], 1))
    assert orders_hold(out) and state(book(out)["p1_c1"]) == ("merged", False, False, False, "stale") and state(rows["p1_c2_s2"])[1:] == (False, False, False, "stale")


def test_split(spark, tree):
    edits = edits_of(spark, [("b", "p1_c1_s2", ["x", "y"]), ("b", "p1_c1", ["x", "y"]), ("other", "p1_c1_s1", ["only"])], "titles array<string>")
    out = sx.split_sections(tree, edits)
    rows = sorted((r for r in active(out).values() if r.parent_id == "p1_c1"), key=lambda r: r.position)
    assert [r.title for r in rows] == ["p1_c1_s1", "x", "y"] and orders_hold(out) and "p1_c1" in active(out)
    assert rows[1].section_id.startswith("sec_split_v2_") and rows[2].text_hash == "sha256:" + hashlib.sha256(b"hp1_c1_s2:y:3").hexdigest()
    assert state(book(out)["p1_c1_s2"]) == ("split", False, False, False, "stale") and state(rows[2]) == ("active", False, False, False, "stale")


def test_rollup(spark, tree):
    bad = tree.withColumn("analysis_valid", F.col("section_id") != "p1_c2_s2")
    rows = {r.section_id: r.analysis_valid for r in sx.rollup_validity(bad).collect() if r.book_id == "b"}
    assert rows["p1_c1"] and not rows["p1_c2"] and not rows["p1"]


LONG = "word " * 60


def test_parts_and_chapters(spark):
    text = f"{LONG}\nBOOK ONE\n\nCHAPTER I\n\n{LONG}a\n\nCHAPTER II. Home\n\n{LONG}b\n\nBOOK TWO the rest\n\n{LONG}c"
    parts = sg.split_parts(spark.createDataFrame([("b", text)], "book_id string, text string"))
    rows = {r.part_id: r for r in parts.collect()}
    assert list(sorted(rows)) == ["part_p0", "part_p2", "part_p3"] and rows["part_p2"].title == "BOOK ONE"
    chapters = {r.chapter_id: r for r in sg.split_chapters(parts.drop("title")).collect()}
    assert chapters["part_p2_c2"].title == "CHAPTER II. Home" and chapters["part_p2_c2"].text.endswith("b")
    assert chapters["part_p3_c1"].title == "Chapter 1"


def test_table_of_contents_and_roman(spark):
    toc = f"CHAPTER I\nx\nCHAPTER II\ny\n\nCHAPTER I\n\n{LONG}"
    rows = sg.split_chapters(spark.createDataFrame([("b", "part_p1", toc)], "book_id string, part_id string, text string")).collect()
    assert [r.chapter_id for r in rows] == ["part_p1_c1"]
    roman = "I\n\none\n\nV\n\nII\n\ntwo\n\nIII\n\nthree"
    rows = sg.split_chapters(spark.createDataFrame([("b", "part_p1", roman)], "book_id string, part_id string, text string")).collect()
    assert [(r.title, r.text) for r in rows] == [("Section I", "one\n\nV"), ("Section II", "two"), ("Section III", "three")]


def test_scenes(spark):
    paragraphs = [f"p{i}" for i in range(20)]
    marked = "\n\n".join(paragraphs) + "\n\n* *\n\nlast"
    turned = "\n\n".join(["a", "b", "Meanwhile c", *[f"d{i}" for i in range(16)]])
    df = spark.createDataFrame([("x", "c1", marked), ("y", "c1", turned), ("z", "c1", "short"), ("z", "c2", "also")], "book_id string, chapter_id string, text string")
    rows = {}
    for r in sg.split_scenes(df).collect():
        rows.setdefault((r.book_id, r.chapter_id), []).append((r.scene_id, r.boundary_source, len(r.text.split("\n\n"))))
    assert sorted(rows["x", "c1"]) == [("c1_s1", "marker_then_size_chunk", 12), ("c1_s2", "marker_then_size_chunk", 8), ("c1_s3", "explicit_marker", 1)]
    assert sorted(rows["y", "c1"]) == [("c1_s1", "transition_heuristic", 2), ("c1_s2", "transition_heuristic", 15), ("c1_s3", "transition_heuristic", 2)]
    assert rows["z", "c1"][0][1] == "whole_chapter"


def test_boundary_chunks_cover(spark):
    text = ("One two three. " * 40 + "\n\n") * 5
    rows = sg.boundary_chunks(spark.createDataFrame([(1, text), (2, None), (3, "x" * 900)], "i int, text string"), size=400, overlap=50).collect()
    for i, whole in ((1, text), (3, "x" * 900)):
        own = sorted((r.start, r.text) for r in rows if r.i == i)
        assert own[0][0] == 0 and own[-1][0] + len(own[-1][1]) == len(whole)
        assert all(a[0] < b[0] <= a[0] + len(a[1]) for a, b in zip(own, own[1:], strict=False))


def test_min_gap(spark):
    df = spark.createDataFrame([("k", p) for p in [1, 3, 8, 9, 13]], "key string, at long")
    assert sorted(r.at for r in sg.min_gap_rows(df, "key", "at", 5).collect()) == [1, 8, 13]


def test_html(spark):
    page = "<html><head><title>no</title></head><body><h1>Top <b>x</b></h1><p>One&amp;two<script>no</script></p><div>three</div><h2>next</h2></body></html>"
    r = sg.html_to_text(spark.createDataFrame([(page,)], "h string"), "h").first()
    assert r.heading == "Top x" and r.text == "One&two\n\nthree\n\nnext" and not r.is_nav


def test_music(spark):
    e = [("s", 1.0, "change", "a"), ("s", 1.5, "change", "b"), ("s", 4.0, "stop", None), ("s", 6.0, "resume", "c")]
    df = spark.createDataFrame([(*x, 9.0) for x in e], "s string, t double, action string, style string, total double")
    rows = sorted((r.start, r.end, r.style) for r in pr.music_segments(df, "s", F.col("total")).collect())
    assert rows == [(1.0, 4.0, "b"), (6.0, 9.0, "c")]


def test_rule_ladder(spark):
    rows = [(0, 0, "dialogue", "Hi"), (0, 1, "narrative", "said Ann today"), (1, 0, "dialogue", "Yes"), (2, 0, "dialogue", "No"), (3, 0, "dialogue", "So"), (3, 1, "narrative", "Bob looked up"), (4, 0, "dialogue", "Eh")]
    segments = spark.createDataFrame([("b", 1, *r) for r in rows], "book_id string, scene long, par int, seg int, segment_type string, text string")
    roster = spark.createDataFrame([("b", "Ann"), ("b", "Bob")], "book_id string, name string")
    got = {(r.par, r.seg): (r.character, r.attribution_method) for r in at.rule_ladder(segments, roster).collect()}
    assert got[0, 0] == ("Ann", "Direct Speech Verb (After)") and got[1, 0][1] == got[2, 0][1] == "Speaker Lock Override"
    assert got[3, 0] == ("Bob", "Context Alias Mention") and got[4, 0] == ("Bob", "Context Alias Mention")
    assert got[0, 1][0] == "Narrator"
    more = [(0, 0, "narrative", "Mr. Fox replied then"), (0, 1, "dialogue", "Hi"), (0, 2, "narrative", "said, and Ann ran"), (1, 0, "narrative", "Night."), (2, 0, "dialogue", "So"), (3, 0, "narrative", "Ann says"), (3, 1, "dialogue", "No"), (3, 2, "narrative", "Mr Fox told her")]
    segments = spark.createDataFrame([("b", 1, *r) for r in more], segments.schema)
    roster = spark.createDataFrame([("b", "Ann"), ("b", "Mr Fox")], "book_id string, name string")
    got = {(r.par, r.seg): (r.character, r.attribution_method) for r in at.rule_ladder(segments, roster).collect()}
    assert got[0, 1] == ("Mr Fox", "Direct Speech Verb (Before)") and got[3, 1] == ("Mr Fox", "Direct Speech Verb (After)")
    assert got[2, 0] == ("Mr Fox", "Auto-Attributed (Single Active)")  # the paragraph of narration ended the lock
    assert at.rule_ladder(segments.limit(0), roster).count() == 0


def test_ladder_aliases(spark):
    """The longest name that stands anywhere comes first; a title with another dot is found as an entity."""
    rows = [(0, 0, "dialogue", "Hi"), (0, 1, "narrative", "the Annabels and ann"), (1, 0, "dialogue", "Yes"), (1, 1, "narrative", "Mrs. Fox was there")]
    segments = spark.createDataFrame([("b", 1, *r) for r in rows], "book_id string, scene long, par int, seg int, segment_type string, text string")
    roster = spark.createDataFrame([("b", "Ann"), ("b", "Annabel"), ("b", "Mrs Fox")], "book_id string, name string")
    got = {(r.par, r.seg): (r.character, r.attribution_method) for r in at.rule_ladder(segments, roster).collect()}
    assert got[0, 0] == ("Annabel", "Context Alias Mention") and got[1, 0] == ("Mrs Fox", "Context Entity Mention")


def test_route_confidence(spark):
    rng, names = random.Random(8), ["Ann", "Ann Lee", "Ümit", "Bo", "İz", "x.y", ""]
    bits = [*names, "said", "ASKED", "whispered", "saidx", " ", "  ", "\n", ",", "annex", "ümit", "he"]
    rows = [(f"l{i}", "s", rng.choice(["dialogue", "narrative"]), rng.choice(["", " "]).join(rng.choice(bits) for _ in range(rng.randrange(9)))) for i in range(600)]
    rows += [("null", "s", "dialogue", None), ("none", "t", "dialogue", "Ann said"), ("kind", "s", None, "Ann said")]
    lines = spark.createDataFrame(rows, "line_id string, scene_id string, segment_type string, text string")
    active = spark.createDataFrame([("s", n) for n in [*names, None, "Ann"]], "scene_id string, name string")
    verbs = "(?:said|asked|replied|shouted|whispered)"

    def want(scene, kind, text):
        if kind != "dialogue":
            return "Narrator", 1.0
        cast = sorted(n for n in names if n) if scene == "s" and text else []
        for n in cast:
            if re.search(rf"\b{verbs}\s+{re.escape(n)}\b|{re.escape(n)}\s+{verbs}\b", text, re.I):
                return n, 0.95
        found = [n for n in cast if re.search(rf"\b{re.escape(n)}\b", text, re.I)]
        return (found[0], 0.7) if len(found) == 1 else ("Narrator", 0.5)

    got = {r.line_id: r for r in at.route_confidence(lines, active).collect()}
    for key, scene, kind, text in rows:
        assert (got[key].speaker, got[key].confidence) == want(scene, kind, text), text
        assert got[key].queued == (got[key].confidence < 0.85)
    assert at.route_confidence(lines.limit(0), active).count() == 0


def test_names(spark):
    text = "His mother met Anna in Rome. Anna said Chapter Two. Mr. Fox and  Mr.  Fox saw King of Spain, the Mc Donald-Smith Old House. Well, Rome"
    got = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(at.name_candidates(F.col("t")).alias("c")).collect()
    assert got[1].c == got[2].c == []
    found = [(c["name"], c.honorific, c.mid) for c in got[0].c]
    assert found.count(("Mr. Fox", True, False)) == 2 and ("King of Spain", True, False) in found
    assert ("Anna", False, True) in found and ("Anna", False, False) in found and ("Rome", False, True) in found
    assert not any(n.split()[0] in ("His", "Chapter", "Well", "Mr") for n, h, _ in found if not h)


def test_merges_and_names(spark):
    names = spark.createDataFrame([("b", n) for n in ("Mr. McGregor", "Mrs. McGregor", "McGregor", "Peter Rabbit", "Peter Rabit", "Peter", "Benjamin", "Bunny")], "book_id string, name string")
    known = spark.createDataFrame([("b", "Peter", "Peter Rabbit", False, 0.4), ("b", "Bunny", "Benjamin", True, 0.9)], "book_id string, original string, canonical string, yes boolean, confidence double")
    got = {(r.original, r.canonical, r.status) for r in at.consolidate_characters(names, known).collect()}
    assert got == {("Peter", "Peter Rabbit", "rejected"), ("Bunny", "Benjamin", "confirmed"), ("Peter Rabit", "Peter Rabbit", "pending")}
    rounds = [("s", 1, 1, "Ann", 3, "gasp", "Oh!"), ("s", 1, 2, "Ann", 4, "gasp", "oh"), ("s", 2, 1, "ann", 3, "gasp", "New"), ("s", 2, 2, "Ann", 9, "sigh", "New"), ("t", 1, 1, "Ann", 3, "gasp", "Oh!")]
    inserts = spark.createDataFrame(rounds, "scene_id string, round int, n int, character string, anchor int, kind string, text string")
    kept = at.merge_rounds(inserts, ["scene_id"])
    assert kept.columns == inserts.columns and sorted((r.scene_id, r.round, r.n) for r in kept.collect()) == [("s", 1, 1), ("s", 2, 2), ("t", 1, 1)]


def test_ladder_aliases(spark):
    """The longest name that stands anywhere comes first; a title with another dot is found as an entity."""
    rows = [(0, 0, "dialogue", "Hi"), (0, 1, "narrative", "the Annabels and ann"), (1, 0, "dialogue", "Yes"), (1, 1, "narrative", "Mrs. Fox was there")]
    segments = spark.createDataFrame([("b", 1, *r) for r in rows], "book_id string, scene long, par int, seg int, segment_type string, text string")
    roster = spark.createDataFrame([("b", "Ann"), ("b", "Annabel"), ("b", "Mrs Fox")], "book_id string, name string")
    got = {(r.par, r.seg): (r.character, r.attribution_method) for r in at.rule_ladder(segments, roster).collect()}
    assert got[0, 0] == ("Annabel", "Context Alias Mention") and got[1, 0] == ("Mrs Fox", "Context Entity Mention")


def test_route_confidence(spark):
    rng, names = random.Random(8), ["Ann", "Ann Lee", "Ümit", "Bo", "İz", "x.y", ""]
    bits = [*names, "said", "ASKED", "whispered", "saidx", " ", "  ", "\n", ",", "annex", "ümit", "he"]
    rows = [(f"l{i}", "s", rng.choice(["dialogue", "narrative"]), rng.choice(["", " "]).join(rng.choice(bits) for _ in range(rng.randrange(9)))) for i in range(600)]
    rows += [("null", "s", "dialogue", None), ("none", "t", "dialogue", "Ann said"), ("kind", "s", None, "Ann said")]
    lines = spark.createDataFrame(rows, "line_id string, scene_id string, segment_type string, text string")
    active = spark.createDataFrame([("s", n) for n in [*names, None, "Ann"]], "scene_id string, name string")
    verbs = "(?:said|asked|replied|shouted|whispered)"

    def want(scene, kind, text):
        if kind != "dialogue":
            return "Narrator", 1.0
        cast = sorted(n for n in names if n) if scene == "s" and text else []
        for n in cast:
            if re.search(rf"\b{verbs}\s+{re.escape(n)}\b|{re.escape(n)}\s+{verbs}\b", text, re.I):
                return n, 0.95
        found = [n for n in cast if re.search(rf"\b{re.escape(n)}\b", text, re.I)]
        return (found[0], 0.7) if len(found) == 1 else ("Narrator", 0.5)

    got = {r.line_id: r for r in at.route_confidence(lines, active).collect()}
    for key, scene, kind, text in rows:
        assert (got[key].speaker, got[key].confidence) == want(scene, kind, text), text
        assert got[key].queued == (got[key].confidence < 0.85)
    assert at.route_confidence(lines.limit(0), active).count() == 0


def test_names(spark):
    text = "Mr. Fox met Ann Lee. Then Ann Lee saw Mr. Fox near Paris. However he left. However it rained in Paris."
    got = {r.name for r in at.global_roster(spark.createDataFrame([("b", text)], "book_id string, text string")).collect()}
    assert "Mr. Fox" in got and "Paris" in got and "However" not in got


def test_word_errors(spark):
    r = at.word_errors(spark.createDataFrame([("a b c d", "a x c")], "reference string, hypothesis string")).first()
    assert (r.errors, r.words, r.wer) == (2, 4, 0.5)


def docx(paragraphs):
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def epub(chapters):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        items = "".join(f'<item id="i{n}" href="{name}" media-type="application/xhtml+xml"/>' for n, (name, _) in enumerate(chapters))
        refs = "".join(f'<itemref idref="i{n}"/>' for n in range(len(chapters)))
        z.writestr("o/p.opf", f'<package xmlns="http://www.idpf.org/2007/opf"><manifest>{items}</manifest><spine>{refs}</spine></package>')
        for name, html in chapters:
            z.writestr(f"o/{name}", html)
    return out.getvalue()


def test_readers(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.txt").write_text("text é")
    (tmp_path / "a" / "two.txt").write_text(" \n")
    (tmp_path / "three.docx").write_bytes(docx(["p one", "", "p two"]))
    body = "<p>" + "word " * 100 + "</p>"
    (tmp_path / "four.epub").write_bytes(epub([("cover.xhtml", body), ("x1.xhtml", f"<h1>First</h1>{body}"), ("x2.xhtml", f"<h1>CHAPTER 9</h1>{body}"), ("x3.xhtml", "<p>short</p>")]))
    texts = {r.book_id: r for r in fl.read_text_corpus(spark, str(tmp_path)).collect()}
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "one.txt").write_bytes(b"line\nother \xff")
    (tmp_path / "bad.epub").write_bytes(b"nothing")
    again = {r.book_id: r.text for r in fl.read_text_corpus(spark, str(tmp_path)).collect()}
    assert again["sub/one"] == "line\nother \ufffd" and again["a/one"] == "text é"
    books = {r.book_id: r.status for r in fl.read_epub_corpus(spark, str(tmp_path)).collect()}
    assert books == {"four": "ok", "bad": "broken"}
    (tmp_path / "bad.epub").unlink()
    (tmp_path / "sub" / "one.txt").unlink()
    assert texts["a/one"].text == "text é" and texts["a/two"].status == "skipped_empty"
    assert fl.read_docx_corpus(spark, str(tmp_path)).first().text == "p one\n\np two"
    text = fl.read_epub_corpus(spark, str(tmp_path)).first().text
    assert text.startswith("CHAPTER 1. First\n\nword") and "CHAPTER 9\n\n" in text and "short" not in text
    assert fl.provenance_hashes(spark, str(tmp_path)).count() == 4


def test_uploads(spark):
    body = "<p>" + "word " * 100 + "</p>"
    rows = [
        ("a.txt", b"ok", None), ("b.txt", b"PK\x03\x04", "SPOOFED_EXTENSION"), ("c.txt", b"\xff\xfe\xff", "TEXT_DECODE_FAILED"), ("d.pdf", b"x", "UNSUPPORTED_FORMAT"),
        ("e.docx", docx(["x"]), None), ("f.docx", b"nope", "INVALID_DOCX"), ("g.epub", epub([("x.xhtml", body)]), None), ("h.epub", epub([]), "EMPTY_EPUB"),
        ("l.txt", b" \n\t ", "MISSING_FILE"), ("m.txt", b"\x01\x02" * 20 + b"abc", "SPOOFED_EXTENSION"), ("n.epub", epub([("cover.xhtml", body)]), "EMPTY_EPUB"),
        ("o.epub", epub([("x.xhtml", "<p>too short</p>")]), "EMPTY_EPUB"), ("p.TXT", b"ok", None), ("", b"x", "MISSING_FILE"), ("q.docx", epub([]), "INVALID_DOCX"),
        ("i.epub", b"nope", "INVALID_EPUB"), ("j.txt", None, "MISSING_FILE"), ("k.txt", b"x" * 200, "FILE_TOO_LARGE"),
    ]
    uploads = spark.createDataFrame([(n, c) for n, c, _ in rows], "filename string, content binary")
    got = {r.filename: r.error_code for r in fl.validate_uploads(uploads.where("filename != 'k.txt'")).collect()}
    got |= {r.filename: r.error_code for r in fl.validate_uploads(uploads.where("filename = 'k.txt'"), most_bytes=100).collect()}
    assert got == {n: e for n, _, e in rows}


def test_audit_log(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"timestamp": 1.5, "provider": "a", "success": true}\nnot json\n{"timestamp": 2, "provider": "b", "book": "x"}\n')
    rows = fl.read_audit_log(spark, str(tmp_path / "log.jsonl")).orderBy("timestamp").collect()
    assert [(r.provider, r.book) for r in rows] == [("a", None), ("b", "x")]


def test_writers(spark, tmp_path):
    lines = spark.createDataFrame([("b", 1, 1, 1, "l1", "N", "narrative", "x"), ("b", 1, 2, 1, "l2", "N", "narrative", "y")], "book_id string, chapter int, scene int, line_number int, line_id string, character string, segment_type string, text string")
    fl.write_manifest_json(lines, str(tmp_path / "m"))
    m = spark.read.json(str(tmp_path / "m")).first()
    assert m.totals.scenes == 2 and m.chapters[0].scenes[1].lines[0].text == "y"
    fl.write_results_csv(spark.createDataFrame([(1, [1, 2], float("nan"))], "a int, b array<int>, c double"), str(tmp_path / "c"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).first().b == "[1,2]"
    clips = spark.createDataFrame([("i", "hi", "Joy", 1.234, 20.55, "PASS")], "id string, transcript string, emotion string, duration_s double, snr_db double, verdict string")
    fl.write_clip_manifest(clips, str(tmp_path / "k"))
    assert spark.read.text(str(tmp_path / "k")).first().value.startswith("i|hi|Joy|1.23|20.")


def test_foley_finds_every_action(spark):
    from sparkbooks.operators.attribution import FOLEY, spot_foley

    story = """He opened the door. The door was slammed. She tapped on the door. The bell rang. He entered. She left the room. He paced. He sat down.
        She stood up. They climbed the stairs. He lit his pipe. She poured the tea. He unfolded the letter. The carriage drew up. The window was shut. The fire blazed."""
    sentences = " ".join(story.split()).split(". ")
    lines = [(i, 1, "narrative", t.strip().rstrip(".") + ".") for i, t in enumerate(sentences)] + [(99, 1, "narrative", "The door opened. He closed the door.")]
    found = spot_foley(spark.createDataFrame(lines, "scene_id int, line_number int, segment_type string, text string")).collect()
    assert len(FOLEY) == 16 and sorted((r.scene_id, r.suggestion) for r in found) == [(i, idea) for i, (_, idea) in enumerate(FOLEY)] + [(99, FOLEY[0][1])]
    assert [r.sentence for r in found if r.scene_id == 99] == ["He closed the door."]


def test_deep_trees(spark):
    """Five levels, with an inactive branch, two roots and equal positions."""
    rows = [("a", None, 2), ("b", None, 1), ("a1", "a", 1), ("a2", "a", 1), ("a1x", "a1", 5), ("a1y", "a1", 3), ("deep", "a1x", 1), ("leaf", "deep", 9), ("off", "a", 0), ("under", "off", 1), ("b1", "b", 7)]
    kinds = {"leaf": "scene", "under": "scene", "b1": "scene"}
    sections = spark.createDataFrame(
        [("k", i, p, kinds.get(i, "chapter"), n, i.upper(), "chapter", "h", "deleted" if i == "off" else "active", True, True, True, "approved", 3) for i, p, n in rows],
        "book_id string, section_id string, parent_id string, kind string, position long, title string, content_type string, text_hash string, status string, analysis_valid boolean, audio_valid boolean, render_valid boolean, approval string, structure_version int",
    )
    got = {r.section_id: (r.depth, r.number, r.title) for r in sx.outline_rows(sections).collect()}
    assert got == {
        "b": (1, "1", "B"), "b1": (2, "1.1", "B1"), "a": (1, "2", "A"), "a1": (2, "2.1", "A1"), "a2": (2, "2.2", "A2"), "a1y": (3, "2.1.1", "A1Y"),
        "a1x": (3, "2.1.2", "A1X"), "deep": (4, "2.1.2.1", "DEEP"), "leaf": (5, "2.1.2.1.1", "LEAF"),
    }
    assert sorted((r.place, r.section_id) for r in sx.canonical_order(sections).collect()) == [(1, "b1"), (2, "leaf")]
    named = spark.createDataFrame([("k", "a"), ("k", "a1"), ("k", "nothing")], "book_id string, section_id string")
    found = {(r.top, r.section_id): r.depth for r in sx.below(sections, named).collect()}
    assert found == {
        ("a", "a1"): 1, ("a", "a2"): 1, ("a", "off"): 1, ("a", "a1x"): 2, ("a", "a1y"): 2, ("a", "under"): 2, ("a", "deep"): 3, ("a", "leaf"): 4,
        ("a1", "a1x"): 1, ("a1", "a1y"): 1, ("a1", "deep"): 2, ("a1", "leaf"): 3,
    }
    gone = {r.section_id for r in sx.remove_sections(sections, named).collect() if r.status == "deleted"}
    assert gone == {"a", "a1", "a2", "off", "a1x", "a1y", "under", "deep", "leaf"}
    merged = {r.section_id: r for r in sx.merge_sections(sections, spark.createDataFrame([("k", ["a1", "a2"], None)], "book_id string, section_ids array<string>, title string")).collect()}
    (new,) = [r for k, r in merged.items() if k.startswith("sec_merge_v4")]
    assert new.title == "A1 / A2" and {k for k, r in merged.items() if r.parent_id == new.section_id} == {"a1x", "a1y"}
    assert {k for k, r in merged.items() if not r.analysis_valid} == {new.section_id, "a1", "a2", "a1x", "a1y", "deep", "leaf"} and {r.structure_version for r in merged.values()} == {4}


def test_latest_stream(spark, tmp_path):
    """A restart goes on from the checkpoint: rows that are older than what the state holds change nothing; batches of one file each."""
    from sparkbooks.streaming import usage as us

    rng, seen = random.Random(2), {}
    schema = "k string, j int, at int, v string, note string"
    stream = us.replay(spark, str(tmp_path / "in" / "*"), schema, maxFilesPerTrigger="1")
    for part in range(2):
        for n in range(3):
            rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2]), rng.choice([None, *range(30)]), f"{part}{n}{i}", None) for i in range(5)]
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}n{n}"))
            for k, j, at_, v, _ in rows:
                if (k, j) not in seen or (at_ if at_ is not None else -1) > seen[k, j]:
                    seen[k, j] = at_ if at_ is not None else -1
        got = us.run_latest(stream, str(tmp_path / "out"), ["k", "j"], ["at"]).collect()
        assert {(r.k, r.j): r.at if r.at is not None else -1 for r in got} == seen and len(got) == len(seen)
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    # nothing new: nothing is written
    batches = len(list((tmp_path / "out" / "rows").iterdir()))
    us.run_latest(stream, str(tmp_path / "out"), ["k", "j"], ["at"])
    assert len(list((tmp_path / "out" / "rows").iterdir())) == batches


def test_usage_closes_windows(spark, tmp_path):
    """Rows behind the watermark are left out and counted; a window appears once it is closed, and only once."""
    from sparkbooks.streaming import usage as us

    schema = "ts timestamp, provider string, task string, success boolean, latency_ms double"
    parts = [["10:05", "10:40", "11:20"], ["10:50", "11:30"], ["12:30", "13:15"]]
    stream, rows, late = us.replay(spark, str(tmp_path / "in" / "*"), schema), [], []
    for n, times in enumerate(parts):
        frame = spark.createDataFrame([(f"2024-01-01 {t}:00", "local", "x", True, 1.0) for t in times], "ts string, provider string, task string, success boolean, latency_ms double")
        frame.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in" / f"n{n}"))
        closed, dropped = us.run_closed(us.usage_stream(stream), str(tmp_path / "out"))
        rows.append(sorted((r.start.hour, r.calls) for r in closed.collect()))
        late.append(dropped)
    # 10:50 came after 11:20 had closed the hour from 10
    assert rows == [[(10, 2)], [(10, 2)], [(10, 2), (11, 2), (12, 1)]] and late == [0, 1, 0]
