"""Queries of section trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkbooks.operators import catalog as ct
from sparkbooks.operators import structure as sx
from sparkbooks.plans.registry import query

_ORDERED = """o AS (SELECT * REPLACE (CASE WHEN status = 'active' THEN row_number() OVER (PARTITION BY book_id, parent_id, status = 'active' ORDER BY position, section_id) ELSE position END AS position) FROM sections)"""
COLUMNS = "section_id, parent_id, position, title, content_type, text_hash, status, analysis_valid, audio_valid, render_valid, approval, structure_version"


def changed(table: str, **to: str) -> str:
    """SQL for all columns of a table of sections, some of them by another expression."""
    return f"SELECT {', '.join(f'{to[c]} AS {c}' if c in to else c for c in COLUMNS.split(', '))} FROM {table}"


def invalid(hit: str) -> dict[str, str]:
    """What becomes of a section's validity and approval where `hit` holds."""
    return {f"{x}_valid": f"{x}_valid AND NOT ({hit})" for x in ("analysis", "audio", "render")} | {"approval": f"CASE WHEN {hit} THEN 'stale' ELSE approval END"}


def version(hit: str) -> str:
    """The version of a book, one more if it has a section where `hit` holds."""
    return f"structure_version + coalesce(max(CASE WHEN {hit} THEN 1 END) OVER (PARTITION BY book_id), 0)"


def renumbered(parents: str) -> str:
    """The position of active children of the parents that SQL lists."""
    return f"CASE WHEN status = 'active' AND parent_id IN ({parents}) THEN row_number() OVER (PARTITION BY book_id, parent_id, status = 'active' ORDER BY position, section_id) ELSE position END"


def shown(sections: DataFrame) -> DataFrame:
    return sections.select(*COLUMNS.split(", "))


@query("W9_normalize_sibling_order", "sections", sql=f"WITH {_ORDERED} SELECT {COLUMNS} FROM o")
def w9(sections: DataFrame) -> DataFrame:
    return shown(sx.normalize_sibling_order(sections))


@query(
    "K5_canonical_scene_order", "sections",
    sql="""SELECT s.section_id, row_number() OVER (PARTITION BY s.book_id ORDER BY p.position, p.section_id, c.position, c.section_id, s.position, s.section_id)::INTEGER AS place
           FROM sections s JOIN sections c ON s.parent_id = c.section_id JOIN sections p ON c.parent_id = p.section_id WHERE s.status = 'active' AND c.status = 'active' AND p.status = 'active'""",
)
def k5(sections: DataFrame) -> DataFrame:
    return sx.canonical_order(sections).select("section_id", "place")


@query("E1_sections_from_scenes", "scenes", "lines", sql="""
SELECT 'sec_' || scene_id AS section_id, 'sec_' || regexp_extract(scene_id, '^(.*)_s[^_]*$', 1) AS parent_id, row_number() OVER (PARTITION BY book_id, chapter ORDER BY scene)::INTEGER AS position,
  'Scene ' || row_number() OVER (PARTITION BY book_id, chapter ORDER BY scene) AS title, 'sha256:' || sha256(t) AS text_hash
FROM scenes JOIN (SELECT scene_id, string_agg(text, chr(10) || chr(10) ORDER BY line_number) AS t FROM lines GROUP BY scene_id) USING (scene_id)""")
def e1(scenes: DataFrame, lines: DataFrame) -> DataFrame:
    """Sections for scenes: ids and parents from the scene's id, order in the chapter, and the hash of the text."""
    return ct.sections_from_scenes(scenes, lines).drop("book_id")


_E2 = "kind = 'chapter' AND structure_version = 1"


@query("E2_rename_section", "sections", sql=changed("sections", title=f"CASE WHEN {_E2} THEN lower(title) ELSE title END", render_valid=f"render_valid AND NOT ({_E2})", approval=f"CASE WHEN {_E2} THEN 'stale' ELSE approval END", structure_version=version(_E2)))
def e2(sections: DataFrame) -> DataFrame:
    """The chapters of some books; an edit of a section that is not there makes no new version."""
    edits = sections.where(_E2).select("book_id", "section_id", F.lower("title").alias("title"))
    nowhere = sections.where("kind = 'part'").select("book_id", F.concat("section_id", F.lit("x")).alias("section_id"), "title")
    return shown(sx.rename_sections(sections, edits.unionByName(nowhere)))


_E3 = "kind = 'scene' AND position % 40 = 4"


@query("E3_change_content_type", "sections", sql=changed("sections", content_type=f"CASE WHEN {_E3} THEN 'epilogue' ELSE content_type END", approval=f"CASE WHEN {_E3} THEN 'stale' ELSE approval END", structure_version=version(_E3)))
def e3(sections: DataFrame) -> DataFrame:
    """Some scenes become epilogues; the edits with an unknown type do nothing."""
    edits = sections.where("kind = 'scene' AND position % 20 = 4").select("book_id", "section_id", F.when(F.expr(_E3), "epilogue").otherwise("nonsense").alias("content_type"))
    return shown(sx.change_content_type(sections, edits, ["chapter", "epilogue"]))


@query("E4_reorder_section", "sections", sql=f"""
WITH n AS (SELECT *, count(*) FILTER (status = 'active') OVER (PARTITION BY book_id, parent_id) AS n, row_number() OVER (PARTITION BY book_id, parent_id, status = 'active' ORDER BY position, section_id) AS rn FROM sections),
m AS (SELECT *, kind = 'scene' AND rn = 1 AND status = 'active' AND n > 1 AND structure_version < 3 AS moved FROM n),
g AS (SELECT *, status = 'active' AND bool_or(moved) OVER (PARTITION BY book_id, parent_id) AS touched FROM m)
{changed("g", position="CASE WHEN touched THEN CASE WHEN moved THEN n ELSE rn - 1 END ELSE position END", render_valid="render_valid AND NOT touched", approval="CASE WHEN touched THEN 'stale' ELSE approval END", structure_version=version("moved"))}""")
def e4(sections: DataFrame) -> DataFrame:
    """The first scene of each chapter of some books goes to the end."""
    from pyspark.sql import Window

    ordered = sx.normalize_sibling_order(sections)
    n = F.sum((F.col("status") == "active").cast("long")).over(Window.partitionBy("book_id", "parent_id"))
    first = ordered.withColumn("n", n).where("kind = 'scene' AND status = 'active' AND position = 1 AND n > 1 AND structure_version < 3")
    return shown(sx.reorder_sections(sections, first.select("book_id", "section_id", F.lit(1_000_000).alias("order"))))


_E5 = "kind = 'chapter' AND section_id LIKE '%3'"


@query("E5_remove_section", "sections", sql=f"""
WITH named AS (SELECT section_id, parent_id FROM sections WHERE {_E5}),
g AS (SELECT *, section_id IN (SELECT section_id FROM named) OR coalesce(parent_id IN (SELECT section_id FROM named), FALSE) AS gone FROM sections),
d AS (SELECT * REPLACE (CASE WHEN gone THEN 'deleted' ELSE status END AS status) FROM g)
{changed("d", position=renumbered("SELECT parent_id FROM named"), structure_version=version(_E5), **invalid("gone"))}""")
def e5(sections: DataFrame) -> DataFrame:
    return shown(sx.remove_sections(sections, sections.where(_E5).select("book_id", "section_id")))


@query("E6_merge_sections", "sections", sql=f"""
WITH o AS (SELECT *, row_number() OVER (PARTITION BY book_id, parent_id ORDER BY position, section_id) AS rn FROM sections WHERE kind = 'chapter' AND status = 'active'),
e AS (SELECT book_id, parent_id, structure_version, list(section_id ORDER BY rn) AS ids, string_agg(title, ' / ' ORDER BY rn) AS titles, string_agg(text_hash, '|' ORDER BY rn) AS hashes, min(position) AS position
      FROM o WHERE rn <= 2 GROUP BY ALL HAVING count(*) = 2),
n AS (SELECT *, 'sec_merge_v' || (structure_version + 1) || '_' || sha1(array_to_string(ids, '|'))[1:12] AS new_id FROM e), s AS (SELECT new_id, unnest(ids) AS section_id FROM n),
d AS (SELECT x.* REPLACE (coalesce(p.new_id, x.parent_id) AS parent_id, CASE WHEN s.new_id IS NULL THEN status ELSE 'merged' END AS status,
               CASE WHEN p.new_id IS NULL THEN position ELSE row_number() OVER (PARTITION BY p.new_id ORDER BY position, x.section_id) END AS position),
             s.new_id IS NOT NULL OR p.new_id IS NOT NULL AS hit
      FROM sections x LEFT JOIN s ON x.section_id = s.section_id LEFT JOIN s p ON x.parent_id = p.section_id),
u AS (SELECT * FROM d UNION ALL BY NAME
      SELECT new_id AS section_id, parent_id, book_id, 'chapter' AS kind, position, CASE WHEN structure_version = 2 THEN titles ELSE 'joined' END AS title, 'chapter' AS content_type,
             'sha256:' || sha256(hashes) AS text_hash, 'active' AS status, FALSE AS analysis_valid, FALSE AS audio_valid, FALSE AS render_valid, 'stale' AS approval, structure_version, TRUE AS hit FROM n)
{changed("u", position=renumbered("SELECT parent_id FROM n"), structure_version=version("hit"), **invalid("hit"))}""")
def e6(sections: DataFrame) -> DataFrame:
    """The first two chapters of each part become one, in some books without a title of its own; a merge of chapters that do not stand together does nothing."""
    ordered = sx.normalize_sibling_order(sections).where("kind = 'chapter' AND status = 'active'")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("position", "section_id"))), lambda x: x.section_id)
    pairs = [ordered.where(F.col("position").isin(*p)).groupBy("book_id", "parent_id", "structure_version").agg(ids.alias("section_ids")).where(F.size("section_ids") == 2) for p in ((1, 2), (3, 5))]
    title = F.when(F.col("structure_version") != 2, "joined")
    return shown(sx.merge_sections(sections, pairs[0].unionByName(pairs[1]).select("book_id", "section_ids", title.alias("title"))))


_E7 = "kind = 'scene' AND status = 'active' AND position % 32 = 1"


@query("E7_split_section", "sections", sql=f"""
WITH e AS (SELECT * FROM sections WHERE {_E7}),
d AS (SELECT *, coalesce({_E7}, FALSE) AS hit FROM sections),
u AS (SELECT * REPLACE (CASE WHEN hit THEN 'split' ELSE status END AS status) FROM d UNION ALL BY NAME
      SELECT e.* REPLACE ('sec_split_v' || (structure_version + 1) || '_' || sha1(section_id || '|' || (position + i) || '|' || t)[1:12] AS section_id, t AS title, position + i AS position,
                          'sha256:' || sha256(text_hash || ':' || t || ':' || (position + i)) AS text_hash), TRUE AS hit FROM e, (VALUES (0, 'first'), (1, 'second')) v(i, t))
{changed("u", position=renumbered("SELECT parent_id FROM e"), structure_version=version("hit"), **invalid("hit"))}""")
def e7(sections: DataFrame) -> DataFrame:
    """Some scenes become two; edits of sections with children do nothing."""
    edits = sections.where(f"({_E7}) OR kind = 'part'").select("book_id", "section_id", F.array(F.lit("first"), F.lit("second")).alias("titles"))
    return shown(sx.split_sections(sections, edits))


@query("E8_outline_rows", "sections", sql="""
WITH RECURSIVE a AS (SELECT *, row_number() OVER (PARTITION BY book_id, parent_id ORDER BY position, section_id) AS n FROM sections WHERE status = 'active'),
t AS (SELECT book_id, section_id, 1 AS depth, n::VARCHAR AS number, title FROM a WHERE parent_id IS NULL
      UNION ALL SELECT a.book_id, a.section_id, depth + 1, number || '.' || n, a.title FROM t JOIN a ON a.book_id = t.book_id AND a.parent_id = t.section_id)
SELECT * FROM t""")
def e8_rows(sections: DataFrame) -> DataFrame:
    return sx.outline_rows(sections)


@query("E8_outline", "sections", sql="""
WITH a AS (SELECT * FROM sections WHERE status = 'active')
SELECT p.book_id, p.section_id AS part, c.section_id AS chapter, s.section_id AS scene,
       CASE WHEN s.section_id IS NOT NULL THEN row_number() OVER (PARTITION BY c.section_id ORDER BY s.position, s.section_id) END::INTEGER AS place
FROM a p LEFT JOIN a c ON c.parent_id = p.section_id AND c.kind = 'chapter' LEFT JOIN a s ON s.parent_id = c.section_id WHERE p.kind = 'part'""")
def e8(sections: DataFrame) -> DataFrame:
    """The nested outlines, unfolded again to rows."""
    parts = sx.outline(sections).select("book_id", F.explode("parts").alias("p"))
    chapters = parts.select("book_id", F.col("p.section_id").alias("part"), F.explode_outer("p.chapters").alias("c"))
    scenes = chapters.select("book_id", "part", F.col("c.section_id").alias("chapter"), F.posexplode_outer("c.scenes").alias("at", "s"))
    return scenes.select("book_id", "part", "chapter", F.col("s.section_id").alias("scene"), (F.col("at") + 1).alias("place"))


@query("E9_scene_text_of", "lines", "scenes", sql="""
SELECT chapter, string_agg(t, chr(10) || chr(10) ORDER BY scene) AS text FROM (SELECT chapter, scene, string_agg(text, ' ' ORDER BY line_number) AS t FROM lines GROUP BY ALL) GROUP BY chapter""")
def e9(lines: DataFrame, scenes: DataFrame) -> DataFrame:
    """The text of sections made from others, every chapter from its scenes: the sources' texts in order, a blank line between."""
    own = lines.groupBy(F.col("scene_id").alias("section_id")).agg(ct.ordered_text("line_number", "text", " ").alias("text"))
    sources = F.transform(F.array_sort(F.collect_list(F.struct("scene", "scene_id"))), lambda x: x.scene_id)
    made = scenes.groupBy(F.col("chapter").cast("string").alias("section_id")).agg(sources.alias("source_section_ids")).withColumn("text", F.lit(None).cast("string"))
    return ct.scene_text_of(made, own).select(F.col("section_id").cast("long").alias("chapter"), "text")


@query("E11_merge_scene_lines", "lines", sql="SELECT line_id, scene - scene % 2 AS scene, row_number() OVER (PARTITION BY book_id, scene - scene % 2 ORDER BY scene, line_number)::INTEGER AS line_number FROM lines")
def e11(lines: DataFrame) -> DataFrame:
    """Each odd scene's lines move to the end of the scene before it."""
    moves = lines.where("scene % 2 = 1").select("book_id", "scene", (F.col("scene") - 1).alias("into")).distinct()
    return ct.merge_scene_lines(lines.select("book_id", "line_id", "scene", "line_number"), moves).select("line_id", "scene", "line_number")


@query("E11_split_scene_lines", "lines", sql="""
WITH s AS (SELECT *, CASE WHEN scene % 3 = 0 AND line_number >= 3 THEN scene_id || '_' || sha1(scene_id || '|' || first_value(line_id) OVER (PARTITION BY scene_id, line_number >= 3 ORDER BY line_number))[1:8] ELSE scene_id END AS new_id FROM lines)
SELECT line_id, new_id AS scene_id, row_number() OVER (PARTITION BY book_id, new_id ORDER BY line_number)::INTEGER AS line_number FROM s""")
def e11b(lines: DataFrame) -> DataFrame:
    """Every third scene is cut before its third line; a cut before the first line does nothing."""
    cuts = lines.where("(scene % 3 = 0 AND line_number = 3) OR (scene % 3 = 1 AND line_number = 1)")
    return ct.split_scene_lines(lines, cuts).select("line_id", "scene_id", "line_number")


@query("E13_upsert_by_key", "customer", "orders", sql="""
WITH c AS (SELECT o_custkey AS k, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY 1)
SELECT c_custkey AS k, CASE WHEN c.k IS NULL THEN 'none' ELSE status END AS status, c_name AS name FROM customer LEFT JOIN c ON c.k = c_custkey""")
def e13(customer: DataFrame, orders: DataFrame) -> DataFrame:
    """Accounts with the status of their last order; a null name in a change keeps the name."""
    table = customer.select(F.col("c_custkey").alias("k"), F.lit("none").alias("status"), F.col("c_name").alias("name"))
    changes = orders.select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("status"), F.lit(None).cast("string").alias("name"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    return sx.upsert(table, changes, ["k"], ["name"])


@query("A21_rollup_validity", "sections", sql="""
WITH c AS (SELECT parent_id AS section_id, bool_and(analysis_valid) AS v FROM sections WHERE kind = 'scene' AND status = 'active' GROUP BY 1),
a AS (SELECT s.*, CASE WHEN kind = 'chapter' THEN coalesce(v, analysis_valid) ELSE analysis_valid END AS w FROM sections s LEFT JOIN c USING (section_id)),
p AS (SELECT parent_id AS section_id, bool_and(w) AS v FROM a WHERE kind = 'chapter' AND status = 'active' GROUP BY 1)
SELECT section_id, CASE WHEN kind = 'part' THEN coalesce(v, w) ELSE w END AS analysis_valid FROM a LEFT JOIN p USING (section_id)""")
def a21(sections: DataFrame) -> DataFrame:
    return sx.rollup_validity(sections).select("section_id", "analysis_valid")


@query("P18_invalid_sections", "sections", sql="""
SELECT section_id, concat_ws('|', CASE WHEN NOT analysis_valid THEN 'analysis' END, CASE WHEN NOT audio_valid THEN 'audio' END, CASE WHEN NOT render_valid THEN 'render' END) AS wrong
FROM sections WHERE status = 'active' AND NOT (analysis_valid AND audio_valid AND render_valid)""")
def p18(sections: DataFrame) -> DataFrame:
    return sx.invalid_sections(sections).select("section_id", "wrong")


@query("P18_structure_readiness", "sections", sql="SELECT book_id, bool_and(analysis_valid AND audio_valid AND render_valid) AS ready, sum((NOT (analysis_valid AND audio_valid AND render_valid))::INTEGER)::BIGINT AS invalid FROM sections WHERE status = 'active' GROUP BY book_id")
def p18b(sections: DataFrame) -> DataFrame:
    return sx.structure_readiness(sections)


@query("E10_snapshot_history", "sections", sql="SELECT section_id, 1 AS structure_version FROM sections UNION ALL SELECT section_id, 2 FROM sections")
def e10(sections: DataFrame) -> DataFrame:
    """A version that is saved twice is kept once."""
    first = sections.withColumn("structure_version", F.lit(1).cast("long"))
    second = sections.withColumn("structure_version", F.lit(2).cast("long"))
    history = sx.snapshot_history(sx.snapshot_history(first, second), second)
    return history.select("section_id", "structure_version")


@query("E12_refresh_lines", "lines", sql="""
SELECT scene, row_number() OVER (PARTITION BY scene ORDER BY line_number)::INTEGER AS line_number, text FROM lines WHERE scene % 2 = 0 AND line_number != 2
UNION ALL SELECT scene, 1, 'again ' || scene FROM (SELECT DISTINCT scene FROM lines WHERE scene % 2 = 1)""")
def e12(lines: DataFrame) -> DataFrame:
    """Every other scene has lost its lines, and the rest a line."""
    kept = lines.where("scene % 2 = 0 AND line_number != 2").withColumn("line_number", F.col("line_number").cast("int"))
    scenes = lines.select("book_id", "chapter", "scene").distinct().withColumn("text", F.concat(F.lit("again "), F.col("scene").cast("string")))
    return sx.refresh_lines(kept.select("book_id", "chapter", "scene", "line_number", "text"), scenes).select("scene", "line_number", "text")
