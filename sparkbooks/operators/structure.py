"""Versioned section trees as adjacency lists, of any depth, edited in bulk: sections in, sections out.

A section row has book_id, section_id, parent_id, kind, position, title, content_type, text_hash, status, analysis_valid, audio_valid, render_valid,
approval and structure_version at least. An edit makes a new version of the books that it changes: all their sections carry the next structure_version. Where an edit
names a section that is not there, or breaks a rule of its own, it does nothing, and the book keeps its version. Sections that an edit touches
need approval again, so their approval is stale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def active() -> Column:
    return F.col("status") == "active"


def siblings() -> Window:
    return Window.partitionBy("book_id", "parent_id")


def normalize_sibling_order(sections: DataFrame) -> DataFrame:
    """Active sections numbered from 1 among their siblings by position and id; others keep their position."""
    order = Window.partitionBy("book_id", "parent_id", active()).orderBy("position", "section_id")
    return sections.withColumn("position", F.when(active(), F.row_number().over(order).cast("long")).otherwise(F.col("position")))


def paths(sections: DataFrame) -> DataFrame:
    """(book_id, section_id, kind, title, path): active sections whose ancestors are all active, up to one without a parent. path has the position and id of each
    section on the way down, so paths sort in the order of reading. Recursion goes 100 levels down, as Spark lets it; circles have no start and are left out."""
    return sections.sparkSession.sql(
        """WITH RECURSIVE down(book_id, section_id, kind, title, path) AS (
             SELECT book_id, section_id, kind, title, array(struct(position AS position, section_id AS id)) FROM {s} WHERE parent_id IS NULL
             UNION ALL
             SELECT s.book_id, s.section_id, s.kind, s.title, array_append(down.path, struct(s.position AS position, s.section_id AS id))
             FROM down JOIN {s} s ON s.book_id = down.book_id AND s.parent_id = down.section_id)
           SELECT * FROM down LIMIT ALL""",
        s=sections.where(active()).select("book_id", "section_id", "parent_id", "kind", "title", "position"),
    )


def canonical_order(sections: DataFrame) -> DataFrame:
    """(book_id, section_id, place) of the active scenes below active parents, at any depth, by the positions and ids on their paths."""
    order = Window.partitionBy("book_id").orderBy("path")
    return paths(sections).where("kind = 'scene'").select("book_id", "section_id", F.row_number().over(order).alias("place"))


def edited(sections: DataFrame, edits: DataFrame, **changes: Column) -> DataFrame:
    """sections with the changes where edits(book_id, section_id, ..) names them; the edit's columns have the prefix e_."""
    e = edits.select("book_id", "section_id", *[F.col(c).alias(f"e_{c}") for c in edits.columns if c not in ("book_id", "section_id")], F.lit(True).alias("e_hit"))
    joined = sections.join(e, ["book_id", "section_id"], "left")
    hit = F.coalesce("e_hit", F.lit(False))
    return joined.select(*[F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in sections.columns])


def invalid() -> dict[str, Column]:
    """The changes of a section that must be analysed, recorded, rendered and approved again."""
    return {"analysis_valid": F.lit(False), "audio_valid": F.lit(False), "render_valid": F.lit(False), "approval": F.lit("stale")}


def new_version(sections: DataFrame, books: DataFrame) -> DataFrame:
    """sections with the next structure_version where books(book_id) names their book."""
    changed = books.select("book_id").distinct().withColumn("e_changed", F.lit(1).cast("long"))
    version = (F.col("structure_version") + F.coalesce("e_changed", F.lit(0))).alias("structure_version")
    return sections.join(changed, "book_id", "left").select(*[version if c == "structure_version" else F.col(c) for c in sections.columns])


def _known(sections: DataFrame, edits: DataFrame) -> DataFrame:
    return edits.join(sections.select("book_id", "section_id"), ["book_id", "section_id"], "left_semi")


def rename_sections(sections: DataFrame, edits: DataFrame) -> DataFrame:
    """New titles; what was rendered is stale. The hash of the text, analysis and audio stay."""
    known = _known(sections, edits)
    return new_version(edited(sections, known, title=F.col("e_title"), render_valid=F.lit(False), approval=F.lit("stale")), known)


def change_content_type(sections: DataFrame, edits: DataFrame, kinds: list[str]) -> DataFrame:
    """New content types, if they are among `kinds`; validity stays."""
    known = _known(sections, edits.where(F.col("content_type").isin(*kinds)))
    return new_version(edited(sections, known, content_type=F.col("e_content_type"), approval=F.lit("stale")), known)


def reorder_sections(sections: DataFrame, edits: DataFrame) -> DataFrame:
    """Active sections moved to a place, from 1, among their active siblings, which are renumbered; all of those must be rendered again."""
    order = Window.partitionBy("book_id", "parent_id", active()).orderBy("position", "section_id")
    e = edits.select("book_id", "section_id", F.col("order").alias("e_to"))
    joined = sections.join(e, ["book_id", "section_id"], "left").withColumn("e_at", F.row_number().over(order))
    moved = F.col("e_to").isNotNull() & active()
    joined = joined.withColumn("e_n", F.sum(active().cast("long")).over(siblings())).withColumn("e_touched", F.bool_or(moved).over(siblings()) & active())
    to = F.greatest(F.lit(1), F.least(F.col("e_to"), F.col("e_n")))
    # a moved section goes before or after the one that is there, by the direction that it comes from
    aside = F.when(to > F.col("e_at"), 0.5).when(to < F.col("e_at"), -0.5).otherwise(0.0)
    joined = joined.withColumn("e_key", F.when(moved, to + aside).otherwise(F.col("e_at").cast("double")))
    place = F.row_number().over(Window.partitionBy("book_id", "parent_id", active()).orderBy("e_key", "section_id")).cast("long")
    out = joined.withColumn("e_place", place)
    touched = {"position": F.col("e_place"), "render_valid": F.lit(False), "approval": F.lit("stale")}
    done = out.select(*[F.when(F.col("e_touched"), touched[c]).otherwise(F.col(c)).alias(c) if c in touched else F.col(c) for c in sections.columns])
    return new_version(done, e.join(sections.where(active()), ["book_id", "section_id"], "left_semi"))


def _renumbered(sections: DataFrame, parents: DataFrame) -> DataFrame:
    """sections with the active children of parents(book_id, parent_id) numbered from 1; a null parent is one too."""
    p = parents.select("book_id", F.col("parent_id").alias("e_parent")).distinct().withColumn("e_hit", F.lit(True)).alias("p")
    joined = sections.alias("s").join(p, (F.col("s.book_id") == F.col("p.book_id")) & F.col("s.parent_id").eqNullSafe(F.col("e_parent")), "left").select("s.*", "e_hit")
    order = Window.partitionBy("book_id", "parent_id", active()).orderBy("position", "section_id")
    place = F.when(F.col("e_hit") & active(), F.row_number().over(order).cast("long")).otherwise(F.col("position"))
    return joined.withColumn("position", place).select(*sections.columns)


def below(sections: DataFrame, named: DataFrame) -> DataFrame:
    """(book_id, section_id, top, depth) of all sections, of any status, below named(book_id, section_id): once for each named one, `depth` levels under it."""
    return sections.sparkSession.sql(
        """WITH RECURSIVE down(book_id, section_id, top, depth) AS (
             SELECT s.book_id, s.section_id, n.section_id, 1 FROM {s} s JOIN {n} n ON s.book_id = n.book_id AND s.parent_id = n.section_id
             UNION ALL
             SELECT s.book_id, s.section_id, down.top, down.depth + 1 FROM down JOIN {s} s ON s.book_id = down.book_id AND s.parent_id = down.section_id)
           SELECT * FROM down LIMIT ALL""",
        s=sections.select("book_id", "section_id", "parent_id"), n=named.select("book_id", "section_id").distinct(),
    )


def remove_sections(sections: DataFrame, edits: DataFrame) -> DataFrame:
    """The named sections and all below them deleted and invalid; their siblings renumbered."""
    named = _known(sections, edits.select("book_id", "section_id").distinct())
    gone = named.unionByName(below(sections, named).select("book_id", "section_id")).distinct()
    parents = sections.join(named, ["book_id", "section_id"], "left_semi").select("book_id", "parent_id")
    return new_version(_renumbered(edited(sections, gone, status=F.lit("deleted"), **invalid()), parents), named)


def rollup_validity(sections: DataFrame) -> DataFrame:
    """Scenes are valid as they say; a chapter or part is valid if all its active children are, and as it says without any."""

    def raised(s: DataFrame, kind: str, child: str) -> DataFrame:
        per = s.where(active() & (F.col("kind") == child)).groupBy("book_id", F.col("parent_id").alias("section_id")).agg(F.bool_and("analysis_valid").alias("__all"))
        joined = s.join(per, ["book_id", "section_id"], "left")
        valid = F.when(F.col("kind") == kind, F.coalesce("__all", "analysis_valid")).otherwise(F.col("analysis_valid"))
        return joined.withColumn("analysis_valid", valid).drop("__all")

    return raised(raised(sections, "chapter", "scene"), "part", "chapter").select(*sections.columns)


def invalid_sections(sections: DataFrame, needs: tuple[str, ...] = ("analysis", "audio", "render")) -> DataFrame:
    """Active sections that are not valid in one of `needs`, with what is wrong."""
    wrong = F.array_compact(F.array(*[F.when(~F.col(f"{x}_valid"), x) for x in needs]))
    return sections.where(active()).withColumn("wrong", F.array_join(wrong, "|")).where("wrong != ''").select("book_id", "section_id", "wrong")


def structure_readiness(sections: DataFrame, needs: tuple[str, ...] = ("analysis", "audio", "render")) -> DataFrame:
    """For each book whether all active sections are valid in all of `needs`, and how many are not."""
    bad = ~F.least(*[F.col(f"{x}_valid").cast("int") for x in needs], F.lit(1)).cast("boolean")
    return sections.where(active()).groupBy("book_id").agg((~F.bool_or(bad)).alias("ready"), F.sum(bad.cast("long")).alias("invalid"))


def merged_id(version: Column, ids: Column) -> Column:
    """The id of a section made from others: from the version and the hash of their ids."""
    return F.concat(F.lit("sec_merge_v"), version.cast("string"), F.lit("_"), F.substring(F.sha1(F.array_join(ids, "|").cast("binary")), 1, 12))


def merge_sections(sections: DataFrame, edits: DataFrame) -> DataFrame:
    """Sections merged into new ones: edits(book_id, section_ids, title). The sources must be active siblings that stand together in the given order;
    other edits do nothing. Sources become merged, their children belong to the new section in the order of their places, and all involved, those
    below too, are invalid. Without a title the sources' titles are joined; the hash is that of the sources' hashes."""
    order = Window.partitionBy("book_id", "parent_id", active()).orderBy("position", "section_id")
    placed = sections.withColumn("e_at", F.row_number().over(order))
    numbered = edits.select("book_id", "section_ids", "title")
    asked = numbered.select("book_id", "section_ids", F.col("title").alias("e_title"), F.posexplode("section_ids").alias("at", "section_id"))
    found = asked.join(placed.select("book_id", "section_id", "parent_id", "position", "e_at", "status", "kind", "title", "content_type", "text_hash", "structure_version"), ["book_id", "section_id"])
    listed = F.array_sort(F.collect_list(F.struct("at", "title", "content_type", "kind", "text_hash")))
    together = found.groupBy("book_id", "section_ids").agg(
        F.first("e_title").alias("e_title"), listed.alias("listed"), F.max("structure_version").alias("version"),
        F.min("parent_id").alias("parent_id"), F.max("parent_id").alias("other"), F.min("position").alias("position"), F.count("*").alias("n"), F.count("parent_id").alias("held"),
        F.bool_and(active()).alias("active"), F.count_distinct(F.col("e_at") - F.col("at")).alias("runs"),
    )
    good = together.where("active AND runs = 1 AND n = size(section_ids) AND n > 1 AND parent_id <=> other AND held IN (0, n)")
    good = good.withColumn("new_id", merged_id(F.col("version") + 1, F.col("section_ids")))
    sources = good.select("book_id", "new_id", F.explode("section_ids").alias("section_id"))
    # one map says of each section what becomes of it: sources, their children, which move, and what lies deeper
    under = below(sections, sources).alias("u").join(sources.alias("t"), (F.col("u.book_id") == F.col("t.book_id")) & (F.col("u.top") == F.col("t.section_id")))
    involved = sources.select("book_id", "section_id", F.lit(0).alias("depth"), "new_id").unionByName(under.select("u.book_id", "u.section_id", "u.depth", "t.new_id"))
    involved = involved.groupBy("book_id", "section_id").agg(
        F.bool_or(F.col("depth") == 0).alias("e_source"), F.max(F.when(F.col("depth") == 1, F.col("new_id"))).alias("e_parent"), F.lit(True).alias("e_hit")
    )
    hit, source = F.coalesce("e_hit", F.lit(False)), F.coalesce("e_source", F.lit(False))
    place = F.row_number().over(Window.partitionBy("book_id", "e_parent").orderBy("position", "section_id")).cast("long")
    own = {c: F.when(hit, v).otherwise(F.col(c)) for c, v in invalid().items()} | {
        "status": F.when(source, "merged").otherwise(F.col("status")), "parent_id": F.coalesce("e_parent", "parent_id"),
        "position": F.when(F.col("e_parent").isNotNull(), place).otherwise(F.col("position")),
    }
    done = sections.join(involved, ["book_id", "section_id"], "left")
    done = done.select(*[own[c].alias(c) if c in own else F.col(c) for c in sections.columns], F.lit(False).alias("e_new"))
    joined = F.sha2(F.array_join(F.transform("listed", lambda x: x.text_hash), "|"), 256)
    new = good.select(
        "book_id", F.col("new_id").alias("section_id"), "parent_id", F.col("listed")[0].kind.alias("kind"), "position",
        F.coalesce("e_title", F.array_join(F.transform("listed", lambda x: x.title), " / ")).alias("title"), F.col("listed")[0].content_type.alias("content_type"),
        F.concat(F.lit("sha256:"), joined).alias("text_hash"), F.lit("active").alias("status"), *[v.alias(c) for c, v in invalid().items()], F.col("version").alias("structure_version"), F.lit(True).alias("e_new"),
    )
    every = done.unionByName(new, allowMissingColumns=True)
    # the siblings of a new section are numbered again, and its book has a new version
    order = Window.partitionBy("book_id", "parent_id", active()).orderBy("position", "section_id")
    among = F.bool_or("e_new").over(siblings()) & active()
    every = every.withColumn("position", F.when(among, F.row_number().over(order).cast("long")).otherwise(F.col("position")))
    changed = F.bool_or("e_new").over(Window.partitionBy("book_id")).cast("int")
    return every.withColumn("structure_version", F.col("structure_version") + changed).select(*sections.columns)


def split_sections(sections: DataFrame, edits: DataFrame) -> DataFrame:
    """Active leaves split by edits(book_id, section_id, titles): two titles at least. The source becomes split and invalid; the new sections
    take places from the source's on, and all siblings are numbered again by place and id."""
    parents = sections.where(active()).select("book_id", F.col("parent_id").alias("section_id")).distinct()
    leaf = edits.where(F.size("titles") >= 2).join(parents, ["book_id", "section_id"], "left_anti")
    source = sections.where(active()).join(leaf.select("book_id", "section_id", "titles"), ["book_id", "section_id"])
    parts = source.select("*", F.posexplode("titles").alias("e_n", "e_title")).withColumn("e_at", F.col("position") + F.col("e_n"))
    name = F.substring(F.sha1(F.concat_ws("|", "section_id", "e_at", "e_title").cast("binary")), 1, 12)
    own = {
        "section_id": F.concat(F.lit("sec_split_v"), (F.col("structure_version") + 1).cast("string"), F.lit("_"), name), "title": F.col("e_title"), "position": F.col("e_at"),
        "text_hash": F.concat(F.lit("sha256:"), F.sha2(F.concat_ws(":", "text_hash", "e_title", "e_at"), 256)), **invalid(),
    }
    new = parts.select(*[own[c].alias(c) if c in own else F.col(c) for c in sections.columns])
    old = edited(sections, source.select("book_id", "section_id"), status=F.lit("split"), **invalid())
    return new_version(_renumbered(old.unionByName(new), source), source)


def outline(sections: DataFrame) -> DataFrame:
    """Each book's active tree, nested and in order: parts of chapters of scenes."""
    s = sections.where(active())
    leaf = F.array_sort(F.collect_list(F.struct("position", "section_id", "title")))
    scenes = s.where("kind = 'scene'").groupBy("book_id", F.col("parent_id").alias("section_id")).agg(leaf.alias("scenes"))
    chapters = s.where("kind = 'chapter'").join(scenes, ["book_id", "section_id"], "left")
    chapters = chapters.groupBy("book_id", F.col("parent_id").alias("section_id")).agg(
        F.array_sort(F.collect_list(F.struct("position", "section_id", "title", "scenes"))).alias("chapters")
    )
    parts = s.where("kind = 'part'").join(chapters, ["book_id", "section_id"], "left")
    return parts.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("position", "section_id", "title", "chapters"))).alias("parts"))


def outline_rows(sections: DataFrame) -> DataFrame:
    """(book_id, section_id, depth, number, title): each book's active tree of any depth as a table of contents, numbered 1.2.3 by the places among active siblings."""
    p = paths(sections)
    siblings_of = Window.partitionBy("book_id", F.slice("path", 1, F.size("path") - 1)).orderBy("path")
    place = p.withColumn("place", F.row_number().over(siblings_of)).select("book_id", "section_id", "place", "title", "path")
    steps = place.select("book_id", "section_id", F.posexplode(F.transform("path", lambda x: x.id)).alias("at", "step"))
    steps = steps.join(place.select("book_id", F.col("section_id").alias("step"), F.col("place").alias("n")), ["book_id", "step"])
    number = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "n"))), lambda x: x.n.cast("string")), ".")
    numbers = steps.groupBy("book_id", "section_id").agg(number.alias("number"))
    return place.join(numbers, ["book_id", "section_id"]).select("book_id", "section_id", F.size("path").alias("depth"), "number", "title")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], keep_old_if_null: list[str] | None = None) -> DataFrame:
    """The table with the last change of each key (by column at); a null in the listed columns keeps what was there."""
    last = changes.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("at")))).where("__n = 1").drop("__n", "at")
    value = [c for c in table.columns if c not in keys]
    new = last.select(*keys, *[F.col(c).alias(f"__{c}") for c in value], F.lit(True).alias("__new"))
    joined = table.withColumn("__old", F.lit(True)).join(new, keys, "full")
    out = [
        F.when(F.col("__new").isNull(), F.col(c)).otherwise(F.coalesce(f"__{c}", c) if c in (keep_old_if_null or []) else F.col(f"__{c}")).alias(c)
        for c in value
    ]
    return joined.select(*keys, *out)


def snapshot_history(history: DataFrame, sections: DataFrame) -> DataFrame:
    """The history with the sections' version appended, once for each book and structure_version."""
    known = history.select("book_id", "structure_version").distinct()
    return history.unionByName(sections.join(known, ["book_id", "structure_version"], "left_anti"))


def refresh_lines(lines: DataFrame, scenes: DataFrame) -> DataFrame:
    """Lines of (book_id, chapter, scene, line_number, .., text): those that scenes have are renumbered, scenes without any are parsed anew."""
    from sparkbooks.operators.lines import parse_lines

    keys = ["book_id", "chapter", "scene"]
    order = Window.partitionBy(*keys).orderBy("line_number")
    kept = lines.join(scenes.select(*keys), keys, "left_semi").withColumn("line_number", F.row_number().over(order))
    missing = scenes.join(lines.select(*keys).distinct(), keys, "left_anti").select(*keys, "text")
    return kept.unionByName(parse_lines(missing), allowMissingColumns=True).select(*lines.columns)
