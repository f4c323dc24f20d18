"""Corrections and proposals as layers over line tables: overrides, alias maps, reuse, and grounding of proposals in the text.

Correction tables are joined as they are; Spark broadcasts the small ones by their measured size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkbooks.functions.text import normalized, slug


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first in the order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def apply_speaker_overrides(lines: DataFrame, overrides: DataFrame) -> DataFrame:
    """Lines with the human's speaker where there is one: method human_override, confidence 1. The latest override of a line holds;
    one with an empty speaker withdraws. The lines that are enriched stay as they were stored: this is a layer."""
    last = latest(overrides, ["book_id", "line_id"], F.desc("at"), F.col("character")).where("character != ''")
    joined = lines.join(last.select("book_id", "line_id", F.col("character").alias("__by")), ["book_id", "line_id"], "left")
    hit = F.col("__by").isNotNull()
    return joined.withColumns(
        {
            "character": F.coalesce("__by", "character"),
            "attribution_method": F.when(hit, "human_override").otherwise(F.col("attribution_method")),
            "confidence": F.when(hit, 1.0).otherwise(F.col("confidence")),
        }
    ).drop("__by")


def apply_alias_map(lines: DataFrame, aliases: DataFrame) -> DataFrame:
    """Lines whose character is an alias get the canonical name and its speaker id; one look-up, never a chain."""
    named = aliases.select("book_id", F.col("alias").alias("character"), F.col("canonical").alias("__to"))
    joined = lines.join(named, ["book_id", "character"], "left").withColumn("character", F.coalesce("__to", "character"))
    return joined.withColumn("speaker_id", F.concat(F.lit("char_"), slug(F.col("character")))).drop("__to")


def merges_layer(merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From decisions (book_id, alias, canonical, confirmed): the alias map, and the pairs that stay apart."""
    pair = merges.select("book_id", "alias", "canonical")
    return pair.where(F.lit(True)).join(merges.where("confirmed").select("book_id", "alias", "canonical"), pair.columns, "left_semi"), merges.where(
        "NOT confirmed"
    ).select("book_id", "alias", "canonical")


def scene_hashes(lines: DataFrame) -> DataFrame:
    """A hash of each scene's texts in order, and whether its dialogue, if it has any, was attributed."""
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_number", "text"))), lambda x: x.text), "\x1e")
    spoken = F.col("segment_type") == "dialogue"
    return lines.groupBy("book_id", "scene_id").agg(
        F.sha2(ordered, 256).alias("text_hash"),
        (~F.bool_or(spoken) | F.bool_or(spoken & (F.col("attribution_method") != "Tier 1 Default"))).alias("attributed"),
    )


def reusable_scenes(new: DataFrame, old: DataFrame) -> DataFrame:
    """(book_id, scene_id, reuse) of the new scenes: reusable where the old one has the same texts in order and was attributed."""
    known = scene_hashes(old).where("attributed").select("book_id", "scene_id", "text_hash").withColumn("reuse", F.lit(True))
    return scene_hashes(new).drop("attributed").join(known, ["book_id", "scene_id", "text_hash"], "left").select(
        "book_id", "scene_id", F.coalesce("reuse", F.lit(False)).alias("reuse")
    )


def conversation_switches(lines: DataFrame) -> DataFrame:
    """How often two characters' dialogue lines follow one another in a scene, for each unordered pair."""
    order = Window.partitionBy("book_id", "scene_id").orderBy("line_number")
    pairs = lines.where("segment_type = 'dialogue'").withColumn("before", F.lag("character").over(order)).where("before != character")
    return pairs.groupBy("book_id", F.least("before", "character").alias("a"), F.greatest("before", "character").alias("b")).agg(F.count("*").alias("switches"))


def unblocked_merges(proposals: DataFrame, switches: DataFrame, most: int = 1) -> DataFrame:
    """Proposed merges (book_id, alias, canonical) of names that do not talk to each other: they alternate `most` times at most."""
    talk = switches.where(F.col("switches") > most)
    both = talk.select("book_id", F.col("a").alias("alias"), F.col("b").alias("canonical")).unionByName(
        talk.select("book_id", F.col("b").alias("alias"), F.col("a").alias("canonical"))
    )
    return proposals.join(both, ["book_id", "alias", "canonical"], "left_anti")


def grounded(proposals: DataFrame, texts: DataFrame, keys: list[str], snippet: str, text: str, first: int | None = None) -> DataFrame:
    """proposals with `found`: whether the normalised snippet, or its first characters, is in the normalised text of the same keys.

    Texts are normalised once. Empty snippets are not found.
    """
    clean = texts.select(*keys, normalized(F.col(text)).alias("__text"))
    want = normalized(F.col(snippet))
    want = F.substring(want, 1, first) if first else want
    return proposals.withColumn("__want", want).join(clean, keys, "left").withColumn(
        "found", F.coalesce((F.col("__want") != "") & F.contains(F.col("__text"), F.col("__want")), F.lit(False))
    ).drop("__want", "__text")


def outside_dialogue(events: DataFrame, lines: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Events whose text no dialogue line of the same keys holds."""
    said = lines.where("segment_type = 'dialogue'").select(*[F.col(k).alias(f"__{k}") for k in keys], normalized(F.col("text")).alias("__said"))
    want = normalized(F.col(text))
    on = [events[k] == said[f"__{k}"] for k in keys] + [(want != "") & F.contains(F.col("__said"), want)]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return events.join(said, condition, "left_anti")


def match_to_roster(names: DataFrame, roster: DataFrame) -> DataFrame:
    """names(book_id, name) with the first of the book's roster(book_id, name, position) that holds the name or is held by it."""
    r = roster.select("book_id", F.col("name").alias("match"), "position")
    low, other = F.lower("name"), F.lower("match")
    hit = F.contains(low, other) | F.contains(other, low)
    best = names.distinct().join(r, "book_id").where(hit).groupBy("book_id", "name").agg(F.min_by("match", "position").alias("match"))
    return names.join(best, ["book_id", "name"], "left")


def apply_answers(lines: DataFrame, answers: DataFrame, lock: float = 0.6) -> DataFrame:
    """Attribution answers (book_id, scene_id, line_number, answer_no, speaker, confidence) on dialogue lines.

    Empty speakers and the narrator are dropped; the last answer of a line holds; confidences are clamped to 0 to 1, and lock the speaker from `lock` on.
    """
    good = answers.where(F.trim("speaker").isNotNull() & ~F.lower(F.trim("speaker")).isin("", "narrator"))
    last = latest(good, ["book_id", "scene_id", "line_number"], F.desc("answer_no")).select(
        "book_id", "scene_id", "line_number", F.trim("speaker").alias("__s"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))).alias("__c")
    )
    joined = lines.join(last, ["book_id", "scene_id", "line_number"], "left")
    hit = F.col("__s").isNotNull() & (F.col("segment_type") == "dialogue")
    return joined.withColumns(
        {
            "character": F.when(hit, F.col("__s")).otherwise(F.col("character")),
            "speaker_id": F.concat(F.lit("char_"), slug(F.when(hit, F.col("__s")).otherwise(F.col("character")))),
            "confidence": F.when(hit, F.col("__c")).otherwise(F.col("confidence")),
            "speaker_locked": F.when(hit, F.col("__c") >= lock).otherwise(F.lit(True)),
        }
    ).drop("__s", "__c")


def apply_corrections(lines: DataFrame, corrections: DataFrame, least: int = 6, speakers: int = 2, share: float = 0.3) -> DataFrame:
    """Review corrections (book_id, scene_id, line_number, current_speaker, corrected_speaker) on lines.

    Only scenes with `least` dialogue lines and `speakers` speakers are eligible; one with over max(1, share) corrections is rejected whole; corrections that
    are stale, change nothing or name the narrator are dropped.
    """
    spoken = F.col("segment_type") == "dialogue"
    scene = lines.groupBy("book_id", "scene_id").agg(F.sum(spoken.cast("long")).alias("d"), F.count_distinct(F.when(spoken, F.col("character"))).alias("s"))
    asked = corrections.groupBy("book_id", "scene_id").agg(F.count("*").alias("asked"))
    open_ = scene.join(asked, ["book_id", "scene_id"]).where((F.col("d") >= least) & (F.col("s") >= speakers))
    open_ = open_.where(F.col("asked") <= F.greatest(F.lit(1.0), share * F.col("d"))).select("book_id", "scene_id")
    good = corrections.join(open_, ["book_id", "scene_id"], "left_semi").where("corrected_speaker != current_speaker AND corrected_speaker NOT IN ('', 'Narrator')")
    good = good.select("book_id", "scene_id", "line_number", F.col("current_speaker").alias("__from"), F.col("corrected_speaker").alias("__to"))
    joined = lines.join(good, ["book_id", "scene_id", "line_number"], "left")
    hit = F.coalesce((F.col("__from") == F.col("character")) & spoken, F.lit(False))
    return joined.withColumns(
        {
            "attribution_method": F.when(hit, F.concat("attribution_method", F.lit("+reviewed"))).otherwise(F.col("attribution_method")),
            "confidence": F.when(hit, 0.75).otherwise(F.col("confidence")),
            "character": F.when(hit, F.col("__to")).otherwise(F.col("character")),
        }
    ).drop("__from", "__to")


def splice_inserts(lines: DataFrame, inserts: DataFrame, keys: list[str]) -> DataFrame:
    """Lines with inserts(.., anchor, text) after their anchor lines, renumbered from 1; old is the line's former number."""
    a = lines.select(*keys, F.col("line_number").alias("anchor"), F.lit(0).alias("is_insert"), F.lit(0).cast("long").alias("n"), "text", F.col("line_number").alias("old"))
    order = Window.partitionBy(*keys, "anchor").orderBy("text")
    b = inserts.select(*keys, "anchor", F.lit(1).alias("is_insert"), F.row_number().over(order).cast("long").alias("n"), "text", F.lit(None).cast("long").alias("old"))
    by = Window.partitionBy(*keys).orderBy("anchor", "is_insert", "n")
    return a.unionByName(b).select(*keys, F.row_number().over(by).alias("line_number"), "text", "old", (F.col("is_insert") == 1).alias("inserted"))


def parse_chapter_spec(spec: DataFrame) -> DataFrame:
    """(book_id, ordinal) of specs(book_id, spec) such as '1-3,5'; parts that are not numbers are left out."""
    part = spec.select("book_id", F.explode(F.split("spec", ",")).alias("p")).withColumn("p", F.trim("p")).where(F.col("p").rlike(r"^\d+(\s*-\s*\d+)?$"))
    low = F.regexp_extract("p", r"^(\d+)", 1).cast("int")
    high = F.regexp_extract("p", r"(\d+)$", 1).cast("int")
    return part.where(low <= high).select("book_id", F.explode(F.sequence(low, high)).alias("ordinal")).distinct()
