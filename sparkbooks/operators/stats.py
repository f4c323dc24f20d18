"""Statistics of books, scenes and speakers over line tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkbooks.functions.text import words

# Size classes in bytes, pronouns, emotions that always have a row, and words spoken in a minute.
SIZE_TIERS = ((50 * 1024, "Micro-Tier"), (500 * 1024, "Standard Tier"), (1500 * 1024, "Epic Tier"))
FIRST_PERSON = ("i", "me", "my", "myself", "we", "us", "our", "ourselves")
THIRD_PERSON = ("he", "him", "his", "himself", "she", "her", "hers", "herself", "they", "them", "their", "themselves")
BASE_EMOTIONS = ("Neutral", "Joy", "Sadness", "Tension")
WORDS_A_MINUTE = 150.0


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.when(whole > 0, F.round(part * 100.0 / whole, digits)).otherwise(0.0)


def size_tier(size: Column) -> Column:
    out = F.lit("Behemoth Tier")
    for limit, name in reversed(SIZE_TIERS):
        out = F.when(size < limit, name).otherwise(out)
    return out


def book_profile(books: DataFrame, id_col: str = "book_id", text_col: str = "text") -> DataFrame:
    """Bytes, characters, words, paragraphs, spoken minutes and size class of each book."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    paragraphs = F.size(F.filter(F.split(text, r"\r?\n\s*\r?\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")) != ""))
    out = books.select(
        F.col(id_col), F.octet_length(text).cast("long").alias("bytes"), F.length(text).cast("long").alias("chars"),
        words(text).alias("words"), paragraphs.cast("long").alias("paragraphs"),
    )
    return out.withColumn("spoken_minutes", F.round(F.col("words") / WORDS_A_MINUTE, 1)).withColumn("tier", size_tier(F.col("bytes")))


def narration_pov(books: DataFrame, id_col: str = "book_id", text_col: str = "text") -> DataFrame:
    """First or third person by pronouns: first if over 15 and over a quarter of the third-person ones."""

    def mentions(words: tuple[str, ...]) -> Column:
        # a token counts as its letters alone, so anything but letters may stand around and between them
        spelt = "|".join(r"[^a-z\s]*".join(w) for w in words)
        return F.regexp_count(F.lower(text_col), F.lit(rf"(?<!\S)[^a-z\s]*(?:{spelt})[^a-z\s]*(?!\S)")).cast("long")

    per = books.where(F.col(text_col).isNotNull()).select(id_col, mentions(FIRST_PERSON).alias("first_person"), mentions(THIRD_PERSON).alias("third_person"))
    first = (F.col("first_person") > 15) & (F.col("first_person") > F.col("third_person") * 0.25)
    return per.withColumn("pov", F.when(first, "First-Person").otherwise("Third-Person"))


def speaker_breakdown(lines: DataFrame, top: int | None = None) -> DataFrame:
    """Lines and words of each speaker of a book, with shares of the book's dialogue lines and words.

    All lines with text count for their speaker while the share is of dialogue lines, so shares can pass 100. The narrator has a row always.
    """
    counted = lines.where(F.col("text") != "").withColumn("w", words(F.col("text")))
    per = counted.groupBy("book_id", "character").agg(F.count("*").alias("lines"), F.sum("w").alias("words"))
    totals = lines.groupBy("book_id").agg(
        F.sum((F.col("segment_type") == "dialogue").cast("long")).alias("dialogue"), F.sum(words(F.col("text"))).alias("all_words")
    )
    narrators = totals.select("book_id", F.lit("Narrator").alias("character"), F.lit(0).cast("long").alias("lines"), F.lit(0).cast("long").alias("words"))
    per = per.unionByName(narrators).groupBy("book_id", "character").agg(F.sum("lines").alias("lines"), F.sum("words").alias("words"))
    out = per.join(totals, "book_id").select(
        "book_id", "character", "lines", "words",
        percent(F.col("lines"), F.col("dialogue")).alias("line_share"), percent(F.col("words"), F.col("all_words")).alias("word_share"),
    )
    if top is None:
        return out
    order = Window.partitionBy("book_id").orderBy(F.desc("lines"), "character")
    return out.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def emotion_breakdown(lines: DataFrame) -> DataFrame:
    """The share of each emotion in a book's lines; four basic ones have rows always."""
    seeds = lines.select("book_id").distinct().select("book_id", F.explode(F.array(*[F.lit(e) for e in BASE_EMOTIONS])).alias("emotion"))
    counted = lines.groupBy("book_id", "emotion").agg(F.count("*").alias("n"))
    both = counted.unionByName(seeds.withColumn("n", F.lit(0).cast("long"))).groupBy("book_id", "emotion").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy("book_id"))
    return both.select("book_id", "emotion", "n", percent(F.col("n"), total).alias("share"))


def attribution_summary(lines: DataFrame) -> DataFrame:
    return lines.groupBy("book_id", "attribution_method").agg(F.count("*").alias("n"))


def scene_metrics(lines: DataFrame) -> DataFrame:
    """Words of dialogue and narration, dialogue lines and the characters present, for each scene."""
    spoken = F.col("segment_type") == "dialogue"
    w = words(F.col("text"))
    return lines.groupBy("book_id", "scene_id").agg(
        F.sum(F.when(spoken, w).otherwise(0)).alias("dialogue_words"), F.sum(F.when(spoken, 0).otherwise(w)).alias("narration_words"),
        F.sum(spoken.cast("long")).alias("dialogue_lines"), F.array_join(F.array_sort(F.collect_set("character")), "|").alias("characters"),
    )


def console_tree(lines: DataFrame, scenes: DataFrame, excerpt: int = 40) -> DataFrame:
    """What an overview shows of each scene: size, excerpt, lines, enriched and reviewed lines, speakers, and whether it is left out."""
    first = F.min_by(F.substring("text", 1, excerpt), "line_number")
    speakers = F.collect_set(F.when(F.col("segment_type") == "dialogue", F.col("character")))
    per = lines.groupBy("book_id", "scene_id").agg(
        F.sum(F.length("text")).alias("chars"), first.alias("excerpt"), F.count("*").alias("lines"),
        F.sum((F.col("segment_type") == "dialogue").cast("long")).alias("dialogue"),
        F.sum((F.col("attribution_method") != "Tier 1 Default").cast("long")).alias("enriched"),
        F.sum(F.col("attribution_method").endswith("+reviewed").cast("long")).alias("reviewed"),
        F.array_join(F.array_sort(speakers), "|").alias("speakers"),
    )
    return per.join(scenes.select("book_id", "scene_id", "omit"), ["book_id", "scene_id"], "left").withColumn("omit", F.coalesce("omit", F.lit(False)))


def level_totals(lines: DataFrame) -> DataFrame:
    """Lines, scenes and characters of each book and chapter, and of the whole, in one rollup; level says which."""
    out = lines.rollup("book_id", "chapter").agg(
        F.count("*").alias("lines"), F.countDistinct("scene_id").alias("scenes"), F.countDistinct("character").alias("characters"),
        F.grouping_id().alias("g"),
    )
    return out.withColumn("level", F.element_at(F.array(F.lit("chapter"), F.lit("book"), F.lit("none"), F.lit("all")), (F.col("g") + 1).cast("int"))).drop("g")


def batch_summary(lines: DataFrame) -> DataFrame:
    """Chapters, scenes, lines and dialogue lines of each book, and its speakers by number of lines."""
    per = lines.groupBy("book_id").agg(
        F.countDistinct("chapter").alias("chapters"), F.countDistinct("scene_id").alias("scenes"), F.count("*").alias("lines"),
        F.sum((F.col("segment_type") == "dialogue").cast("long")).alias("dialogue_lines"),
    )
    counts = lines.where("segment_type = 'dialogue'").groupBy("book_id", "character").agg(F.count("*").alias("n"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "character", "n")))
    shown = F.array_join(F.transform(order, lambda x: F.concat_ws("=", x.character, x.n.cast("string"))), "|")
    return per.join(counts.groupBy("book_id").agg(shown.alias("speakers")), "book_id", "left")


def trailer_scene(lines: DataFrame, least: int = 60, most: int = 900) -> DataFrame:
    """The scene of each book that fits a trailer best: dialogue, speakers and vocalizations score, times how its words fit; the earliest of equals."""
    w = F.sum(words(F.col("text")))
    spoken = F.col("segment_type") == "dialogue"
    per = lines.groupBy("book_id", "scene_id", "scene").agg(
        w.alias("words"),
        (2 * F.sum(spoken.cast("long")) + 6 * F.count_distinct(F.when(spoken, F.col("character"))) + 4 * F.sum((F.col("utterance_type") == "vocalization").cast("long"))).alias("points"),
    )
    fit = F.when(F.col("words").between(least, most), 1.0).otherwise(0.5)
    per = per.withColumn("score", F.col("points") * fit)
    order = Window.partitionBy("book_id").orderBy(F.desc("score"), "scene")
    return per.withColumn("place", F.row_number().over(order)).where("place = 1").select("book_id", "scene_id", "words", "score")


def speaker_samples(lines: DataFrame, k: int = 2, chars: int = 70) -> DataFrame:
    """Each speaker's number of dialogue lines and the first k of them, cut to `chars`."""
    spoken = lines.where("segment_type = 'dialogue'")
    order = Window.partitionBy("book_id", "character").orderBy("scene", "line_number")
    ranked = spoken.withColumn("place", F.row_number().over(order))
    sample = F.when(F.col("place") <= k, F.struct("place", F.substring("text", 1, chars).alias("t")))
    return ranked.groupBy("book_id", "character").agg(
        F.count("*").alias("lines"), F.array_join(F.transform(F.array_sort(F.collect_list(sample)), lambda x: x.t), " / ").alias("samples")
    )


def book_speakers(lines: DataFrame) -> DataFrame:
    """The speakers of a book's dialogue, and the narrator."""
    spoken = lines.where("segment_type = 'dialogue'").select("book_id", "character")
    return spoken.unionByName(lines.select("book_id", F.lit("Narrator").alias("character"))).distinct()


def scene_roster(lines: DataFrame, least: int = 2, ascii_words: bool = False) -> DataFrame:
    """Capitalised names that a scene's narration has at least twice. A name stands between characters that are no letters, digits or underscores, of any script; with
    `ascii_words` other letters than A to Z end a word too. White space is ASCII's."""
    letter = "[A-Za-z0-9_]" if ascii_words else r"[\p{L}\p{M}\p{N}_]"
    names = F.explode(F.regexp_extract_all("text", F.lit(rf"(?<!{letter})[A-Z][a-z]+(?:[ \t\n\f\r]+[A-Z][a-z]+){{0,2}}(?!{letter})"), F.lit(0)))
    found = lines.where("segment_type = 'narrative'").select("book_id", "scene_id", names.alias("name")).where(F.length("name") >= 3)
    return found.groupBy("book_id", "scene_id", "name").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def top_per_group(rows: DataFrame, group: str, *order: Column, k: int) -> DataFrame:
    """The first k rows of each group."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("place") <= k)


def implausible_structure(chapters: DataFrame, most_chars: int, factor: int = 8) -> DataFrame:
    """Books whose chapters look wrong: one very long chapter, or one over `factor` times the upper median size."""
    sizes = F.array_sort(F.collect_list("size"))
    per = chapters.groupBy("book_id").agg(F.count("*").alias("chapters"), F.max("size").alias("largest"), sizes.alias("sizes"))
    per = per.withColumn("median", F.expr("element_at(sizes, cast(size(sizes) div 2 as int) + 1)")).drop("sizes")
    wrong = ((F.col("chapters") == 1) & (F.col("largest") > most_chars)) | (F.col("largest") > factor * F.col("median"))
    return per.withColumn("implausible", wrong)
