"""From paragraphs to labelled lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkbooks.functions.text import strip

# How paragraphs are told apart, by name.
PARAGRAPH_BREAKS = {"blank": r"\n\n+", "spaced": r"\r?\n\s*\r?\n", "line": r"\n+"}


def split_paragraphs(books: DataFrame, text_col: str = "text", style: str = "blank") -> DataFrame:
    """A row (.., par, paragraph) for each paragraph that is not empty, stripped; par counts those from 0."""
    split = F.filter(F.transform(F.split(F.col(text_col), PARAGRAPH_BREAKS[style]), strip), lambda p: p != "")
    keep = [c for c in books.columns if c != text_col]
    return books.select(*keep, F.posexplode(split).alias("par", "paragraph"))


#: Single quotes that are no apostrophes within a word.
SINGLE_QUOTE = r"(?<!\p{L})'|'(?!\p{L})"


def quote_segments(paragraphs: DataFrame, text_col: str = "text") -> DataFrame:
    """A row (.., seg, segment_type, segment) for each stretch of a paragraph between quotes; seg counts from 0 those that are not empty.

    Double quotes delimit if there are any; else single ones, if those that are no apostrophes are even in number. An odd
    quote leaves what follows as dialogue. Segments lose white space and hyphens at their ends, but a paragraph without quotes keeps its hyphens.
    """
    p, pieces = F.col(text_col), F.col("__pieces")
    # each step is a column of its own, so that no pattern is searched twice; single quotes are only counted where there are no double ones
    double = F.contains(p, F.lit('"'))
    cut = F.when(double, F.split(p, '"')).when((F.col("__singles") > 0) & (F.col("__singles") % 2 == 0), F.split(p, SINGLE_QUOTE)).otherwise(F.array(p))
    counted = F.when(F.contains(p, F.lit("'")) & ~double, F.regexp_count(p, F.lit(SINGLE_QUOTE))).otherwise(0)
    trimmed = F.transform(pieces, lambda s, i: F.struct((i % 2 == 1).alias("d"), F.regexp_replace(s, r"(?U)^[\s-]+|[\s-]+$", "").alias("t")))
    whole = F.array(F.struct(F.lit(False).alias("d"), p.alias("t")))
    segments = F.when(F.size(pieces) > 1, F.filter(trimmed, lambda s: s.t != "")).when(strip(p) != "", whole)
    keep = [c for c in paragraphs.columns if c != text_col]
    out = paragraphs.withColumn("__singles", counted).withColumn("__pieces", cut).select(*keep, segments.alias("__segments"))
    out = out.select(*keep, F.posexplode("__segments").alias("seg", "s"), F.size("__segments").alias("segs"))
    return out.select(
        *[c for c in paragraphs.columns if c != text_col],
        "seg",
        "segs",
        F.when(F.col("s.d"), "dialogue").otherwise("narrative").alias("segment_type"),
        F.col("s.t").alias("segment"),
    )


def parse_lines(scenes: DataFrame, text_col: str = "text", part: Column | None = None) -> DataFrame:
    """The lines of scenes(book_id, chapter, scene, text): numbered in the scene, with a content-hash id, padding and the narrator as speaker."""
    paragraphs = split_paragraphs(scenes, text_col).withColumn("paragraph", F.regexp_replace("paragraph", r"(?U)\s*\n\s*", " "))
    segments = quote_segments(paragraphs, "paragraph")
    order = Window.partitionBy("book_id", "chapter", "scene").orderBy("par", "seg")
    out = segments.withColumn("line_number", F.row_number().over(order))
    raw = F.concat(
        F.lit("p"), (part if part is not None else F.lit(1)).cast("string"), F.lit("_c"), F.col("chapter").cast("string"),
        F.lit("_s"), F.col("scene").cast("string"), F.lit("_l"), F.col("line_number").cast("string"), F.lit("_"), F.col("segment"),
    )
    padding = F.when(F.col("seg") == F.col("segs") - 1, 600).when(F.substring("segment", -1, 1).isin(".", "?", "!"), 200).otherwise(50)
    return out.select(
        "book_id", "chapter", "scene", "line_number", F.substring(F.sha2(raw, 256), 1, 16).alias("line_id"),
        F.lit("Narrator").alias("character"), F.lit("char_narrator").alias("speaker_id"), "segment_type", F.col("segment").alias("text"),
        padding.alias("post_padding_ms"), F.lit("Tier 1 Default").alias("attribution_method"), F.lit(1.0).alias("confidence"),
    )


def fixed_overlap_chunks(docs: DataFrame, text_col: str = "text", size: int = 10_000, overlap: int = 1_000) -> DataFrame:
    """Windows of `size` characters that begin every size - overlap, the last where the text's end is reached: (.., chunk, start, text, position)."""
    n, step = F.length(text_col), size - overlap
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(step))).cast("int")
    out = docs.withColumn("chunks", last + 1).withColumn("chunk", F.explode(F.sequence(F.lit(0), last)))
    position = F.when(F.col("chunks") == 1, "only").when(F.col("chunk") == 0, "first").when(F.col("chunk") == F.col("chunks") - 1, "last").otherwise("middle")
    start = (F.col("chunk") * step).cast("int")
    return out.select(
        *[c for c in docs.columns if c != text_col], "chunk", "chunks", start.alias("start"),
        F.substr(F.col(text_col), start + 1, F.lit(size)).alias(text_col), position.alias("position"),
    )


def number_lines(lines: DataFrame) -> DataFrame:
    """Lines renumbered from 1 in their scene, and the scene's place in its book."""
    scene = Window.partitionBy("book_id", "scene").orderBy("line_number", "line_id")
    book = Window.partitionBy("book_id").orderBy("scene")
    scenes = lines.select("book_id", "scene").distinct().withColumn("scene_number", F.row_number().over(book))
    return lines.withColumn("line_number", F.row_number().over(scene)).join(scenes, ["book_id", "scene"])


def dialogue_windows(lines: DataFrame, size: int = 30, least: int = 1) -> DataFrame:
    """Dialogue lines with the number of their window of `size` in the scene, from 1; windows with fewer than `least` lines are left out."""
    order = Window.partitionBy("book_id", "scene").orderBy("line_number")
    out = lines.where("segment_type = 'dialogue'").withColumn("index", F.row_number().over(order))
    out = out.withColumn("window", F.ceil(F.col("index") / size).cast("int"))
    held = F.count("*").over(Window.partitionBy("book_id", "scene", "window"))
    return out.withColumn("held", held).where(F.col("held") >= least).drop("held")


def fill_forward(rows: DataFrame, partition: str, order: str, value: Column, name: str) -> DataFrame:
    """rows with the last value that is not null up to each row."""
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(partition).orderBy(order)))


def read_gold_script(raw: DataFrame) -> DataFrame:
    """(book_id, scene, speaker, text, pos) of the quoted lines of gold_raw(book_id, pos, line).

    [Scene N ..] begins a scene and makes the narrator speak, 'Name:' changes the speaker.
    """
    line = strip(F.col("line"))
    scene = F.regexp_extract(line, r"(?i)^\[scene\s+(\d+)", 1)
    speaker = F.regexp_extract(line, r"^([^\":\[\]]{1,60}):$", 1)
    rows = raw.select("book_id", "pos", line.alias("line"), scene.alias("s"), speaker.alias("p"))
    rows = fill_forward(rows, "book_id", "pos", F.when(F.col("s") != "", F.col("s").cast("int")), "scene")
    rows = fill_forward(rows, "book_id", "pos", F.when(F.col("s") != "", "Narrator").when(F.col("p") != "", F.col("p")), "speaker")
    quoted = rows.where(F.col("line").rlike('^".*"$') & (F.length("line") > 2))
    text = F.expr("substring(line, 2, length(line) - 2)")
    return quoted.select("book_id", F.coalesce("scene", F.lit(1)).alias("scene"), F.coalesce("speaker", F.lit("Narrator")).alias("speaker"), text.alias("text"), "pos")
