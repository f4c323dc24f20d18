"""Small jobs over tables of books, lines and files: what is there, what is missing, what belongs together, and what comes first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkbooks.functions.text import strip
from sparkbooks.operators.production import cosine
from sparkbooks.operators.stats import top_per_group

# Words that are no names, alone or at all.
PRONOUNS = (
    "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their", "theirs", "themselves",
    "i", "me", "my", "mine", "myself", "you", "your", "yours", "yourself", "we", "us", "our", "ours", "ourselves",
)
NO_NAMES = ("down", "up", "left", "right", "chapter", "book", "title", "author", "release")


def valid_person_name(name: Column) -> Column:
    """Whether a found name can be a person's: no pronoun, longer than a letter, and if one word, of letters only and no word of directions or headings."""
    own = strip(name)
    one = ~own.rlike(r"(?U)\s")
    return (F.length(own) > 1) & ~F.lower(own).isin(*PRONOUNS) & (~one | (own.rlike("^[A-Za-z]+$") & ~F.lower(own).isin(*NO_NAMES)))


def omit_scenes(lines: DataFrame, scenes: DataFrame, keys: tuple[str, ...] = ("book_id", "scene_id")) -> DataFrame:
    """lines without those of scenes(.., omit) that are marked; the table of lines itself stays complete."""
    return lines.join(scenes.where("omit").select(*keys), list(keys), "left_anti")


def attributable_dialogue(lines: DataFrame, least: int = 3) -> DataFrame:
    """Dialogue with at least so many letters or digits."""
    return lines.where("segment_type = 'dialogue'").where(F.length(F.regexp_replace("text", "[^A-Za-z0-9]", "")) >= least)


def clean_check_issues(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """answers with one row for each issue (issue_type, detail) of a JSON answer; answers that are no JSON have none. The text itself is not changed."""
    parsed = F.from_json(F.regexp_extract(answer, r"(?s)\{.*\}", 0), "is_clean boolean, issues array<struct<issue_type: string, detail: string>>")
    return answers.withColumn("issue", F.explode(parsed["issues"])).select(*[c for c in answers.columns if c != answer], "issue.*")


def scene_detail(scenes: DataFrame, lines: DataFrame, overrides: DataFrame, beside: dict[str, DataFrame] | None = None) -> DataFrame:
    """scenes with the number of their lines and of those with an override, and with the columns of the tables beside them, which have a row a scene."""
    marked = lines.select("book_id", "scene_id", "line_id").join(overrides.select("book_id", "line_id", F.lit(1).alias("o")), ["book_id", "line_id"], "left")
    per = marked.groupBy("book_id", "scene_id").agg(F.count("*").alias("lines"), F.count("o").alias("overridden"))
    out = scenes.join(per, ["book_id", "scene_id"], "left").fillna(0, ["lines", "overridden"])
    for name, table in (beside or {}).items():
        own = [F.col(c).alias(f"{name}_{c}") for c in table.columns if c not in ("book_id", "scene_id")]
        out = out.join(table.select("book_id", "scene_id", *own), ["book_id", "scene_id"], "left")
    return out


def attach_performance(lines: DataFrame, drawers: DataFrame) -> DataFrame:
    """lines with pitch_modifier and speed_modifier of drawers(character, pitch, speed), pitch in semitones; 1 where a character has none."""
    joined = lines.join(drawers.select("character", "pitch", "speed"), "character", "left")
    pitch = F.pow(F.lit(2.0), F.coalesce("pitch", F.lit(0.0)) / 12).alias("pitch_modifier")
    return joined.select(*lines.columns, pitch, F.coalesce("speed", F.lit(1.0)).alias("speed_modifier"))


def resolve_voice(requests: DataFrame, drawers: DataFrame, references: DataFrame, narrator: str, least: float = 0.65) -> DataFrame:
    """requests(request_id, character, emotion, vector) with path, speed, pitch and the rule that found them.

    The reference of the character, references(character, position, emotion, path, vector), that is nearest to the request's vector, if its cosine is above
    `least`, of equal ones the first; else the first of exactly the emotion; else the default of the character's drawer, drawers(character, default_path, speed,
    pitch); a character without a drawer has the narrator's path.
    """
    refs = references.select("character", "position", F.col("emotion").alias("r_emotion"), "path", F.col("vector").alias("r_vector"))
    joined = requests.join(refs, "character", "left")
    near = F.when(F.col("vector").isNotNull(), cosine(F.col("vector"), F.col("r_vector")))
    nearest = F.max(F.when(near > least, F.struct(near.alias("s"), (-F.col("position")).alias("p"), "path")))
    exact = F.min(F.when(F.col("emotion") == F.col("r_emotion"), F.struct("position", "path")))
    found = joined.groupBy("request_id", "character", "emotion").agg(nearest.alias("nearest"), exact.alias("exact"))
    out = found.join(drawers.select("character", "default_path", "speed", "pitch", F.lit(True).alias("known")), "character", "left")
    known = F.coalesce("known", F.lit(False))
    rule = F.when(~known, "no drawer").when(F.col("nearest").isNotNull(), "nearest").when(F.col("exact").isNotNull(), "emotion").otherwise("default")
    path = F.when(known, F.coalesce("nearest.path", "exact.path", "default_path")).otherwise(F.lit(narrator))
    return out.select("request_id", "character", path.alias("path"), F.coalesce("speed", F.lit(1.0)).alias("speed"), F.coalesce("pitch", F.lit(0.0)).alias("pitch"), rule.alias("rule"))


def missing_keys(wanted: DataFrame, known: DataFrame, key: str, known_key: str | None = None) -> DataFrame:
    """Rows of wanted whose key is not among known ones: files not yet ingested, prompts without a clip. A null key is never known."""
    return wanted.join(known.select(F.col(known_key or key).alias(key)), key, "left_anti").select(*wanted.columns)


def pair_common(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of two tables that share a key; columns of b whose names a has too get the suffix _b."""
    own = [F.col(c).alias(f"{c}_b" if c in a.columns else c) for c in b.columns if c != key]
    return a.join(b.select(key, *own), key)


def account_overview(sources: dict[str, DataFrame], renders: DataFrame, k: int = 10) -> DataFrame:
    """(owner, kind, name): what belongs to each owner by kind, and the last k renders(owner, name, at, tie). Rows without an owner are 'local' ones."""
    owner = F.coalesce(F.col("owner").cast("string"), F.lit("local")).alias("owner")
    parts = [t.select(owner, F.lit(kind).alias("kind"), F.col("name").cast("string").alias("name")) for kind, t in sources.items()]
    last = top_per_group(renders.select(owner, "name", "at", "tie"), "owner", F.desc("at"), F.desc("tie"), k=k)
    out = last.select("owner", F.lit("render").alias("kind"), F.col("name").cast("string").alias("name"))
    for p in parts:
        out = out.unionByName(p)
    return out


def voice_fingerprint(reference: Column, speaker: Column, speed: Column, pitch: Column) -> Column:
    """Eight digits that change with a voice's reference, speaker, speed or pitch; nulls count as empty."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (reference, speaker, speed, pitch)]
    return F.substring(F.sha1(F.concat_ws("|", *parts).cast("binary")), 1, 8)


def changed_voice_lines(lines: DataFrame, voices: DataFrame, cache: DataFrame) -> DataFrame:
    """lines whose character's fingerprint, of voices(character, fingerprint), is not the one in cache(line_id, fingerprint), or that are not in there."""
    return lines.join(voices.select("character", "fingerprint"), "character").join(cache.select("line_id", "fingerprint"), ["line_id", "fingerprint"], "left_anti")


def model_comparison(results: DataFrame, model: str, metric: str, value: str, metrics: list[str]) -> DataFrame:
    """A row for each model: the mean of each of `metrics` as a column, and the number of results."""
    wide = results.groupBy(model).pivot(metric, metrics).agg(F.avg(value))
    return wide.join(results.groupBy(model).agg(F.count("*").alias("n")), model)


def book_inventory(books: DataFrame, artifacts: dict[str, DataFrame], key: str = "book_id") -> DataFrame:
    """books with has_<kind> for each kind of artifact: whether the table of that kind has a row of the book."""
    kinds = None
    for kind, table in artifacts.items():
        one = table.select(key, F.lit(kind).alias("kind")).distinct()
        kinds = one if kinds is None else kinds.unionByName(one)
    wide = kinds.groupBy(key).pivot("kind", list(artifacts)).agg(F.count(F.lit(1)))
    joined = books.join(wide, key, "left")
    return joined.select(*books.columns, *[F.col(kind).isNotNull().alias(f"has_{kind}") for kind in artifacts])


def speaker_changes(lines: DataFrame, keys: list[str], order: str = "line_number") -> DataFrame:
    """lines with `changed`: whether the speaker is another than that of the line before it; true for the first."""
    before = F.lag("character").over(Window.partitionBy(*keys).orderBy(order))
    return lines.withColumn("changed", F.coalesce(before != F.col("character"), F.lit(True)))


def top_emotional_sentences(sentences: DataFrame, key: str, k: int = 5, polarity: float = 0.1, subjectivity: float = 0.3) -> DataFrame:
    """Of sentences(key, pos, polarity, subjectivity, ..) the k of each key whose polarity is farthest from 0, among those that are polar and subjective enough."""
    strong = sentences.where((F.abs("polarity") >= polarity) & (F.col("subjectivity") >= subjectivity))
    return top_per_group(strong, key, F.desc(F.abs("polarity")), F.col("pos"), k=k)


def first_candidates(rows: DataFrame, key: str, order: str, k: int = 8) -> DataFrame:
    """The first k rows of each key, in order, with their place."""
    return top_per_group(rows, key, F.col(order), k=k)


def latest_renders(renders: DataFrame, owner: str, at: str, tie: str, k: int = 10) -> DataFrame:
    """The last k renders of each owner, with their place."""
    return top_per_group(renders, owner, F.desc(at), F.desc(tie), k=k)


def union_rosters(*rosters: DataFrame) -> DataFrame:
    """The different rows of rosters with the same columns."""
    out = rosters[0]
    for r in rosters[1:]:
        out = out.unionByName(r)
    return out.distinct()


def set_parts(found: DataFrame, gold: DataFrame) -> DataFrame:
    """(part, ..): what is in both, only found, or only in the gold set; duplicates count once."""
    a, b = found.distinct(), gold.select(*found.columns).distinct()
    parts = {"both": a.intersect(b), "only_found": a.exceptAll(b), "only_gold": b.exceptAll(a)}
    out = None
    for name, rows in parts.items():
        one = rows.select(F.lit(name).alias("part"), *found.columns)
        out = one if out is None else out.unionByName(one)
    return out


def first_seen(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """Of rows with the same key the first in order; rows with a null key are one group."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__n = 1").drop("__n")


def sections_from_scenes(scenes: DataFrame, lines: DataFrame) -> DataFrame:
    """(book_id, section_id, parent_id, position, title, text_hash) of scenes(book_id, chapter, scene, scene_id): ids and parents from the scene's id, the place
    in the chapter, and the hash of the text, a blank line between lines. A scene without lines has the hash of an empty text."""
    texts = lines.groupBy("scene_id").agg(ordered_text("line_number", "text", "\n\n").alias("t"))
    n = F.row_number().over(Window.partitionBy("book_id", "chapter").orderBy("scene"))
    return scenes.join(texts, "scene_id", "left").select(
        "book_id",
        F.concat(F.lit("sec_"), "scene_id").alias("section_id"),
        F.concat(F.lit("sec_"), F.regexp_extract("scene_id", "^(.*)_s[^_]*$", 1)).alias("parent_id"),
        n.alias("position"),
        F.concat(F.lit("Scene "), n.cast("string")).alias("title"),
        F.concat(F.lit("sha256:"), F.sha2(F.coalesce("t", F.lit("")), 256)).alias("text_hash"),
    )


def ordered_text(order: str, text: str, by: str) -> Column:
    """An aggregate: the texts of a group in order, with `by` between."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), by)


def scene_text_of(sections: DataFrame, texts: DataFrame, id_col: str = "section_id") -> DataFrame:
    """(id, text) of sections(id, text, source_section_ids): its own text, else the texts(id, text) of its sources in their order, a blank line between; an empty
    one without either."""
    asked = sections.where("text IS NULL").select(id_col, F.posexplode("source_section_ids").alias("at", "source"))
    found = asked.join(texts.select(F.col(id_col).alias("source"), "text"), "source").groupBy(id_col).agg(ordered_text("at", "text", "\n\n").alias("made"))
    return sections.join(found, id_col, "left").select(id_col, F.coalesce("text", "made", F.lit("")).alias("text"))


def merge_scene_lines(lines: DataFrame, moves: DataFrame) -> DataFrame:
    """lines(book_id, scene, line_number, ..) with the scenes of moves(book_id, scene, into) moved behind the lines of the scene that they go into, and numbered again."""
    target = F.coalesce("into", "scene")
    order = Window.partitionBy("book_id", "__scene").orderBy("scene", "line_number")
    moved = lines.join(moves.select("book_id", "scene", "into"), ["book_id", "scene"], "left").withColumn("__scene", target)
    moved = moved.withColumn("__n", F.row_number().over(order))
    return moved.select(*[F.col({"scene": "__scene", "line_number": "__n"}.get(c, c)).alias(c) for c in lines.columns])


def split_scene_lines(lines: DataFrame, cuts: DataFrame) -> DataFrame:
    """lines(book_id, scene_id, line_number, line_id, ..) with scenes cut before the line that cuts(book_id, scene_id, line_id) names: what follows is a scene of
    its own, whose id is made from the hash of the old one and of the line. A cut before the first line, which would leave nothing, does nothing."""
    at = lines.join(cuts.select("book_id", "scene_id", "line_id"), ["book_id", "scene_id", "line_id"]).groupBy("book_id", "scene_id").agg(F.min(F.struct("line_number", "line_id")).alias("__cut"))
    first = lines.groupBy("book_id", "scene_id").agg(F.min("line_number").alias("__first"))
    joined = lines.join(at, ["book_id", "scene_id"], "left").join(first, ["book_id", "scene_id"])
    after = F.coalesce((F.col("line_number") >= F.col("__cut.line_number")) & (F.col("__cut.line_number") > F.col("__first")), F.lit(False))
    name = F.concat("scene_id", F.lit("_"), F.substring(F.sha1(F.concat_ws("|", "scene_id", "__cut.line_id").cast("binary")), 1, 8))
    out = joined.withColumn("__scene", F.when(after, name).otherwise(F.col("scene_id")))
    out = out.withColumn("__n", F.row_number().over(Window.partitionBy("book_id", "__scene").orderBy("line_number")))
    return out.select(*[F.col({"scene_id": "__scene", "line_number": "__n"}.get(c, c)).alias(c) for c in lines.columns])
