"""Timelines, usage, evaluation, voices and clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkbooks.functions.text import words
from sparkbooks.operators import fuzzy
from sparkbooks.operators.stats import percent

# Seconds a word takes when it is not rendered yet, the least line, and the pause after a chapter in ms.
SECONDS_A_WORD, LEAST_SECONDS, CHAPTER_PAUSE = 0.42, 1.0, 1500


def timeline(lines: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """Lines with start and end in seconds in their scope: durations and paddings of the lines before. Lines without a duration are estimated."""
    estimate = F.greatest(F.lit(LEAST_SECONDS), words(F.col("text")) * SECONDS_A_WORD)
    timed = lines.withColumn("estimated", F.col("duration").isNull()).withColumn("duration", F.coalesce("duration", estimate))
    before = Window.partitionBy(*scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("duration") + F.col("post_padding_ms") / 1000.0).over(before), F.lit(0.0))
    return timed.withColumn("start", start).withColumn("end", F.col("start") + F.col("duration"))


def chapter_marks(lines: DataFrame) -> DataFrame:
    """(book_id, chapter, start, end): each chapter's place in its book's time, with a pause after its last line.

    Summed per chapter first, then over the few chapters, so no task orders a whole book's lines.
    """
    seconds = F.coalesce("duration", F.greatest(F.lit(LEAST_SECONDS), words(F.col("text")) * SECONDS_A_WORD)) + F.col("post_padding_ms") / 1000.0
    per = lines.groupBy("book_id", "chapter").agg((F.sum(seconds) + CHAPTER_PAUSE / 1000.0).alias("s"))
    order = Window.partitionBy("book_id").orderBy("chapter")
    start = F.coalesce(F.sum("s").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return per.withColumn("start", start).withColumn("end", F.col("start") + F.col("s")).drop("s")


def anchored(events: DataFrame, timed: DataFrame, overrides: DataFrame, scope: list[str]) -> DataFrame:
    """Events (.., key, line_number) at the ends of their lines; overrides (key, mute, gain_db, nudge_s) drop, add to the gain, or move, not below 0."""
    at = events.join(timed.select(*scope, "line_number", "end"), [*scope, "line_number"])
    out = at.join(overrides.select("key", "mute", F.col("gain_db").alias("__g"), "nudge_s"), "key", "left").where(~F.coalesce("mute", F.lit(False)))
    start = F.greatest(F.lit(0.0), F.col("end") + F.coalesce("nudge_s", F.lit(0.0)))
    return out.select(*scope, "key", "line_number", start.alias("start"), (F.col("gain_db") + F.coalesce("__g", F.lit(0.0))).alias("gain_db"))


def anchored_by_text(cues: DataFrame, timed: DataFrame, scope: list[str], first: int = 30) -> DataFrame:
    """(scope, key, line_number, start, gain_db): cues (scope, key, sound_text, gain_db) without a line number, at the end of the first line that holds the first
    characters of their text, or at 0 where none does. Cues whose whole text a line of dialogue holds are speech, and left out.

    Case and white space make no difference. Lines are looked up by the rarest pair of characters of a cue, as a line that holds the text has that pair too. A text of one
    character or none meets all lines of its scope; null texts are as empty, which the first line holds.
    """
    flat = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+", " ")
    c = cues.select(*scope, "key", "gain_db", flat(F.col("sound_text")).alias("cue")).withColumn("head", F.substring("cue", 1, first))
    t = timed.select(*scope, "line_number", "end", (F.col("segment_type") == "dialogue").alias("said"), flat(F.col("text")).alias("line"))
    index = fuzzy.indexed(t, scope, "line_number", "line")
    rare = fuzzy.rarest(c, index, scope, "key", "head").where("turn = 1").select(*scope, "key", "pair")
    met = rare.unionByName(c.where("length(head) < 2").select(*scope, "key", F.lit(None).cast("string").alias("pair"))).alias("a")
    on = [F.col(f"a.{k}") == F.col(f"i.{k}") for k in scope] + [F.col("a.pair").eqNullSafe(F.col("i.pair"))]
    met = met.join(index.alias("i"), on).select(*[F.col(f"a.{k}") for k in scope], "key", "line_number")
    seen = met.join(c, [*scope, "key"]).join(t, [*scope, "line_number"]).where(F.contains("line", "head"))
    speech = F.bool_or(F.col("said") & F.contains("line", "cue"))
    place = seen.groupBy(*scope, "key").agg(F.min(F.struct("line_number", "end")).alias("at"), speech.alias("speech"))
    out = c.join(place, [*scope, "key"], "left").where(~F.coalesce("speech", F.lit(False)))
    return out.select(*scope, "key", F.col("at.line_number").alias("line_number"), F.coalesce("at.end", F.lit(0.0)).alias("start"), "gain_db")


def music_segments(events: DataFrame, scope: str, total: Column, collapse: float = 1.0) -> DataFrame:
    """Segments (scope, start, end, style) from events (scope, t, action, style, total): change and resume begin one, stop ends it.

    An event within `collapse` seconds of the start of the segment that is open replaces its style. This depends on the last bound that was kept,
    so it is a fold over a scope's few events.
    """
    ordered = F.array_sort(F.collect_list(F.struct("t", "action", "style")))
    per = events.groupBy(scope).agg(ordered.alias("e"), F.max(total).alias("total"))
    empty = "cast(array() as array<struct<start: double, style: string>>)"
    fold = f"""aggregate(e, {empty}, (acc, x) -> CASE
        WHEN size(acc) > 0 AND x.t - element_at(acc, -1).start < {collapse}
          THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'style', if(x.action = 'stop', cast(null as string), x.style))))
        ELSE concat(acc, array(named_struct('start', cast(x.t as double), 'style', if(x.action = 'stop', cast(null as string), x.style)))) END)"""
    bounds = per.select(scope, "total", F.expr(fold).alias("all")).select("*", F.posexplode("all").alias("i", "b"))
    end = F.coalesce(F.expr("try_element_at(all, i + 2).start"), F.col("total"))
    return bounds.select(scope, F.col("b.start").alias("start"), end.alias("end"), F.col("b.style").alias("style")).where("style IS NOT NULL AND end > start")


def usage_summary(audit: DataFrame, scope: str = "book") -> DataFrame:
    """Calls, successes, success rate and first and last time: for each scope, and in it by provider and by task, as one pass of grouping sets."""
    rate = F.round(F.sum(F.col("success").cast("long")) / F.count("*"), 3)
    grouped = audit.groupingSets([[F.col(scope)], [F.col(scope), F.col("provider")], [F.col(scope), F.col("task")]], scope, "provider", "task")
    return grouped.agg(F.count("*").alias("calls"), F.sum(F.col("success").cast("long")).alias("successes"), rate.alias("success_rate"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def provider_outcomes(audit: DataFrame, since: Column) -> DataFrame:
    outcome = F.concat_ws(":", "provider", F.when(F.col("success"), "ok").otherwise("fail"))
    return audit.where(F.col("ts") >= since).groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def daily_quota(audit: DataFrame, limit: int) -> DataFrame:
    """Calls of each provider on each day against a limit."""
    per = audit.groupBy("provider", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("used"))
    return per.select("provider", F.col("w.start").alias("day"), "used", (F.col("used") > limit).alias("over"))


def perf_summary(results: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, interpolated median, sample deviation (0 for one row) and number of the times of each kind, rounded to four places."""
    r = lambda c: F.round(c, 4)
    return results.groupBy(*keys).agg(
        r(F.avg("time")).alias("mean"), r(F.percentile("time", F.lit(0.5))).alias("median"), r(F.coalesce(F.stddev_samp("time"), F.lit(0.0))).alias("std"), F.count("*").alias("n")
    )


def scores(found: DataFrame, gold: DataFrame, keys: list[str], item: str) -> DataFrame:
    """True and false positives and false negatives of sets of items for each key, with precision, recall and F1; 0 where a ratio has no base."""
    a = found.select(*keys, item).distinct().withColumn("f", F.lit(1))
    b = gold.select(*keys, item).distinct().withColumn("g", F.lit(1))
    per = a.join(b, [*keys, item], "full").groupBy(*keys).agg(
        F.sum(F.when(F.col("f").isNotNull() & F.col("g").isNotNull(), 1).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("g").isNull(), 1).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("f").isNull(), 1).otherwise(0)).alias("fn"),
    )
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    per = per.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return per.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def macro_average(scored: DataFrame, keys: list[str], *metrics: str) -> DataFrame:
    return scored.groupBy(*keys).agg(*[F.round(F.coalesce(F.avg(m), F.lit(0.0)), 6).alias(m) for m in metrics])


def merge_chunk_results(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Results of chunks (.., chunk, pos, item, seconds, chars) as one row for each key: total time, the distinct items in the order first seen, and speed."""
    first = chunks.groupBy(*keys, "item").agg(F.min(F.struct("chunk", "pos")).alias("at"))
    items = first.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "item"))), lambda x: x["item"]), "|").alias("items"))
    time = chunks.select(*keys, "chunk", "seconds", "chars").distinct().groupBy(*keys).agg(F.sum("seconds").alias("seconds"), F.sum("chars").alias("chars"))
    return time.join(items, keys).withColumn("chars_per_second", F.when(F.col("seconds") > 0, F.round(F.col("chars") / F.col("seconds"), 4)).otherwise(0.0))


def metric_stats(rows: DataFrame, metrics: list[str], keys: list[str] | None = None) -> DataFrame:
    """Mean, population deviation, least and largest of each metric."""
    long = rows.unpivot(keys or [], metrics, "metric", "value")
    return long.groupBy(*(keys or []), "metric").agg(
        F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"), F.min("value").alias("min"), F.max("value").alias("max")
    )


def zscores(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(x - mean) / (deviation + 1e-8) by the key's statistics."""
    stats = rows.groupBy(key).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    return rows.join(stats, key).withColumn("z", (F.col(value) - F.col("__m")) / (F.col("__s") + 1e-8)).drop("__m", "__s")


def take_until(rows: DataFrame, scope: list[str], order: list[Column], amount: str, enough: float) -> DataFrame:
    """Rows in order until those before them have `enough` in sum."""
    before = Window.partitionBy(*scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("__b", F.coalesce(F.sum(amount).over(before), F.lit(0.0))).where(F.col("__b") < enough).drop("__b")


def latest_progress(progress: DataFrame) -> DataFrame:
    """The last row of each book and stage, with the percentage."""
    pct = percent(F.col("current"), F.col("total"))
    last = progress.groupBy("book", "stage").agg(F.max_by(F.struct("current", "total", "updated_at"), F.struct("updated_at", "current")).alias("l"))
    return last.select("book", "stage", "l.current", "l.total", "l.updated_at").withColumn("pct", pct)


def onboarded(listings: DataFrame, samples: DataFrame, least_seconds: float = 6.0) -> DataFrame:
    """Listings with their seconds of samples and why they are rejected, if they are: consent, no samples, or too short."""
    per = samples.groupBy("voice_id").agg(F.sum("seconds").alias("seconds"))
    out = listings.join(per, "voice_id", "left")
    reason = F.when(~F.col("consent"), "no consent").when(F.col("seconds").isNull(), "no samples").when(F.col("seconds") < least_seconds, "too short")
    return out.withColumn("reason", reason).withColumn("listing_id", F.substring(F.sha2(F.col("voice_id").cast("string"), 256), 1, 12))


def acx_compliance(clips: DataFrame, samples: str = "samples", peak_limit: float = -3.0) -> DataFrame:
    """Peak and RMS in dB of full scale, -100 when silent, and whether they are in the audiobook range."""
    peak = F.array_max(F.transform(samples, lambda x: F.abs(x.cast("double"))))
    square = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rms = F.sqrt(square / F.size(samples))
    decibel = lambda x: F.when(x > 0, F.greatest(F.lit(-100.0), 20 * F.log10(x))).otherwise(-100.0)
    out = clips.withColumn("peak_db", decibel(peak)).withColumn("rms_db", decibel(rms))
    return out.withColumn("passes", F.col("rms_db").between(-23.0, -18.0) & (F.col("peak_db") <= peak_limit))


def roomtone_check(clips: DataFrame, samples: str = "samples", floor: float = -45.0) -> DataFrame:
    rms = acx_compliance(clips, samples)
    return rms.withColumn("verdict", F.when(F.col("rms_db") < floor, "PASS").otherwise("FLAG"))


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null where a vector has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.nullif(dot(a, b), F.lit(None)) / F.sqrt(dot(a, a)) / F.sqrt(dot(b, b))


def render_script(lines: DataFrame) -> DataFrame:
    """Each scene as a script: a speaker's header where the speaker changes, vocalizations marked."""
    order = Window.partitionBy("scene_id").orderBy("line_number")
    changed = F.coalesce(F.lag("character").over(order) != F.col("character"), F.lit(True))
    said = F.concat(F.col("text"), F.when(F.col("utterance_type") == "vocalization", " [vocalization]").otherwise(""))
    shown = F.concat(F.when(changed, F.concat(F.upper("character"), F.lit("\n"))).otherwise(""), said)
    per = lines.withColumn("shown", shown).groupBy("scene_id").agg(F.array_sort(F.collect_list(F.struct("line_number", "shown"))).alias("l"))
    return per.select("scene_id", F.array_join(F.transform("l", lambda x: x.shown), "\n").alias("script"))


def export_script(lines: DataFrame, scenes: DataFrame, tier: int) -> DataFrame:
    """Each book as one text: chapter and scene headers in order; tier 2 names the speakers; omitted scenes are out."""
    kept = lines.join(scenes.where("omit").select("book_id", "scene_id"), ["book_id", "scene_id"], "left_anti")
    said = F.concat(F.lit("["), "character", F.lit("] "), "text") if tier == 2 else F.col("text")
    body = kept.select("book_id", F.struct("chapter", "scene", F.lit(2).alias("k"), "line_number", said.alias("t")).alias("r"))
    heads = kept.select("book_id", "chapter", "scene").distinct()
    scene = heads.select("book_id", F.struct("chapter", "scene", F.lit(1).alias("k"), F.lit(0).cast("long").alias("line_number"), F.concat(F.lit("Scene "), F.col("scene").cast("string")).alias("t")).alias("r"))
    chapter = heads.groupBy("book_id", "chapter").agg(F.min("scene").alias("scene")).select(
        "book_id", F.struct("chapter", "scene", F.lit(0).alias("k"), F.lit(0).cast("long").alias("line_number"), F.concat(F.lit("CHAPTER "), F.col("chapter").cast("string")).alias("t")).alias("r")
    )
    all_ = body.unionByName(scene).unionByName(chapter).groupBy("book_id").agg(F.array_sort(F.collect_list("r")).alias("r"))
    return all_.select("book_id", F.array_join(F.transform("r", lambda x: x.t), "\n").alias("script"))
