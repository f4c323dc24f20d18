"""Queries of timelines, usage, evaluation and voices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkbooks.operators import catalog as ct
from sparkbooks.operators import neighbours as nb
from sparkbooks.operators import production as pr
from sparkbooks.plans.registry import query

_DUR = "CASE WHEN line_number % 3 = 0 THEN length(text) / 20.0::DOUBLE END"
_EST = "greatest(1.0::DOUBLE, len(regexp_extract_all(text, '\\S+')) * 0.42::DOUBLE)"
_TIMED = f"""t AS (SELECT *, {_DUR} IS NULL AS estimated, coalesce({_DUR}, {_EST}) AS duration FROM lines),
u AS (SELECT *, coalesce(sum(duration + post_padding_ms / 1000.0::DOUBLE) OVER (PARTITION BY scene_id ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS start FROM t)"""


def with_durations(lines: DataFrame) -> DataFrame:
    """Every third line is rendered."""
    return lines.withColumn("duration", F.when(F.col("line_number") % 3 == 0, F.length("text") / 20.0))


@query("W3_timeline_offsets", "lines", sql=f'WITH {_TIMED} SELECT line_id, round(start, 6) AS start, round(start + duration, 6) AS "end", estimated FROM u')
def w3(lines: DataFrame) -> DataFrame:
    out = pr.timeline(with_durations(lines), ["scene_id"], ["line_number"])
    return out.select("line_id", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "estimated")


@query(
    "W4_chapter_marks", "lines",
    sql=f"""WITH {_TIMED}, c AS (SELECT book_id, chapter, sum(duration + post_padding_ms / 1000.0::DOUBLE) + 1.5 AS s FROM t GROUP BY ALL)
            SELECT book_id, chapter, round(coalesce(sum(s) OVER w, 0.0), 6) AS start, round(coalesce(sum(s) OVER w, 0.0) + s, 6) AS "end" FROM c WINDOW w AS (PARTITION BY book_id ORDER BY chapter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def w4(lines: DataFrame) -> DataFrame:
    return pr.chapter_marks(with_durations(lines)).select("book_id", "chapter", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query(
    "J13_anchor_events_to_timeline", "lines",
    sql=f"""WITH {_TIMED} SELECT line_id AS key, scene_id, line_number, round(greatest(0.0, start + duration + CASE WHEN line_number % 4 = 1 THEN -3.5 ELSE 0.0 END), 6) AS start,
              CASE WHEN line_number % 4 = 1 THEN -8.0::DOUBLE ELSE -6.0 END AS gain_db FROM u WHERE line_number % 2 = 1 AND NOT (line_number % 4 = 1 AND scene % 5 = 0)""",
)
def j13(lines: DataFrame) -> DataFrame:
    """Sounds after every other line; of each second the gain, place, or in some scenes the sound itself is overridden."""
    timed = pr.timeline(with_durations(lines), ["scene_id"], ["line_number"])
    events = lines.where("line_number % 2 = 1").select("scene_id", F.col("line_id").alias("key"), "line_number", F.lit(-6.0).alias("gain_db"))
    overrides = lines.where("line_number % 4 = 1").select(F.col("line_id").alias("key"), (F.col("scene") % 5 == 0).alias("mute"), F.lit(-2.0).alias("gain_db"), F.lit(-3.5).alias("nudge_s"))
    return pr.anchored(events, timed, overrides, ["scene_id"]).withColumn("start", F.round("start", 6))


_FLAT = "regexp_replace(lower({}), '[\\s\\x1c-\\x1f\\x85\\p{{Z}}]+', ' ', 'g')"


@query(
    "J13_anchor_by_text", "lines",
    sql=f"""WITH {_TIMED}, c AS (SELECT scene_id, line_id AS key, {_FLAT.format("concat(substring(text, 4, 40 - 38 * (line_number % 3 = 0)::INTEGER), CASE WHEN line_number % 4 = 2 THEN ' and a bang' ELSE '' END)")} AS cue FROM lines),
            l AS (SELECT scene_id, line_number, start + duration AS "end", segment_type = 'dialogue' AS said, {_FLAT.format("text")} AS line FROM u),
            m AS (SELECT scene_id, key, min(line_number) AS line_number, arg_min("end", line_number) AS "end", bool_or(said AND contains(line, cue)) AS speech
                  FROM c JOIN l USING (scene_id) WHERE contains(line, substring(cue, 1, 30)) GROUP BY ALL)
            SELECT key, scene_id, line_number, round(coalesce("end", 0), 6) AS start, -6.0::DOUBLE AS gain_db FROM c LEFT JOIN m USING (scene_id, key) WHERE NOT coalesce(speech, FALSE)""",
)
def j13_text(lines: DataFrame) -> DataFrame:
    """Cues that quote a line from its fourth character on; some go on otherwise than the line, some are two characters long."""
    text = F.expr("concat(substring(text, 4, 40 - 38 * int(line_number % 3 = 0)), CASE WHEN line_number % 4 = 2 THEN ' and a bang' ELSE '' END)")
    cues = lines.select("scene_id", F.col("line_id").alias("key"), text.alias("sound_text"), F.lit(-6.0).alias("gain_db"))
    timed = pr.timeline(with_durations(lines), ["scene_id"], ["line_number"])
    return pr.anchored_by_text(cues, timed, ["scene_id"]).withColumn("start", F.round("start", 6))


@query("W7_music_segments", "lines", sql=f"""
WITH RECURSIVE {_TIMED},
x AS (SELECT scene_id, start + duration AS t0, ['change', 'stop', 'resume'][length(text) % 3 + 1] AS action, emotion AS style FROM u),
e AS (SELECT *, CASE WHEN action = 'stop' THEN NULL ELSE style END AS own, row_number() OVER (PARTITION BY scene_id ORDER BY t0, action, style) AS n FROM x),
r AS (SELECT scene_id, n, t0 AS start, own, 1 AS b FROM e WHERE n = 1
      UNION ALL SELECT e.scene_id, e.n, CASE WHEN e.t0 - r.start < 1 THEN r.start ELSE e.t0 END, e.own, CASE WHEN e.t0 - r.start < 1 THEN r.b ELSE r.b + 1 END
      FROM r JOIN e ON e.scene_id = r.scene_id AND e.n = r.n + 1),
l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY scene_id, b ORDER BY n DESC) = 1),
s AS (SELECT scene_id, start, coalesce(lead(start) OVER (PARTITION BY scene_id ORDER BY b), (SELECT max(t0) FROM e WHERE e.scene_id = l.scene_id)) AS "end", own AS style FROM l)
SELECT scene_id, round(start, 6) AS start, round("end", 6) AS "end", style FROM s WHERE style IS NOT NULL AND "end" > start""")
def w7(lines: DataFrame) -> DataFrame:
    timed = pr.timeline(with_durations(lines), ["scene_id"], ["line_number"])
    total = timed.groupBy("scene_id").agg(F.max("end").alias("total"))
    action = F.element_at(F.array(F.lit("change"), F.lit("stop"), F.lit("resume")), (F.length("text") % 3 + 1).cast("int"))
    events = timed.join(total, "scene_id").select("scene_id", F.col("end").alias("t"), action.alias("action"), F.col("emotion").alias("style"), "total")
    found = pr.music_segments(events, "scene_id", F.col("total"))
    return found.withColumns({c: F.round(c, 6) for c in ("start", "end")})


@query(
    "A11_usage_summary", "audit",
    sql="""SELECT book, provider, task, count(*) AS calls, sum(success::INTEGER)::BIGINT AS successes, round(sum(success::INTEGER)::DOUBLE / count(*), 3) AS success_rate, min(ts) AS first, max(ts) AS last
           FROM audit GROUP BY GROUPING SETS ((book), (book, provider), (book, task))""",
)
def a11(audit: DataFrame) -> DataFrame:
    return pr.usage_summary(audit)


@query(
    "A12_provider_outcomes", "audit",
    sql="SELECT provider || ':' || CASE WHEN success THEN 'ok' ELSE 'fail' END AS outcome, count(*) AS n FROM audit WHERE ts >= TIMESTAMP '2024-01-03' GROUP BY ALL",
)
def a12(audit: DataFrame) -> DataFrame:
    return pr.provider_outcomes(audit, F.to_timestamp(F.lit("2024-01-03 00:00:00")))


@query("R2_daily_quota_used", "audit", sql="SELECT provider, date_trunc('day', ts) AS day, count(*) AS used, count(*) > 100 AS over FROM audit GROUP BY ALL")
def r2(audit: DataFrame) -> DataFrame:
    return pr.daily_quota(audit, 100)


@query(
    "A14_perf_summary", "audit",
    sql="SELECT task, provider, round(avg(latency_ms), 4) AS mean, round(quantile_cont(latency_ms, 0.5), 4) AS median, round(coalesce(stddev_samp(latency_ms), 0), 4) AS std, count(*) AS n FROM audit GROUP BY ALL",
)
def a14(audit: DataFrame) -> DataFrame:
    return pr.perf_summary(audit.withColumn("time", F.col("latency_ms")), ["task", "provider"])


_SCORES = """p AS (SELECT lang, doc_id, n_chars > 1500 AS f FROM documents), s AS (
  SELECT lang, sum((f AND quality = 1)::INTEGER)::BIGINT AS tp, sum((f AND quality IS DISTINCT FROM 1)::INTEGER)::BIGINT AS fp, sum((NOT f AND quality = 1)::INTEGER)::BIGINT AS fn
  FROM p LEFT JOIN labels USING (doc_id) WHERE f OR quality = 1 GROUP BY lang),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0.0 END AS recall FROM s),
k AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM r)"""


def quality_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    found = documents.where("n_chars > 1500").select("lang", "doc_id")
    gold = documents.join(labels.where("quality = 1"), "doc_id").select("lang", "doc_id")
    return pr.scores(found, gold, ["lang"], "doc_id")


@query("A15_precision_recall_f1", "documents", "labels", sql=f"WITH {_SCORES} SELECT * FROM k")
def a15(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Long documents as a guess at good ones, by language."""
    return quality_scores(documents, labels)


@query("A16_macro_average", "documents", "labels", sql=f"WITH {_SCORES} SELECT 'quality' AS task, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM k")
def a16(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return pr.macro_average(quality_scores(documents, labels).withColumn("task", F.lit("quality")), ["task"], "precision", "recall", "f1")


@query(
    "A17_merge_chunk_results", "documents",
    sql="""WITH c AS (SELECT doc_id, unnest(range(greatest(0, ceil((length(text) - 2000) / 1800.0))::BIGINT + 1)) AS chunk, text FROM documents),
           w AS (SELECT doc_id, chunk, length(text[chunk * 1800 + 1 : chunk * 1800 + 2000]) AS chars, regexp_extract_all(text[chunk * 1800 + 1 : chunk * 1800 + 2000], '[A-Z][a-z]+') AS n FROM c),
           i AS (SELECT doc_id, chunk, unnest(range(len(n))) AS pos, unnest(n) AS item FROM w), f AS (SELECT doc_id, item, min((chunk, pos)) AS first_at FROM i GROUP BY ALL),
           t AS (SELECT doc_id, sum(chars) AS chars, sum((chunk + 1) / 4.0::DOUBLE) AS seconds FROM w WHERE len(n) > 0 GROUP BY doc_id)
           SELECT doc_id, seconds, chars::BIGINT AS chars, items, round(chars / seconds, 4) AS chars_per_second FROM t JOIN (SELECT doc_id, string_agg(item, '|' ORDER BY first_at, item) AS items FROM f GROUP BY doc_id) USING (doc_id)""",
)
def a17(documents: DataFrame) -> DataFrame:
    """Capitalised words of overlapping chunks, merged to documents."""
    from sparkbooks.operators.lines import fixed_overlap_chunks

    chunks = fixed_overlap_chunks(documents.select("doc_id", "text"), size=2000, overlap=200)
    items = chunks.select(
        "doc_id", "chunk", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0))).alias("pos", "item"),
        ((F.col("chunk") + 1) / 4.0).alias("seconds"), F.length("text").cast("long").alias("chars"),
    )
    return pr.merge_chunk_results(items, ["doc_id"])


@query(
    "A23_metric_stats", "lineitem",
    sql="""SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max FROM (UNPIVOT (SELECT l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME metric VALUE value) GROUP BY metric""",
)
def a23(lineitem: DataFrame) -> DataFrame:
    return pr.metric_stats(lineitem, ["l_quantity", "l_discount", "l_tax"])


@query(
    "A24_model_comparison", "audit",
    sql="""SELECT provider, round(avg(latency_ms) FILTER (task = 'click'), 6) AS click, round(avg(latency_ms) FILTER (task = 'view'), 6) AS "view", count(*) AS n FROM audit GROUP BY provider""",
)
def a24(audit: DataFrame) -> DataFrame:
    """Mean latency of each provider by task, as columns, and calls."""
    return ct.model_comparison(audit, "provider", "task", "latency_ms", ["click", "view"]).select("provider", F.round("click", 6).alias("click"), F.round("view", 6).alias("view"), "n")


@query(
    "A26_book_inventory", "lines", "overrides",
    sql="""SELECT book_id, count(DISTINCT scene_id) AS scenes, TRUE AS has_lines, book_id IN (SELECT book_id FROM overrides) AS has_overrides FROM lines GROUP BY book_id""",
)
def a26(lines: DataFrame, overrides: DataFrame) -> DataFrame:
    scenes = lines.groupBy("book_id").agg(F.countDistinct("scene_id").alias("scenes"))
    return ct.book_inventory(scenes, {"lines": lines, "overrides": overrides})


@query(
    "W11_pick_reference_clips", "events",
    sql="""SELECT event_id FROM (SELECT event_id, coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY event_type, value DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM events) WHERE b < 180""",
)
def w11(events: DataFrame) -> DataFrame:
    return pr.take_until(events, ["user_id"], [F.col("event_type"), F.desc("value"), F.col("event_id")], "value", 180.0).select("event_id")


@query(
    "W12_latest_progress", "events",
    sql="""SELECT book, stage, arg_max(current, (updated_at, current)) AS current, 100 AS total, max(updated_at) AS updated_at, round(arg_max(current, (updated_at, current)) * 100.0::DOUBLE / 100, 1) AS pct
           FROM (SELECT user_id AS book, event_type AS stage, event_id % 100 AS current, ts AS updated_at FROM events) GROUP BY ALL""",
)
def w12(events: DataFrame) -> DataFrame:
    rows = events.select(F.col("user_id").alias("book"), F.col("event_type").alias("stage"), (F.col("event_id") % 100).alias("current"), F.lit(100).alias("total"), F.col("ts").alias("updated_at"))
    return pr.latest_progress(rows)


@query(
    "V2_cosine_top_k", "embeddings",
    sql="""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
           s AS (SELECT q.vec_id AS query, l.vec_id AS id, list_inner_product(q.v, l.v) / sqrt(list_inner_product(q.v, q.v)) / sqrt(list_inner_product(l.v, l.v)) AS similarity FROM e q JOIN e l ON q.vec_id % 20 = 0)
           SELECT query, id, round(similarity, 9) AS similarity, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS place FROM s) WHERE place <= 5""",
)
def v2(embeddings: DataFrame) -> DataFrame:
    """The five nearest of all vectors to every vector whose id is divisible by 20."""
    return nb.cosine_top_k(embeddings.where("vec_id % 20 = 0"), embeddings, 5).withColumn("similarity", F.round("similarity", 9))


@query(
    "K3_voice_search", "embeddings",
    sql="""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
           s AS (SELECT q.vec_id AS query, l.vec_id, l.label, list_inner_product(q.v, l.v) / sqrt(list_inner_product(q.v, q.v)) / sqrt(list_inner_product(l.v, l.v)) AS score FROM e q JOIN e l ON q.vec_id % 20 = 0),
           t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, vec_id) AS place FROM s)
           SELECT query, vec_id, round(score, 9) AS score, place::INTEGER AS place, label, 'voice ' || vec_id AS voice_name FROM t WHERE place <= 5""",
)
def k3(embeddings: DataFrame) -> DataFrame:
    """A marketplace of all vectors, asked for five voices by every vector whose id is divisible by 20."""
    voices = embeddings.withColumn("voice_name", F.concat(F.lit("voice "), F.col("vec_id").cast("string")))
    return nb.voice_search(embeddings.where("vec_id % 20 = 0"), voices, 5, "vec_id", pivots=64).withColumn("score", F.round("score", 9))


@query(
    "V3_cast_characters", "embeddings",
    sql="""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
           s AS (SELECT q.vec_id AS query, l.vec_id AS id, list_inner_product(q.v, l.v) / sqrt(list_inner_product(q.v, q.v)) / sqrt(list_inner_product(l.v, l.v)) AS similarity FROM e q JOIN e l ON q.vec_id % 20 = 0),
           t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS place FROM s)
           SELECT query AS character, min_by(id, place) AS voice_id, sha256(query || '|' || min_by(id, place))[1:12] AS license_id FROM t WHERE place <= 3 AND id % 3 > 0 GROUP BY query""",
)
def v3(embeddings: DataFrame) -> DataFrame:
    """Characters get the best of their three nearest voices whose reference exists, and a licence row."""
    found = nb.cosine_top_k(embeddings.where("vec_id % 20 = 0"), embeddings, 3, pivots=16).where("id % 3 > 0")
    best = found.groupBy(F.col("query").alias("character")).agg(F.min_by("id", "place").alias("voice_id"))
    licence = F.substring(F.sha2(F.concat_ws("|", F.col("character").cast("string"), F.col("voice_id").cast("string")), 256), 1, 12)
    return best.withColumn("license_id", licence)


@query(
    "V4_onboard_listings", "supplier", "lineitem",
    sql="""WITH s AS (SELECT l_suppkey AS k, sum(CASE WHEN l_quantity < 3 THEN l_quantity ELSE 0.25 END) AS seconds FROM lineitem GROUP BY 1)
           SELECT s_suppkey AS voice_id, seconds, CASE WHEN s_suppkey % 4 = 0 THEN 'no consent' WHEN seconds IS NULL THEN 'no samples' WHEN seconds < 6 THEN 'too short' END AS reason, sha256(s_suppkey::VARCHAR)[1:12] AS listing_id FROM supplier LEFT JOIN s ON k = s_suppkey""",
)
def v4(supplier: DataFrame, lineitem: DataFrame) -> DataFrame:
    listings = supplier.select(F.col("s_suppkey").alias("voice_id"), (F.col("s_suppkey") % 4 != 0).alias("consent"))
    samples = lineitem.select(F.col("l_suppkey").alias("voice_id"), F.expr("CASE WHEN l_quantity < 3 THEN l_quantity ELSE 0.25 END").alias("seconds"))
    return pr.onboarded(listings, samples).select("voice_id", "seconds", "reason", "listing_id")


_LOUD = """SELECT vec_id, CASE WHEN p > 0 THEN greatest(-100.0, 20 * log10(p)) ELSE -100.0 END AS peak_db, CASE WHEN q > 0 THEN greatest(-100.0, 10 * log10(q)) ELSE -100.0 END AS rms_db
FROM (SELECT vec_id, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS p, list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding) AS q FROM embeddings)"""


@query("V7_acx_compliance", "embeddings", sql=f"SELECT vec_id, round(peak_db, 6) AS peak_db, round(rms_db, 6) AS rms_db, rms_db BETWEEN -23 AND -18 AND peak_db <= -3 AS passes FROM ({_LOUD})")
def v7(embeddings: DataFrame) -> DataFrame:
    """Vectors taken as samples."""
    out = pr.acx_compliance(embeddings, "embedding")
    return out.select("vec_id", F.round("peak_db", 6).alias("peak_db"), F.round("rms_db", 6).alias("rms_db"), "passes")


@query("V6_roomtone_check", "embeddings", sql=f"SELECT vec_id, CASE WHEN rms_db < -45 THEN 'PASS' ELSE 'FLAG' END AS verdict FROM ({_LOUD})")
def v6(embeddings: DataFrame) -> DataFrame:
    return pr.roomtone_check(embeddings, "embedding").select("vec_id", "verdict")


@query(
    "V8_zscore_features", "embeddings",
    sql="""WITH f AS (SELECT vec_id, unnest(range(len(embedding)))::INTEGER AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)
           SELECT vec_id, dim, round((x - avg(x) OVER w) / (stddev_pop(x) OVER w + 1e-8), 6) AS z FROM f WINDOW w AS (PARTITION BY dim)""",
)
def v8(embeddings: DataFrame) -> DataFrame:
    long = embeddings.select("vec_id", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    return pr.zscores(long, "dim", "x").select("vec_id", "dim", F.round("z", 6).alias("z"))


@query(
    "S11_render_production_script", "lines",
    sql="""WITH c AS (SELECT *, coalesce(lag(character) OVER (PARTITION BY scene_id ORDER BY line_number) != character, TRUE) AS changed FROM lines)
           SELECT scene_id, string_agg(CASE WHEN changed THEN upper(character) || chr(10) ELSE '' END || text || CASE WHEN utterance_type = 'vocalization' THEN ' [vocalization]' ELSE '' END, chr(10) ORDER BY line_number) AS script FROM c GROUP BY scene_id""",
)
def s11(lines: DataFrame) -> DataFrame:
    return pr.render_script(lines)


@query(
    "S10_export_script", "lines", "scenes",
    sql="""WITH k AS (SELECT l.* FROM lines l JOIN scenes s USING (book_id, scene_id) WHERE NOT omit), r AS (
             SELECT book_id, chapter, scene, 2 AS k, line_number AS n, '[' || character || '] ' || text AS t FROM k UNION ALL SELECT DISTINCT book_id, chapter, scene, 1, 0, 'Scene ' || scene FROM k
             UNION ALL SELECT book_id, chapter, min(scene), 0, 0, 'CHAPTER ' || chapter FROM k GROUP BY book_id, chapter)
           SELECT book_id, string_agg(t, chr(10) ORDER BY chapter, scene, k, n) AS script FROM r GROUP BY book_id""",
)
def s10(lines: DataFrame, scenes: DataFrame) -> DataFrame:
    return pr.export_script(lines, scenes, tier=2)
