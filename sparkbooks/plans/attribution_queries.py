"""Queries of attribution and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkbooks.operators import attribution as at
from sparkbooks.operators import lines as ln
from sparkbooks.plans.registry import query
from sparkbooks.sources.shared import shared_path


def _quoted(text: str) -> str:
    return text.replace("'", "''")


#: DuckDB tells words apart by ASCII alone, so other letters are shown to it as underscores; names have none.
_ASCII = r"regexp_replace(text, '[\x{00C0}-\x{1FFF}\x{2C00}-\x{D7FF}\x{F900}-\x{FFEF}]', '_', 'g')"


@query("A1_global_roster", "documents", sql=rf"""
WITH t AS (SELECT doc_id, {_ASCII} AS t FROM documents),
h AS (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(t, '{_quoted(at.HONORIFIC)}')), '\s+', ' ', 'g') AS name FROM t
      UNION ALL SELECT doc_id, regexp_replace(unnest(regexp_extract_all(t, '{_quoted(at.TITLED)}')), '\s+', ' ', 'g') FROM t),
l AS (SELECT doc_id, string_split(regexp_replace(t, '({_quoted(at.GENERIC)})', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS l FROM t),
p AS (SELECT doc_id, unnest(list_transform(range(2, len(l) + 1), lambda i: {{'name': split_part(l[i], chr(2), 1), 'before': regexp_replace(replace(l[i - 1], chr(2), ''), '\s+$', '')[-1]}})) AS c FROM l),
c AS (SELECT doc_id, name, TRUE AS h, FALSE AS m FROM h
      UNION ALL SELECT doc_id, c.name, FALSE, c.before != '' AND NOT contains('{_quoted(at.BOUNDARY)}', c.before) FROM p
      WHERE length(c.name) >= 3 AND lower(regexp_extract(c.name, '^\S+')) NOT IN {at.STOPWORDS}),
g AS (SELECT doc_id, name, count(*) AS n, bool_or(h) AS h, bool_or(m) AS m FROM c GROUP BY doc_id, name),
r AS (SELECT doc_id, name, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, name)::INTEGER AS place FROM g WHERE n >= 2 AND (h OR m))
SELECT * FROM r WHERE place <= 30""")
def a1(documents: DataFrame) -> DataFrame:
    return at.global_roster(documents, "doc_id")


@query(
    "A19_main_cast", "lines",
    sql="""WITH s AS (SELECT book_id, character, count(*) AS lines FROM lines WHERE segment_type = 'dialogue' AND character != 'Narrator' GROUP BY ALL),
           t AS (SELECT book_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_\\p{M}]+')) AS w FROM lines), m AS (SELECT book_id, w, count(*) AS mentions FROM t GROUP BY ALL),
           b AS (SELECT s.*, coalesce(mentions, 0) AS mentions FROM s LEFT JOIN m ON s.book_id = m.book_id AND w = string_split(character, ' ')[-1])
           SELECT book_id, character, lines, mentions, 3 * lines + mentions AS importance, row_number() OVER (PARTITION BY book_id ORDER BY 3 * lines + mentions DESC, character)::INTEGER AS place
           FROM b WHERE lines >= 2 OR mentions >= 3""",
)
def a19(lines: DataFrame) -> DataFrame:
    return at.main_cast(lines)


def gold_of(lines: DataFrame) -> DataFrame:
    """Gold lines: the lines themselves, of which some lack their last words or have another speaker."""
    text = F.when(F.col("line_number") % 2 == 0, F.expr("substring(text, 1, cast(length(text) * 0.8 as int))")).otherwise(F.col("text"))
    speaker = F.when(F.col("scene") % 4 == 0, "Narrator").otherwise(F.col("character"))
    return lines.select("book_id", "scene", F.col("line_number").alias("pos"), speaker.alias("speaker"), text.alias("text"))


@query("J5_align_gold_best_match", "lines")
def j5(lines: DataFrame) -> DataFrame:
    return at.align_gold(gold_of(lines), lines).select("book_id", "scene", "pos", "line_id", F.round("ratio", 6).alias("ratio"), "compared")


@query("A18_attribution_accuracy", "lines")
def a18(lines: DataFrame) -> DataFrame:
    return at.attribution_accuracy(at.align_gold(gold_of(lines), lines), lines, ["book_id"])


@query(
    "J6_composed_name_merges", "lines",
    sql="SELECT book_id, CASE WHEN sum((character = 'Cora')::INTEGER) >= sum((character = 'Ada')::INTEGER) THEN 'Cora' ELSE 'Ada' END AS canonical, CASE WHEN sum((character = 'Cora')::INTEGER) >= sum((character = 'Ada')::INTEGER) THEN 'Ada' ELSE 'Cora' END AS alias, 'Miss Ada Cora' AS \"full\" FROM lines GROUP BY book_id HAVING sum((character = 'Cora')::INTEGER) > 0 AND sum((character = 'Ada')::INTEGER) > 0",
)
def j6(lines: DataFrame) -> DataFrame:
    """The roster has a full name that two speakers' names make."""
    speakers = lines.where("character IN ('Ada', 'Cora', 'Bram')").groupBy("book_id", F.col("character").alias("name")).agg(F.count("*").alias("n"))
    return at.composed_name_merges(speakers, lines.select("book_id", F.lit("Miss Ada Cora").alias("name")).distinct())


@query("J7_consolidate_characters", "lines")
def j7(lines: DataFrame) -> DataFrame:
    names = lines.where("character != 'Narrator'").select("book_id", F.col("character").alias("name")).distinct()
    known = lines.where("scene % 40 < 20").select("book_id", F.lit("Cora").alias("original"), F.lit("Cora Bell").alias("canonical"), F.lit(False).alias("yes"), F.lit(0.5).alias("confidence")).distinct()
    return at.consolidate_characters(names, known)


@query("W6_alternate_speakers", "lines")
def w6(lines: DataFrame) -> DataFrame:
    p = lines.withColumn("t", F.concat(F.lit('"'), F.regexp_replace("text", r'[\s"]+', " "), F.lit('" '), F.when(F.col("line_number") == 1, F.concat(F.lit("said "), "character")).otherwise("and so on")))
    segments = ln.quote_segments(p.select("book_id", "scene", F.col("line_number").cast("int").alias("par"), "t"), "t").withColumnRenamed("segment", "text")
    roster = lines.where("character != 'Narrator'").select("book_id", F.col("character").alias("name")).distinct()
    return at.rule_ladder(segments.drop("segs"), roster)


@query("A22_merge_dramatizations", "lines", sql="""
WITH a AS (SELECT scene_id, line_number AS n, lower(character) AS who, character, line_number AS anchor, substring(text, 1, 12) AS text,
                  regexp_replace(lower(substring(text, 1, 12)), '[^\\p{L}\\p{N}\\p{M}_]+', '', 'g') AS said FROM lines),
k AS (SELECT *, row_number() OVER (PARTITION BY scene_id, who, said ORDER BY n) AS nth FROM a)
SELECT scene_id, 1 AS round, n, character, anchor, 'gasp' AS kind, text FROM k WHERE nth = 1
UNION ALL
SELECT scene_id, 2, n, character, anchor, 'gasp', text || ' more' FROM k WHERE nth > 1 AND n % 2 = 1
  AND n = (SELECT min(b.n) FROM k b WHERE b.scene_id = k.scene_id AND b.who = k.who AND b.said = k.said AND b.nth > 1 AND b.n % 2 = 1)""")
def a22(lines: DataFrame) -> DataFrame:
    """Two rounds of inserts, of which the second repeats some of the first."""
    first = lines.select("scene_id", F.lit(1).alias("round"), F.col("line_number").alias("n"), "character", F.col("line_number").alias("anchor"), F.lit("gasp").alias("kind"), F.substring("text", 1, 12).alias("text"))
    second = first.withColumn("round", F.lit(2)).withColumn("text", F.when(F.col("n") % 2 == 0, F.upper("text")).otherwise(F.concat("text", F.lit(" more"))))
    return at.merge_rounds(first.unionByName(second), ["scene_id"])


@query("V22_word_error_rate", "lines", sql="""
WITH t AS (SELECT line_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x != '') AS w FROM lines)
SELECT line_id, (len(w) // 7)::BIGINT AS errors, len(w)::BIGINT AS words, CASE WHEN len(w) > 0 THEN round((len(w) // 7)::DOUBLE / len(w), 6) ELSE 0 END AS wer FROM t""")
def v22(lines: DataFrame) -> DataFrame:
    """Texts against themselves without each seventh word."""
    kept = F.array_join(F.filter(F.split("text", r"\s+"), lambda w, i: i % 7 != 6), " ")
    out = at.word_errors(lines.select("line_id", F.col("text").alias("reference"), kept.alias("hypothesis")))
    return out.select("line_id", "errors", "words", F.round("wer", 6).alias("wer"))


@query("V22_corpus_word_error_rate", "lines", sql="""
WITH t AS (SELECT book_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x != '') AS w FROM lines),
e AS (SELECT book_id, len(w) AS n, len(list_filter(range(len(w)), lambda i: i % 7 = 6 OR i % 5 = 4)) AS errors FROM t)
SELECT book_id, count(*) AS pairs, sum(errors)::BIGINT AS errors, sum(n)::BIGINT AS words, round(sum(errors)::DOUBLE / sum(n), 6) AS wer FROM e GROUP BY book_id""")
def v22_corpus(lines: DataFrame) -> DataFrame:
    """Each book's texts against themselves without each seventh word, and with each fifth spoilt."""
    heard = F.filter(F.transform(F.split("text", r"\s+"), lambda w, i: F.when(i % 7 == 6, "").when(i % 5 == 4, F.concat(F.lit("#"), w)).otherwise(w)), lambda w: w != "")
    pairs = lines.select("book_id", F.col("text").alias("reference"), F.array_join(heard, " ").alias("hypothesis"))
    return at.corpus_word_error_rate(pairs, "book_id").withColumn("wer", F.round("wer", 6))


#: One sentence for each pattern of actions, in their order.
ACTIONS = (
    "He opened the door", "The door was shut at once", "She knocked on the door", "Somebody rang the bell", "They entered", "He left the room", "Footsteps were heard", "She sat down",
    "He rose to his feet", "They climbed the stairs", "He struck a match", "She poured the tea", "He unfolded the letter", "A carriage drew up", "The window was raised", "The fire crackled",
)
_ACTED = "replace(text, chr(10), concat(' ', CASE doc_id % 16 " + " ".join(f"WHEN {i} THEN '{x}. '" for i, x in enumerate(ACTIONS)) + " END))"
_HITS = " UNION ALL ".join(
    f"SELECT scene_id, pos, regexp_replace(sentence, '^\\s+|\\s+$', '', 'g')[1:160] AS sentence, {i} AS i, '{idea.replace(chr(39), chr(39) * 2)}' AS suggestion FROM s WHERE regexp_matches(sentence, '(?i)(?:{p})')" for i, (p, idea) in enumerate(at.FOLEY)
)


@query("V11_spot_action_foley", "documents", sql=rf"""
WITH t AS (SELECT doc_id::VARCHAR AS scene_id, regexp_extract_all({_ACTED}, '[^.]+\.?') AS l FROM documents),
s AS (SELECT scene_id, unnest(range(len(l))) AS pos, unnest(l) AS sentence FROM t),
h AS ({_HITS}),
g AS (SELECT scene_id, suggestion, arg_min(sentence, (i, pos)) AS sentence, min(i) AS i FROM h GROUP BY scene_id, suggestion),
n AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY i) AS n FROM g)
SELECT scene_id, 1 AS line_number, sentence, suggestion FROM n WHERE n <= 8""")
def v11(documents: DataFrame) -> DataFrame:
    """Documents with a sentence that describes a sound after each line end; all sixteen patterns are met."""
    rows = documents.select(F.col("doc_id").cast("string").alias("scene_id"), F.lit(1).alias("line_number"), F.lit("narrative").alias("segment_type"), F.expr(_ACTED).alias("text"))
    return at.spot_foley(rows)


VERBS = "|".join(at.SPEECH_VERBS)

#: Lines that name their speaker before or after a verb, elsewhere, in capitals, or within another word.
TOLD = """CASE line_number % 8 WHEN 2 THEN concat(text, ' said  ', character) WHEN 3 THEN concat(character, ' WHISPERED: ', text)
          WHEN 4 THEN concat(text, ' to ', upper(character)) WHEN 6 THEN concat('aside to ', character, 's, ', text) ELSE text END"""
_EDGE = r"[^\p{L}\p{N}_]"


@query(
    "V20_route_confidence", "lines",
    sql=rf"""
WITH t AS (SELECT line_id, scene_id, segment_type, {TOLD} AS t FROM lines),
a AS (SELECT scene_id, character AS name FROM lines WHERE character != 'Narrator' UNION SELECT scene_id, regexp_extract(text, '^[A-Za-z]+') FROM lines),
e AS (SELECT scene_id, name, regexp_escape(name) AS p FROM a WHERE name != ''),
h AS (SELECT line_id, name, regexp_matches(t, '(?i)(?:^|{_EDGE})(?:said|asked|replied|shouted|whispered)\s+' || p || '(?:{_EDGE}|$)')
               OR regexp_matches(t, '(?i)' || p || '\s+(?:said|asked|replied|shouted|whispered)(?:{_EDGE}|$)') AS told,
             regexp_matches(t, '(?i)(?:^|{_EDGE})' || p || '(?:{_EDGE}|$)') AS named
      FROM t JOIN e USING (scene_id) WHERE segment_type = 'dialogue'),
m AS (SELECT line_id, min(name) FILTER (told) AS told, min(name) FILTER (named) AS named, count(*) FILTER (named) AS n FROM h GROUP BY line_id)
SELECT line_id, CASE WHEN told IS NOT NULL THEN told WHEN n = 1 THEN named ELSE 'Narrator' END AS speaker,
       CASE WHEN segment_type != 'dialogue' THEN 1.0::DOUBLE WHEN told IS NOT NULL THEN 0.95 WHEN n = 1 THEN 0.7 ELSE 0.5 END AS confidence,
       CASE WHEN told IS NOT NULL THEN 'Speech Verb' WHEN n = 1 THEN 'Context Mention' ELSE 'Narrator Fallback' END AS attribution_method,
       segment_type = 'dialogue' AND told IS NULL AS queued
FROM t LEFT JOIN m USING (line_id)""",
)
def v20(lines: DataFrame) -> DataFrame:
    """The characters of a scene are its speakers and the words that its lines begin with."""
    active = lines.where("character != 'Narrator'").select("scene_id", F.col("character").alias("name"))
    active = active.unionByName(lines.select("scene_id", F.regexp_extract("text", "^[A-Za-z]+", 0).alias("name")))
    return at.route_confidence(lines.withColumn("text", F.expr(TOLD)), active)


@query("V21_dialogue_sentences", "paragraphs", sql=rf"""
WITH s AS (SELECT book_id, unnest(range(len(l))) AS pos, unnest(l) AS sentence FROM (SELECT book_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS l FROM paragraphs)),
q AS (SELECT *, list_filter(list_transform(regexp_extract_all(sentence, '{at.QUOTE.replace("'", "''")}'), lambda m: regexp_replace(m[2:len(m) - 1], '^\s+|\s+$', '', 'g')),
        lambda m: length(m) > 2 AND NOT (regexp_matches(m, '[\p{{Lu}}\p{{Ll}}\p{{Lt}}]') AND NOT regexp_matches(m, '{at.LETTER_AFTER[0]}') AND NOT regexp_matches(m, '{at.LETTER_AFTER[1]}'))) AS l FROM s)
SELECT book_id, pos::INTEGER AS pos, sentence, unnest(range(len(l)))::INTEGER AS n, unnest(l) AS quote, regexp_matches(sentence, '(?i)\b(?:{VERBS})\b') AS spoken FROM q""")
def v21(paragraphs: DataFrame) -> DataFrame:
    return at.dialogue_sentences(paragraphs, "book_id")


@query(
    "V24_job_outcomes", "lines",
    sql="SELECT line_id, CASE WHEN line_number % 3 = 0 THEN 'failed_retry_required' ELSE 'success' END AS status FROM lines",
)
def v24(lines: DataFrame) -> DataFrame:
    """Raw answers, of which some are in fences and some are cut off."""
    whole = F.to_json(F.struct(F.col("character").alias("speaker")))
    raw = F.when(F.col("line_number") % 3 == 0, F.substring(whole, 1, 8)).when(F.col("line_number") % 3 == 1, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).otherwise(whole)
    return at.job_outcomes(lines.select("line_id", raw.alias("raw"))).select("line_id", "status")


@query("V23_build_prompt_requests", "lines", sql="""
WITH d AS (SELECT *, ceil(row_number() OVER (PARTITION BY scene ORDER BY line_number) / 3.0)::INTEGER AS "window" FROM lines WHERE segment_type = 'dialogue'),
r AS (SELECT book_id, array_to_string(list_sort(list(DISTINCT character)), ', ') AS roster FROM lines GROUP BY book_id)
SELECT d.book_id, scene_id, "window", string_agg(line_number || ': ' || text, chr(10) ORDER BY line_number) AS lines, count(*) AS n, any_value(roster) AS roster FROM d JOIN r USING (book_id) GROUP BY d.book_id, scene_id, "window" """)
def v23(lines: DataFrame) -> DataFrame:
    roster = lines.select("book_id", F.col("character").alias("name")).distinct()
    return at.prompt_requests(ln.dialogue_windows(lines, size=3), roster)


@query("V23_with_answers", "lines", sql="""
WITH d AS (SELECT *, ceil(row_number() OVER (PARTITION BY scene ORDER BY line_number) / 3.0)::INTEGER AS "window" FROM lines WHERE segment_type = 'dialogue'),
r AS (SELECT book_id, min(character) AS speaker FROM lines GROUP BY book_id),
q AS (SELECT sha256(book_id || '|' || scene_id || '|' || "window")[1:16] AS request_id, book_id, count(*) AS n FROM d GROUP BY book_id, scene_id, "window")
SELECT request_id, CASE WHEN n > 1 THEN speaker END AS speaker, CASE WHEN n > 1 THEN 'success' ELSE 'failed_retry_required' END AS status, CASE WHEN n > 1 THEN 1 ELSE 4 END::BIGINT AS tries
FROM q JOIN r USING (book_id)""")
def v23_answers(lines: DataFrame) -> DataFrame:
    """All windows' requests answered by a function that names the roster's first, and gets single lines wrong; asked twice, so that the second run asks for the wrong ones only."""
    roster = lines.select("book_id", F.col("character").alias("name")).distinct()
    requests = at.prompt_requests(ln.dialogue_windows(lines, size=3), roster)
    requests = requests.withColumn("request_id", F.substring(F.sha2(F.concat_ws("|", "book_id", "scene_id", "window"), 256), 1, 16))

    def answer(frames):
        for f in frames:
            first = f["roster"].str.split(", ").str[0]
            raw = ('{"speaker": "' + first + '"}').where(f["n"] > 1, "I cannot tell")
            yield f[["request_id"]].assign(raw=raw)

    folder = shared_path(lines.sparkSession, "answers")
    at.with_answers(requests, answer, folder, tries=2)
    return at.with_answers(requests, answer, folder, tries=2).select("request_id", "answer.speaker", "status", "tries")


_STRONG = " OR ".join(f"contains(lower(w), '{x}')" for x in at.STRONG_LOOKS)
_WEAK = " OR ".join(f"contains(lower(w), '{x}')" for x in at.WEAK_LOOKS)


@query("K7_description_windows", "documents", sql=rf"""
WITH p AS (SELECT doc_id::VARCHAR AS book_id, text, name, word, string_split(text, word) AS p FROM documents, (VALUES ('Old The', 'The'), ('La', 'La')) v(name, word) WHERE contains(text, word)),
n AS (SELECT *, unnest(range(1, len(p))) AS i FROM p),
a AS (SELECT book_id, name, text, word, list_sum(list_transform(p[1:i], lambda x: length(x)))::BIGINT + (i - 1) * length(word) AS pos FROM n),
w AS (SELECT book_id, name, pos, trim(regexp_replace(text[greatest(0, pos - 160) + 1 : pos + length(word) + 200], '\s+', ' ', 'g')) AS w FROM a),
k AS (SELECT *, row_number() OVER (PARTITION BY book_id, name ORDER BY CASE WHEN {_STRONG} THEN 0 WHEN {_WEAK} THEN 1 ELSE 2 END, pos) AS place FROM w)
SELECT book_id, name, place::INTEGER AS place, w AS "window" FROM k WHERE place <= 4""")
def k7(documents: DataFrame) -> DataFrame:
    """Windows around words that many documents have."""
    books = documents.select(F.col("doc_id").cast("string").alias("book_id"), "text")
    cast = books.select("book_id", F.explode(F.array(F.lit("Old The"), F.lit("La"))).alias("name"))
    return at.description_windows(books, cast)
