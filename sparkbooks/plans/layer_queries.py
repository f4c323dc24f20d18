"""Queries of corrections, joins and grounding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkbooks.operators import catalog as ct
from sparkbooks.operators import layers as ly
from sparkbooks.operators import lines as ln
from sparkbooks.plans.registry import query

SPOKEN = "segment_type = 'dialogue'"


@query(
    "J1_apply_speaker_overrides", "lines", "overrides",
    sql="""SELECT line_id, coalesce(o.character, l.character) AS character, CASE WHEN o.line_id IS NULL THEN attribution_method ELSE 'human_override' END AS attribution_method,
           CASE WHEN o.line_id IS NULL THEN confidence ELSE 1.0 END AS confidence FROM lines l LEFT JOIN overrides o USING (book_id, line_id)""",
)
def j1(lines: DataFrame, overrides: DataFrame) -> DataFrame:
    return ly.apply_speaker_overrides(lines, overrides).select("line_id", "character", "attribution_method", "confidence")


@query(
    "J2_apply_alias_map", "lines",
    sql="""WITH a AS (SELECT DISTINCT book_id, 'Cora' AS character, 'Cora Bell' AS canonical FROM lines)
           SELECT line_id, coalesce(canonical, character) AS character, 'char_' || trim(regexp_replace(lower(coalesce(canonical, character)), '[^a-z0-9]+', '_', 'g'), '_') AS speaker_id
           FROM lines LEFT JOIN a USING (book_id, character)""",
)
def j2(lines: DataFrame) -> DataFrame:
    aliases = lines.select("book_id").distinct().select("book_id", F.lit("Cora").alias("alias"), F.lit("Cora Bell").alias("canonical"))
    return ly.apply_alias_map(lines, aliases).select("line_id", "character", "speaker_id")


@query(
    "J3_confirmed_merges_layer", "lines",
    sql="""SELECT DISTINCT book_id, character AS alias, 'Cora Bell' AS canonical, length(book_id) % 2 = 0 AS confirmed FROM lines WHERE character = 'Cora'""",
)
def j3(lines: DataFrame) -> DataFrame:
    merges = lines.where("character = 'Cora'").select("book_id", F.col("character").alias("alias"), F.lit("Cora Bell").alias("canonical"), (F.length("book_id") % 2 == 0).alias("confirmed")).distinct()
    yes, no = ly.merges_layer(merges)
    return yes.withColumn("confirmed", F.lit(True)).unionByName(no.withColumn("confirmed", F.lit(False)))


@query(
    "J4_reuse_previous_enrichment", "lines",
    sql="SELECT DISTINCT book_id, scene_id, scene % 3 != 0 AND (bool_and(segment_type != 'dialogue') OVER w OR bool_or(segment_type = 'dialogue' AND attribution_method != 'Tier 1 Default') OVER w) AS reuse FROM lines WINDOW w AS (PARTITION BY scene_id)",
)
def j4(lines: DataFrame) -> DataFrame:
    """The old run has other texts in every third scene."""
    old = lines.withColumn("text", F.when(F.col("scene") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return ly.reusable_scenes(lines, old)


_SWITCHES = """s AS (SELECT book_id, least(a, b) AS a, greatest(a, b) AS b, count(*) AS switches FROM (
  SELECT book_id, lag(character) OVER (PARTITION BY book_id, scene_id ORDER BY line_number) AS a, character AS b FROM lines WHERE segment_type = 'dialogue') WHERE a != b GROUP BY ALL)"""


@query("W2_conversation_switches", "lines", sql=f"WITH {_SWITCHES} SELECT * FROM s")
def w2(lines: DataFrame) -> DataFrame:
    return ly.conversation_switches(lines)


@query(
    "J8_merge_blocker", "lines",
    sql=f"""WITH {_SWITCHES}, p AS (SELECT DISTINCT a.book_id, a.character AS alias, b.character AS canonical FROM lines a JOIN lines b USING (book_id) WHERE a.character < b.character AND a.character != 'Narrator' AND b.character != 'Narrator')
            SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.book_id = p.book_id AND s.a = alias AND s.b = canonical AND switches >= 2)""",
)
def j8(lines: DataFrame) -> DataFrame:
    names = lines.where("character != 'Narrator'").select("book_id", "character").distinct()
    other = names.select("book_id", F.col("character").alias("canonical"))
    pairs = names.withColumnRenamed("character", "alias").join(other, "book_id").where("alias < canonical")
    return ly.unblocked_merges(pairs, ly.conversation_switches(lines))


@query(
    "J9_scene_detail", "lines", "scenes", "overrides",
    sql="""SELECT s.scene_id, s.omit, count(line_id) AS lines, count(o.line_id) AS overridden FROM scenes s LEFT JOIN lines l USING (book_id, scene_id) LEFT JOIN overrides o USING (book_id, line_id) GROUP BY ALL""",
)
def j9(lines: DataFrame, scenes: DataFrame, overrides: DataFrame) -> DataFrame:
    """Each scene with what belongs to it from the tables beside it."""
    return ct.scene_detail(scenes, lines, overrides).select("scene_id", "omit", "lines", "overridden")


@query(
    "J10_resolve_voice", "embeddings",
    sql="""WITH e AS (SELECT vec_id, (vec_id // 20)::VARCHAR AS c, vec_id % 4 AS emotion, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
           q AS (SELECT * FROM e WHERE vec_id % 2 = 0), r AS (SELECT * FROM e WHERE vec_id % 3 = 0),
           j AS (SELECT q.vec_id AS request_id, q.c AS character, q.emotion, r.vec_id AS ref, r.emotion AS r_emotion,
                        CASE WHEN q.vec_id % 5 > 0 THEN list_inner_product(q.v, r.v) / sqrt(list_inner_product(q.v, q.v)) / sqrt(list_inner_product(r.v, r.v)) END AS s FROM q LEFT JOIN r ON q.c = r.c),
           f AS (SELECT request_id, character, arg_min(ref, struct_pack(s := -s, p := ref)) FILTER (s > 0.65) AS nearest, min(ref) FILTER (emotion = r_emotion) AS exact FROM j GROUP BY request_id, character)
           SELECT request_id, character, CASE WHEN character::BIGINT % 7 = 3 THEN 'narrator.wav' WHEN coalesce(nearest, exact) IS NOT NULL THEN 'ref' || coalesce(nearest, exact) ELSE 'default' || character END AS path,
                  CASE WHEN character::BIGINT % 7 = 3 THEN 1.0::DOUBLE ELSE 0.9 END AS speed, CASE WHEN character::BIGINT % 7 = 3 THEN 0.0::DOUBLE ELSE 2.0 END AS pitch,
                  CASE WHEN character::BIGINT % 7 = 3 THEN 'no drawer' WHEN nearest IS NOT NULL THEN 'nearest' WHEN exact IS NOT NULL THEN 'emotion' ELSE 'default' END AS rule FROM f""",
)
def j10(embeddings: DataFrame) -> DataFrame:
    """Every 20 vectors belong to a character; those divisible by 3 are its references, and those by 2 its requests, some without a vector."""
    named = embeddings.select("vec_id", F.expr("cast(vec_id div 20 as string)").alias("character"), (F.col("vec_id") % 4).alias("emotion"), F.col("embedding").alias("vector"))
    requests = named.where("vec_id % 2 = 0").select(F.col("vec_id").alias("request_id"), "character", "emotion", F.when(F.col("vec_id") % 5 > 0, F.col("vector")).alias("vector"))
    references = named.where("vec_id % 3 = 0").select("character", F.col("vec_id").alias("position"), "emotion", F.concat(F.lit("ref"), F.col("vec_id").cast("string")).alias("path"), "vector")
    drawers = named.select("character").distinct().where("character % 7 != 3").select("character", F.concat(F.lit("default"), "character").alias("default_path"), F.lit(0.9).alias("speed"), F.lit(2.0).alias("pitch"))
    return ct.resolve_voice(requests, drawers, references, "narrator.wav")


@query(
    "J11_attach_performance", "lines",
    sql="""WITH d AS (SELECT * FROM (VALUES ('Ada', 2.0::DOUBLE, 1.1::DOUBLE), ('Dov', -3.0, 0.9)) v(character, pitch, speed))
           SELECT line_id, round(pow(2, coalesce(pitch, 0) / 12), 9) AS pitch_modifier, coalesce(speed, 1.0) AS speed_modifier FROM lines LEFT JOIN d USING (character)""",
)
def j11(lines: DataFrame) -> DataFrame:
    drawers = lines.sparkSession.createDataFrame([("Ada", 2.0, 1.1), ("Dov", -3.0, 0.9)], "character string, pitch double, speed double")
    return ct.attach_performance(lines.select("line_id", "character"), drawers).select("line_id", F.round("pitch_modifier", 9).alias("pitch_modifier"), "speed_modifier")


@query(
    "J12_splice_inserts", "lines",
    sql="""SELECT scene_id, row_number() OVER (PARTITION BY scene_id ORDER BY anchor, i)::INTEGER AS line_number, text, old, i = 1 AS inserted FROM (
             SELECT scene_id, line_number AS anchor, 0 AS i, text, line_number AS old FROM lines UNION ALL SELECT scene_id, line_number, 1, 'gasp', NULL FROM lines WHERE length(text) % 4 = 0)""",
)
def j12(lines: DataFrame) -> DataFrame:
    inserts = lines.where("length(text) % 4 = 0").select("scene_id", F.col("line_number").alias("anchor"), F.lit("gasp").alias("text"))
    return ly.splice_inserts(lines, inserts, ["scene_id"])


_NORM = "trim(regexp_replace(lower(translate({0}, '“”„«»‘’‚‹›', '\"\"\"\"\"''' || repeat('''', 4))), '[^a-z0-9]+', ' ', 'g'))"


@query(
    "J14_ground_in_text", "documents",
    sql=f"""WITH d AS (SELECT doc_id, text[CASE WHEN doc_id % 2 = 0 THEN 20 ELSE 1 END : 80] || CASE WHEN doc_id % 3 = 0 THEN ' not there' ELSE '' END AS snippet, text FROM documents)
            SELECT doc_id, {_NORM.format("snippet")} != '' AND contains({_NORM.format("text")}, {_NORM.format("snippet")}) AS found FROM d""",
)
def j14(documents: DataFrame) -> DataFrame:
    """Snippets of documents, a third with words that are not there."""
    start = F.when(F.col("doc_id") % 2 == 0, 20).otherwise(1)
    snippet = F.concat(F.substr("text", start, 81 - start), F.when(F.col("doc_id") % 3 == 0, " not there").otherwise(""))
    proposals = documents.select("doc_id", snippet.alias("snippet"))
    return ly.grounded(proposals, documents.select("doc_id", "text"), ["doc_id"], "snippet", "text").select("doc_id", "found")


@query(
    "J15_sound_duplicates_dialogue", "lines",
    sql=f"""WITH e AS (SELECT scene_id, line_id, text[1:30] AS t FROM lines WHERE line_number % 2 = 1),
            q AS (SELECT scene_id, {_NORM.format("text")} AS said FROM lines WHERE {SPOKEN})
            SELECT line_id FROM e WHERE {_NORM.format("t")} = '' OR NOT EXISTS (SELECT 1 FROM q WHERE q.scene_id = e.scene_id AND contains(said, {_NORM.format("t")}))""",
)
def j15(lines: DataFrame) -> DataFrame:
    events = lines.where("line_number % 2 = 1").select("scene_id", "line_id", F.substring("text", 1, 30).alias("t"))
    return ly.outside_dialogue(events, lines, ["scene_id"], "t").select("line_id")


@query(
    "J16_match_to_roster", "lines",
    sql="""WITH r AS (SELECT DISTINCT book_id, character AS name FROM lines), k AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY length(name) DESC, name) AS position FROM r),
           n AS (SELECT DISTINCT book_id, upper(character) AS name FROM lines)
           SELECT n.book_id, n.name, arg_min(k.name, position) AS match FROM n JOIN k ON n.book_id = k.book_id AND (contains(lower(n.name), lower(k.name)) OR contains(lower(k.name), lower(n.name))) GROUP BY ALL""",
)
def j16(lines: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    names = lines.select("book_id", F.col("character").alias("name")).distinct()
    roster = names.withColumn("position", F.row_number().over(Window.partitionBy("book_id").orderBy(F.desc(F.length("name")), "name")))
    return ly.match_to_roster(names.withColumn("name", F.upper("name")), roster)


@query("J17_new_sources", "documents", "labels", sql="SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j17(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """What is there and not yet known: documents without a label."""
    return ct.missing_keys(documents.select("doc_id"), labels, "doc_id")


@query("J18_missing_prompts", "part", "lineitem", sql="SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def j18(part: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Required keys without a row that counts."""
    return ct.missing_keys(part.select("p_partkey"), lineitem.where("l_quantity > 49"), "p_partkey", "l_partkey")


@query("J19_pair_common_files", "documents", "labels", sql="SELECT doc_id, n_chars, quality FROM documents JOIN labels USING (doc_id)")
def j19(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return ct.pair_common(documents.select("doc_id", "n_chars"), labels.select("doc_id", "quality"), "doc_id")


@query(
    "J20_account_overview", "customer", "orders",
    sql="""SELECT owner, kind, name FROM (SELECT CASE WHEN c_custkey % 100 > 0 THEN c_custkey::VARCHAR ELSE 'local' END AS owner, 'account' AS kind, c_name AS name FROM customer UNION ALL
           SELECT o_custkey::VARCHAR, 'render', o_orderkey::VARCHAR FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 10)""",
)
def j20(customer: DataFrame, orders: DataFrame) -> DataFrame:
    """Each owner's account and last ten orders, by kind; one account in a hundred has no owner."""
    owner = F.when(F.col("c_custkey") % 100 > 0, F.col("c_custkey")).alias("owner")
    renders = orders.select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("name"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("tie"))
    return ct.account_overview({"account": customer.select(owner, F.col("c_name").alias("name"))}, renders)


@query(
    "J21_changed_voice_lines", "lines",
    sql="""SELECT line_id, sha1(character || '.wav|' || character || '|1.0|')[1:8] AS fingerprint FROM lines WHERE character IN ('Ada', 'Dov')""",
)
def j21(lines: DataFrame) -> DataFrame:
    """Lines whose speaker's voice fingerprint is not the cached one: the voices of two speakers have changed."""
    speed = F.when(F.col("character").isin("Ada", "Dov"), "1.0").otherwise("0.9")

    def mark(speed):
        return ct.voice_fingerprint(F.concat("character", F.lit(".wav")), F.col("character"), speed, F.lit(None)).alias("fingerprint")

    voices = lines.select("character").distinct().select("character", mark(speed))
    cache = lines.select("line_id", mark(F.lit("0.9")))
    return ct.changed_voice_lines(lines, voices, cache).select("line_id", "fingerprint")


@query(
    "P15_filter_chapters", "lines",
    sql="SELECT line_id FROM lines JOIN (SELECT chapter FROM (SELECT chapter, dense_rank() OVER (PARTITION BY book_id ORDER BY chapter) AS o FROM lines) GROUP BY ALL HAVING any_value(o) IN (1, 2, 4)) USING (chapter)",
)
def p15(lines: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    spec = lines.select("book_id").distinct().withColumn("spec", F.lit("1-2, 4, x"))
    ordinal = F.dense_rank().over(Window.partitionBy("book_id").orderBy("chapter"))
    return lines.withColumn("ordinal", ordinal).join(ly.parse_chapter_spec(spec), ["book_id", "ordinal"], "left_semi").select("line_id")


@query("P16_omit_scenes", "lines", "scenes", sql="SELECT line_id FROM lines JOIN scenes USING (book_id, scene_id) WHERE NOT omit")
def p16(lines: DataFrame, scenes: DataFrame) -> DataFrame:
    return ct.omit_scenes(lines, scenes).select("line_id")


@query(
    "P19_valid_person_name", "documents",
    sql="""WITH w AS (SELECT DISTINCT unnest(string_split(text[1:400], ' ')) AS name FROM documents UNION SELECT 'Mrs. Rabbit' UNION SELECT ' himself '), t AS (SELECT name, regexp_replace(name, '^\\s+|\\s+$', '', 'g') AS o FROM w)
           SELECT name FROM t WHERE length(o) > 1 AND lower(o) NOT IN ('he', 'him', 'his', 'himself', 'she', 'her', 'hers', 'herself', 'it', 'its', 'itself', 'they', 'them', 'their', 'theirs', 'themselves',
             'i', 'me', 'my', 'mine', 'myself', 'you', 'your', 'yours', 'yourself', 'we', 'us', 'our', 'ours', 'ourselves')
             AND (regexp_matches(o, '\\s') OR (regexp_full_match(o, '[A-Za-z]+') AND lower(o) NOT IN ('down', 'up', 'left', 'right', 'chapter', 'book', 'title', 'author', 'release')))""",
)
def p19(documents: DataFrame) -> DataFrame:
    """The first words of documents, and two names, as found names."""
    found = documents.select(F.explode(F.split(F.substring("text", 1, 400), " ")).alias("name"))
    some = documents.select(F.explode(F.array(F.lit("Mrs. Rabbit"), F.lit(" himself "))).alias("name"))
    return found.unionByName(some).distinct().where(ct.valid_person_name(F.col("name")))


@query(
    "V9_apply_attribution_answers", "lines",
    sql="""WITH a AS (SELECT line_id, 'Ada' AS s, least(1.0::DOUBLE, confidence * 1.5) AS c FROM lines WHERE line_number % 3 = 0 AND segment_type = 'dialogue')
           SELECT line_id, coalesce(s, character) AS character, 'char_' || trim(regexp_replace(lower(coalesce(s, character)), '[^a-z0-9]+', '_', 'g'), '_') AS speaker_id, round(coalesce(c, confidence), 6) AS confidence,
                  CASE WHEN s IS NULL THEN TRUE ELSE c >= 0.6 END AS speaker_locked FROM lines LEFT JOIN a USING (line_id)""",
)
def v9(lines: DataFrame) -> DataFrame:
    """Each third line has an early answer, a later one and an empty one; the later one counts."""
    asked = lines.where("line_number % 3 = 0")
    keys = ["book_id", "scene_id", "line_number"]
    a = [
        asked.select(*keys, F.lit(n).alias("answer_no"), F.lit(s).alias("speaker"), (F.col("confidence") * 1.5).alias("confidence"))
        for n, s in enumerate(["Bram", " Ada ", "", "narrator"])
    ]
    out = ly.apply_answers(lines, a[0].unionByName(a[1]).unionByName(a[2]).unionByName(a[3]))
    return out.select("line_id", "character", "speaker_id", F.round("confidence", 6).alias("confidence"), "speaker_locked")


@query(
    "V10_apply_review_corrections", "lines",
    sql="""WITH s AS (SELECT scene_id FROM lines GROUP BY scene_id HAVING sum((segment_type = 'dialogue')::INTEGER) >= 2 AND count(DISTINCT CASE WHEN segment_type = 'dialogue' THEN character END) >= 2
               AND sum((line_number % 4 = 2)::INTEGER) <= greatest(1.0, 0.5 * sum((segment_type = 'dialogue')::INTEGER))),
             h AS (SELECT l.*, line_number % 4 = 2 AND segment_type = 'dialogue' AND character != 'Eve' AND scene_id IN (SELECT scene_id FROM s) AS hit FROM lines l)
           SELECT line_id, CASE WHEN hit THEN 'Eve' ELSE character END AS character, attribution_method || CASE WHEN hit THEN '+reviewed' ELSE '' END AS attribution_method, CASE WHEN hit THEN 0.75 ELSE confidence END AS confidence FROM h""",
)
def v10(lines: DataFrame) -> DataFrame:
    asked = lines.where("line_number % 4 = 2").select("book_id", "scene_id", "line_number", F.col("character").alias("current_speaker"), F.lit("Eve").alias("corrected_speaker"))
    out = ly.apply_corrections(lines, asked, least=2, speakers=2, share=0.5)
    return out.select("line_id", "character", "attribution_method", "confidence")


@query("U1_union_rosters", "lines", "overrides", sql="SELECT book_id, character FROM lines UNION SELECT book_id, character FROM overrides")
def u1(lines: DataFrame, overrides: DataFrame) -> DataFrame:
    return ct.union_rosters(lines.select("book_id", "character"), overrides.select("book_id", "character"))


@query(
    "U2_set_scoring", "documents", "labels",
    sql="SELECT 'both' AS part, doc_id FROM (SELECT doc_id FROM documents WHERE n_chars > 1500 INTERSECT SELECT doc_id FROM labels WHERE quality = 1) UNION ALL SELECT 'only_found', doc_id FROM (SELECT doc_id FROM documents WHERE n_chars > 1500 EXCEPT SELECT doc_id FROM labels WHERE quality = 1) UNION ALL SELECT 'only_gold', doc_id FROM (SELECT doc_id FROM labels WHERE quality = 1 EXCEPT SELECT doc_id FROM documents WHERE n_chars > 1500)",
)
def u2(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return ct.set_parts(documents.where("n_chars > 1500").select("doc_id"), labels.where("quality = 1").select("doc_id"))


@query(
    "U3_dedup_first_seen", "documents",
    sql="SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(lower(text)) ORDER BY doc_id) AS n FROM documents) WHERE n = 1",
)
def u3(documents: DataFrame) -> DataFrame:
    keyed = documents.select("doc_id", F.md5(F.lower("text").cast("binary")).alias("k"))
    return ct.first_seen(keyed, F.col("k"), "doc_id").select("doc_id")


@query(
    "U4_dropped_proposals", "documents",
    sql=f"""WITH d AS (SELECT doc_id, text[1:40] || CASE WHEN doc_id % 3 = 0 THEN ' not there' ELSE '' END AS snippet, text FROM documents)
            SELECT doc_id, 'not grounded' AS reason FROM d WHERE NOT ({_NORM.format("snippet")} != '' AND contains({_NORM.format("text")}, {_NORM.format("snippet")}))""",
)
def u4(documents: DataFrame) -> DataFrame:
    """Proposals that were dropped, and why."""
    snippet = F.concat(F.substring("text", 1, 40), F.when(F.col("doc_id") % 3 == 0, " not there").otherwise(""))
    found = ly.grounded(documents.select("doc_id", snippet.alias("snippet")), documents.select("doc_id", "text"), ["doc_id"], "snippet", "text")
    return found.where("NOT found").select("doc_id", F.lit("not grounded").alias("reason"))


@query(
    "K4_first_k_candidates", "lines",
    sql="SELECT scene_id, line_id FROM (SELECT scene_id, line_id, row_number() OVER (PARTITION BY scene_id ORDER BY line_number) AS n FROM lines WHERE segment_type = 'dialogue') WHERE n <= 2",
)
def k4(lines: DataFrame) -> DataFrame:
    return ct.first_candidates(lines.where(SPOKEN), "scene_id", "line_number", k=2).select("scene_id", "line_id")


@query(
    "W5_fill_forward_speaker", "lines",
    sql="SELECT line_id, last_value(CASE WHEN segment_type = 'dialogue' THEN character END IGNORE NULLS) OVER (PARTITION BY scene ORDER BY line_number) AS speaker FROM lines",
)
def w5(lines: DataFrame) -> DataFrame:
    return ln.fill_forward(lines, "scene", "line_number", F.when(F.expr(SPOKEN), F.col("character")), "speaker").select("line_id", "speaker")


@query(
    "W10_speaker_change_flags", "lines",
    sql="SELECT line_id, coalesce(lag(character) OVER (PARTITION BY scene ORDER BY line_number) != character, TRUE) AS changed FROM lines",
)
def w10(lines: DataFrame) -> DataFrame:
    return ct.speaker_changes(lines, ["scene"]).select("line_id", "changed")
