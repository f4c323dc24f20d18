"""Tables that the queries derive from the given ones, by SQL that Spark and the oracle both run.

The given tables hold no books, so conversations are read as books: 20 conversations are a book, 5 a chapter, one a scene, and a turn
is a line whose speaker follows from its role. Customers in nations in regions are the scenes, chapters and parts of section trees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

LINES = """
SELECT concat('book', CAST(CAST(floor(conv_id / 20) AS BIGINT) AS STRING)) AS book_id,
       CAST(floor(conv_id / 5) AS BIGINT) AS chapter,
       concat('p1_c', CAST(CAST(floor(conv_id / 5) AS BIGINT) AS STRING), '_s', CAST(conv_id AS STRING)) AS scene_id,
       conv_id AS scene,
       CAST(turn + 1 AS BIGINT) AS line_number,
       concat('l', CAST(conv_id AS STRING), '_', CAST(turn AS STRING)) AS line_id,
       CASE WHEN turn % 4 = 0 THEN 'Narrator'
            WHEN role = 'user' THEN CASE WHEN conv_id % 3 = 0 THEN 'Ada' WHEN conv_id % 3 = 1 THEN 'Bram' ELSE 'Cora Bell' END
            ELSE CASE WHEN conv_id % 2 = 0 THEN 'Dov' ELSE 'Cora' END END AS character,
       CASE WHEN turn % 4 = 0 THEN 'narrative' ELSE 'dialogue' END AS segment_type,
       coalesce(text, '') AS text,
       CASE WHEN length(text) % 5 = 0 THEN 'Joy' WHEN length(text) % 5 = 1 THEN 'Tension' WHEN length(text) % 7 = 2 THEN 'Fear' ELSE 'Neutral' END AS emotion,
       CASE WHEN turn % 4 = 0 THEN 'Tier 1 Default' WHEN length(text) % 3 = 0 THEN 'LLM+reviewed' ELSE 'LLM' END AS attribution_method,
       CASE WHEN turn % 4 = 0 THEN 1.0E0 ELSE (length(text) % 10) / 10.0E0 END AS confidence,
       CASE WHEN length(text) % 11 = 0 THEN 'vocalization' ELSE 'speech' END AS utterance_type,
       CASE WHEN length(text) % 2 = 0 THEN 600 ELSE 200 END AS post_padding_ms
FROM conversations
"""

#: One paragraph for each turn and one for each document.
PARAGRAPHS = """
SELECT concat('c', CAST(conv_id AS STRING)) AS book_id, turn AS paragraph, concat('"', coalesce(text, ''), '" - said ', role, '.') AS text
FROM conversations
UNION ALL
SELECT concat('d', CAST(doc_id AS STRING)) AS book_id, CAST(0 AS BIGINT) AS paragraph, coalesce(text, '') AS text FROM documents
"""

#: Human corrections of speakers, one for each line in seven.
OVERRIDES = """
SELECT book_id, line_id, 'Eve' AS character, scene AS at FROM lines WHERE (scene + line_number) % 7 = 0
"""

SCENES = """
SELECT DISTINCT book_id, chapter, scene_id, scene, scene % 6 = 5 AS omit FROM lines
"""

#: Every 200 customers are a book, whose parts, chapters and scenes are their regions, nations and the customers.
_BOOK = "CAST(CAST(floor(c_custkey / 200) AS BIGINT) AS STRING)"
_VERSION = "CAST(floor(c_custkey / 200) AS BIGINT) % 3 + 1"
SECTIONS = f"""
SELECT DISTINCT concat('b', {_BOOK}, '_r', CAST(r_regionkey AS STRING)) AS section_id, CAST(NULL AS STRING) AS parent_id, concat('b', {_BOOK}) AS book_id, 'part' AS kind,
       CAST(r_regionkey AS BIGINT) AS position, r_name AS title, 'part' AS content_type, concat('md5:', md5(r_name)) AS text_hash, 'active' AS status,
       r_regionkey % 2 = 0 AS analysis_valid, TRUE AS audio_valid, TRUE AS render_valid, 'approved' AS approval, {_VERSION} AS structure_version, 0 AS size
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT DISTINCT concat('b', {_BOOK}, '_n', CAST(n_nationkey AS STRING)), concat('b', {_BOOK}, '_r', CAST(n_regionkey AS STRING)), concat('b', {_BOOK}), 'chapter',
       CAST(n_nationkey AS BIGINT), n_name, 'chapter', concat('md5:', md5(n_name)), CASE WHEN n_nationkey % 9 = 8 THEN 'deleted' ELSE 'active' END,
       n_nationkey % 3 > 0, n_nationkey % 5 > 0, n_nationkey % 4 > 0, CASE WHEN n_nationkey % 2 = 0 THEN 'approved' ELSE 'not_required' END, {_VERSION}, 0
FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL
SELECT concat('c', CAST(c_custkey AS STRING)), concat('b', {_BOOK}, '_n', CAST(c_nationkey AS STRING)), concat('b', {_BOOK}), 'scene',
       CAST(c_custkey AS BIGINT) % 200, c_name, 'scene', concat('md5:', md5(c_name)), CASE WHEN c_custkey % 10 = 9 THEN 'deleted' ELSE 'active' END,
       c_custkey % 5 > 0, c_custkey % 7 > 0, c_custkey % 6 > 0, CASE WHEN c_custkey % 2 = 0 THEN 'approved' ELSE 'pending' END, {_VERSION}, CAST(c_custkey % 100 AS INTEGER)
FROM customer
"""

#: Events as an audit log of model calls.
AUDIT = """
SELECT event_id, ts, CASE WHEN user_id % 3 = 0 THEN 'local' WHEN user_id % 3 = 1 THEN 'north' ELSE 'south' END AS provider,
       event_type AS task, value AS latency_ms, event_id % 7 > 0 AS success, CAST(user_id % 10 AS BIGINT) AS book
FROM events
"""

DERIVED = {
    "lines": LINES,
    "paragraphs": PARAGRAPHS,
    "overrides": OVERRIDES,
    "scenes": SCENES,
    "sections": SECTIONS,
    "audit": AUDIT,
}
NEEDS = {"overrides": ["lines"], "scenes": ["lines"]}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given or a derived table; views are not registered, so sessions can be shared."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sources = {t: derived(spark, sf_dir, t) for t in [*TABLES, *NEEDS.get(name, [])] if f" {t}" in DERIVED[name].replace("\n", " ")}
    text = DERIVED[name]
    for t in sources:
        for before in ("FROM", "JOIN"):
            text = text.replace(f"{before} {t}", f"{before} {{{t}}}")
    return spark.sql(text, **sources)


def oracle(sql: str, *names: str) -> str:
    """sql with the derived tables that it names as common table expressions."""
    wanted = [n for n in DERIVED if n in names or any(n in NEEDS.get(x, []) for x in names)]
    parts = ", ".join(f"{n} AS ({DERIVED[n].strip()})" for n in wanted)
    if not parts:
        return sql
    stripped = sql.strip()
    if stripped.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {parts}, {stripped[14:]}"
    if stripped.upper().startswith("WITH"):
        return f"WITH {parts}, {stripped[4:]}"
    return f"WITH {parts} {stripped}"
