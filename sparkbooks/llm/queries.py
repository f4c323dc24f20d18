"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkbooks.llm import (
    bpe,
    divergence,
    embedding_dedup,
    exact_dedup,
    importance,
    jaccard_join,
    mixing,
    packing,
    secret_scan,
    sharding,
    token_counts,
    toxicity,
    warc_audit,
)
from sparkbooks.llm.shared import shared_folder, table


def rank_file() -> tuple[str, str]:
    """The rank file and the pattern that op1 encodes by."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def piece_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def word_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = rank_file()
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), path, pattern, decoded=True))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find_secrets(table(spark, sf_dir, "documents")))


def damaged_copy(pages: DataFrame) -> DataFrame:
    """A replica of pages with known damage, chosen by the hash of the id: a character changed in place, one put before the page, pages lost, and pages added."""
    part = F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 2)
    changed = F.concat(F.when(F.substring("html", 1, 1) == "<", "#").otherwise("<"), F.expr("substring(html, 2)"))
    html = F.when((part == "7f") & (F.length("html") > 0), changed).when(part == "7e", F.concat(F.lit("#"), F.coalesce("html", F.lit("")))).otherwise(F.col("html"))
    kept = pages.where(F.coalesce(part != "3c", F.lit(True))).withColumn("html", html)
    return kept.unionByName(pages.where(part == "55").withColumn("page_id", F.col("page_id") + ADDED))


#: What is added to the ids of pages that only the replica of op4 has.
ADDED = 10**12


def op4_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages and a replica with known damage as WARC files, reads both back, and finds what is damaged, missing or added."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    rows, levels = pages.count(), []
    for side in (pages, damaged_copy(pages)):
        path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
        warc_audit.write_warc(side, path, rows)
        read = warc_audit.read_warc(spark, path, bodies=False)
        number = F.regexp_extract("file", "/file=([0-9]+)/", 1).cast("long")
        levels.append(warc_audit.tree_levels(read.withColumn("file", number)))
    found = warc_audit.audit(*levels)
    page = F.regexp_extract("id", "^<urn:page:([0-9-]+)>$", 1).cast("long")
    return found.select(page.alias("page_id"), "file", "number", "begin", "end", "status")


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), n=3, percent=90)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), piece_file())


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_file())


QUERIES = {
    f.__name__: f
    for f in (
        op1_bpe,
        op2_toxicity,
        op3_secrets,
        op4_warc_audit,
        op5_jaccard,
        op6_sharding,
        op7_embeddings,
        op8_token_counts,
        op9_exact_dedup,
        op10_mixing,
        op11_divergence,
        op12_importance,
        op13_packing,
    )
}

OP4_SQL = """
WITH p AS (
  SELECT page_id, md5(page_id::VARCHAR)[1:2] AS part, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages
), both_sides AS (
  SELECT 'ours' AS side, page_id, url, html FROM p
  UNION ALL SELECT 'theirs', page_id, url, CASE WHEN part = '7f' AND length(html) > 0 THEN CASE WHEN html[1] = '<' THEN '#' ELSE '<' END || html[2:]
                                               WHEN part = '7e' THEN '#' || html ELSE html END FROM p WHERE part != '3c'
  UNION ALL SELECT 'theirs', page_id + 1000000000000, url, html FROM p WHERE part = '55'
), r AS (
  SELECT side, page_id, html, ('0x' || md5(page_id::VARCHAR)[1:12])::BIGINT % (SELECT greatest(1, (count(*) + 1023) // 1024) FROM pages) AS file,
         strlen('WARC/1.0') + 2 + strlen('WARC-Type: response') + 2 + strlen('WARC-Target-URI: ') + strlen(url) + 2
         + strlen('WARC-Record-ID: <urn:page:') + strlen(page_id::VARCHAR) + 1 + 2 + strlen('Content-Type: text/html; charset=utf-8') + 2
         + strlen('Content-Length: ') + strlen(strlen(html)::VARCHAR) + 4 + strlen(html) + 4 AS length
  FROM both_sides
), f AS (
  SELECT *, row_number() OVER w - 1 AS number, (sum(length) OVER (w ROWS UNBOUNDED PRECEDING))::BIGINT AS "end" FROM r
  WINDOW w AS (PARTITION BY side, file ORDER BY page_id)
), m AS (
  SELECT a.page_id AS a, b.page_id AS b, coalesce(a.page_id, b.page_id) AS page_id, coalesce(a.file, b.file) AS file, coalesce(a.number, b.number) AS number,
         coalesce(a."end", b."end") AS "end", coalesce(a.length, b.length) AS length, a.html AS ours, b.html AS theirs
  FROM (SELECT * FROM f WHERE side = 'ours') a FULL JOIN (SELECT * FROM f WHERE side = 'theirs') b ON a.page_id = b.page_id
)
SELECT page_id, file::BIGINT AS file, number::BIGINT AS number, "end" - length AS begin, "end",
       CASE WHEN b IS NULL THEN 'missing' WHEN a IS NULL THEN 'added' ELSE 'damaged' END AS status
FROM m WHERE a IS NULL OR b IS NULL OR ours != theirs
"""

OP5_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
                                    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM d
), n AS (SELECT doc_id, coalesce(len(s), 0)::BIGINT AS n, s FROM s),
t AS (SELECT doc_id, n, unnest(s) AS g FROM n),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n) GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common WHERE 100 * i >= 90 * (na + nb - i)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a
)
SELECT doc_id, n AS n_shingles, component_id, (SELECT count(*) FROM both_ways WHERE both_ways.a = doc_id) AS n_links FROM n JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
"""

OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id != b.vec_id
  WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e)) / sqrt(list_inner_product(b.e, b.e)) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c
"""

OP9_SQL = """
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256, 0::INTEGER AS chain FROM d JOIN g USING (t)
"""

SQL = {
    "op4_warc_audit": OP4_SQL,
    "op5_jaccard": OP5_SQL,
    "op7_embeddings": OP7_SQL,
    "op9_exact_dedup": OP9_SQL,
    "op10_mixing": mixing.sql(),
    "op11_divergence": divergence.sql(),
}
