"""Queries of streams and of files; each replays or reads a whole given table."""

from __future__ import annotations

import io
import re
import zipfile
from xml.sax.saxutils import escape

import pandas as pd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkbooks.plans.inputs import AUDIT, derived, oracle
from sparkbooks.plans.registry import QUERIES, SQL, query
from sparkbooks.sources import files as fl
from sparkbooks.sources.shared import shared_path
from sparkbooks.streaming import usage as us


def _replayed(spark: SparkSession, sf_dir: str, name: str, parts: int = 4) -> tuple[DataFrame, str]:
    """A given table as a stream: its rows in files of a folder, in the order of time if it has one."""
    folder = shared_path(spark, "replay")
    rows = derived(spark, sf_dir, name)
    (rows.repartitionByRange(parts, "ts") if "ts" in rows.columns else rows).write.parquet(folder)
    return us.replay(spark, folder, rows.schema), folder


def r1_usage_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as an audit stream, aggregated by the hour; update mode, so that the last windows are there too."""
    events, folder = _replayed(spark, sf_dir, "events")
    audit = spark.sql(AUDIT.replace("FROM events", "FROM {events}"), events=events)
    # append mode would hold back the windows that the watermark has not passed, so updates are kept and the last of each window counts
    out = us.run_updates(us.usage_stream(audit), folder, ["start", "provider", "task"], "calls")
    return out


def r1_usage_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hours of the same stream that the watermark has closed when all events have come, in append mode."""
    events, folder = _replayed(spark, sf_dir, "events")
    audit = spark.sql(AUDIT.replace("FROM events", "FROM {events}"), events=events)
    return us.run_closed(us.usage_stream(audit), f"{folder}-closed")[0]


def r3_latest_progress_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, folder = _replayed(spark, sf_dir, "events")
    rows = events.select(F.col("user_id").alias("book"), F.col("event_type").alias("stage"), "ts", "event_id", "value")
    return us.run_latest(rows, f"{folder}-latest", ["book", "stage"], ["ts", "event_id"]).drop("ts")


def r4_override_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, folder = derived(spark, sf_dir, "lines"), shared_path(spark, "replay")
    lines.select("line_id", "character").write.parquet(folder)
    stream = us.replay(spark, folder, lines.select("line_id", "character").schema)
    return us.run_to_end(us.override_stream(stream, derived(spark, sf_dir, "overrides")), folder + "-out")


QUERIES |= {"R1_usage_stream": r1_usage_stream, "R1_usage_closed": r1_usage_closed, "R3_latest_progress_stream": r3_latest_progress_stream, "R4_override_stream": r4_override_stream}
SQL |= {
    "R1_usage_stream": oracle(
        "SELECT date_trunc('hour', ts) AS start, provider, task, count(*) AS calls, sum(success::INTEGER)::BIGINT AS successes, round(sum(latency_ms), 2) AS latency_ms FROM audit GROUP BY ALL", "audit"
    ),
    "R1_usage_closed": oracle(
        """SELECT date_trunc('hour', ts) AS start, provider, task, count(*) AS calls, sum(success::INTEGER)::BIGINT AS successes, round(sum(latency_ms), 2) AS latency_ms FROM audit
           WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM audit) - INTERVAL 10 MINUTE GROUP BY ALL""", "audit"
    ),
    "R3_latest_progress_stream": "SELECT user_id AS book, event_type AS stage, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL",
    "R4_override_stream": oracle("SELECT line_id, coalesce(o.character, l.character) AS character FROM lines l LEFT JOIN overrides o USING (line_id)", "lines", "overrides"),
}


def _book_files(lines: DataFrame) -> str:
    """The books' lines in order as text files, one folder a book; the folder above."""
    folder = shared_path(lines.sparkSession, "books")
    ordered = lines.select("book_id", "scene", "line_number", F.regexp_replace("text", r"[\r\n]+", " ").alias("text"))
    ordered.repartition("book_id").sortWithinPartitions("book_id", "scene", "line_number").select("book_id", "text").write.partitionBy("book_id").text(folder)
    return folder


_BOOK_TEXT = "SELECT book_id, string_agg(regexp_replace(text, '[\\r\\n]+', ' ', 'g'), chr(10) ORDER BY scene, line_number) || chr(10) AS text FROM lines GROUP BY book_id"


@query("S1_read_text_corpus", "lines", sql=f"SELECT book_id, text, 'ok' AS status FROM ({_BOOK_TEXT})")
def s1(lines: DataFrame) -> DataFrame:
    """Books written as files and read back; their ids are the folders below the one that is read."""
    read = fl.read_text_corpus(lines.sparkSession, _book_files(lines))
    return read.select(F.regexp_extract("book_id", "^book_id=([^/]*)/part-", 1).alias("book_id"), "text", "status")


@query("V25_provenance_hashes", "lines", sql=f"SELECT book_id, strlen(text)::BIGINT AS bytes, sha256(text) AS sha256 FROM ({_BOOK_TEXT})")
def v25(lines: DataFrame) -> DataFrame:
    """The hashes of the books' files."""
    found = fl.provenance_hashes(lines.sparkSession, _book_files(lines)).where("path LIKE '%.txt'")
    return found.select(F.regexp_extract("path", "/book_id=([^/]*)/", 1).alias("book_id"), "bytes", "sha256")


@F.pandas_udf(T.BinaryType())
def word_file(texts: pd.Series) -> pd.Series:
    """Word files with a paragraph for each line."""

    def made(text: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            body = "".join(f"<w:p><w:r><w:t>{escape(line)}</w:t></w:r></w:p>" for line in text.split("\n"))
            z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
        return out.getvalue()

    return texts.map(lambda t: made(t or ""))


@F.pandas_udf(T.BinaryType())
def epub_file(names: pd.Series, pages: pd.Series) -> pd.Series:
    """EPUBs with a cover and one page, or nothing at all where the page is null."""

    def made(name: str, page: str | None) -> bytes:
        if page is None:
            return b"no package"
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="b.opf"/></rootfiles></container>')
            items = "".join(f'<item id="{x}" href="{x}.xhtml" media-type="application/xhtml+xml"/>' for x in ("cover", name))
            z.writestr("b.opf", f'<package xmlns="http://www.idpf.org/2007/opf"><manifest>{items}</manifest><spine><itemref idref="cover"/><itemref idref="{name}"/></spine></package>')
            z.writestr("cover.xhtml", page)
            z.writestr(f"{name}.xhtml", page)
        return out.getvalue()

    return pd.Series([made(n, p) for n, p in zip(names, pages, strict=True)])


@query("S2_read_docx_corpus", "documents", sql="""
SELECT doc_id::VARCHAR AS book_id, CASE WHEN doc_id % 10 > 0 THEN array_to_string(list_filter(string_split(regexp_replace(text, '[\\x00-\\x08\\x0B-\\x1F]', ' ', 'g'), chr(10)), lambda x: x != ''), chr(10) || chr(10)) END AS text,
       CASE WHEN doc_id % 10 = 0 THEN 'broken' WHEN regexp_matches(text, '[^\\s]') THEN 'ok' ELSE 'skipped_empty' END AS status FROM documents WHERE text IS NOT NULL""")
def s2(documents: DataFrame) -> DataFrame:
    """Documents made Word files, of which some are broken."""
    plain = F.regexp_replace("text", r"[\x00-\x08\x0B-\x1F]", " ")
    content = F.when(F.col("doc_id") % 10 == 0, F.lit(b"no package")).otherwise(word_file(plain))
    files = documents.where("text IS NOT NULL").select(F.concat(F.lit("/files/"), F.col("doc_id").cast("string"), F.lit(".docx")).alias("path"), content.alias("content"))
    return fl.docx_corpus(files, "/files").select("book_id", "text", "status")


@query("S3_read_epub_corpus", "pages", sql="""
SELECT page_id::VARCHAR AS book_id, CASE WHEN page_id % 10 > 0 THEN 'CHAPTER 1. ' || page_id || chr(10) || chr(10) || 'text ' || repeat('of a page ', 40) || 'end' || chr(10) END AS text,
       CASE WHEN page_id % 10 = 0 THEN 'broken' ELSE 'ok' END AS status FROM pages""")
def s3(pages: DataFrame) -> DataFrame:
    """Pages in EPUBs, of which some are broken; the cover is left out, and the heading becomes the chapter's."""
    page = F.concat(F.lit("<html><head><title>no</title></head><body><h2>"), F.col("page_id").cast("string"), F.lit("</h2><p>text "), F.repeat(F.lit("of a page "), 40), F.lit("end</p></body></html>"))
    content = epub_file(F.concat(F.lit("p"), F.col("page_id").cast("string")), F.when(F.col("page_id") % 10 > 0, page))
    files = pages.select(F.concat(F.lit("/files/"), F.col("page_id").cast("string"), F.lit(".epub")).alias("path"), content.alias("content"))
    return fl.epub_books(fl.epub_spines(files, "/files"))


@query("S5_read_audit_log", "events", sql="SELECT floor(epoch(ts))::BIGINT AS second, event_type AS task_name, value AS latency_ms, event_id % 7 > 0 AS success, CASE WHEN event_id % 3 = 0 THEN user_id::VARCHAR END AS book FROM events")
def s5(events: DataFrame) -> DataFrame:
    """Events written as a log of JSON lines, a broken line after each tenth, and read back."""
    spark, folder = events.sparkSession, shared_path(events.sparkSession, "audit")
    row = F.to_json(
        F.struct(
            F.unix_timestamp("ts").cast("double").alias("timestamp"), F.col("event_type").alias("task_name"), F.col("value").alias("latency_ms"), (F.col("event_id") % 7 > 0).alias("success"),
            F.when(F.col("event_id") % 3 == 0, F.col("user_id").cast("string")).alias("book"),
        )
    )
    events.select(F.concat(row, F.when(F.col("event_id") % 10 == 0, '\n{"timestamp": 1, "task').otherwise("")).alias("value")).write.text(folder)
    log = fl.read_audit_log(spark, folder)
    return log.select(F.col("timestamp").cast("long").alias("second"), "task_name", "latency_ms", "success", "book")


@query("S9_write_clip_manifest", "events", sql="SELECT event_id::VARCHAR AS id, 'said ' || event_type AS transcript, CASE WHEN event_id % 2 = 0 THEN 'Joy' END AS emotion, verdict FROM (SELECT *, CASE WHEN value < 5 THEN 'REJECT' ELSE 'PASS' END AS verdict FROM events)")
def s9(events: DataFrame) -> DataFrame:
    """Clips written as a manifest and read back."""
    spark, folder = events.sparkSession, shared_path(events.sparkSession, "clips")
    verdict = F.when(F.col("value") < 5, "REJECT").otherwise("PASS")
    clips = events.select(
        F.col("event_id").alias("id"), F.concat(F.lit("said "), "event_type").alias("transcript"), F.when(F.col("event_id") % 2 == 0, "Joy").alias("emotion"),
        F.col("value").alias("duration_s"), F.col("value").alias("snr_db"), verdict.alias("verdict"),
    )
    fl.write_clip_manifest(clips, folder)
    return spark.read.option("sep", "|").schema("id string, transcript string, emotion string, duration string, snr string, verdict string").csv(folder).select("id", "transcript", "emotion", "verdict")


@query("S7_manifests", "lines", sql="""
SELECT book_id, chapter, scene, line_number, line_id, character, segment_type, text, count(*) OVER (PARTITION BY book_id) AS lines,
       (SELECT count(DISTINCT x.scene) FROM lines x WHERE x.book_id = lines.book_id) AS scenes, (SELECT count(DISTINCT x.chapter) FROM lines x WHERE x.book_id = lines.book_id) AS chapters FROM lines""")
def s7(lines: DataFrame) -> DataFrame:
    """The manifests written as JSON, read back and unfolded again, with their totals."""
    spark, folder = lines.sparkSession, shared_path(lines.sparkSession, "manifests")
    fl.write_manifest_json(lines, folder)
    m = spark.read.schema(fl.manifests(lines).schema).json(folder).select("book_id", "totals", F.explode("chapters").alias("c"))
    m = m.select("book_id", "totals", "c.chapter", F.explode("c.scenes").alias("s")).select("book_id", "totals", "chapter", "s.scene", F.explode("s.lines").alias("l"))
    return m.select("book_id", "chapter", "scene", "l.*", F.col("totals.lines").cast("long").alias("lines"), F.col("totals.scenes").alias("scenes"), F.col("totals.chapters").alias("chapters"))


@query("S4_read_line_artifacts", "lines", sql="SELECT line_id, CASE WHEN chapter IN (SELECT chapter FROM lines WHERE scene % 10 < 5) THEN 'enriched' ELSE 'raw' END AS lane FROM lines")
def s4(lines: DataFrame) -> DataFrame:
    """Some chapters were enriched; they are the books here."""
    books = lines.withColumn("book_id", F.col("chapter").cast("string"))
    done = books.join(books.where("scene % 10 < 5").select("book_id").distinct(), "book_id", "left_semi")
    return fl.read_line_artifacts(books.withColumn("lane", F.lit("raw")), done.withColumn("lane", F.lit("enriched"))).select("line_id", "lane")


@query("S8_flat_results", "lines", sql="""
SELECT line_id, to_json(string_split(text, ' ')[1:3])::VARCHAR AS words, '{"chapter":' || chapter || ',"scene":' || scene || '}' AS place,
       CASE WHEN line_number % 4 > 0 THEN confidence END AS confidence, CASE WHEN line_number % 3 > 0 THEN '{"' || character || '":' || line_number || '}' END AS counts FROM lines""")
def s8(lines: DataFrame) -> DataFrame:
    """Results with lists, structs, maps and NaN written as CSV and read back."""
    spark, folder = lines.sparkSession, shared_path(lines.sparkSession, "results")
    counts = F.when(F.col("line_number") % 3 > 0, F.create_map("character", "line_number")).alias("counts")
    confidence = F.when(F.col("line_number") % 4 > 0, F.col("confidence")).otherwise(F.lit(float("nan"))).alias("confidence")
    results = lines.select("line_id", F.slice(F.split("text", " "), 1, 3).alias("words"), F.struct("chapter", "scene").alias("place"), confidence, counts)
    fl.write_results_csv(results, folder)
    return spark.read.schema("line_id string, words string, place string, confidence double, counts string").csv(folder, header=True, escape='"', multiLine=True)


@query("P10_validate_uploads", "documents", sql="""
SELECT doc_id, CASE WHEN text IS NULL THEN 'MISSING_FILE' WHEN doc_id % 4 = 1 THEN CASE doc_id % 20 WHEN 5 THEN 'EMPTY_EPUB' WHEN 9 THEN NULL ELSE 'INVALID_EPUB' END WHEN doc_id % 4 = 2 THEN 'UNSUPPORTED_FORMAT' WHEN doc_id % 4 = 3 THEN CASE WHEN doc_id % 20 != 7 THEN 'INVALID_DOCX' END
  WHEN doc_id % 20 = 4 THEN 'SPOOFED_EXTENSION' WHEN doc_id % 20 = 8 THEN 'TEXT_DECODE_FAILED' WHEN doc_id % 20 = 12 OR NOT regexp_matches(text, '[^\\s]') THEN 'MISSING_FILE' END AS error_code FROM documents""")
def p10(documents: DataFrame) -> DataFrame:
    """Documents' bytes as uploads under names of four kinds: plain, damaged, blank and as packages of all kinds."""
    kind = F.element_at(F.array(*[F.lit(x) for x in (".txt", ".epub", ".pdf", ".docx")]), (F.col("doc_id") % 4 + 1).cast("int"))
    raw, k = F.encode("text", "UTF-8"), F.col("doc_id") % 20
    page = F.when(k == 5, F.lit("<p>too short</p>")).when(k == 9, F.lit("<p>long enough to be a page of a book</p>"))
    content = F.when(k == 4, F.encode(F.concat(F.repeat(F.lit("\x01"), 4000), F.substring("text", 1, 16_000)), "UTF-8")).when(k == 8, F.concat(raw, F.lit(b"\xff")))
    content = content.when(k == 12, F.lit(b" \n\t ")).when(k.isin(5, 9), epub_file(F.lit("p1"), page)).when(k == 7, word_file(F.lit("x"))).otherwise(raw)
    uploads = documents.select("doc_id", F.concat(F.lit("f"), kind).alias("filename"), F.when(F.col("text").isNotNull(), content).alias("content"))
    return fl.validate_uploads(uploads).select("doc_id", "error_code")
