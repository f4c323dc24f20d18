"""Manuscripts, logs and results as files: readers and writers, and the checks of uploads."""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkbooks.functions.text import printable_ratio, strip
from sparkbooks.operators.segments import SILENT_TAGS, SKIPPED_NAMES, filter_spine_items, html_to_text
from sparkbooks.sources.shared import small_batches

WORD_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
AUDIT_SCHEMA = (
    "timestamp double, provider string, model string, task_name string, latency_ms double, success boolean, error string, "
    "book string, owner string, project_id string, plan string, _corrupt string"
)


def relative_id(file: Column, path: str, ending: str) -> Column:
    """A file's path below the folder `path`, without its ending."""
    root = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/", path).rstrip("/")
    below = F.regexp_replace(F.url_decode(F.replace(file, F.lit("+"), F.lit("%2B"))), f"^.*?{re.escape(root)}/", "")
    return F.regexp_replace(below, re.escape(ending) + "$", "")


def read_text_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(book_id, source_file, text, status) of all .txt files under a folder: the id is the path below the folder, so that files of one name in two folders are two
    books. Undecodable bytes are replaced; files without anything visible are skipped_empty."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt")
    file = F.col("_metadata.file_path")
    status = F.when(strip(F.col("value")) == "", "skipped_empty").otherwise("ok")
    return files.select(relative_id(file, path, ".txt").alias("book_id"), file.alias("source_file"), F.make_valid_utf8("value").alias("text"), status.alias("status"))


def _docx_text(data: bytes) -> str | None:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    runs = ("".join(t.text or "" for t in p.iter(f"{WORD_NS}t")) for p in root.iter(f"{WORD_NS}p"))
    return "\n\n".join(r for r in runs if r)


@F.pandas_udf(T.StringType())
def docx_text(content: pd.Series) -> pd.Series:
    """A Word file's paragraphs with blank lines between, without empty ones; null if it is no such file."""
    return content.map(_docx_text)


def docx_corpus(files: DataFrame, path: str = "") -> DataFrame:
    """(book_id, source_file, text, status) of files(path, content): the text of Word files; broken ones have none."""
    text = docx_text("content")
    out = files.select(relative_id(F.col("path"), path, ".docx").alias("book_id"), F.col("path").alias("source_file"), text.alias("text"))
    return out.withColumn("status", F.when(F.col("text").isNull(), "broken").when(strip(F.col("text")) == "", "skipped_empty").otherwise("ok"))


def read_docx_corpus(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.docx").load(path)
    return docx_corpus(files, path)


def _spine(data: bytes) -> list[tuple[str, str, str]]:
    """(idref, href, html) of an EPUB's spine in order; navigation documents and what is no HTML are left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        container = ElementTree.fromstring(z.read("META-INF/container.xml"))
        rootfile = next(e for e in container.iter() if e.tag.endswith("rootfile")).attrib["full-path"]
        package = ElementTree.fromstring(z.read(rootfile))
        base, names = rootfile.rpartition("/")[0], set(z.namelist())
        items = {e.get("id"): e for e in package.iter() if e.tag.endswith("}item") and e.get("href")}
        out = []
        for ref in (e.get("idref") for e in package.iter() if e.tag.endswith("}itemref")):
            item = items.get(ref)
            if item is None or "nav" in (item.get("properties") or "").lower():
                continue
            href = f"{base}/{item.get('href')}" if base else item.get("href")
            page = "html" in item.get("media-type", "").lower() or href.lower().endswith((".xhtml", ".html", ".htm"))
            if page and href in names:
                out.append((ref, href, z.read(href).decode("utf-8", "replace")))
    return out


BROKEN_PACKAGE = (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError, RuntimeError, EOFError)


def epub_spines(files: DataFrame, path: str = "") -> DataFrame:
    """(book_id, spine_index, name, html, status) of files(path, content): one row for each content document of each EPUB; one broken row for a file that is none."""

    table = lambda rows: pd.DataFrame(rows, columns=["book_id", "spine_index", "name", "html", "status"]).astype({"spine_index": "Int32"})
    small_batches(files.sparkSession)

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows, held = [], 0
            for book, data in zip(frame["book_id"], frame["content"], strict=True):
                try:
                    rows += [(book, i, f"{ref} {href.rpartition('/')[2]}", page, "ok") for i, (ref, href, page) in enumerate(_spine(data))]
                except BROKEN_PACKAGE:
                    rows.append((book, None, None, None, "broken"))
                held += len(data)
                # many small packages make one table, a large one makes its own
                if held > 4 << 20:
                    yield table(rows)
                    rows, held = [], 0
            yield table(rows)

    named = files.select(relative_id(F.col("path"), path, ".epub").alias("book_id"), "content")
    return named.mapInPandas(parse, "book_id string, spine_index int, name string, html string, status string")


def read_epub_spines(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.epub").load(path)
    return epub_spines(files, path)


def epub_books(spines: DataFrame, least: int = 300) -> DataFrame:
    """(book_id, text, status) of spines: the chapters in spine order, with CHAPTER headings where theirs are not; a broken file has no text."""
    pages = html_to_text(spines.where("status = 'ok'").select("book_id", "spine_index", "name", "html")).drop("html")
    kept = filter_spine_items(pages, least)
    ordered = kept.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("spine_index", "heading", "text"))).alias("c"))

    def chapter(x: Column, i: Column) -> Column:
        n = (i + 1).cast("string")
        own = F.coalesce(x.heading, F.lit(""))
        head = F.when(own.rlike(r"(?i)^(chapter|letter|book|part)\b"), own).when(own != "", F.concat(F.lit("CHAPTER "), n, F.lit(". "), own)).otherwise(F.concat(F.lit("CHAPTER "), n, F.lit(".")))
        return F.concat(head, F.lit("\n\n"), x.text)

    books = ordered.select("book_id", F.concat(F.array_join(F.transform("c", chapter), "\n\n\n"), F.lit("\n")).alias("text"), F.lit("ok").alias("status"))
    broken = spines.where("status != 'ok'").select("book_id", F.lit(None).cast("string").alias("text"), "status")
    return books.unionByName(broken)


def read_epub_corpus(spark: SparkSession, path: str, least: int = 300) -> DataFrame:
    return epub_books(read_epub_spines(spark, path), least)


def read_audit_log(spark: SparkSession, path: str) -> DataFrame:
    """Calls of models, one JSON object a line; lines that are none are left out, absent fields are null."""
    rows = spark.read.schema(AUDIT_SCHEMA).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where("timestamp IS NOT NULL").drop("_corrupt").withColumn("ts", F.timestamp_seconds("timestamp"))


def read_line_artifacts(raw: DataFrame, enriched: DataFrame) -> DataFrame:
    """A book's enriched lines if it has any, else its raw ones."""
    rest = raw.join(enriched.select("book_id").distinct(), "book_id", "left_anti")
    return enriched.unionByName(rest, allowMissingColumns=True)


def manifests(lines: DataFrame) -> DataFrame:
    """One nested row for each book: chapters of scenes of lines in order, with totals."""
    line = F.struct("line_number", "line_id", "character", "segment_type", "text")
    scenes = lines.groupBy("book_id", "chapter", "scene").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    chapters = scenes.groupBy("book_id", "chapter").agg(F.array_sort(F.collect_list(F.struct("scene", "lines"))).alias("scenes"))
    totals = F.struct(F.count("*").alias("chapters"), F.sum(F.size("scenes")).alias("scenes"), F.sum(F.aggregate("scenes", F.lit(0), lambda n, s: n + F.size(s.lines))).alias("lines"))
    return chapters.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("chapter", "scenes"))).alias("chapters"), totals.alias("totals"))


def write_manifest_json(lines: DataFrame, path: str) -> None:
    manifests(lines).write.mode("overwrite").json(path)


def flat_for_csv(results: DataFrame) -> DataFrame:
    """Results with lists, maps and structs as JSON text and NaN as null."""
    out = []
    for f in results.schema.fields:
        if isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType):
            out.append(F.to_json(f.name).alias(f.name))
        elif isinstance(f.dataType, T.DoubleType | T.FloatType):
            out.append(F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return results.select(*out)


def write_results_csv(results: DataFrame, path: str) -> None:
    flat_for_csv(results).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_clip_manifest(clips: DataFrame, path: str) -> None:
    """id|transcript|emotion|duration|snr|verdict"""
    columns = ["id", "transcript", "emotion", F.format_number("duration_s", 2), F.format_number("snr_db", 1), "verdict"]
    clips.select(*columns).write.mode("overwrite").option("sep", "|").csv(path)


def provenance_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of all files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def _package_error(kind: str, data: bytes) -> str | None:
    """What is wrong with a Word file or an EPUB, as a code. An EPUB needs a content document of twenty letters or digits that is not left out by its name."""
    if kind == "docx":
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                return None if "word/document.xml" in z.namelist() else "INVALID_DOCX"
        except zipfile.BadZipFile:
            return "INVALID_DOCX"
    try:
        pages = _spine(data)
    except BROKEN_PACKAGE:
        return "INVALID_EPUB"
    named = [page for ref, href, page in pages if not re.search(SKIPPED_NAMES, f"{ref} {href.rpartition('/')[2]}")]
    silent = re.compile(rf"(?is)<({SILENT_TAGS})\b.*?</\1\s*>|<[^>]*>")
    return None if any(len(re.sub(r"\W+", "", html.unescape(silent.sub("", page)))) >= 20 for page in named) else "EMPTY_EPUB"


def validate_uploads(uploads: DataFrame, most_bytes: int = 80 << 20, printable: float = 0.9) -> DataFrame:
    """uploads(filename, content, ..) with an error_code, null where the file can be read.

    Of a text: SPOOFED_EXTENSION if it is a package or less than `printable` of it can be printed, TEXT_DECODE_FAILED if it is not UTF-8, MISSING_FILE if nothing in it is
    visible, FILE_TOO_LARGE after all these; of a package FILE_TOO_LARGE comes first.
    """

    @F.pandas_udf(T.StringType())
    def package_error(kinds: pd.Series, contents: pd.Series) -> pd.Series:
        return pd.Series([_package_error(k, c) if k is not None and c is not None else None for k, c in zip(kinds, contents, strict=True)], dtype=object)

    kind = F.lower(F.regexp_extract(F.coalesce("filename", F.lit("")), r"\.([^.]+)$", 1))
    content, text = F.col("content"), F.col("content").cast("string")
    zipped = F.startswith(content, F.lit(b"PK")) & F.contains(content, F.lit(b"PK\x05\x06"))
    large = F.length("content") > most_bytes
    of_text = (
        F.when(zipped, "SPOOFED_EXTENSION")
        .when(~F.is_valid_utf8(text), "TEXT_DECODE_FAILED")
        .when(strip(text) == "", "MISSING_FILE")
        .when(printable_ratio(text) < printable, "SPOOFED_EXTENSION")
        .when(large, "FILE_TOO_LARGE")
    )
    package = kind.isin("docx", "epub")
    code = (
        F.when(F.coalesce(F.col("filename"), F.lit("")) == "", "MISSING_FILE")
        .when(content.isNull(), "MISSING_FILE")
        .when(~kind.isin("txt", "docx", "epub"), "UNSUPPORTED_FORMAT")
        .when(kind == "txt", of_text)
        .when(large, "FILE_TOO_LARGE")
        .otherwise(F.col("__package"))
    )
    # only packages go to Python
    checked = F.when(package & content.isNotNull() & ~large, package_error(F.when(package & ~large, kind), F.when(package & ~large, content)))
    return uploads.withColumn("__package", checked).withColumn("error_code", code).drop("__package")
