"""A training-data pipeline over documents: each stage works on what the stage before it kept.

1. toxicity: documents that the class-conditional models call toxic go; the models learn from `labels` and from documents that have reached this stage.
2. exact_dedup: of equal texts one stays.
3. near_dedup: of documents linked by shared five-word shingles (similarity 0.8) one stays, the one with the smallest id.
4. mixing: the sources are mixed to their target weights; a document appears as often as the schedule takes its first word's block.
5. bpe: what is left is encoded, and decoded again.

Each function takes (spark, docs, sf_dir); all but the last return the columns of documents. Empty inputs give empty outputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkbooks.llm import bpe, exact_dedup, jaccard_join, mixing, toxicity
from sparkbooks.llm.queries import rank_file
from sparkbooks.llm.shared import same, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below one half. Null and empty texts have the score of no evidence; repeated rows stay or go together; no rows
    give no rows; columns of any names are kept."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_ordinary(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id. Null and empty texts are equal; a null id loses to any other; of repeated rows one stays; no
    rows give no rows; columns of any names are kept."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents of a component the one with the smallest id stays. A null id loses to any other; a component with only null ids stays
    whole. Documents without words, null texts among them, link with nothing and stay. Repeated rows stay or go together; no rows give no rows; columns of
    any names are kept."""
    found = jaccard_join.jaccard_components(docs.select("doc_id", "text"), text_key=True)
    loses = "n_shingles > 0 AND component_id IS NOT NULL AND (doc_id IS NULL OR doc_id != component_id)"
    gone = found.where(loses).select(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).distinct()
    gone = written(gone, "near-copies").alias("gone")
    shown = held(docs, F.xxhash64(docs["text"]).alias("key"))
    return shown.join(gone, same(F.col("shown.id"), F.col("gone.id")) & (F.col("shown.key") == F.col("gone.key")), "left_anti").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the mix, repeated as often as the schedule takes them. Documents without words, null texts among them, are in no mix. Rows that
    repeat id, source and size are taken as often as the most taken of them; no rows give no rows; columns of any names are kept."""
    mixed = mixing.mix(docs.select("doc_id", "text", "source")).groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies")).where("copies > 0")
    mixed = written(mixed.select(F.col("doc_id").alias("id"), "source", "size", "copies"), "mix-copies").alias("mixed")
    size = F.coalesce(F.regexp_count(docs["text"], F.lit(mixing.WORD)), F.lit(0)).cast("long").alias("size")
    shown = held(docs, docs["source"].alias("source"), size)
    on = same(F.col("shown.id"), F.col("mixed.id")) & same(F.col("shown.source"), F.col("mixed.source")) & (F.col("shown.size") == F.col("mixed.size"))
    return shown.join(mixed, on).select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row. A null text counts as empty, and has no tokens; repeated rows are encoded each; no
    rows give no rows; other columns are not looked at."""
    path, pattern = rank_file()
    return bpe.digests(bpe.encode(docs.select("doc_id", "text"), path, pattern, decoded=True))


def held(docs: DataFrame, *columns: Column) -> DataFrame:
    """(row, id, *columns) of docs: its own columns are in row, where their names cannot clash with others."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].alias("id"), *columns).alias("shown")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Toxicity has no SQL, so the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
