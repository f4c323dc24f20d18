"""Sharding by rendezvous hashing over weighted shards, in DataFrame functions alone.

Each shard draws a number from the record's key and its own number; the record goes to the shard
with the best draw. A further shard only wins some of the records, so no record moves between old shards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkbooks.llm.shared import power_of_two

#: Rows that one task numbers, about.
CHUNK_ROWS = 8192


def _digest(key: Column, salt: Column) -> Column:
    return F.md5(F.concat(key, F.lit(":"), salt).cast("binary"))


def _unit(digest: Column) -> Column:
    """The first 52 bits of a hex digest as a number above 0 and below 1."""
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _draw(key: Column, weight: float, j: int) -> Column:
    """What shard j draws for a key: weight / -ln(draw), and the shard so that of equal draws the first counts as larger."""
    score = F.lit(float(weight)) / -F.log(_unit(_digest(F.coalesce(key.cast("string"), F.lit("null")), F.lit(str(j)))))
    return F.struct(score.alias("score"), F.lit(-j).alias("shard"))


def _best(key: Column, weights: Sequence[float]) -> Column:
    if not weights or min(weights) <= 0:
        raise ValueError("each shard needs a weight above 0")
    draws = [_draw(key, w, j) for j, w in enumerate(weights)]
    return F.greatest(*draws) if len(draws) > 1 else draws[0]


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The number of the shard with the largest weight / -ln(draw); of equal ones the first.

    A null key is a key of its own. Weights must be above 0.
    """
    return (-_best(key, weights)["shard"]).cast("int")


def shard(
    docs: DataFrame,
    weights: Sequence[float] = (1.0,) * 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    grown: float = 1.0,
) -> DataFrame:
    """One row for each row of docs: id, size, text_crc32, law, shard, slot, grown_shard.

    law is 'key': the id and the weights decide. grown_shard is the shard if one more of weight `grown`
    were there. slot numbers a shard's rows from 0 without gaps, by the key's digest, then id, checksum and size;
    rows equal in all of these are interchangeable. A null text has no bytes and checksum 0. Rows with a null
    id share a shard, and are numbered there by the digest of their text's checksum. No rows give no rows; other columns are not looked at.

    Slots are counted in chunks of each shard, so that no task sorts a whole shard: chunk totals are summed
    first, then rows are numbered within their chunk.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    if grown <= 0:
        raise ValueError("each shard needs a weight above 0")
    key = F.col(id_col)
    rows = docs.select(
        key.alias("id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        _best(key, weights).alias("best"),
        # a shard more is one draw more
        _draw(key, grown, len(weights)).alias("more"),
        F.md5(F.coalesce(key.cast("string"), F.concat(F.lit("null "), F.crc32(text.cast("binary")).cast("string"))).cast("binary")).alias("place"),
    )
    number = lambda best: (-best["shard"]).cast("int")
    shards = [number(F.col("best")).alias("shard"), number(F.greatest("best", "more")).alias("grown_shard")]
    rows = rows.select("id", "size", "text_crc32", *shards, "place")
    bits = min(40, power_of_two(docs.count() / len(weights) / CHUNK_ROWS) + 3)
    rows = rows.withColumn("chunk", F.shiftright(F.conv(F.substring("place", 1, 10), 16, 10).cast("long"), 40 - bits))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = (
        rows.groupBy("shard", "chunk")
        .agg(F.count("*").alias("n"))
        .select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    order = Window.partitionBy("shard", "chunk").orderBy("place", "id", "text_crc32", "size")
    numbered = rows.withColumn("at", F.row_number().over(order)).join(chunks, ["shard", "chunk"])
    return numbered.select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("start") + F.col("at") - 1).cast("long").alias("slot"),
        "grown_shard",
    )
