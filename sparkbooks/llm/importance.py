"""Importance resampling towards a target distribution, with the drawn rows found by distributed quickselect.

Features of a text are its words and pairs of neighbouring words, hashed into buckets. Counts of all documents and of the target texts give each bucket
a gain, the log-ratio of its shares; a document's weight is the mean gain over its features, read from the array of gains. Gumbel noise from the hash
of the id is added, and the highest scores are drawn, which samples without replacement in proportion to exp(weight).

The draw sorts only the winners. Pivots are taken at random among the keys still in question, one pass counts exactly how many keys lie before, on
and between them, and the search goes on where the k-th lies, until it falls on a pivot.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkbooks.llm.shared import id_type, slices, written

BUCKETS = 10_000
#: What one more count stands for in a gain, gains, noise and scores being whole numbers.
UNIT = 1000
#: Pivots of a round.
PIVOTS = 32
#: Different words whose checksums a task holds, and bytes of text taken at once.
HELD, AT_ONCE = 1 << 18, 1 << 20

#: 0-9, a-z and bytes of other characters as they are, A-Z lower-cased, all else a space.
TO_WORDS = bytes(b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
space = re.compile(rb"\x20")


@lru_cache
def _zeros() -> list[np.ndarray]:
    """For k from 0: what 2^k zero bytes make of a CRC-32 register, as tables by the register's four bytes."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1)
    basis = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * j) for j in range(4)])
    tables = [(basis >> np.uint32(8)) ^ one[basis & 255]]
    for _ in range(31):
        tables.append(_through(tables[-1], tables[-1]))
    return tables


def _through(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    return table[0][x & 255] ^ table[1][(x >> 8) & 255] ^ table[2][(x >> 16) & 255] ^ table[3][x >> 24]


def joined_crc(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRC-32 of strings put together: left's is carried over the length of right, as the checksum is linear."""
    left = left.copy()
    for k in range(int(length.max(initial=0)).bit_length()):
        at = np.flatnonzero(length >> k & 1)
        left[at] = _through(_zeros()[k], left[at])
    return left ^ right


class Features:
    """Buckets of texts' features, with the checksums of the words that a task has met."""

    def __init__(self, buckets: int):
        self.buckets, self.places = buckets, {}
        n = HELD + AT_ONCE
        self.crc, self.open, self.length = np.zeros(n, np.uint32), np.zeros(n, np.uint32), np.zeros(n, np.int64)

    def of(self, text: bytes) -> Iterator[np.ndarray]:
        """The buckets of all features of text, part by part."""
        before = None
        for part in slices(text.translate(TO_WORDS), space, AT_ONCE):
            words = part.split()
            if not words:
                continue
            if len(self.places) > HELD:
                self.places.clear()
            known = self.places
            for w in set(words).difference(known):
                i = known[w] = len(known)
                self.crc[i] = crc = zlib.crc32(w)
                self.open[i], self.length[i] = zlib.crc32(b" ", crc), len(w)
            at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            crc, left = self.crc[at], self.open[at]
            if before is not None:
                left = np.concatenate([before, left])
            right = crc if before is not None else crc[1:]
            pairs = joined_crc(left[: len(right)], right, self.length[at[len(at) - len(right) :]])
            before = left[-1:]
            yield np.concatenate([crc, pairs]) % self.buckets


def _texts(column: pa.Array) -> Iterator[bytes]:
    for text in column:
        yield text.as_buffer().to_pybytes() if text.is_valid else b""


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows of docs: `buckets` numbers, however many rows there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, counts = Features(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in _texts(batch.column(0)):
                for part in found.of(text):
                    counts += np.bincount(part, minlength=buckets)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["bucket", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in rows.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(target: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """floor(UNIT * ln(share in target / share in docs)) of each bucket, with one more count in each bucket of both."""
    more, t_all, s_all = len(docs), float(target.sum()), float(docs.sum())
    return np.array(
        [math.floor(UNIT * math.log((t + 1.0) * (s_all + more) / ((s + 1.0) * (t_all + more)))) for t, s in zip(target.tolist(), docs.tolist(), strict=True)],
        np.int64,
    )


def noise(text: str) -> int:
    """Gumbel noise, in UNITs, from the first 32 bits of the text's SHA-256."""
    h = int(hashlib.sha256(text.encode()).hexdigest()[:8], 16)
    return math.floor(-UNIT * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_features, weight, score) of each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        found = Features(len(gain))
        for batch in batches:
            counts, weights, scores = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), strict=True):
                n = total = 0
                for part in found.of(text):
                    n += len(part)
                    total += int(gain[part].sum())
                weight = total // n if n else 0
                counts.append(n)
                weights.append(weight)
                scores.append(weight + noise(f"{seed}:{'null' if key is None else key}"))
            arrays = [batch.column(0), *(pa.array(x, pa.int64()) for x in (counts, weights, scores))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n_features", "weight", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {id_type(rows, 'id')}, n_features long, weight long, score long")


def _key(score: Column, key: Column) -> Column:
    """What rows are drawn by, as a struct that sorts upwards: high scores first, then small ids, null ids last."""
    return F.struct((-score).alias("a"), key.isNull().alias("b"), key.alias("c"))


def kth(rows: DataFrame, k: int, seed: int = 0) -> tuple[int, object] | None:
    """(score, id) of the k-th of rows by _key(), from 1; None if there is no such row.

    rows (id, score) are read twice a round and must read the same each time, as a written table does. Each round keeps one of PIVOTS + 1 intervals, so some
    log(n) / log(PIVOTS) rounds are expected; up to PIVOTS keys and 2 * PIVOTS + 1 counts come to the driver in each.
    """
    kind = id_type(rows, "id")
    lit = lambda p: _key(F.lit(p[0]).cast("long"), F.lit(p[1]).cast(kind))
    rows = rows.withColumn("key", _key(F.col("score"), F.col("id")))
    low = high = None
    for turn in range(1000):
        active = rows
        if low:
            active = active.where((F.col("score") <= low[0]) & (F.col("key") > lit(low)))
        if high:
            active = active.where((F.col("score") >= high[0]) & (F.col("key") < lit(high)))
        drawn = active.orderBy(F.xxhash64("score", "id", F.lit(f"{seed} {turn}"))).limit(PIVOTS).select("score", "id").collect()
        pivots = sorted({(r.score, r.id) for r in drawn}, key=lambda p: (-p[0], p[1] is None, p[1] or 0))
        if not pivots:
            return None
        # 2 i: between pivot i - 1 and pivot i; 2 i + 1: pivot i
        place = F.lit(0)
        for p in pivots:
            place = place + (F.col("key") >= lit(p)).cast("int") + (F.col("key") > lit(p)).cast("int")
        counts = dict(tuple(r) for r in active.groupBy(place.alias("place")).count().collect())
        for at in range(2 * len(pivots) + 1):
            n = counts.get(at, 0)
            if k <= n:
                break
            k -= n
        else:
            return None
        if at % 2:
            return pivots[at // 2]
        low, high = pivots[at // 2 - 1] if at else low, pivots[at // 2] if at // 2 < len(pivots) else high
    raise RuntimeError("rows change from read to read")


def ranked(rows: DataFrame) -> DataFrame:
    """rows with `rank`, from 1 by _key(). Sorted in range partitions and numbered by what comes before each; rows alike in all are told apart by a number,
    so that many of them spread over partitions."""
    parts = rows.withColumn("own", F.monotonically_increasing_id()).repartitionByRange(-F.col("score"), F.col("id").isNull(), F.col("id"), F.col("own"))
    parts = parts.sortWithinPartitions(-F.col("score"), F.col("id").isNull(), F.col("id"), F.col("own")).drop("own")
    low = F.lit((1 << 33) - 1)
    parts = written(parts.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(low).alias("at")), "ranked")
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    # a row for each partition
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return parts.join(F.broadcast(before), "part").withColumn("rank", F.col("before") + F.col("at") + 1).drop("part", "at", "before")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 25,
    least_words: int = 20,
    seed: int = 7,
    buckets: int = BUCKETS,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
) -> DataFrame:
    """(id, n_features, weight, score, rank): one row for each row of docs; rank is 1, 2, 3, .. in the order drawn, null for what is not drawn.

    Of the rows with at least `least_words` words, `percent` in a hundred (rounded down) with the highest scores are drawn, ties to smaller ids, null ids
    last. Null and empty texts have no features and a weight of 0. Rows that repeat are scored and drawn each; where only some of several rows of one id and
    score can be drawn, any of them are, with their own weights in an order that is not fixed. A null id's noise is that of "null". Without rows
    nothing is drawn; without target texts all gains compare with even shares. Other columns are not looked at.
    """
    gain = gains(bucket_counts(target, target_text_col, buckets), bucket_counts(docs, text_col, buckets))
    rows = written(scored(docs, gain, seed, id_col, text_col), "scored")
    enough = F.col("n_features") >= 2 * least_words - 1
    able = rows.where(enough)
    k = able.count() * percent // 100
    last = kth(able.select("id", "score"), k) if k else None
    if last is None:
        return rows.select(F.col("id").alias(id_col), "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    drawn = enough & (_key(F.col("score"), F.col("id")) <= _key(F.lit(last[0]).cast("long"), F.lit(last[1]).cast(id_type(rows, "id"))))
    winners = ranked(rows.where(drawn)).withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    losers = rows.where(~drawn).withColumn("rank", F.lit(None).cast("long"))
    return winners.unionByName(losers).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
