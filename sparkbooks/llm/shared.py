"""What the operators of this subpackage share: the folder that driver and executors both see,
tables written there, and connected components over edge tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes 0x20 and 0x09 to 0x0D; a word is a run of anything else.
SPACE = r"[\x20\x09-\x0D]"
ROWS_AT_ONCE = 1000
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset on one machine, as in tests, a temporary one is made and set; a cluster must name one
    that all its machines see."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of ROWS_AT_ONCE where the session leaves Spark's own, larger number: texts can be long, and a batch is held
    several times over by the JVM and by Python."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_AT_ONCE))


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and lost executors cost nothing."""
    return written_at(df, name)[0]


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As written(), with the table's path."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table that written_at() made and that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def power_of_two(n: float) -> int:
    """The exponent of the smallest power of two that is at least n."""
    return max(0, (max(1, int(n)) - 1).bit_length())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the smallest node that links reach. Nodes without an edge are absent.

    Alternates large-star and small-star rounds (Kiveris et al. 2014) until the edges stay as they are,
    which takes a number of rounds near the logarithm of a component's size; each round is two
    aggregations and two joins over the edges, written to the shared folder in place of the round before. Edges with a null end
    or with equal ends are left out.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    )
    (e, path), seen = written_at(e.distinct(), "edges"), None
    while True:
        # large star: neighbours above a node go to the smallest of its neighbourhood
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        e = (
            e.select(F.col("v").alias("u"), F.col("u").alias("w"))
            .join(least, "u")
            .select(F.col("w").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        # small star: neighbours below a node, and the node, go to the smallest of them
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        e = (
            e.join(least, "u")
            .select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
            .where("u != v")
            .distinct()
        )
        before, (e, path) = path, written_at(e, "edges")
        removed(e.sparkSession, before)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return e.groupBy("u").agg(F.min("v").alias("component")).select(
        F.col("u").alias("node"), "component"
    ).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def id_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def same(a: Column, b: Column) -> Column:
    """Equal, or both null."""
    return a.eqNullSafe(b)


def slices(text: bytes, space: re.Pattern[bytes], most: int) -> Iterator[bytes]:
    """text in parts of about `most` bytes, each cut before a match of space, so that no word is cut."""
    begin = 0
    while len(text) - begin > most:
        found = space.search(text, begin + most)
        if not found:
            break
        yield text[begin : found.start()]
        begin = found.start()
    yield text[begin:] if begin else text


class Remembered(dict):
    """What a worker remembers of keys, in two generations: new keys and keys that are met again are young, and when `most` / 2 are young the others are
    forgotten. So memory is bounded and what is met often stays."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most // 2, {}

    def __missing__(self, key: Any) -> Any:
        self[key] = value = self.old[key]
        return value

    def unknown(self, keys: set) -> list:
        """Those of keys, none of which is young, that are not remembered; the others are young from now on."""
        new = []
        for key in keys:
            value = self.old.get(key)
            if value is None:
                new.append(key)
            else:
                self[key] = value
        return new

    def turn(self) -> None:
        """Forgets the old generation if the young one is full."""
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
