"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, or one of our own where none is set and there is one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder or tempfile.mkdtemp(prefix="spark-shared-")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Files that go to Python at a time.
FILES_AT_ONCE = 256


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of FILES_AT_ONCE where the session leaves Spark's own, larger number: files can be large, and a batch of 10,000 is held several times over."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(FILES_AT_ONCE))


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: a lost executor costs nothing that came before."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
