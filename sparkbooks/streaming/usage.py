"""Usage and progress as streams over files that are appended to."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType


def usage_stream(audit: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Calls, successes and seconds of each provider and task in windows of event time; rows later than `late` behind are left out."""
    per = audit.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "provider", "task")
    counted = per.agg(F.count("*").alias("calls"), F.sum(F.col("success").cast("long")).alias("successes"), F.round(F.sum("latency_ms"), 2).alias("latency_ms"))
    return counted.select(F.col("w.start").alias("start"), "provider", "task", "calls", "successes", "latency_ms")


def override_stream(lines: DataFrame, overrides: DataFrame) -> DataFrame:
    """Lines as they come, with the speakers of an override table as it is at the start of each batch."""
    o = overrides.select("line_id", F.col("character").alias("__by"))
    return lines.join(o, "line_id", "left").withColumn("character", F.coalesce("__by", "character")).drop("__by")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last in order."""
    value = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*value), F.struct(*order)).alias("l")).select(*keys, "l.*").select(*rows.columns)


class Latest(StatefulProcessor):
    """Holds the last row of a key, and gives it whenever it changes. After `ttl` milliseconds without a change a key is forgotten; without ttl it stays."""

    def __init__(self, keys: list[str], value: StructType, order: list[str], ttl: int | None):
        self.keys, self.value, self.order, self.ttl = keys, value, order, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", self.value, self.ttl) if self.ttl else handle.getValueState("last", self.value)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timers) -> Iterator[Row]:  # noqa: N802
        place = [self.value.names.index(c) for c in self.order]
        rank = lambda v: [(v[i] is not None, v[i]) for i in place]
        best = max((tuple(r[c] for c in self.value.names) for r in rows), key=rank)
        if not self.last.exists() or rank(best) > rank(self.last.get()):
            self.last.update(best)
            yield Row(**dict(zip([*self.keys, *self.value.names], [*key, *best], strict=True)))

    def close(self) -> None:
        pass


def latest_stream(stream: DataFrame, keys: list[str], order: list[str], ttl: int | None = None) -> DataFrame:
    """A stream of the last rows by key: a row for each key that changes in a batch. The state is one row a key, held by Spark's state store. Rows of equal
    order change nothing once one is there; null orders come first."""
    value = StructType([f for f in stream.schema if f.name not in keys])
    whole = StructType([stream.schema[k] for k in keys] + list(value))
    time = "ProcessingTime" if ttl else "None"
    return stream.groupBy(*keys).transformWithState(Latest(keys, value, order, ttl), whole, "Update", time)


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that begin within have the state store that keeps values by key on disk; the session's own setting is put back."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def run_latest(stream: DataFrame, path: str, keys: list[str], order: list[str], ttl: int | None = None) -> DataFrame:
    """Runs latest_stream() over what is there now and gives the last row of each key so far. Run again with the same path, it goes on from its checkpoint."""
    spark = stream.sparkSession
    with state_store(spark):
        out = latest_stream(stream, keys, order, ttl)
        spark.createDataFrame([], out.schema).write.mode("ignore").parquet(f"{path}/rows/batch=0")

        def append(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

        query = out.writeStream.outputMode("update").foreachBatch(append).trigger(availableNow=True).option("checkpointLocation", f"{path}/state").start()
    query.awaitTermination()
    return latest(spark.read.schema(out.schema).parquet(f"{path}/rows"), keys, order).select(*stream.columns)


def run_closed(stream: DataFrame, path: str) -> tuple[DataFrame, int]:
    """Runs an aggregated stream in append mode over what is there now: the windows that the watermark has closed so far, each once and for good, and how many rows
    came too late for theirs in this run. Run again with the same path, it goes on from its checkpoint."""
    query = stream.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{path}/state").format("parquet").start(f"{path}/rows")
    query.awaitTermination()
    late = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows"), late


def run_to_end(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now, writing Parquet files under the folder, and gives what it wrote."""
    path = f"{folder}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}/state").format("parquet").start(f"{path}/rows")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def replay(spark: SparkSession, folder: str, schema, **options: str) -> DataFrame:
    """A stream of the Parquet files in a folder."""
    return spark.readStream.schema(schema).options(**options).parquet(folder)


def run_updates(stream: DataFrame, folder: str, keys: list[str], order: str) -> DataFrame:
    """Runs an aggregated stream in update mode over what is there now; of the updates of a key the last one, with the largest count, stays."""
    path = f"{folder}-updates-{uuid.uuid4().hex}"

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    query = stream.writeStream.outputMode("update").foreachBatch(append).trigger(availableNow=True).option("checkpointLocation", f"{path}/state").start()
    query.awaitTermination()
    rows = stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
    value = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*value), order).alias("l")).select(*keys, "l.*")
