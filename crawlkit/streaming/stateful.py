"""Keyed state: the limiter.

It needs ``spark.sql.streaming.stateStore.providerClass`` set to the RocksDB provider
(``use_rocksdb``). A key's rows of one micro-batch are sorted in memory; bound the
micro-batch at the source (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from crawlkit.functions.times import millis
from crawlkit.operators.limits import DOMAIN_DURATION_MS, DOMAIN_POINTS
from crawlkit.sources.files import remove
from crawlkit.streaming.calendar import Calendar, fields
from crawlkit.streaming.run import run_id

# The driver starts its own Python worker for stateful processors, and that one does not
# see files added to the session: send the processors themselves, not their names.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _sorted_rows(chunks: Iterator[pd.DataFrame], *columns: str) -> list[tuple]:
    """Rows of a key, ordered by the first columns. Groups are small: plain lists win."""
    rows = [row for chunk in chunks for row in zip(*[chunk[c].tolist() for c in columns])]
    return sorted(rows, key=lambda row: row[:2])


class _Limiter(StatefulProcessor):
    """Window start and points used, per key."""

    def __init__(self, points: int, duration_ms: int, delay: bool, ttl_ms: int | None):
        self.points, self.duration, self.delay, self.ttl_ms = points, duration_ms, delay, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getValueState("window", "start BIGINT, used BIGINT", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        start, used = self.window.get() or (None, 0)
        out = []
        for ms, id in _sorted_rows(rows, "ms", "id"):
            if start is None or ms >= start + self.duration:
                start, used = ms, 0
            elif self.delay and used == self.points:
                start, used = start + self.duration, 0
            passes = used < self.points
            used += passes
            ready = max(ms, start) if passes else start + self.duration
            out.append((key[0], id, ms, passes, ready))
        self.window.update((start, used))
        yield pd.DataFrame(out, columns=["key", "id", "ms", "allowed", "ready_ms"])

    def close(self) -> None:
        pass


def rate_limit_stream(
    df: DataFrame,
    key: str,
    ts: str = "ts",
    id: str = "id",
    points: int = DOMAIN_POINTS,
    duration_ms: int = DOMAIN_DURATION_MS,
    emit: str = "reject",
    ttl_ms: int | None = None,
) -> DataFrame:
    """First-hit fixed windows on a stream, in order of arrival.

    ``reject``: hits over the limit come out with ``allowed`` false, ``ready_ms`` being
    the end of their window. ``delay``: every hit is allowed, but one over the limit gets
    the start of the next window with a free point as ``ready_ms``; keys do not wait for
    one another. Such rows come out at once: ``hold_until_ready`` keeps them back.
    ``ttl_ms`` forgets idle keys after that much processing time.
    """
    hits = df.select(F.col(key).alias("key"), F.col(id).alias("id"), millis(F.col(ts)).alias("ms"))
    out = T.StructType(
        [
            hits.schema["key"],
            hits.schema["id"],
            T.StructField("ms", T.LongType()),
            T.StructField("allowed", T.BooleanType()),
            T.StructField("ready_ms", T.LongType()),
        ]
    )
    return (
        hits.where("key is not null")
        .groupBy("key")
        .transformWithStateInPandas(
            statefulProcessor=_Limiter(points, duration_ms, emit == "delay", ttl_ms),
            outputStructType=out,
            outputMode="Append",
            # Time to live needs a clock; without it no empty micro-batches are run.
            timeMode="None" if ttl_ms is None else "ProcessingTime",
        )
    )


def hold_until_ready(limited: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the rows of ``rate_limit_stream`` under ``<path>/out`` once their ``ready_ms`` has come.

    The clock is the latest ``ms`` seen. Rows ahead of it wait in a calendar, so a key with a
    long queue holds no other one up, and a waiting row costs neither memory nor state.
    ``read_ready`` reads what came out, ``read_held`` what waits.
    """

    def route(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        calendar = Calendar(spark, f"{path}/calendar", run_id(spark, checkpoint))
        home = f"{path}/arrived/batch={batch_id}"
        batch.write.mode("overwrite").parquet(home)
        rows = spark.read.schema(batch.schema).parquet(home)
        since, now = calendar.clock(batch_id, rows.agg(F.max("ms")).first()[0])
        calendar.hold(rows.where(F.col("ready_ms") > now).withColumn("due_ms", F.col("ready_ms")), batch_id)
        released = calendar.due(f"{fields(batch)}, due_ms BIGINT", batch_id, since, now).drop("due_ms")
        ready = rows.where(F.col("ready_ms") <= now).unionByName(released)
        ready.withColumn("released_ms", F.lit(now)).write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")
        calendar.tidy(since)
        remove(spark, home)

    return (
        limited.writeStream.foreachBatch(route)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_ready(spark: SparkSession, path: str) -> DataFrame:
    """What came out, with the clock at that moment as ``released_ms``."""
    return spark.read.parquet(f"{path}/out").drop("batch")


def read_held(spark: SparkSession, path: str, checkpoint: str, schema: str) -> DataFrame:
    """What still waits; ``schema`` is that of the limiter's rows."""
    calendar = Calendar(spark, f"{path}/calendar", run_id(spark, checkpoint))
    return calendar.waiting(f"{schema}, due_ms BIGINT", calendar.latest()).drop("due_ms")
