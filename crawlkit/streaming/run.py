"""Running a stream over what is there now."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from crawlkit.session import scratch


def run_id(spark: SparkSession, checkpoint: str) -> str:
    """Id of the query that owns a checkpoint; a new checkpoint is a new query."""
    return spark.read.json(f"{checkpoint}/metadata").first()["id"]


def finish(query: StreamingQuery) -> None:
    """Wait for an ``availableNow`` query; raise what it raised."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def drain(stream: DataFrame, label: str) -> DataFrame:
    """Process everything available, and return the sink as a table.

    The sink and its checkpoint live in the shared scratch folder.
    """
    home = scratch(stream.sparkSession, label)
    finish(
        stream.writeStream.format("parquet")
        .option("path", f"{home}/out")
        .option("checkpointLocation", f"{home}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    return stream.sparkSession.read.parquet(f"{home}/out")
