"""Continuous ingestion: admit, deduplicate, hand over to the fetch queue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from crawlkit import schemas
from crawlkit.functions.times import with_watermark
from crawlkit.operators.frontier import accepted, first_per_key
from crawlkit.session import forget, materialize
from crawlkit.sources import keyed
from crawlkit.streaming.run import run_id


def ingest_stream(requests: DataFrame, within: str | None = None) -> DataFrame:
    """Admitted requests with a URL not seen before, as a stream.

    State holds every URL ever seen. ``within`` (a watermark delay on ``ts``) bounds it;
    a URL that comes back later than that is then admitted again.
    """
    asked = accepted(requests)
    if within is None:
        return asked.dropDuplicates(["url"])
    fresh = with_watermark(asked, within).dropDuplicatesWithinWatermark(["url"])
    return fresh.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def ingest_stream_exact(
    requests: DataFrame, path: str, checkpoint: str, seen: DataFrame | None = None
) -> StreamingQuery:
    """Route each micro-batch against all URLs accepted before it.

    ``requests`` needs ``id, ts, url``. What was accepted is kept in ``<path>/seen`` as a key
    table (``sources.keyed``): a batch reads only the hash prefixes of its own URLs, and no
    URL text. ``seen`` is loaded into it once, before the first batch. Folders are named by
    query and batch, which makes a replay idempotent: batch n sees all URLs but its own and
    later ones of the same query, and replaces what it wrote. A new checkpoint is a new
    query, so it adds to the table that is there. Rows are told apart by a key of their
    own, not by ``id``, so ids may repeat or be NULL.
    """
    index = f"{path}/seen"

    def route(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = run_id(spark, checkpoint)
        if seen is not None:
            keyed.load(keyed.keyed(seen, F.col("url")).select("h").distinct(), index, "given")
        keyed.compact(spark, index, "", run, batch_id)
        asked = accepted(batch).select("id", "ts", "url", F.monotonically_increasing_id().alias("row"))
        candidates = materialize(keyed.keyed(asked, F.col("url")), "candidates")
        firsts = first_per_key(candidates, ["h"], [F.col("ts"), F.col("id"), F.col("row")])
        known = keyed.lookup(candidates, index, "", run, batch_id)
        folder = f"run={run}/batch_id={batch_id}"
        fresh = firsts.join(known, "h", "left_anti").drop("h")
        fresh.write.mode("overwrite").parquet(f"{path}/accepted/{folder}")
        mine = spark.read.schema("url STRING, row BIGINT").parquet(f"{path}/accepted/{folder}")
        keyed.write(keyed.keyed(mine, F.col("url")).select("h"), index, run, batch_id)
        rest = candidates.join(mine.select("row"), "row", "left_anti").drop("h")
        rest.write.mode("overwrite").parquet(f"{path}/rejected/{folder}")
        forget(candidates)

    return (
        requests.writeStream.foreachBatch(route)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_routed(spark, path: str, route: str) -> DataFrame:
    """The ``accepted`` or ``rejected`` table of ``ingest_stream_exact``."""
    return spark.read.schema(f"{schemas.INGEST}, run STRING, batch_id BIGINT").parquet(f"{path}/{route}")
