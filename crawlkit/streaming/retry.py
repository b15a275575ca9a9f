"""The retry loop: failed jobs come back when their wait is over, or are dead.

Every step is a set operation on the micro-batch. Attempts are numbered by rank within the
batch, on top of a key table with the attempts each job has used; waits go into a calendar
and come out by folder. No job has a state object or a timer of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from crawlkit.functions.retry import POLICIES
from crawlkit.functions.times import millis
from crawlkit.sources import keyed
from crawlkit.sources.files import remove
from crawlkit.streaming.calendar import Calendar, fields
from crawlkit.streaming.run import run_id

USED = "used BIGINT"


def retry_stream(
    failures: DataFrame, path: str, checkpoint: str, policy: str = "fetch", delay_ms: int = 0
) -> StreamingQuery:
    """Retries and deaths of failed jobs (``job_id, ts, seq, error``), under ``<path>/out``.

    A row with verdict ``retry`` appears once event time, less ``delay_ms``, passes its
    ``at_ms``; the failure that uses up the last attempt of ``policy`` (``ingest`` or
    ``fetch``) appears at once as ``dead``. A job dies once: what comes after is ignored.
    Failures of a job in one micro-batch count in order of time and ``seq``, those of a later
    micro-batch after them. ``read_retries`` reads the rows.

    A batch ranks at most as many failures of a job as it may have attempts (the rank limit
    also works before the shuffle), so no job is hot.
    """
    cap, wait = POLICIES[policy]

    def route(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = run_id(spark, checkpoint)
        calendar = Calendar(spark, f"{path}/calendar", run)
        keyed.compact(spark, f"{path}/attempts", USED, run, batch_id)

        failed = batch.where("job_id is not null").select("job_id", "seq", "error", millis(F.col("ts")).alias("ms"))
        order = Window.partitionBy("job_id").orderBy("ms", "seq")
        ranked = failed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap)
        home = f"{path}/arrived/batch={batch_id}"
        keyed.keyed(ranked, F.col("job_id")).write.mode("overwrite").parquet(home)
        rows = spark.read.parquet(home)
        latest = batch.agg(F.max(millis(F.col("ts")))).first()[0]
        since, now = calendar.clock(batch_id, None if latest is None else latest - delay_ms)

        used = keyed.lookup(rows, f"{path}/attempts", USED, run, batch_id)
        counted = rows.join(used, "h", "left").withColumn(
            "attempt", F.coalesce("used", F.lit(0)).cast("bigint") + F.col("rank")
        )
        counted = counted.where(F.col("attempt") <= cap)
        judged = counted.select(
            "job_id",
            "attempt",
            "error",
            F.when(F.col("attempt") == cap, F.col("ms"))
            .otherwise(F.col("ms") + wait(F.col("error"), F.col("attempt")))
            .alias("at_ms"),
            F.when(F.col("attempt") == cap, "dead").otherwise("retry").alias("verdict"),
        )
        waits = (F.col("verdict") == "retry") & (F.col("at_ms") > now)
        schema = f"{fields(judged)}, due_ms BIGINT"
        calendar.hold(judged.where(waits).withColumn("due_ms", F.col("at_ms")), batch_id)
        released = calendar.due(schema, batch_id, since, now).drop("due_ms")
        judged.where(~waits).unionByName(released).write.mode("overwrite").parquet(f"{path}/out/run={run}/batch={batch_id}")

        keyed.write(counted.groupBy("h").agg(F.max("attempt").alias("used")), f"{path}/attempts", run, batch_id)
        calendar.tidy(since)
        remove(spark, home)

    return (
        failures.writeStream.foreachBatch(route)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_retries(spark: SparkSession, path: str) -> DataFrame:
    """``job_id, attempt, error, at_ms, verdict`` of everything that came out."""
    return spark.read.parquet(f"{path}/out").drop("run", "batch")
