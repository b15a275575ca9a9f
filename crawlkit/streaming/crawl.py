"""Continuous crawl over already fetched pages, and the loop that closes it.

A fetch job is discarded if its URL has no host, waits if its host is over the limit, and is
otherwise stored or failed. Links of stored pages become ingest files; ``crawl_loop`` runs
ingest and crawl in turn until no URL is new and none waits.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from crawlkit import schemas
from crawlkit.functions.html import page_title
from crawlkit.functions.times import millis
from crawlkit.functions.urls import url_hash, url_host
from crawlkit.operators.frontier import fetch_join
from crawlkit.operators.graph import page_links
from crawlkit.operators.limits import DOMAIN_DURATION_MS, DOMAIN_POINTS
from crawlkit.operators.spread import ranked
from crawlkit.session import forget, materialize
from crawlkit.sources import keyed
from crawlkit.sources.files import exists
from crawlkit.sources.store import read_html_store, write_html_store
from crawlkit.streaming.calendar import Calendar
from crawlkit.streaming.ingest import ingest_stream_exact, read_routed
from crawlkit.streaming.run import finish, run_id

#: State of the limiter: when the last booked window of a host starts, and the points it has given.
WINDOW = "start BIGINT, used BIGINT"
JOB = "url STRING, ts TIMESTAMP_NTZ"
HELD = f"{JOB}, host STRING, due_ms BIGINT"
OUTCOME = "url STRING, outcome STRING, title STRING, at_ms BIGINT, batch BIGINT"


def book(jobs: DataFrame, windows: DataFrame, now: int, points: int, duration_ms: int) -> tuple[DataFrame, DataFrame]:
    """Give jobs (``host, h, url, ts``) of one moment their fetch times, and the new windows.

    A host's open window gives the points it has left at once; the others are booked in
    the windows that follow, so no host gets more than ``points`` in any. All of it is
    arithmetic on a job's rank within its host, which no hot host can drag into one task.
    Returns ``jobs`` with ``ready_ms``, and ``h, start, used`` of each host in them.
    """
    order = materialize(ranked(jobs, ["h"], [F.col("ts"), F.col("url")], "rank"), "booked")
    over = F.col("start").isNull() | (F.col("start") + duration_ms <= now)
    hosts = order.groupBy("h").agg(F.count("*").alias("n")).join(windows, "h", "left")
    hosts = hosts.select(
        "h",
        "n",
        F.when(over, F.lit(now)).otherwise(F.col("start")).alias("start"),
        F.when(over, 0).otherwise(F.col("used")).cast("bigint").alias("used"),
    )
    hosts = materialize(hosts, "hosts")

    def window(hits):
        return F.floor((F.col("used") + hits - 1) / points).cast("bigint")

    ready = F.greatest(F.lit(now), F.col("start") + window(F.col("rank")) * duration_ms)
    booked = order.join(hosts.drop("n"), "h").select("url", "ts", "host", ready.cast("bigint").alias("ready_ms"))
    last = window(F.col("n"))
    return booked, hosts.select(
        "h",
        (F.col("start") + last * duration_ms).cast("bigint").alias("start"),
        (F.col("used") + F.col("n") - last * points).cast("bigint").alias("used"),
    )


def crawl_stream(
    frontier: DataFrame,
    pages: DataFrame | str,
    store_path: str,
    ingest_path: str,
    checkpoint: str,
    points: int | None = None,
    duration_ms: int = DOMAIN_DURATION_MS,
    span_ms: int = 0,
) -> StreamingQuery:
    """Judge, fetch and store the jobs of ``frontier`` (``url, ts``), and write their links as ingest files.

    ``pages`` is a table (``url, html``, optionally ``version``) or the path of a page store,
    of which only the folders of a batch's URLs are read. With ``points`` no host gets more
    than that many fetches per ``duration_ms``; jobs over the limit wait in a calendar and
    hold up no other host. The clock is the latest ``now`` (BIGINT milliseconds, an optional
    column whose rows need no URL), else the latest ``ts``. A micro-batch covers the last
    ``span_ms`` before it: jobs are booked from their start on, and those ready by the clock go.

    Every job ends up once in ``<store_path>-outcomes`` as ``stored`` (with the page's title),
    ``failed`` (no page) or ``discarded`` (no valid URL), or still waits. Each
    micro-batch writes folders named by query and number, so a replay replaces them and a
    new checkpoint leaves what is there. A page stored again is newer by its time of writing.
    """

    def crawl(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = run_id(spark, checkpoint)
        here = f"run={run}/batch={batch_id}"
        clocked = batch if "now" in batch.columns else batch.withColumn("now", F.lit(None).cast("bigint"))
        rows = materialize(clocked.select("url", "ts", "now", url_host(F.col("url")).alias("host")), "jobs")
        told, latest = rows.agg(F.max("now"), F.max(millis(F.col("ts")))).first()
        asked = rows.where("url is not null").groupBy("url", "host").agg(F.min("ts").alias("ts"))
        calendar = Calendar(spark, f"{store_path}-waiting", run)
        since, now = calendar.clock(batch_id, latest if told is None else told)
        start = max(now - span_ms, since)

        going = asked.where("host is not null")
        if points is not None:
            windows = f"{store_path}-windows"
            keyed.compact(spark, windows, WINDOW, run, batch_id)
            jobs = materialize(keyed.keyed(going, F.col("host")), "asked")
            known = keyed.lookup(jobs.select("h").distinct(), windows, WINDOW, run, batch_id)
            booked, after = book(jobs, known, start, points, duration_ms)
            keyed.write(after, windows, run, batch_id)
            calendar.hold(booked.where(F.col("ready_ms") > now).withColumnRenamed("ready_ms", "due_ms"), batch_id)
            released = calendar.due(HELD, batch_id, since, now)
            going = booked.where(F.col("ready_ms") <= now).unionByName(released.withColumnRenamed("due_ms", "ready_ms"))
            forget(jobs)
        else:
            going = going.withColumn("ready_ms", F.lit(start))
        going = materialize(going.select("url", "ts", "ready_ms"), "going")

        known_pages = read_html_store(spark, pages, urls=going) if isinstance(pages, str) else pages
        joined = fetch_join(going, known_pages.join(going.select("url"), "url", "left_semi"))
        version = F.lit(time.time_ns() // 1_000_000)
        found = joined.where("status = 'success'").select("url", "html", version.alias("version"))
        write_html_store(found, store_path, batch_id, run=run, replay=True)
        # Titles and links come from what was just stored: pages are fetched once.
        stored = spark.read.schema(schemas.STORED_PAGE).parquet(f"{store_path}/{here}").select("url", "html")
        titled = stored.select("url", page_title(F.col("html")).alias("title"), F.lit("stored").alias("found"))
        judged = going.join(titled, "url", "left").select(
            "url", F.coalesce("found", F.lit("failed")).alias("outcome"), "title", F.col("ready_ms").alias("at_ms")
        )
        bad = asked.where("host is null").select(
            "url", F.lit("discarded").alias("outcome"), F.lit(None).cast("string").alias("title"), F.lit(start).alias("at_ms")
        )
        judged.unionByName(bad).write.mode("overwrite").parquet(f"{store_path}-outcomes/{here}")
        parents = stored.join(going.select("url", "ts"), "url")
        discovered = page_links(parents, only_http=True, keep=("ts",)).select(
            F.concat_ws("#", url_hash(F.col("url")), F.col("pos").cast("string")).alias("id"),
            "ts",
            F.col("resolved").alias("url"),
        )
        discovered.write.mode("overwrite").parquet(f"{ingest_path}/batch={run}-{batch_id}")
        calendar.tidy(since)
        forget(rows)
        forget(going)

    return (
        frontier.writeStream.foreachBatch(crawl)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_outcomes(spark: SparkSession, store_path: str) -> DataFrame:
    """``url, outcome, title, at_ms, batch`` of every job that is done."""
    return spark.read.schema(f"{OUTCOME}, run STRING").parquet(f"{store_path}-outcomes").drop("run")


def read_waiting(spark: SparkSession, store_path: str, checkpoint: str) -> DataFrame:
    """``url, ts, host, due_ms`` of every job that waits for its host."""
    calendar = Calendar(spark, f"{store_path}-waiting", run_id(spark, checkpoint))
    return calendar.waiting(HELD, calendar.latest())


def crawl_loop(
    seeds: DataFrame,
    pages: DataFrame | str,
    home: str,
    points: int = DOMAIN_POINTS,
    duration_ms: int = DOMAIN_DURATION_MS,
    step_ms: int | None = None,
    max_rounds: int | None = None,
) -> DataFrame:
    """Crawl from ``seeds`` (``id, ts, url``) until no URL is new and none waits; the state is under ``home``.

    A round is a tick of the clock and two streaming queries: ingest routes what was
    discovered against all URLs accepted before, and crawl takes the accepted ones and
    those whose wait is over. A tick is ``step_ms`` long (default: a thousand windows). All
    state is in tables and checkpoints, so calling again with the same ``home`` goes on
    where a failed run stopped; seeds are written once. ``max_rounds`` stops early.

    Returns every accepted URL with ``outcome``: ``stored``, ``failed``, ``discarded``, or
    ``throttled`` for those still waiting (after an early stop only), ``title`` and ``at_ms``.
    """
    spark = seeds.sparkSession
    step = 1000 * duration_ms if step_ms is None else step_ms
    paths = {n: f"{home}/{n}" for n in ("ingest", "ticks", "routed", "store", "cp-ingest", "cp-crawl")}
    if not exists(spark, f"{paths['ingest']}/batch=seeds/_SUCCESS"):
        given = seeds.select(F.col("id").cast("string").alias("id"), F.col("ts").cast("timestamp_ntz").alias("ts"), "url")
        given.write.mode("overwrite").parquet(f"{paths['ingest']}/batch=seeds")
    first = spark.read.schema(schemas.INGEST).parquet(f"{paths['ingest']}/batch=seeds").agg(F.max(millis(F.col("ts")))).first()[0] or 0
    done = spark.read.parquet(paths["ticks"]).agg(F.max("now"), F.max("round")).first() if exists(spark, paths["ticks"]) else (None, None)
    now, number = (first + step, 0) if done[0] is None else (done[0] + step, done[1] + 1)
    last = -1 if done[0] is None else None
    started = 0
    while max_rounds is None or started < max_rounds:
        spark.range(1).select(F.lit(now).alias("now")).coalesce(1).write.mode("overwrite").parquet(f"{paths['ticks']}/round={number}")
        ingest = spark.readStream.schema(schemas.INGEST).parquet(paths["ingest"])
        finish(ingest_stream_exact(ingest, paths["routed"], paths["cp-ingest"]))
        accepted = spark.readStream.schema(JOB).parquet(f"{paths['routed']}/accepted")
        ticks = spark.readStream.schema("now BIGINT").parquet(paths["ticks"])
        both = accepted.withColumn("now", F.lit(None).cast("bigint")).unionByName(ticks, allowMissingColumns=True)
        finish(crawl_stream(both, pages, paths["store"], paths["ingest"], paths["cp-crawl"], points, duration_ms, step))
        number, started = number + 1, started + 1
        routed = read_routed(spark, paths["routed"], "accepted")
        newest = routed.agg(F.max("batch_id")).first()[0]
        # After a restart the first round has no earlier one to compare with, and goes on.
        fresh = newest is not None and (last is None or newest > last)
        last = -1 if newest is None else newest
        due = read_waiting(spark, paths["store"], paths["cp-crawl"]).agg(F.min("due_ms")).first()[0]
        if not fresh and due is None:
            break
        now = max(now + step, due or 0)
    waiting = read_waiting(spark, paths["store"], paths["cp-crawl"]).select(
        "url", F.lit("throttled").alias("outcome"), F.lit(None).cast("string").alias("title"), F.col("due_ms").alias("at_ms")
    )
    return read_outcomes(spark, paths["store"]).drop("batch").unionByName(waiting)
