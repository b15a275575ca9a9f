"""Counters, rates, gauges and reconciliation over crawl logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlkit.functions.times import from_micros, micros
from crawlkit.operators.limits import rate_limit
from crawlkit.operators.spread import first_per_key, running

SUCCESS, FAILED, THROTTLED = "success", "failed", "rate_limited"
# Job states shown by the queue status report.
JOB_STATES = ["waiting", "active", "completed", "failed", "delayed"]


def _is(*status: str) -> Column:
    return F.col("status").isin(*status)


def fetch_counts(log: DataFrame, totals: bool = False) -> DataFrame:
    """Finished fetches by domain and status; ``totals`` adds subtotal rows (NULL keys)."""
    done = log.where(_is(SUCCESS, FAILED))
    grouped = done.rollup("domain", "status") if totals else done.groupBy("domain", "status")
    return grouped.agg(F.count("*").alias("n"))


def throttle_counts(log: DataFrame) -> DataFrame:
    return log.where(_is(THROTTLED)).groupBy("domain").agg(F.count("*").alias("n"))


def success_rate(log: DataFrame) -> DataFrame:
    """100 x success / (success + failed); NULL when nothing finished."""
    return log.agg(
        F.count_if(_is(SUCCESS)).alias("n_success"),
        F.count_if(_is(FAILED)).alias("n_failed"),
    ).withColumn(
        "success_pct", F.lit(100) * F.try_divide("n_success", F.col("n_success") + F.col("n_failed"))
    )


def rolling_success_rate(log: DataFrame, period_us: int = 300_000_000) -> DataFrame:
    """Success share per domain over ``(t - period, t]`` at every fetch time.

    Each fetch counts +1 at its time and -1 one period later, so the trailing window is
    a running sum: two narrow rows per fetch instead of a frame over a hot domain.
    """
    done = log.where(_is(SUCCESS, FAILED)).groupBy("domain", micros(F.col("ts")).alias("us")).agg(
        F.count_if(_is(SUCCESS)).alias("ok"), F.count("*").alias("n")
    )
    entering = done.withColumn("at_fetch", F.lit(1))
    leaving = done.select(
        "domain",
        (F.col("us") + period_us).alias("us"),
        (-F.col("ok")).alias("ok"),
        (-F.col("n")).alias("n"),
        F.lit(0).alias("at_fetch"),
    )
    steps = (
        entering.unionByName(leaving)
        .groupBy("domain", "us")
        .agg(F.sum("ok").alias("ok"), F.sum("n").alias("n"), F.max("at_fetch").alias("at_fetch"))
    )
    return (
        running(steps, ["domain"], [F.col("us")], {"n_success": F.col("ok"), "n_done": F.col("n")})
        .where("at_fetch = 1")
        .select(
            "domain",
            from_micros(F.col("us")).alias("ts"),
            "n_success",
            "n_done",
            (F.lit(100) * F.try_divide("n_success", "n_done")).alias("success_pct"),
        )
    )


def sliding_success_rate(log: DataFrame, period: str = "5 minutes", step: str = "1 minute") -> DataFrame:
    """Success share over all domains in sliding windows, as two hash aggregations.

    Fetches are first reduced to one row per step, so the sliding windows multiply only
    the step rows. ``period`` must be a multiple of ``step``.
    """
    steps = log.where(_is(SUCCESS, FAILED)).groupBy(
        F.window("ts", step)["start"].alias("ts")
    ).agg(F.count_if(_is(SUCCESS)).alias("ok"), F.count("*").alias("n"))
    return (
        steps.groupBy(F.window("ts", period, step).alias("w"))
        .agg(F.sum("ok").alias("n_success"), F.sum("n").alias("n_done"))
        .select(
            F.col("w.start").alias("window_start"),
            "n_success",
            "n_done",
            (F.lit(100) * F.try_divide("n_success", "n_done")).alias("success_pct"),
        )
    )


def throttle_increase(log: DataFrame, period_us: int = 3_600_000_000, at: Column | None = None) -> DataFrame:
    """Throttles per domain in ``(at - period, at]``; ``at`` defaults to the newest record."""
    at = log.agg(F.max("ts").alias("at")).scalar() if at is None else at
    since = at - F.make_dt_interval(secs=F.lit(period_us / 1e6))
    return throttle_counts(log.where((F.col("ts") > since) & (F.col("ts") <= at)))


def top_throttled(log: DataFrame, k: int = 10, period_us: int = 3_600_000_000) -> DataFrame:
    return throttle_increase(log, period_us).orderBy(F.desc("n"), "domain").limit(k)


def log_level_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("level").agg(F.count("*").alias("n"))


def log_fields(records: DataFrame, *keep: str) -> DataFrame:
    """One row per line and top-level field of its ``rest``: ``field, kind, value`` as JSON text."""
    fields = records.sparkSession.tvf.variant_explode(F.col("rest").outer())
    return records.lateralJoin(fields).where("key is not null").select(
        *keep, F.col("key").alias("field"), F.schema_of_variant("value").alias("kind"), F.to_json("value").alias("value")
    )


def log_field_kinds(records: DataFrame) -> DataFrame:
    """Fields beyond the schema with their types and the lines that have them."""
    return log_fields(records).groupBy("field", "kind").agg(F.count("*").alias("n"))


def seen_cardinality(urls: DataFrame) -> DataFrame:
    """Exact number of distinct URLs, and an estimate from a mergeable sketch."""
    return urls.agg(
        F.count_distinct("url").alias("n_seen"),
        F.hll_sketch_estimate(F.hll_sketch_agg("url")).alias("n_estimated"),
    )


def latest_jobs(job_events: DataFrame) -> DataFrame:
    return first_per_key(job_events, ["job_id"], [F.desc("ts"), F.desc("seq")])


def queue_status(jobs: DataFrame) -> DataFrame:
    """Jobs per queue and state, one row per queue, zero where there are none."""
    return (
        jobs.groupBy("queue")
        .pivot("state", JOB_STATES)
        .agg(F.count(F.lit(1)))
        .na.fill(0, JOB_STATES)
    )


def gauge_at(transitions: DataFrame, step_us: int) -> DataFrame:
    """Level of each ``(queue, gauge)`` series, sampled every ``step_us``.

    ``transitions`` holds ``queue, gauge, us, delta``. Transitions are summed into the
    sample that first sees them; samples without one come from the time grid.
    """
    at = (F.ceil(F.col("us") / F.lit(step_us)).cast("bigint") * step_us).alias("us")
    buckets = transitions.groupBy("queue", "gauge", at).agg(F.sum("delta").alias("delta"))
    # Two explodes, so that no row holds the whole grid of a series.
    stretch = F.lit(step_us * 4096).cast("bigint")
    grid = (
        buckets.groupBy("queue", "gauge")
        .agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
        .select("queue", "gauge", "hi", F.explode(F.sequence("lo", "hi", stretch)).alias("lo"))
        .select(
            "queue",
            "gauge",
            F.explode(
                F.sequence(
                    "lo",
                    F.least(F.col("hi"), F.col("lo") + stretch - step_us),
                    F.lit(step_us).cast("bigint"),
                )
            ).alias("us"),
            F.lit(0).cast("bigint").alias("delta"),
        )
    )
    samples = buckets.unionByName(grid).groupBy("queue", "gauge", "us").agg(
        F.sum("delta").alias("delta")
    )
    return running(
        samples, ["queue", "gauge"], [F.col("us")], {"level": F.col("delta")}
    ).select("queue", "gauge", from_micros(F.col("us")).alias("ts"), "level")


def active_workers(log: DataFrame, bucket_us: int) -> DataFrame:
    """Fetches in flight per domain at the end of every time bucket with a change.

    A fetch without a latency has not ended: it counts from its start on.
    """
    start = micros(F.col("ts"))
    end = start + (F.col("latency_ms") * 1000).cast("bigint")
    moves = log.select(
        "domain",
        F.explode(
            F.array(
                F.struct(start.alias("us"), F.lit(1).cast("bigint").alias("delta")),
                F.struct(end.alias("us"), F.lit(-1).cast("bigint").alias("delta")),
            )
        ).alias("m"),
    ).where("m.us is not null")
    bucket = (F.col("m.us") - F.pmod(F.col("m.us"), F.lit(bucket_us))).alias("us")
    buckets = moves.groupBy("domain", bucket).agg(F.sum("m.delta").alias("delta"))
    return running(buckets, ["domain"], [F.col("us")], {"in_flight": F.col("delta")}).select(
        "domain", from_micros(F.col("us")).alias("bucket"), "in_flight"
    )


def latency_summary(calls: DataFrame, latency: str = "latency_ms", shares=(0.5, 0.95, 0.99)) -> DataFrame:
    """Count, rate, maximum and exact percentiles (smallest value covering the share).

    Percentiles are read off the running count over distinct latencies, so no task ever
    holds the whole column. Calls without a latency count in the rate only.
    """
    per_value = calls.where(F.col(latency).isNotNull()).groupBy(F.col(latency).alias("v")).agg(F.count("*").alias("n"))
    cumulative = running(per_value, [], [F.col("v")], {"upto": F.col("n")})
    us = micros(F.col("ts"))
    base = calls.agg(
        F.count(latency).alias("n_calls"),
        F.max(latency).alias("max_ms"),
        F.try_divide(F.count("*"), (F.max(us) - F.min(us)) / F.lit(1e6)).alias("calls_per_sec"),
    )
    n = base.select("n_calls").scalar()
    names = [f"p{round(q * 100)}_ms" for q in shares]
    picks = cumulative.agg(
        F.struct(
            *[
                F.min(F.when(F.col("upto") >= F.ceil(F.lit(q) * n), F.col("v"))).alias(name)
                for q, name in zip(shares, names)
            ]
        ).alias("picks")
    ).scalar()
    return base.withColumn("_picks", picks).select("*", *[f"_picks.{c}" for c in names]).drop("_picks")


def accept_ratio(answered: DataFrame) -> DataFrame:
    return answered.agg(
        F.count("*").alias("n_requests"),
        F.avg((F.col("status") == 202).cast("double")).alias("accept_ratio"),
    )


def domain_share(frontier: DataFrame, window_us: int, points: int = 5) -> DataFrame:
    """Queue share per host, and look-ups spent on hosts already at their limit."""
    per_window = frontier.where("host is not null").groupBy(
        "host", (F.floor(micros(F.col("ts")) / F.lit(window_us))).alias("w")
    ).agg(F.count("*").alias("n"))
    per_host = per_window.groupBy("host").agg(
        F.sum("n").alias("n_urls"),
        F.sum(F.greatest(F.col("n") - points, F.lit(0))).alias("n_wasted"),
    )
    # The total reads the same exchange of (host, window) counts, not the frontier again.
    total = per_window.agg(F.sum("n")).scalar()
    return per_host.withColumn("share", F.try_divide(F.col("n_urls").cast("double"), total))


def failure_windows(calls: DataFrame, window: str = "10 seconds", slow_ms: float = 200, pct: float = 50) -> DataFrame:
    """Error share per window: a call slower than ``slow_ms`` or failed is an error."""
    bad = F.col("status").eqNullSafe(FAILED) | (F.col("latency_ms") > slow_ms)
    return (
        calls.groupBy(F.window("ts", window)["start"].alias("window_start"))
        .agg(F.count("*").alias("n_calls"), F.count_if(bad).alias("n_errors"))
        .withColumn("error_pct", F.lit(100) * F.col("n_errors") / F.col("n_calls"))
        .withColumn("alert", F.col("error_pct") > pct)
    )


def alert_openings(windows: DataFrame, cooldown_ms: int = 10_000) -> DataFrame:
    """Alerts that open: the first bad window, then the first after each cool-down.

    That is a first-hit limiter with one point, applied to the bad windows.
    """
    bad = windows.where("alert").select(
        F.lit("all").alias("series"), "window_start", F.col("window_start").alias("id"), "error_pct"
    )
    out = rate_limit(bad, "series", "window_start", "id", points=1, duration_ms=cooldown_ms)
    return out.select("window_start", "error_pct", F.col("allowed").alias("opens"))


def reconcile(accepted: DataFrame, jobs: DataFrame) -> DataFrame:
    """Both sides of the ledger by job id: accounted, lost, or a job nobody asked for."""
    a = accepted.select(F.col("job_id"), F.lit(True).alias("was_accepted"))
    j = jobs.select("job_id", "state", F.lit(True).alias("has_job"))
    return a.join(j, "job_id", "full_outer").select(
        "job_id",
        "state",
        F.when(F.col("was_accepted").isNull(), "unrequested")
        .when(F.col("has_job").isNull(), "lost")
        .otherwise("accounted")
        .alias("verdict"),
    )


def metric_rows(log: DataFrame, routed: DataFrame, gauges: DataFrame) -> DataFrame:
    """The seven series as ``(ts, metric, labels, value)`` rows.

    Counters are stated as of the newest record of their log; gauges at each sample.
    ``routed`` needs ``ts, route``; ``gauges`` is the result of ``gauge_at``.
    """
    no_labels = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    newest = F.max("ts").alias("ts")

    def series(df, metric, labels, value):
        return df.select(
            F.col("ts"),
            F.lit(metric).alias("metric"),
            labels.alias("labels"),
            value.cast("double").alias("value"),
        )

    ingest = routed.agg(
        newest,
        F.count_if(F.col("route") == "fetch").alias("fetch"),
        F.count_if(F.col("route") == "reject").alias("reject"),
    )
    fetches = log.where(_is(SUCCESS, FAILED)).groupBy("domain", "status").agg(
        newest, F.count("*").alias("n")
    )
    throttles = log.where(_is(THROTTLED)).groupBy("domain").agg(newest, F.count("*").alias("n"))
    by_domain = F.create_map(F.lit("domain"), F.col("domain"))
    by_status = F.create_map(
        F.lit("domain"), F.col("domain"), F.lit("status"), F.col("status")
    )
    by_queue = F.create_map(F.lit("queue"), F.col("queue"))
    out = series(ingest, "urls_ingested_total", no_labels, F.col("fetch"))
    for part in (
        series(ingest, "urls_rejected_total", no_labels, F.col("reject")),
        series(gauges.where("gauge = 'waiting'"), "queue_waiting", by_queue, F.col("level")),
        series(gauges.where("gauge = 'active'"), "queue_active", by_queue, F.col("level")),
        series(gauges.where("gauge = 'workers'"), "active_workers", no_labels, F.col("level")),
        series(fetches, "fetches_total", by_status, F.col("n")),
        series(throttles, "rate_limits_total", by_domain, F.col("n")),
    ):
        out = out.unionByName(part)
    return out
