"""Every registered query: an operator applied to the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crawlkit import schemas
from crawlkit.functions import retry, urls
from crawlkit.functions.html import page_title
from crawlkit.functions.times import micros
from crawlkit.operators import bloom, frontier, graph, jobs, limits, scaling_bloom, sketches, telemetry
from crawlkit.plans.views import EPOCH, FETCH_QUEUE, Views
from crawlkit.session import materialize, scratch
from crawlkit.sources import io, store
from crawlkit.streaming import crawl, ingest, metrics, stateful
from crawlkit.streaming import retry as retry_loop
from crawlkit.streaming.run import drain, finish

DAY_MS = 86_400_000
DAY_US = DAY_MS * 1000
HOUR_US = 3_600_000_000

Query = Callable[[Views], DataFrame]


# --- admission, deduplication, routing -------------------------------------------------


def ingest_admit(v):
    return frontier.admit(v.requests()).select("id", "status", "reply")


def url_validity(v):
    links = graph.page_links(v.pages()).select(F.col("href").alias("text"))
    texts = v.pages().select(F.col("url").alias("text"))
    texts = texts.unionByName(links).unionByName(v.accepted().select(F.col("url").alias("text")))
    checked = texts.select("text", urls.valid_url(F.col("text")).alias("valid"))
    return checked.groupBy("text", "valid").agg(F.count("*").alias("n"))


def frontier_route(v):
    """A look-up slower than 200 ms counts as no answer."""
    asked = v.accepted().withColumn("answered", F.col("value") <= 200)
    routed = frontier.route_seen(frontier.seen_result(asked, v.seen(), "answered"))
    return routed.select("id", "url", "seen_result", "route")


def dedup_new_urls(v):
    return frontier.new_urls(v.accepted(), v.seen()).select("id", "url", "ts")


def dedup_rejected(v):
    return frontier.duplicate_urls(v.accepted(), v.seen()).select("id", "url")


def ingest_counters(v):
    return frontier.ingest_counters(frontier_route(v))


def seen_cardinality(v):
    close = F.abs(F.col("n_estimated") - F.col("n_seen")) <= F.col("n_seen") * 0.05
    return telemetry.seen_cardinality(v.accepted()).select("n_seen", close.alias("estimate_close"))


def distinct_urls(v):
    return frontier.distinct_urls(v.queue())


def accept_ratio(v):
    out = telemetry.accept_ratio(frontier.admit(v.requests()))
    return out.withColumn("accept_ratio", F.round("accept_ratio", 9))


def frontier_union(v):
    return v.queue().select("producer", "url", "ts", "id")


def priority_frontier(v):
    return frontier.priority_order(v.accepted(), "value").select("id", "position")


def bloom_false_positive(v):
    measured = bloom.measure(v.accepted(), v.seen())
    rate = F.try_divide("n_false_positive", "n_unseen")
    return measured.select("n_seen", "n_unseen", "n_false_negative", (rate < 0.02).alias("rate_in_bound"))


APPROX_BATCHES, APPROX_CAPACITY, APPROX_RATE = 3, 512, 0.2


def approx_route(v):
    """Requests in three batches against a filter that starts small, and how often it errs.

    A false positive is a URL that no earlier batch fetched and that is rejected all the
    same; the first batch meets an empty filter.
    """
    home = scratch(v.spark, "approx")
    seen = scaling_bloom.ScalingBloom(v.spark, f"{home}/seen", APPROX_CAPACITY, APPROX_RATE)
    for batch in range(APPROX_BATCHES):
        mine = v.requests().where(F.col("id") % APPROX_BATCHES == batch).select("id", "ts", "url")
        scaling_bloom.route_approx(mine, seen, batch, f"{home}/routed")
    routed = scaling_bloom.read_approx(v.spark, home)
    known = routed.where("route = 'fetch'").groupBy("url").agg(F.min("batch").alias("since"), F.count("*").alias("n_fetched"))
    per_url = routed.groupBy("batch", "url").agg(F.count_if(F.col("route") == "fetch").alias("n")).join(known, "url", "left")
    before = F.coalesce(F.col("since") < F.col("batch"), F.lit(False))
    return per_url.groupBy("batch").agg(
        F.count("*").alias("n_urls"),
        F.sum("n").alias("n_fetched"),
        F.count_if((F.col("n") == 0) & ~before).alias("n_false_positive"),
        F.count_if((F.col("n") > 0) & before).alias("n_false_negative"),
    ).withColumn("batch", F.col("batch").cast("bigint"))


# --- limits ----------------------------------------------------------------------------


def rate_limit_first_hit(v):
    requests = v.requests().select("id", "ts", "client")
    return limits.rate_limit(requests, "client", points=5, duration_ms=DAY_MS).drop("ts")


def rate_limit_aligned(v):
    requests = v.requests().select("id", "ts", "client")
    return limits.rate_limit_aligned(requests, "client", points=5, duration_ms=DAY_MS).drop("ts")


def polite_plan(v):
    queue = materialize(v.queue().select("host", "url", "ts", "id"), "queue")
    return limits.polite_plan(queue).select("host", "url", "id", "slot", "ready_ms")


def crawl_delay_violations(v):
    return limits.crawl_delay_gaps(
        v.fetch_log(), "domain", "ts", "event_id", delay_us=600_000_000
    )


def hot_domain_share(v):
    out = telemetry.domain_share(v.queue(), HOUR_US)
    return out.withColumn("share", F.round("share", 9))


def eligible_domains(v):
    """Throttled fetches whose domain has rested for an hour at the end of the log."""
    log = v.fetch_log()
    state = log.where("status <> 'rate_limited'").groupBy("domain").agg(
        F.max(micros(F.col("ts"))).alias("last_us")
    )
    now = log.agg(F.max(micros(F.col("ts"))).alias("now")).scalar()
    waiting = log.where("status = 'rate_limited'").select("event_id", "domain")
    return frontier.eligible_urls(waiting, state, now, HOUR_US)


# --- telemetry -------------------------------------------------------------------------


def fetch_outcome(v):
    return v.fetch_log().select("event_id", "status")


def fetches_by_domain_status(v):
    return telemetry.fetch_counts(v.fetch_log(), totals=True)


def throttles_by_domain(v):
    return telemetry.throttle_counts(v.fetch_log())


def success_rate(v):
    out = telemetry.success_rate(v.fetch_log())
    return out.withColumn("success_pct", F.round("success_pct", 6))


def rolling_success_rate(v):
    """Trailing six hours: the events are sparse."""
    out = telemetry.rolling_success_rate(v.fetch_log(), 6 * HOUR_US)
    return out.withColumn("success_pct", F.round("success_pct", 6))


def sliding_success_rate(v):
    out = telemetry.sliding_success_rate(v.fetch_log(), "6 hours", "1 hour")
    return out.withColumn("success_pct", F.round("success_pct", 6))


def throttle_increase_1h(v):
    return telemetry.throttle_increase(v.fetch_log(), HOUR_US)


def top_throttled_domains(v):
    return telemetry.top_throttled(v.fetch_log(), 10, 24 * HOUR_US)


def latency_summary(v):
    out = telemetry.latency_summary(v.fetch_log())
    return out.withColumn("calls_per_sec", F.round("calls_per_sec", 9))


def sketch_rollup(v):
    """Weeks from daily sketches: how far distinct clients and latency ranks are off."""
    rows = v.requests()
    merged = materialize(sketches.rollup(materialize(sketches.daily(rows, "client", "value"), "daily"), "week"), "rollup")
    exact = rows.groupBy(F.date_trunc("week", "ts").cast("date").alias("period")).agg(
        F.count("*").alias("n_rows"), F.count_distinct("client").alias("exact")
    )
    with_rank = rows.withColumn("period", F.date_trunc("week", "ts").cast("date")).join(merged, "period")
    ranks = with_rank.groupBy("period").agg(
        *[F.avg((F.col("value") <= F.col(f"p{q}")).cast("double")).alias(f"r{q}") for q in (50, 95, 99)]
    )
    joined = merged.join(exact, "period").join(ranks, "period")
    off = F.greatest(*[F.abs(F.col(f"r{q}") - q / 100) for q in (50, 95, 99)])
    return joined.select(
        "period", "n", "exact",
        (F.abs(F.col("n_distinct") - F.col("exact")) * 100 <= F.col("exact") * 3).alias("distinct_within_3_pct"),
        (off <= 0.02 + 1 / F.col("n_rows")).alias("ranks_within_2_pct"),
    )


def approx_top_throttled(v):
    """The ten most throttled clients (and ties), and whether the daily sketches' list has each within its bound."""
    throttled = v.table("events").where("event_type = 'signup'").select("ts", F.col("user_id").alias("client"))
    daily = materialize(sketches.heavy_sketches(throttled, "client"), "heavy")
    listed = sketches.heavy_hitters(daily, sketches.COUNTERS)
    exact = throttled.groupBy("client").agg(F.count("*").alias("exact"))
    top = exact.withColumn("place", F.rank().over(Window.orderBy(F.desc("exact")))).where("place <= 10")
    rows = throttled.count()
    near = F.col("n").between(F.col("exact"), F.col("exact") + F.lit(rows / (0.375 * sketches.COUNTERS)))
    return top.join(listed, F.col("item") == F.col("client"), "left").select(
        "client", F.col("exact").alias("n"), F.coalesce(near, F.lit(False)).alias("found")
    )


def failure_windows(v):
    out = telemetry.failure_windows(v.fetch_log(), "1 hour")
    return out.withColumn("error_pct", F.round("error_pct", 6))


def alert_openings(v):
    """Hourly error shares, with a cool-down of six hours."""
    windows = telemetry.failure_windows(v.fetch_log(), "1 hour")
    return telemetry.alert_openings(windows, 6 * 3_600_000).select("window_start", "opens")


def active_workers(v):
    return telemetry.active_workers(v.fetch_log(), 100_000)


def queue_status(v):
    return telemetry.queue_status(v.jobs())


def latest_job_states(v):
    latest = telemetry.latest_jobs(v.job_events())
    return latest.groupBy("state").agg(F.count("*").alias("n"))


def queue_gauges(v):
    return telemetry.gauge_at(v.transitions(), DAY_US)


def reconcile_loss(v):
    """Accepted requests against the jobs that reached the fetch queue."""
    asked = v.accepted().select(F.col("id").alias("job_id"))
    return telemetry.reconcile(asked, v.jobs().where(F.col("queue") == FETCH_QUEUE))


def log_level_counts(v):
    level = (
        F.when(F.col("status") == "success", "info")
        .when(F.col("status") == "failed", "error")
        .otherwise("warn")
    )
    line = F.to_json(
        F.struct("ts", level.alias("level"), F.col("domain").alias("hostname"), F.col("status").alias("msg"))
    )
    records = io.parse_crawl_log(v.fetch_log().select(line.alias("value")))
    return telemetry.log_level_counts(records)


def log_fields(v):
    """Log files with fields beyond the schema, unfit values and lines cut off, read back."""
    home = scratch(v.spark, "log-fields")
    whole = F.to_json(
        F.struct(
            F.col("ts").cast("string").alias("ts"),
            F.lit("info").alias("level"),
            F.col("event_type").alias("msg"),
            F.when(F.col("event_id") % 30 == 1, "soon").otherwise(F.col("user_id").cast("string")).alias("msBeforeNext"),
            "event_id",
            F.parse_json("props").alias("props"),
        )
    )
    cut = F.concat(F.lit('{"level":"info","event_id":'), F.col("event_id").cast("string"))
    v.table("events").select(F.when(F.col("event_id") % 40 == 0, cut).otherwise(whole)).write.text(f"{home}/lines")
    records = io.read_crawl_log(v.spark, f"{home}/lines")
    number = F.try_variant_get("rest", "$.event_id", "bigint").alias("event_id")
    known = records.select(number, "ts", "level", "msg", "msBeforeNext", "_corrupt_record", "rest")
    broken = known.where("rest is null").drop("rest")
    broken = broken.withColumns({c: F.lit(None).cast("string") for c in ("field", "kind", "value")})
    found = telemetry.log_fields(known.where("rest is not null"), *[c for c in known.columns if c != "rest"])
    return found.unionByName(broken).withColumnsRenamed({"msBeforeNext": "ms_before_next", "_corrupt_record": "broken"})


def log_field_kinds(v):
    """Fields of the event payloads, none of which the schema knows."""
    lines = v.table("events").select(F.col("props").alias("value"))
    return telemetry.log_field_kinds(io.parse_crawl_log(lines))


def metrics_export(v):
    asked = v.accepted().withColumn("answered", F.col("value") <= 200)
    routed = frontier.route_seen(frontier.seen_result(asked, v.seen(), "answered"))
    workers = telemetry.active_workers(v.fetch_log(), HOUR_US).groupBy(
        F.lit("all").alias("queue"), F.lit("workers").alias("gauge"), F.col("bucket").alias("ts")
    ).agg(F.sum("in_flight").alias("level"))
    gauges = telemetry.gauge_at(v.transitions(), DAY_US).unionByName(workers)
    rows = telemetry.metric_rows(v.fetch_log(), routed, gauges)
    return rows.withColumn("labels", F.to_json("labels"))


# --- jobs ------------------------------------------------------------------------------


def retention(v):
    return jobs.retain_latest(v.jobs()).select("job_id", "queue", "state")


def _attempts(v):
    return jobs.attempt_number(v.job_events(), retry.INGEST_ATTEMPTS)


def attempts(v):
    return _attempts(v).select("job_id", "seq", "attempt", "exhausted")


def dead_letters(v):
    return jobs.dead_letters(_attempts(v), retry.INGEST_ATTEMPTS).select("job_id", "seq", "error")


def retry_schedule(v):
    out = jobs.retry_schedule(_attempts(v).where("error is not null"))
    return out.select("job_id", "seq", "attempt", "delay_ms", "total_ms")


def fetch_backoff(v):
    failed = _attempts(v).where("error is not null")
    wait = retry.fetch_backoff_ms(F.col("error"), F.col("attempt"))
    return failed.select("job_id", "seq", "error", "attempt", wait.alias("delay_ms"))


def error_classes(v):
    classed = v.failures().withColumn(
        "e", retry.error_class(F.col("kind"), F.col("http_status"), F.col("detail"))
    )
    return classed.select("event_id", "e.name", "e.message", "e.status_code")


# --- pages, links, graph ---------------------------------------------------------------


def url_host(v):
    return v.pages().select("page_id", urls.url_host(F.col("url")).alias("host"))


def host_forms(v):
    """Hosts written as numbers (whole, hexadecimal, octal, two parts) and with percent escapes."""
    n = F.pmod(F.col("page_id") * F.lit(7_919_000_003), F.lit(2**33))
    plain = urls.url_host(F.col("url"))
    forms = {
        "whole": n.cast("string"),
        "hexadecimal": F.concat(F.lit("0x"), F.hex(n)),
        "octal": F.concat(F.lit("0"), F.conv(n.cast("string"), 10, 8)),
        "two": F.concat(F.lit("10."), F.pmod(n, F.lit(2**25)).cast("string")),
        "escaped": F.concat(F.lit("%"), F.hex(F.ascii(plain).cast("bigint")), F.substr(plain, F.lit(2))),
    }
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("form"), t.alias("text")) for k, t in forms.items()])).alias("f")
    rows = v.pages().select("page_id", each).select("page_id", "f.*")
    written = F.concat(F.lit("HTTP://"), F.col("text"), F.lit(":80/a"))
    return rows.select("page_id", "form", urls.url_host(written).alias("host"), urls.valid_url(written).alias("valid"))


def url_hash(v):
    return v.pages().select("page_id", urls.url_hash(F.col("url")).alias("url_hash"))


def shard_path(v):
    hashed = urls.url_hash(F.col("url"))
    return v.pages().select("page_id", urls.shard_path(hashed).alias("path"))


def canonical_urls(v):
    return urls.canonicalize(v.pages().select("page_id", "url"), "url", "canonical").select(
        "page_id", "canonical"
    )


def rate_keys(v):
    return v.pages().select("page_id", urls.rate_key(urls.url_host(F.col("url"))).alias("key"))


def request_bodies(v):
    """URLs through JSON and form encoding and back."""
    bodies = v.pages().select(
        "page_id",
        urls.request_json(F.col("url")).alias("json"),
        F.concat(F.lit("v=1&url="), F.url_encode("url")).alias("form"),
    )
    decoded = io.parse_bodies(bodies, "json").withColumnRenamed("url", "from_json")
    decoded = io.parse_bodies(decoded, "form", form=True).withColumnRenamed("url", "from_form")
    return decoded.select("page_id", "from_json", "from_form")


def html_store_layout(v):
    pages = v.pages().withColumn("version", F.col("page_id"))
    laid_out = store.store_layout(store.latest_pages(pages))
    return laid_out.select(
        "url_hash", "shard1", "shard2", "path", F.md5("html").alias("html_md5")
    )


def page_titles(v):
    return v.pages().select("page_id", page_title(F.col("html")).alias("title"))


def extract_links(v):
    return graph.page_links(v.pages()).select("url", "pos", "href")


def resolve_links(v):
    return graph.page_links(v.pages()).select("url", "pos", "href", "resolved")


def scheme_filter(v):
    links = graph.page_links(v.pages())
    return links.select("url", "pos", urls.http_only(F.col("resolved")).alias("kept"))


def link_edges(v):
    return v.edges()


def link_stats(v):
    return graph.out_degree(v.edges())


def link_in_degree(v):
    return graph.in_degree(v.edges())


def top_hubs(v):
    return graph.top_hubs(v.edges(), 10)


def crawl_depth(v):
    return graph.crawl_closure(v.graph_seeds(), v.graph_edges())


def crawl_growth(v):
    return graph.closure_growth(crawl_depth(v))


def frontier_fetch(v):
    """Discovered targets against the stored pages; raw links have none."""
    pages = v.pages()
    asked = frontier.distinct_urls(v.edges().select(F.col("dst").alias("url"))).unionByName(
        pages.select("url")
    )
    out = frontier.fetch_join(asked, pages)
    return out.select("url", "status", F.length("html").alias("n_chars"))


def new_links_by_host(v):
    """Flagship: links the crawl has not fetched yet, per host, with the store address
    of the first of them."""
    per_url = v.edges().groupBy(F.col("dst").alias("url")).agg(F.count("*").alias("n"))
    fresh = per_url.join(v.pages().select("url"), "url", "left_anti")
    hosts = fresh.select(
        urls.url_host(F.col("url")).alias("host"), urls.url_hash(F.col("url")).alias("h"), "n"
    )
    return (
        hosts.groupBy("host")
        .agg(F.count("*").alias("n_urls"), F.sum("n").alias("n_links"), F.min("h").alias("first_hash"))
        .withColumn("first_path", urls.shard_path(F.col("first_hash")))
    )


# --- streams, run over what is there -----------------------------------------------------


def ingest_stream_urls(v):
    live = v.streaming("events")
    return drain(ingest.ingest_stream(live.requests()), "ingest").select("url")


def ingest_stream_exact(v):
    live = v.streaming("events").requests().withColumn("id", F.col("id").cast("string"))
    home = scratch(v.spark, "ingest-exact")
    finish(
        ingest.ingest_stream_exact(
            live.select("id", "ts", "url"), f"{home}/out", f"{home}/checkpoint", v.seen()
        )
    )
    routed = [
        ingest.read_routed(v.spark, f"{home}/out", name).select(
            F.col("id").cast("bigint").alias("id"), "url", F.lit(name).alias("route")
        )
        for name in ("accepted", "rejected")
    ]
    return routed[0].unionByName(routed[1])


def metrics_stream(v):
    """Hourly counts. A window comes out once the watermark has passed its end."""
    live = v.streaming("events")
    return drain(metrics.metrics_stream(live.fetch_log(), "1 hour"), "metrics")


def sliding_metrics_stream(v):
    """Counts of the last day at every hour, from hourly panes."""
    live = v.streaming("events")
    return drain(metrics.sliding_metrics_stream(live.fetch_log(), "24 hours", "1 hour"), "sliding-metrics")


def rate_limit_stream(v):
    stateful.use_rocksdb(v.spark)
    live = v.streaming("events").requests()
    out = stateful.rate_limit_stream(live, "client", points=5, duration_ms=DAY_MS)
    return drain(out, "limiter").select(
        "id", F.col("key").alias("client"), "allowed", "ready_ms"
    )


def crawl_stream(v):
    """Every page address as a fetch job; the store afterwards."""
    home = scratch(v.spark, "crawl")
    jobs_ = v.stream("pages").select("url", F.lit(EPOCH).cast("timestamp_ntz").alias("ts"))
    finish(
        crawl.crawl_stream(
            jobs_, v.pages(), f"{home}/store", f"{home}/ingest", f"{home}/checkpoint"
        )
    )
    stored = store.read_html_store(v.spark, f"{home}/store")
    found = v.spark.read.schema(schemas.INGEST).parquet(f"{home}/ingest")
    pages = stored.select("url", F.md5("html").alias("html_md5"), F.lit(1).alias("n"))
    links = found.groupBy("url").agg(F.count("*").cast("int").alias("n"))
    return pages.unionByName(links.withColumn("html_md5", F.lit(None).cast("string")))


def crawl_loop(v):
    """From the seeds until nothing is new: what became of every URL that was accepted."""
    home = scratch(v.spark, "crawl-loop")
    fetched = v.linked_pages().withColumn("version", F.lit(0))
    store.write_html_store(fetched, f"{home}/pages", 0)
    out = crawl.crawl_loop(v.crawl_seeds(), f"{home}/pages", f"{home}/crawl")
    return out.select("url", "outcome", "title")


def rate_limit_delay_stream(v):
    """Hits over the limit are held until their window comes; the rest never comes out."""
    stateful.use_rocksdb(v.spark)
    home = scratch(v.spark, "limiter-delay")
    live = v.streaming("events").requests()
    out = stateful.rate_limit_stream(live, "client", points=5, duration_ms=DAY_MS, emit="delay")
    finish(stateful.hold_until_ready(out, home, f"{home}/checkpoint"))
    return stateful.read_ready(v.spark, home).select("id", F.col("key").alias("client"), "ms", "ready_ms")


def _retry_stream(v, policy):
    home = scratch(v.spark, f"retry-{policy}")
    failures = v.streaming("lineitem").job_events().where("error is not null")
    finish(retry_loop.retry_stream(failures, home, f"{home}/checkpoint", policy))
    return retry_loop.read_retries(v.spark, home)


def retry_stream(v):
    """Failed ingest attempts come back once event time passes their wait; the fifth is dead."""
    return _retry_stream(v, "ingest")


def retry_stream_fetch(v):
    """The same failures as fetches: throttled ones wait a second, others twice as long each time."""
    return _retry_stream(v, "fetch")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in [
        ingest_admit, url_validity, frontier_route, dedup_new_urls, dedup_rejected,
        ingest_counters, seen_cardinality, distinct_urls, accept_ratio, frontier_union,
        priority_frontier, bloom_false_positive, approx_route, sketch_rollup, approx_top_throttled,
        rate_limit_first_hit, rate_limit_aligned, polite_plan, crawl_delay_violations,
        hot_domain_share, eligible_domains,
        fetch_outcome, fetches_by_domain_status, throttles_by_domain, success_rate,
        rolling_success_rate, sliding_success_rate, throttle_increase_1h,
        top_throttled_domains, latency_summary, failure_windows, alert_openings,
        active_workers, queue_status, latest_job_states, queue_gauges, reconcile_loss,
        log_level_counts, log_fields, log_field_kinds, metrics_export,
        retention, attempts, dead_letters, retry_schedule, fetch_backoff, error_classes,
        url_host, host_forms, url_hash, shard_path, canonical_urls, rate_keys, request_bodies,
        html_store_layout, page_titles, extract_links, resolve_links, scheme_filter,
        link_edges, link_stats, link_in_degree, top_hubs, crawl_depth, crawl_growth,
        frontier_fetch, new_links_by_host,
        ingest_stream_urls, ingest_stream_exact, crawl_stream, crawl_loop, metrics_stream, sliding_metrics_stream,
        rate_limit_stream, rate_limit_delay_stream, retry_stream, retry_stream_fetch,
    ]
}


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES[name](Views(spark, sf_dir))
