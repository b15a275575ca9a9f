"""Operators against brute force, hand-written rows and invariants."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from crawlkit import schemas
from crawlkit.operators import bloom, frontier, graph, jobs, limits, spread, telemetry
from crawlkit.sources import io, store

T0 = dt.datetime(2024, 1, 1)
HITS = "k STRING, ts TIMESTAMP_NTZ, id BIGINT"


def at(ms):
    return T0 + dt.timedelta(milliseconds=ms)


def tuples(df):
    return sorted(map(tuple, df.collect()), key=str)


def limiter_by_hand(rows, points, duration):
    """Sequential limiter over (key, ms, id) rows."""
    windows, out = {}, {}
    for key, ms, id in sorted(rows):
        if key not in windows or ms >= windows[key][0] + duration:
            windows[key] = [ms, 0]
        start = windows[key][0]
        windows[key][1] += 1
        hit = windows[key][1]
        out[id] = (hit, hit <= points, None if hit <= points else start + duration - ms)
    return out


@pytest.mark.parametrize(
    "duration, span, n, keys",
    [
        (1000, 5 * 3_600_000, 4000, "aaaaaabcdef"),
        (1000, 60_000, 3000, "a"),
        (3_600_000, 200 * 3_600_000, 2000, "aaaab"),
        (86_400_000, 40 * 86_400_000, 2000, "aaaabcdef"),
    ],
)
def test_first_hit_limiter(spark, duration, span, n, keys):
    rnd = random.Random(n)
    rows = [(rnd.choice(keys), rnd.randrange(span), i) for i in range(n)]
    df = spark.createDataFrame([(k, at(ms), i) for k, ms, i in rows], HITS)
    out = limits.rate_limit(df, "k", points=5, duration_ms=duration)
    got = {r.id: (r.hit, r.allowed, r.ms_before_next) for r in out.collect()}
    assert got == limiter_by_hand(rows, 5, duration)


def test_limiter_literal_case(spark):
    seconds = [3, 5, 9, 12, 13, 14, 22, 23]
    df = spark.createDataFrame([("a", at(s * 1000), s) for s in seconds], HITS)
    out = limits.rate_limit(df, "k", points=2, duration_ms=10_000).orderBy("id").collect()
    assert [r.ms_before_next for r in out] == [None, None, 4000, 1000, None, None, 1000, None]
    aligned = limits.rate_limit_aligned(df, "k", points=2, duration_ms=10_000).orderBy("id")
    assert [r.allowed for r in aligned.collect()] == [True, True, False, True, True, False, True, True]


def test_limiter_passes_rows_without_key(spark):
    df = spark.createDataFrame([(None, at(0), 1)] * 3, HITS)
    assert [r.allowed for r in limits.rate_limit(df, "k", points=1).collect()] == [True] * 3


@pytest.fixture
def many_slices(spark):
    """Keep small range partitions apart, so that one key really spans several slices."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def test_a_hot_key_is_cut_into_slices(spark, many_slices):
    df = spark.range(8000).select(F.lit("hot").alias("k"), "id")
    slices = spread._sliced(df, ["k"], [F.col("id")]).groupBy("_slice").count().collect()
    assert len(slices) == 8 and max(r["count"] for r in slices) < 3000


@pytest.mark.parametrize("spread_of_keys", ["a", "aaaaaaab", "abcdefgh"])
def test_ranked_equals_window(spark, many_slices, spread_of_keys):
    rnd = random.Random(7)
    rows = [(rnd.choice(spread_of_keys), rnd.randrange(20), i) for i in range(900)]
    df = spark.createDataFrame(rows, "k STRING, t INT, id BIGINT").repartition(7)
    w = Window.partitionBy("k").orderBy(F.desc("t"), "id")
    expected = df.withColumn("rank", F.row_number().over(w).cast("bigint"))
    got = spread.ranked(df, ["k"], [F.desc("t"), F.col("id")])
    assert tuples(got) == tuples(expected)


def test_running_sum_and_maximum(spark, many_slices):
    rnd = random.Random(8)
    rows = [(rnd.choice(["a", "a", "a", None]), i, rnd.randrange(-5, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k STRING, t BIGINT, v BIGINT")
    w = Window.partitionBy("k").orderBy("t")
    expected = df.select(
        "*",
        F.sum("v").over(w).alias("s"),
        F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("m"),
    )
    got = spread.running(df, ["k"], [F.col("t")], {"s": F.col("v")}, {"m": F.col("v")})
    assert tuples(got) == tuples(expected)


def test_no_host_exceeds_its_slot(spark):
    rows = [("hot", at(i), i) for i in range(57)] + [("cold", at(99), 99), (None, at(1), 100)]
    plan = limits.polite_plan(spark.createDataFrame(rows, HITS), "k", points=5)
    per_slot = plan.groupBy("k", "slot").count()
    assert plan.count() == 58 and per_slot.agg(F.max("count")).first()[0] == 5
    assert plan.where("k = 'cold'").first().slot == 0


def test_crawl_delay(spark):
    rows = [("a", at(0), 1), ("a", at(900), 2), ("a", at(1900), 3), ("b", at(1000), 4)]
    gaps = limits.crawl_delay_gaps(spark.createDataFrame(rows, HITS), "k")
    assert [(r.id, r.gap_us) for r in gaps.collect()] == [(2, 900_000)]


def test_new_and_duplicate_urls_partition_the_input(spark):
    rows = [(i, at(i % 7), f"http://h/{i % 5}") for i in range(40)]
    candidates = spark.createDataFrame(rows, "id BIGINT, ts TIMESTAMP_NTZ, url STRING")
    seen = spark.createDataFrame([("http://h/3",)], "url STRING")
    fresh = frontier.new_urls(candidates, seen)
    firsts = {}
    for id, ts, url in sorted(rows, key=lambda r: (r[1], r[0])):
        firsts.setdefault(url, id)
    firsts.pop("http://h/3")
    assert sorted(r.id for r in fresh.collect()) == sorted(firsts.values())
    repeats = frontier.duplicate_urls(candidates, seen)
    assert sorted(r.id for r in fresh.select("id").union(repeats.select("id")).collect()) == list(range(40))


def test_canonical_dedup(spark):
    rows = [(1, at(0), "HTTP://H.com:80"), (2, at(1), "http://h.com/"), (3, at(2), "not a url")]
    candidates = spark.createDataFrame(rows, "id BIGINT, ts TIMESTAMP_NTZ, url STRING")
    none = spark.createDataFrame([], "url STRING")
    assert [(r.id, r.url) for r in frontier.new_urls(candidates, none, canonical=True).collect()] == [
        (1, "http://h.com/")
    ]
    assert frontier.new_urls(candidates, none).count() == 3


def test_retention_keeps_newest(spark):
    rows = [
        (i, "q", "completed" if i % 3 else "failed", at(i // 2)) for i in range(90)
    ] + [(100, "q", "waiting", at(0)), (101, "q", None, at(0))]
    df = spark.createDataFrame(rows, "job_id BIGINT, queue STRING, state STRING, ts TIMESTAMP_NTZ")
    kept = {r.job_id for r in jobs.retain_latest(df, completed=7, failed=4).collect()}
    newest = lambda s, n: {r[0] for r in sorted((r for r in rows if r[2] == s), key=lambda r: (r[3], r[0]))[-n:]}
    assert kept == newest("completed", 7) | newest("failed", 4) | {100, 101}


def test_closure_is_closed_and_bounded(spark):
    edges = spark.createDataFrame(
        [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), ("a", "a")], "src STRING, dst STRING"
    )
    seeds = spark.createDataFrame([("a",)], "url STRING")
    depths = graph.crawl_closure(seeds, edges)
    assert tuples(depths.select("url", "depth")) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    again = graph.crawl_closure(depths, edges)
    assert again.count() == 4 and again.agg(F.max("depth")).first()[0] == 0
    assert graph.crawl_closure(seeds, edges, max_depth=1).count() == 2
    growth = graph.closure_growth(depths).orderBy("depth").collect()
    assert [(r.new_urls, r.seen_urls) for r in growth] == [(1, 1), (1, 2), (1, 3), (1, 4)]


def test_bloom_has_no_false_negative_and_a_bounded_rate(spark):
    seen = spark.range(20000).select(F.concat(F.lit("http://h/"), "id").alias("url"))
    probes = spark.range(10000, 50000).select(F.concat(F.lit("http://h/"), "id").alias("url"))
    row = bloom.measure(probes, seen).first()
    assert (row.n_seen, row.n_unseen, row.n_false_negative) == (10000, 30000, 0)
    assert 0 < row.n_false_positive / row.n_unseen < 0.015


def test_store_rewrites_and_reads_by_url(spark, tmp_path):
    schema = "url STRING, html STRING, version BIGINT"
    first = spark.createDataFrame([("http://h/1", "old", 1), ("http://h/2", "two", 1)], schema)
    second = spark.createDataFrame([("http://h/1", "new", 2), ("http://h/1", "newer", 3)], schema)
    path = str(tmp_path / "store")
    store.write_html_store(first, path, batch=0)
    store.write_html_store(second, path, batch=1)
    with pytest.raises(Exception, match="already exists"):
        store.write_html_store(second, path, batch=1)
    store.write_html_store(second, path, batch=1, replay=True)
    assert store.read_html_store(spark, path).count() == 2
    one = store.read_html_store(spark, path, "http://h/1")
    assert [r.html for r in one.collect()] == ["newer"]
    assert "PartitionFilters: [isnotnull(shard1" in one._jdf.queryExecution().executedPlan().toString()
    store.compact_html_store(spark, path, str(tmp_path / "compact"))
    assert store.read_html_store(spark, str(tmp_path / "compact")).count() == 2


def test_store_breaks_ties_and_thins_out_old_versions(spark, tmp_path):
    rows = [("http://h/hot", f"old {i}", i % 50) for i in range(500)]
    rows += [("http://h/hot", "new a", 99), ("http://h/hot", "new b", 99), ("http://h/hot", "new b", 99)]
    rows += [(f"http://h/{i}", f"page {i}", None if i == 7 else 1) for i in range(60)] + [("http://h/empty", None, 1)]
    pages = spark.createDataFrame(rows, "url STRING, html STRING, version INT").repartition(5)
    for digits in (None, 1, 2, 3):
        path = f"{tmp_path}/store{digits}"
        store.write_html_store(pages, path, batch=0, digits=digits)
        files = spark.read.schema(schemas.STORED_PAGE).parquet(path)
        assert files.count() == 62 == files.select("url").distinct().count()
        hot = files.where("url = 'http://h/hot'").first()
        assert (hot.version, hot.html in ("new a", "new b")) == (99, True)
        assert store.read_html_store(spark, path).where("url <> 'http://h/7'").count() == 61
    store.write_html_store(pages.limit(0), f"{tmp_path}/none", batch=0)
    assert [store._digits(n << 30) for n in (0, 1, 4, 5, 64, 65, 1 << 17)] == [1, 1, 1, 2, 2, 3, 4]


def test_store_shuffles_bodies_once(spark, tmp_path):
    spark.range(1000).selectExpr("'http://h/' || id AS url", "repeat('x', 99) AS html", "id AS version").write.parquet(f"{tmp_path}/p")
    laid_out = store.store_layout(spark.read.parquet(f"{tmp_path}/p")).withColumn("mark", F.xxhash64("html"))
    best = F.max(F.struct("version", "mark")).alias("best")
    laid_out.groupBy("url_hash").agg(best, F.count("*").alias("n")).where("n > 1").write.parquet(f"{tmp_path}/w")
    dealt = store._dealt(laid_out, spark.read.parquet(f"{tmp_path}/w"), 2)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("BroadcastHashJoin") == 1
    assert plan.count("Sort [") == 1, plan


@pytest.mark.parametrize("whole", [0, 64 << 20])
def test_closure_by_key_tables(spark, monkeypatch, whole):
    monkeypatch.setattr(graph, "WHOLE", whole)
    hub = [("hub", f"u{i}") for i in range(300)]
    chain = [(f"u{i}", f"u{i + 1}") for i in range(300, 306)] + [("u299", "u300"), ("u306", "hub"), ("u1", "u1"), (None, "x")]
    edges = spark.createDataFrame(hub + chain + chain, "src STRING, dst STRING")
    seeds = spark.createDataFrame([("hub",), ("hub",), (None,)], "url STRING")
    depths = {r.url: r.depth for r in graph.crawl_closure(seeds, edges).collect()}
    assert depths == {"hub": 0} | {f"u{i}": 1 for i in range(300)} | {f"u{i}": i - 298 for i in range(300, 307)}
    long = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(19)] + [("n9", "n2")], "src STRING, dst STRING")
    start = spark.createDataFrame([("n0",)], "url STRING")
    assert {r.url: r.depth for r in graph.crawl_closure(start, long).collect()} == {f"n{i}": i for i in range(20)}
    assert graph.crawl_closure(start, long, max_depth=0).count() == 1
    assert graph.crawl_closure(seeds, edges.limit(0)).collect()[0].asDict() == {"url": "hub", "depth": 0}
    assert graph.crawl_closure(seeds.limit(0), edges).isEmpty()


def test_requests_bodies_seeds_and_logs(spark, tmp_path):
    lines = ['{"request_id":1,"ts":"2024-01-01T00:00:00","url":"http://h/"}', '{"request_id":2}']
    (tmp_path / "requests.json").write_text("\n".join(lines))
    requests = io.read_requests(spark, str(tmp_path / "requests.json"))
    assert [r.id for r in frontier.new_urls(requests.where("url is not null"), requests.select("url").limit(0)).collect()] == [1]
    admitted = {r.request_id: r.status for r in frontier.admit(requests).collect()}
    assert admitted == {1: 202, 2: 400}
    blank = spark.createDataFrame([(1, " "), (2, ""), (3, None)], "id INT, url STRING")
    assert {r.id: r.status for r in frontier.admit(blank).collect()} == {1: 202, 2: 400, 3: 400}
    bodies = spark.createDataFrame([("a=1&url=http%3A%2F%2Fh%2F%3Fx",), ("b=2",)], "body STRING")
    assert [r.url for r in io.parse_bodies(bodies, form=True).collect()] == ["http://h/?x", None]
    (tmp_path / "seeds.txt").write_text("http://h/1\n\n http://h/2 \n")
    seeds = io.seed_frontier(io.read_seeds(spark, str(tmp_path / "seeds.txt")), F.lit(T0))
    io.append_ingest(seeds, str(tmp_path / "ingest"))
    io.append_ingest(seeds, str(tmp_path / "ingest"))
    assert spark.read.parquet(str(tmp_path / "ingest")).count() == 4
    (tmp_path / "log.json").write_text('{"level":"info","msg":"ok"}\n{broken\n{"level":"warn"}\n')
    log = io.read_crawl_log(spark, str(tmp_path / "log.json"))
    assert tuples(telemetry.log_level_counts(log)) == [("info", 1), ("warn", 1), (None, 1)] or {
        r.level: r.n for r in telemetry.log_level_counts(log).collect()
    } == {"info": 1, "warn": 1, None: 1}


def test_log_lines_keep_what_the_schema_does_not_know(spark, tmp_path):
    lines = [
        '{"ts":"2024-01-01T00:00:00.5Z","level":"info","msBeforeNext":"7","shard":{"a":[1,2]},"rate":0.5}',
        '{"level":5,"msBeforeNext":"soon","count":null,"ts":1700000000,"none":null}',
        '{"msg":"plain"}',
        "{broken",
        '{"a":1,"a":2}',
        "[1]",
        "null",
        "  ",
    ]
    (tmp_path / "log.json").write_text("\n".join(lines))
    log = io.read_crawl_log(spark, str(tmp_path / "log.json")).withColumn("rest", F.to_json("rest"))
    rows = {r._corrupt_record or r.level or r.msg: r for r in log.collect()}
    assert set(rows) == {"info", "5", "plain", "{broken", '{"a":1,"a":2}', "[1]", "null"}
    assert rows["info"].ts == T0.replace(2024, 1, 1, 0, 0, 0, 500_000)
    assert rows["info"].msBeforeNext == 7
    assert rows["info"].rest == '{"rate":0.5,"shard":{"a":[1,2]}}'
    assert (rows["5"].msBeforeNext, rows["5"].ts) == (None, None)
    assert rows["5"].rest == '{"msBeforeNext":"soon","none":null,"ts":1700000000}'
    assert rows["plain"].rest == "{}"
    assert rows["{broken"].rest is None and rows["{broken"].level is None
    kinds = telemetry.log_field_kinds(io.read_crawl_log(spark, str(tmp_path / "log.json")))
    assert {(r.field, r.kind, r.n) for r in kinds.collect()} == {
        ("rate", "DECIMAL(1,1)", 1), ("shard", "OBJECT<a: ARRAY<BIGINT>>", 1),
        ("msBeforeNext", "STRING", 1), ("none", "VOID", 1), ("ts", "BIGINT", 1),
    }
    nothing = io.parse_crawl_log(spark.createDataFrame([(None,)], "value STRING"))
    assert nothing.first()._corrupt_record is None and telemetry.log_field_kinds(nothing).isEmpty()


def test_metrics_are_appended_by_name(spark, tmp_path):
    schema = "ts TIMESTAMP_NTZ, metric STRING, labels MAP<STRING,STRING>, value DOUBLE"
    rows = spark.createDataFrame([(T0, "m1", {"domain": "d"}, 1.0), (T0, "m2", {}, 2.0)], schema)
    for _ in range(2):
        io.write_metrics(rows, str(tmp_path / "metrics"))
    assert spark.read.parquet(str(tmp_path / "metrics")).where("metric = 'm1'").count() == 2


def test_empty_log_has_no_success_rate(spark):
    log = spark.createDataFrame([], "domain STRING, status STRING")
    assert telemetry.success_rate(log).first().success_pct is None


def test_throttled_attempts_are_not_failures(spark):
    df = spark.createDataFrame(
        [(0, "limit"), (3, "boom"), (3, None)], "remaining_points INT, error STRING"
    )
    assert [r.status for r in frontier.classify_outcome(df).collect()] == [
        "rate_limited", "failed", "success"
    ]


def test_attempt_caps_and_dead_letters(spark):
    rows = [("j", at(i), i, "e") for i in range(6)] + [("k", at(0), 0, "e")]
    events = spark.createDataFrame(rows, "job_id STRING, ts TIMESTAMP_NTZ, seq INT, error STRING")
    numbered = jobs.attempt_number(events, 5)
    assert sorted((r.attempt, r.exhausted) for r in numbered.where("job_id = 'j'").collect()) == [
        (n, n >= 5) for n in range(1, 7)
    ]
    assert [(r.job_id, r.seq) for r in jobs.dead_letters(numbered, 5).collect()] == [("j", 4)]
    waits = jobs.retry_schedule(numbered).where("job_id = 'j'").orderBy("attempt").collect()
    assert [(r.delay_ms, r.total_ms) for r in waits] == [
        (2000, 2000), (4000, 6000), (8000, 14000), (16000, 30000)
    ]


def test_lost_jobs_are_found(spark):
    asked = spark.createDataFrame([(1,), (2,)], "job_id INT")
    have = spark.createDataFrame([(2, "completed"), (3, "failed")], "job_id INT, state STRING")
    verdicts = {r.job_id: r.verdict for r in telemetry.reconcile(asked, have).collect()}
    assert verdicts == {1: "lost", 2: "accounted", 3: "unrequested"}


def test_null_answers_states_and_latencies(spark):
    asked = spark.createDataFrame([(1, T0, "http://h/1", None)], "id INT, ts TIMESTAMP_NTZ, url STRING, answered BOOLEAN")
    seen = spark.createDataFrame([], "url STRING")
    routed = frontier.route_seen(frontier.seen_result(asked, seen, "answered"))
    assert [(r.seen_result, r.route) for r in routed.collect()] == [(-1, "retry")]
    jobs = spark.createDataFrame([(1, None)], "job_id INT, state STRING")
    ledger = telemetry.reconcile(spark.createDataFrame([(1,), (2,)], "job_id INT"), jobs)
    assert sorted((r.job_id, r.verdict) for r in ledger.collect()) == [(1, "accounted"), (2, "lost")]
    log = spark.createDataFrame(
        [(T0, "d", None), (T0, "d", 1500.0)], "ts TIMESTAMP_NTZ, domain STRING, latency_ms DOUBLE"
    )
    assert [r.in_flight for r in telemetry.active_workers(log, 1_000_000).orderBy("bucket").collect()] == [2, 1]
    calls = spark.createDataFrame([(T0, None)] * 100 + [(T0, float(i)) for i in range(1, 101)], "ts TIMESTAMP_NTZ, latency_ms DOUBLE")
    row = telemetry.latency_summary(calls).first()
    assert (row.n_calls, row.p50_ms, row.p95_ms, row.p99_ms) == (100, 50.0, 95.0, 99.0)


def test_limiter_keys_of_64_bits(spark):
    big = 1 << 62
    hits = [(big + k, T0 + dt.timedelta(seconds=k), 10 * k) for k in range(3)]
    df = spark.createDataFrame(hits, "key LONG, ts TIMESTAMP_NTZ, id INT")
    assert all(r.allowed for r in limits.rate_limit(df, "key", points=1, duration_ms=60_000).collect())


def test_seeds_have_ids(spark):
    seeds = io.seed_frontier(spark.createDataFrame([("http://h/1",), ("http://h/2",)], "url STRING"), F.lit(T0))
    assert seeds.columns == ["id", "ts", "url"] and seeds.where("id is not null").select("id").distinct().count() == 2


def test_scaling_bloom_opens_layers_and_forgets_nothing(spark, tmp_path):
    from crawlkit.operators import scaling_bloom

    seen = scaling_bloom.ScalingBloom(spark, f"{tmp_path}/seen", capacity=50, fpr=0.05)
    for batch in range(3):
        urls = [(f"{batch}-{i}", f"http://h/{i}") for i in range(batch * 60, batch * 60 + 100)]
        rows = spark.createDataFrame(urls * 2 + [("none", None)], "id STRING, url STRING").withColumn("ts", F.lit(0))
        for _ in range(2):  # every batch is replayed
            scaling_bloom.route_approx(rows, seen, batch, f"{tmp_path}/routed")
    routed = scaling_bloom.read_approx(spark, f"{tmp_path}").collect()
    assert len(routed) == 600
    fetched = [r.url for r in routed if r.route == "fetch"]
    assert len(fetched) == len(set(fetched)) and len(set(fetched)) >= 0.9 * 220
    filled = seen.filled(3)
    assert all(n <= 50 << layer for layer, n in filled.items()) and len(filled) > 1 and sum(filled.values()) == len(fetched)
    before = {layer: sorted(map(tuple, seen.words(layer, 3).collect())) for layer in filled}
    seen.compact(3, most=0)
    assert {layer: sorted(map(tuple, seen.words(layer, 3).collect())) for layer in filled} == before
    probes = spark.createDataFrame([(u,) for u in fetched], "url STRING")
    assert seen.maybe_seen(probes, 3).count() == len(fetched)


def test_daily_sketches_answer_for_months(spark):
    from crawlkit.operators import sketches

    days = spark.range(60).select(F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id as int))").alias("ts"), "id")
    rows = days.select("ts", F.explode(F.sequence(F.col("id") * 100, F.col("id") * 100 + 199)).alias("k"))
    merged = sketches.rollup(sketches.daily(rows, "k", "k")).orderBy("period").collect()
    assert [r.n for r in merged] == [31 * 200, 29 * 200]
    assert abs(merged[0].n_distinct - 3200) <= 0.03 * 3200 and abs(merged[1].n_distinct - 3000) <= 0.03 * 3000
    assert abs(merged[0].p50 - 1600) <= 0.03 * 3200
    skewed = rows.unionByName(rows.withColumn("k", F.col("k") % 3))
    top = sketches.heavy_hitters(sketches.heavy_sketches(skewed, "k"), 3, 1024).collect()
    assert {r.item for r in top} == {0, 1, 2}
    assert all(4000 <= r.n <= 4002 + 24000 / (0.375 * 1024) for r in top)


def test_retention_limits_completed_jobs_before_the_shuffle(spark):
    rows = [("q", state, i, i) for state in ("completed", "failed", "active", None) for i in range(7)]
    kept = jobs.retain_latest(spark.createDataFrame(rows, "queue string, state string, ts long, job_id long"), 2, 3)
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()
    got = sorted((r["state"] or "", r["job_id"]) for r in kept.collect())
    assert got == sorted([("completed", i) for i in (5, 6)] + [("failed", i) for i in (4, 5, 6)] + [(s, i) for s in ("active", "") for i in range(7)])
