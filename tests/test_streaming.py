"""Each stream against its batch operator, in one and in many micro-batches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from crawlkit import schemas
from crawlkit.operators import frontier, limits
from crawlkit.plans import catalogue
from crawlkit.sources import keyed
from crawlkit.sources.store import read_html_store
from crawlkit.streaming import crawl, ingest, metrics, retry, stateful
from crawlkit.streaming.calendar import Calendar

T0 = dt.datetime(2024, 1, 1)
REQUESTS = [(str(i), T0 + dt.timedelta(seconds=i), f"http://h/{i * i % 17}") for i in range(60)] + [
    ("60", T0 + dt.timedelta(seconds=60), None),
    ("61", T0 + dt.timedelta(seconds=61), ""),
]


def write_batches(spark, path, rows, schema, files):
    """One file per chunk, oldest first."""
    size = -(-len(rows) // files)
    for n in range(files):
        chunk = spark.createDataFrame(rows[n * size : (n + 1) * size], schema)
        chunk.coalesce(1).write.mode("append").parquet(str(path))


def stream_of(spark, path, schema, per_trigger=1):
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", per_trigger)
        .parquet(str(path))
    )


def drain(stream, path, checkpoint):
    query = (
        stream.writeStream.format("parquet")
        .option("path", str(path))
        .option("checkpointLocation", str(checkpoint))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(300)
    assert query.exception() is None
    return query


def tuples(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("files", [1, 4])
def test_exact_ingest_equals_batch(spark, tmp_path, files):
    write_batches(spark, tmp_path / "in", REQUESTS, schemas.INGEST, files)
    seen = spark.createDataFrame([("http://h/1",)], "url STRING")
    stream = stream_of(spark, tmp_path / "in", schemas.INGEST)
    query = ingest.ingest_stream_exact(stream, f"{tmp_path}/out", f"{tmp_path}/cp", seen)
    query.awaitTermination(300)
    assert query.exception() is None
    batch = spark.createDataFrame(REQUESTS, schemas.INGEST)
    fresh = ingest.read_routed(spark, f"{tmp_path}/out", "accepted")
    expected = frontier.new_urls(frontier.accepted(batch), seen)
    assert tuples(fresh.select("id", "url")) == tuples(expected.select("id", "url"))
    rejected = ingest.read_routed(spark, f"{tmp_path}/out", "rejected")
    assert fresh.count() + rejected.count() == 60


def test_exact_ingest_restarts_without_loss_or_repeat(spark, tmp_path):
    args = (f"{tmp_path}/out", f"{tmp_path}/cp")
    write_batches(spark, tmp_path / "in", REQUESTS[:30], schemas.INGEST, 2)
    ingest.ingest_stream_exact(
        stream_of(spark, tmp_path / "in", schemas.INGEST), *args
    ).awaitTermination(300)
    write_batches(spark, tmp_path / "in", REQUESTS[30:], schemas.INGEST, 2)
    ingest.ingest_stream_exact(
        stream_of(spark, tmp_path / "in", schemas.INGEST), *args
    ).awaitTermination(300)
    fresh = ingest.read_routed(spark, args[0], "accepted")
    assert fresh.count() == fresh.select("url").distinct().count()
    assert {r.url for r in fresh.collect()} == {u for _, _, u in REQUESTS if u}


def test_stateful_ingest_keeps_one_row_per_url(spark, tmp_path):
    write_batches(spark, tmp_path / "in", REQUESTS, schemas.INGEST, 3)
    for name, within in (("all", None), ("bounded", "1 hour")):
        out = ingest.ingest_stream(stream_of(spark, tmp_path / "in", schemas.INGEST), within)
        drain(out, tmp_path / name, tmp_path / f"cp-{name}")
        urls = [r.url for r in spark.read.parquet(f"{tmp_path}/{name}").collect()]
        assert sorted(urls) == sorted({u for _, _, u in REQUESTS if u})


def test_crawl_loop_closes_through_storage(spark, tmp_path):
    pages = spark.createDataFrame(
        [
            ("http://h/a", '<a href="/b">b</a><a href="/c">c</a>'),
            ("http://h/b", '<a href="/a">a</a><a href="/d">d</a>'),
            ("http://h/c", "no links"),
        ],
        "url STRING, html STRING",
    )
    spark.createDataFrame([("seed", T0, "http://h/a")], schemas.INGEST).write.parquet(
        f"{tmp_path}/ingest/batch=-1"
    )
    for _ in range(3):
        ingest.ingest_stream_exact(
            spark.readStream.schema(schemas.INGEST).parquet(f"{tmp_path}/ingest"),
            f"{tmp_path}/routed",
            f"{tmp_path}/cp1",
        ).awaitTermination(300)
        crawl.crawl_stream(
            spark.readStream.schema(schemas.INGEST).parquet(f"{tmp_path}/routed/accepted"),
            pages,
            f"{tmp_path}/store",
            f"{tmp_path}/ingest",
            f"{tmp_path}/cp2",
        ).awaitTermination(300)
    stored = read_html_store(spark, f"{tmp_path}/store")
    assert sorted(r.url for r in stored.collect()) == ["http://h/a", "http://h/b", "http://h/c"]
    outcomes = crawl.read_outcomes(spark, f"{tmp_path}/store")
    assert [r.url for r in outcomes.where("outcome = 'failed'").collect()] == ["http://h/d"]
    accepted = ingest.read_routed(spark, f"{tmp_path}/routed", "accepted")
    assert sorted(r.url[-1] for r in accepted.collect()) == ["a", "b", "c", "d"]


def test_metrics_stream_equals_batch(spark, tmp_path):
    rows = [
        (T0 + dt.timedelta(seconds=i), f"d{i % 3}", "failed" if i % 5 == 0 else "success")
        for i in range(40)
    ] + [(T0 + dt.timedelta(hours=1), "d0", "success")]
    schema = "ts TIMESTAMP_NTZ, domain STRING, status STRING"
    write_batches(spark, tmp_path / "in", rows, schema, 4)
    out = metrics.metrics_stream(stream_of(spark, tmp_path / "in", schema), "5 seconds")
    drain(out, tmp_path / "out", tmp_path / "cp")
    batch = spark.createDataFrame(rows[:-1], schema)
    expected = batch.groupBy(F.window("ts", "5 seconds")["start"], "domain", "status").count()
    assert tuples(spark.read.parquet(f"{tmp_path}/out")) == tuples(expected)


def test_sliding_windows_are_made_of_panes(spark, tmp_path):
    rows = [(T0 + dt.timedelta(seconds=7 * i), f"d{i % 3}", "failed" if i % 5 == 0 else "success") for i in range(40)]
    last = [(T0 + dt.timedelta(hours=1), "d0", "success")]
    late = [(T0, "d0", "success"), (T0, "d0", "success"), (T0, "d1", "failed"), (None, "d1", "failed")]
    schema = "ts TIMESTAMP_NTZ, domain STRING, status STRING"
    write_batches(spark, tmp_path / "in", rows, schema, 4)
    write_batches(spark, tmp_path / "in", last, schema, 1)
    out = metrics.sliding_metrics_stream(stream_of(spark, tmp_path / "in", schema), "30 seconds", "10 seconds")
    query = drain(out, tmp_path / "out", tmp_path / "cp")
    assert metrics.late_groups(query) == 0

    expected = {}
    for ts, domain, status in rows:
        first = ts - dt.timedelta(seconds=ts.second % 10)
        for back in range(3):
            key = (first - dt.timedelta(seconds=10 * back), domain, status)
            expected[key] = expected.get(key, 0) + 1
    counted = {tuple(r)[:3]: r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert counted == expected
    batch = metrics.sliding_metrics_stream(spark.createDataFrame(rows, schema), "30 seconds", "10 seconds")
    assert {tuple(r)[:3]: r.n for r in batch.collect()} == expected

    write_batches(spark, tmp_path / "in", late, schema, 1)
    query = drain(out, tmp_path / "out", tmp_path / "cp")
    assert metrics.late_groups(query) == 2
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(expected)


def test_a_fetch_is_one_row_of_one_pane(spark):
    schema = "ts TIMESTAMP_NTZ, domain STRING, status STRING"
    plan = metrics.sliding_metrics_stream(spark.createDataFrame([(T0, "d", "success")], schema))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    below = text[text.rindex("Aggregate") :]
    assert "Aggregate" in text[: text.rindex("Aggregate")] and "Expand" not in below and "Generate" not in below


HITS = [(3, 1), (5, 2), (9, 3), (12, 4), (13, 5), (14, 6), (22, 7), (23, 8)]


@pytest.mark.parametrize("files", [1, 4])
def test_limiter_stream(spark, tmp_path, files):
    stateful.use_rocksdb(spark)
    rows = [(k, T0 + dt.timedelta(seconds=s), i) for s, i in HITS for k in ("a", "b")]
    schema = "k STRING, ts TIMESTAMP_NTZ, id BIGINT"
    write_batches(spark, tmp_path / "in", rows, schema, files)
    for emit in ("reject", "delay"):
        out = stateful.rate_limit_stream(
            stream_of(spark, tmp_path / "in", schema), "k", points=2, duration_ms=10_000, emit=emit
        )
        drain(out, tmp_path / emit, tmp_path / f"cp-{emit}")
    batch = limits.rate_limit(
        spark.createDataFrame(rows, schema), "k", points=2, duration_ms=10_000
    )
    rejected = spark.read.parquet(f"{tmp_path}/reject")
    assert tuples(rejected.select("key", "id", "allowed")) == tuples(batch.select("k", "id", "allowed"))
    start = int(T0.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    delayed = spark.read.parquet(f"{tmp_path}/delay").where("key = 'a'")
    ready = {r.id: (r.ready_ms - start) / 1000 for r in delayed.collect()}
    assert ready == {1: 3, 2: 5, 3: 13, 4: 13, 5: 23, 6: 23, 7: 33, 8: 33}


def ms_after(ms):
    return (ms - int(T0.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)) / 1000


@pytest.mark.parametrize("files", [1, 4])
def test_held_delays_come_out_when_due(spark, tmp_path, files):
    """No row before its time, no key held up by another, the same rows in one and many micro-batches."""
    stateful.use_rocksdb(spark)
    rows = [(k, T0 + dt.timedelta(seconds=s), i) for s, i in HITS for k in ("a", "b")] + [("c", T0 + dt.timedelta(seconds=24), 1)]
    schema = "k STRING, ts TIMESTAMP_NTZ, id BIGINT"
    write_batches(spark, tmp_path / "in", rows, schema, files)
    limited = stateful.rate_limit_stream(
        stream_of(spark, tmp_path / "in", schema), "k", points=2, duration_ms=10_000, emit="delay"
    )
    query = stateful.hold_until_ready(limited, f"{tmp_path}/held", f"{tmp_path}/cp")
    query.awaitTermination(300)
    assert query.exception() is None
    out = stateful.read_ready(spark, f"{tmp_path}/held").collect()
    assert all(r.ready_ms <= r.released_ms for r in out)
    ready = sorted((r.key, r.id, ms_after(r.ready_ms)) for r in out)
    expected = {1: 3, 2: 5, 3: 13, 4: 13, 5: 23, 6: 23}
    assert ready == sorted([(k, i, s) for k in "ab" for i, s in expected.items()] + [("c", 1, 24)])
    held = stateful.read_held(spark, f"{tmp_path}/held", f"{tmp_path}/cp", limited.schema.simpleString()[7:-1].replace(":", " "))
    assert sorted((r.key, r.id, ms_after(r.ready_ms)) for r in held.collect()) == [(k, i, 33) for k in "ab" for i in (7, 8)]


FAILURES = [
    ("j", 0, 1, "other"), ("j", 10, 2, "DomainRateLimitError"), ("k", 10, 1, "other"), ("j", 20, 3, "other"),
    ("j", 30, 4, "other"), ("j", 40, 5, "other"), ("j", 41, 6, "other"), ("j", 42, 7, None), (None, 50, 1, "other"),
    ("clock", 60, 1, "other"),
]


@pytest.mark.parametrize("files", [1, 3, 10])
def test_retries_of_both_policies(spark, tmp_path, files):
    rows = [(j, T0 + dt.timedelta(seconds=s), n, e) for j, s, n, e in FAILURES]
    schema = "job_id STRING, ts TIMESTAMP_NTZ, seq BIGINT, error STRING"
    write_batches(spark, tmp_path / "in", rows, schema, files)
    expected = {
        "ingest": [(1, "retry", 2), (2, "retry", 14), (3, "retry", 28), (4, "retry", 46), (5, "dead", 40)],
        "fetch": [(1, "retry", 2), (2, "retry", 11), (3, "retry", 28), (4, "retry", 46)],
    }
    for policy, wanted in expected.items():
        home = f"{tmp_path}/{policy}"
        failures = stream_of(spark, tmp_path / "in", schema).where("error is not null")
        query = retry.retry_stream(failures, home, f"{home}-cp", policy)
        query.awaitTermination(300)
        assert query.exception() is None
        out = retry.read_retries(spark, home).collect()
        assert sorted((r.attempt, r.verdict, ms_after(r.at_ms)) for r in out if r.job_id == "j") == wanted
        assert [(r.attempt, ms_after(r.at_ms)) for r in out if r.job_id == "k"] == [(1, 12)]
        assert not [r for r in out if r.job_id == "clock"]


def key_rows(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "name STRING")
    return keyed.keyed(df, F.col("name")).select("h")


def test_key_table_reads_only_the_prefixes_of_its_keys(spark, tmp_path):
    keyed.load(key_rows(spark, [f"u{i}" for i in range(300)]), f"{tmp_path}/t", "given")
    asked = key_rows(spark, ["u1", "u2", "new"])
    rows = keyed.candidates(asked, f"{tmp_path}/t")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters:") :]
    assert "prefix" in filters[: filters.index("]")]
    assert rows.count() < 100
    found = keyed.lookup(asked, f"{tmp_path}/t")
    assert tuples(found) == tuples(key_rows(spark, ["u1", "u2"]))


def test_key_table_keeps_few_files_and_the_largest_value(spark, tmp_path):
    """100 batches, of which one key grows in each; batch 99 is replayed with another value."""
    path, values = f"{tmp_path}/t", "used BIGINT"
    for n in range(100):
        keyed.compact(spark, path, values, "r", n)
        rows = key_rows(spark, ["hot", f"u{n}"]).withColumn("used", F.lit(n).cast("bigint"))
        keyed.write(rows, path, "r", n)
    spans = keyed.live(spark, path)
    assert len(spans) <= 2 * keyed.FAN and sum(s.hi - s.lo + 1 for s in spans) == 100
    files = [p for p in (tmp_path / "t").rglob("prefix=*/*.parquet")]
    per_prefix = {}
    for p in files:
        per_prefix[p.parent.name] = per_prefix.get(p.parent.name, 0) + 1
    assert max(per_prefix.values()) <= 2 * keyed.FAN
    assert [r.used for r in keyed.lookup(key_rows(spark, ["hot"]), path, values).collect()] == [99]
    # Batch 99 itself does not see what it wrote.
    assert [r.used for r in keyed.lookup(key_rows(spark, ["hot", "u99"]), path, values, "r", 99).collect()] == [98]
    keyed.write(key_rows(spark, ["hot"]).withColumn("used", F.lit(7).cast("bigint")), path, "r", 99)
    assert keyed.lookup(key_rows(spark, ["u99"]), path, values).count() == 0


def test_calendar_releases_every_row_once_and_tidies_up(spark, tmp_path):
    calendar = Calendar(spark, f"{tmp_path}/c", "r", width_ms=10)
    schema = "name STRING, due_ms BIGINT"
    out = []
    for batch, (latest, rows) in enumerate([(5, [("a", 7), ("b", 25), ("c", 90)]), (4, [("d", 6)]), (26, []), (26, [("e", 27)]), (100, [])]):
        for _ in range(2):  # every batch is replayed
            since, now = calendar.clock(batch, latest)
            calendar.hold(spark.createDataFrame(rows, schema), batch)
            due = sorted(r.name for r in calendar.due(schema, batch, since, now).collect())
        out.append((since, now, due))
        calendar.tidy(since)
    assert [o[1:] for o in out] == [(5, []), (5, []), (26, ["a", "b", "d"]), (26, []), (100, ["c", "e"])]
    assert calendar.waiting(schema, 26).count() == 2 and calendar.waiting(schema, 100).count() == 0
    assert calendar._buckets() == [2, 9]


def test_booking_never_exceeds_a_window(spark):
    jobs = [("h", i) for i in range(17)] + [("g", 0)]
    df = spark.createDataFrame([(h, T0, f"u{i:02d}") for h, i in jobs], "host STRING, ts TIMESTAMP_NTZ, url STRING")
    df = keyed.keyed(df, F.col("host"))
    known = keyed.keyed(spark.createDataFrame([("h", 500, 3), ("x", 0, 5)], "host STRING, start BIGINT, used BIGINT"), F.col("host")).drop("host")
    booked, after = crawl.book(df, known, 1200, points=5, duration_ms=1000)
    ready = sorted(r.ready_ms for r in booked.where("host = 'h'").collect())
    assert ready == [1200] * 2 + [1500] * 5 + [2500] * 5 + [3500] * 5
    assert [r.ready_ms for r in booked.where("host = 'g'").collect()] == [1200]
    assert sorted((r.start, r.used) for r in after.collect()) == [(1200, 1), (3500, 5)]


def test_closed_crawl_loop(spark, tmp_path):
    """Every accepted URL ends up once; limits hold; a loop stopped early goes on where it was."""
    links = {i: [2 * i + 1, 2 * i + 2, i // 2] for i in range(20)}
    pages = spark.createDataFrame(
        [
            (f"http://h{i % 2}/p{i}", f"<title>t{i}</title>" + "".join(f'<a href="http://h{j % 2}/p{j}">x</a>' for j in js), v)
            for i, js in links.items()
            for v in (1, 2)
        ],
        "url STRING, html STRING, version BIGINT",
    )
    seeds = spark.createDataFrame([("s", T0, "http://h0/p0"), ("b", T0, "nonsense"), ("c", T0, "http://")], schemas.INGEST)
    home = f"{tmp_path}/loop"
    early = crawl.crawl_loop(seeds, pages, home, points=1, duration_ms=3000, step_ms=1000, max_rounds=3).collect()
    accepted = ingest.read_routed(spark, f"{home}/routed", "accepted")
    assert len(early) == accepted.count() and "throttled" in {r.outcome for r in early}
    out = crawl.crawl_loop(seeds, pages, home, points=1, duration_ms=3000, step_ms=60_000).collect()
    urls = [r.url for r in out]
    assert len(urls) == len(set(urls)) == ingest.read_routed(spark, f"{home}/routed", "accepted").count()
    ends = {o: sorted(r.url for r in out if r.outcome == o) for o in ("stored", "failed", "discarded", "throttled")}
    assert ends["stored"] == sorted(f"http://h{i % 2}/p{i}" for i in range(20))
    assert ends["failed"] == sorted({f"http://h{j % 2}/p{j}" for js in links.values() for j in js if j >= 20})
    assert (ends["discarded"], ends["throttled"]) == (["http://", "nonsense"], [])
    assert {r.title for r in out if r.outcome == "stored"} == {f"t{i}" for i in range(20)}
    fetched = sorted((r.url[:9], r.at_ms) for r in out if r.outcome != "discarded")
    assert all(b[1] - a[1] >= 3000 for a, b in zip(fetched, fetched[1:]) if a[0] == b[0])
    assert read_html_store(spark, f"{home}/store").count() == 20


def test_exact_ingest_keeps_its_table_under_a_new_checkpoint(spark, tmp_path):
    rows = [(None, T0, "http://h/1"), (None, T0, "http://h/2"), ("a", T0, "http://h/3"), ("a", T0, "http://h/3")]
    write_batches(spark, tmp_path / "in", rows, schemas.INGEST, 1)
    for number in range(2):
        ingest.ingest_stream_exact(
            stream_of(spark, tmp_path / "in", schemas.INGEST), f"{tmp_path}/out", f"{tmp_path}/cp{number}"
        ).awaitTermination(300)
    urls = sorted(r.url for r in ingest.read_routed(spark, f"{tmp_path}/out", "accepted").collect())
    assert urls == ["http://h/1", "http://h/2", "http://h/3"]
    assert ingest.read_routed(spark, f"{tmp_path}/out", "rejected").count() == 5


def test_a_table_of_several_files_is_streamed_whole(spark, tmp_path):
    rows = [(i, f"http://h{i}.org/", f'<title>t</title><a href="/x{i % 3}">') for i in range(9)]
    pages = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING")
    pages.repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    out = catalogue.run("crawl_stream", spark, str(tmp_path)).collect()
    assert {r.url for r in out if r.html_md5} == {url for _, url, _ in rows}
    assert {r.url for r in out if not r.html_md5} == {f"http://h{i}.org/x{i % 3}" for i in range(9)}
