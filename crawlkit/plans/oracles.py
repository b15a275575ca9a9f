"""SQL twins of the queries, for DuckDB over the same tables."""

from __future__ import annotations

from crawlkit.operators import scaling_bloom

REQUESTS = """requests AS (
  SELECT event_id AS id, ts, user_id AS client, value,
    CASE WHEN event_id % 97 <> 0 THEN 'https://docs.developer.com/api/v1/resource/' ||
      CAST((CAST(json_extract_string(props, '$.k') AS BIGINT) * 200 + user_id) % 20000 AS VARCHAR)
    END AS url
  FROM events),
accepted AS (SELECT * FROM requests WHERE coalesce(url, '') <> ''),
seen AS (SELECT DISTINCT url FROM requests WHERE md5(url) < '8')"""

FIRSTS = """firsts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ts, id) AS rn FROM accepted)
  WHERE rn = 1 AND url NOT IN (SELECT url FROM seen))"""

ROUTED = """answered AS (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY ts, id) AS rn
  FROM accepted WHERE value <= 200),
routed AS (
  SELECT a.id, a.url, a.ts,
    CASE WHEN a.value > 200 THEN -1
         WHEN n.rn = 1 AND a.url NOT IN (SELECT url FROM seen) THEN 1 ELSE 0 END AS seen_result
  FROM accepted a LEFT JOIN answered n USING (id)),
routes AS (
  SELECT *, CASE seen_result WHEN 1 THEN 'fetch' WHEN 0 THEN 'reject' ELSE 'retry' END AS route
  FROM routed)"""

LOG = """log AS (
  SELECT event_id, ts, 'd' || CAST(user_id % 20 AS VARCHAR) || '.example.com' AS domain,
    CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'rate_limited' ELSE 'success' END
      AS status,
    value AS latency_ms
  FROM events)"""

JOBS = """jobs AS (
  SELECT o_orderkey AS job_id,
    CASE WHEN o_custkey % 2 = 0 THEN 'queue-urls-ingestion' ELSE 'queue-urls-fetch' END AS queue,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'waiting' WHEN 'P' THEN 'failed' END
      AS state,
    o_orderdate AS ts
  FROM orders)"""

JOB_EVENTS = """job_events AS (
  SELECT l_orderkey AS job_id, l_shipdate AS ts,
    l_linenumber * 1000000000000000 + l_partkey * 10000000 + l_suppkey AS seq,
    CASE l_returnflag WHEN 'R' THEN 'DomainRateLimitError' WHEN 'A' THEN 'ConnectionTimeoutError' END
      AS error,
    CASE WHEN l_returnflag = 'R' THEN 'delayed' WHEN l_returnflag = 'A' THEN 'failed'
         WHEN l_linestatus = 'O' THEN 'active' ELSE 'completed' END AS state
  FROM lineitem),
attempts AS (
  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, seq) AS attempt FROM job_events)"""


def _decoded(text: str) -> str:
    """Character references that occur in the test pages, ``&amp;`` last."""
    for name, char in [("quot", '"'), ("lt", "<"), ("gt", ">"), ("copy", "©"), ("middot", "·"), ("amp", "&")]:
        text = f"replace({text}, '&{name};', '{char}')"
    return text


def _encoded(path: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({path}, '[!$-;=@-\\]_a-z|~]+|[^!$-;=@-\\]_a-z|~]+'),"
        " lambda r: CASE WHEN regexp_matches(r, '^[!$-;=@-\\]_a-z|~]') THEN r ELSE url_encode(r) END), '')"
    )


LINKS = f"""stripped AS (
  SELECT page_id, url, regexp_replace(html,
    '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<title\\b.*?</title\\s*>', '', 'g') AS body
  FROM pages),
raw_links AS (
  SELECT page_id, url, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) - 1 AS pos
  FROM (SELECT page_id, url,
          list_filter(regexp_extract_all(body, '(?is)<a\\s[^>]*?href\\s*=\\s*"([^"]*)"', 1), lambda h: h <> '') AS hrefs
        FROM stripped)),
links AS (
  SELECT page_id, url, CAST(pos AS INTEGER) AS pos, {_decoded("href")} AS href,
    CASE WHEN href LIKE '/%' THEN lower(regexp_extract(url, '^https?://[^/?#]*')) || {_encoded(_decoded("href"))} END
      AS resolved
  FROM raw_links),
edges AS (SELECT url AS src, resolved AS dst, pos FROM links)"""

HOST = "lower(regexp_extract({0}, '^https?://([^/?#:]*)', 1))"

QUEUE = f"""queue AS (
  SELECT *, {HOST.format("url")} AS host FROM (
    SELECT 'seeds' AS producer, url, TIMESTAMP '2024-01-01' + to_minutes(page_id) AS ts, 0 AS id
      FROM pages WHERE page_id % 25 = 0
    UNION ALL SELECT 'requests', url, ts, id FROM accepted
    UNION ALL SELECT 'discovered', resolved, TIMESTAMP '2024-01-01' + to_minutes(page_id), pos + 1
      FROM links))"""

GRAPH = f"""{LINKS},
graph_edges AS (
  SELECT DISTINCT e.src, p.url AS dst FROM edges e
  JOIN pages p ON p.page_id = CAST('0x' || substr(md5(e.dst), 1, 7) AS BIGINT) % (SELECT count(*) FROM pages)),
walk AS (
  SELECT url, 0 AS depth FROM pages WHERE page_id % 25 = 0
  UNION
  SELECT g.dst, w.depth + 1 FROM walk w JOIN graph_edges g ON g.src = w.url WHERE w.depth < 12),
depths AS (SELECT url, min(depth) AS depth FROM walk GROUP BY url)"""

GAUGES = f"""{JOBS}, {JOB_EVENTS},
spans AS (SELECT job_id, min(ts) AS first, max(ts) AS last FROM job_events GROUP BY job_id),
transitions AS (
  SELECT queue, unnest(['waiting', 'waiting', 'active', 'active']) AS gauge,
    unnest([ts, first, first, last]) AS ts, unnest([1, -1, 1, -1]) AS delta
  FROM jobs JOIN spans USING (job_id)),
grid AS (
  SELECT queue, gauge, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts
  FROM transitions GROUP BY queue, gauge),
per_day AS (SELECT queue, gauge, ts, sum(delta) AS delta FROM transitions GROUP BY ALL),
gauges AS (
  SELECT queue, gauge, ts,
    CAST(sum(coalesce(delta, 0)) OVER (PARTITION BY queue, gauge ORDER BY ts) AS BIGINT) AS level
  FROM grid LEFT JOIN per_day USING (queue, gauge, ts))"""


def _workers(bucket_us: int) -> str:
    return f"""moves AS (
  SELECT domain, unnest([epoch_us(ts), epoch_us(ts) + CAST(trunc(latency_ms * 1000) AS BIGINT)]) AS us,
    unnest([1, -1]) AS delta FROM log),
in_flight AS (
  SELECT domain, make_timestamp(us) AS bucket,
    CAST(sum(delta) OVER (PARTITION BY domain ORDER BY us) AS BIGINT) AS in_flight
  FROM (SELECT domain, us - us % {bucket_us} AS us, sum(delta) AS delta FROM moves GROUP BY ALL))"""


def _with(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "


def _recursive(*ctes: str) -> str:
    return "WITH RECURSIVE " + ", ".join(ctes) + " "


PCT = "round(100.0 * {0} / nullif({1}, 0), 6)"
DONE = "status IN ('success', 'failed')"
N_OK = "count(*) FILTER (status = 'success')"

ERROR_CLASS = """failures AS (
  SELECT event_id, 'item ' || CAST(user_id AS VARCHAR) AS detail,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events WHERE event_type = 'error')"""

FIRST_HIT = _recursive(
    """hits AS (SELECT event_id AS id, user_id AS client, epoch_us(ts) // 1000 AS ms, ts FROM events)""",
    """starts AS (
      SELECT client, min(ms) AS start FROM hits GROUP BY client
      UNION ALL
      SELECT s.client, (SELECT min(h.ms) FROM hits h WHERE h.client = s.client AND h.ms >= s.start + 86400000)
      FROM starts s WHERE EXISTS (SELECT 1 FROM hits h WHERE h.client = s.client AND h.ms >= s.start + 86400000))""",
    """placed AS (
      SELECT h.id, h.client, h.ms, s.start,
    row_number() OVER (PARTITION BY h.client, s.start ORDER BY h.ts, h.id) AS hit
      FROM hits h ASOF JOIN starts s ON h.client = s.client AND h.ms >= s.start)""",
)

CANONICAL = """lower(regexp_extract(url, '^(https?://[^/?#]*)(.*)$', 1)) ||
      CASE WHEN regexp_matches(url, '^https?://[^/?#]*/') THEN '' ELSE '/' END ||
      regexp_extract(url, '^(https?://[^/?#]*)(.*)$', 2)"""

_FOUND_TITLE = _decoded("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)")
TITLE = f"""coalesce(nullif(trim({_FOUND_TITLE}, ' ' || chr(9) || chr(10) || chr(13)), ''), 'Untitled Document')"""

# Unbounded: a URL enters once, so the recursion ends when no URL is new.
CRAWL = _recursive(
    f"""{LINKS}""",
    """targets AS (
      SELECT DISTINCT e.src, p.url FROM edges e
      JOIN pages p ON p.page_id = CAST('0x' || substr(md5(e.dst), 1, 7) AS BIGINT) % (SELECT count(*) FROM pages))""",
    f"""jumps AS (
      SELECT src, dst FROM edges WHERE dst LIKE 'http://%' OR dst LIKE 'https://%'
      UNION SELECT src, {CANONICAL} FROM targets)""",
    """reached AS (
      SELECT unnest([url, 'no url ' || page_id]) AS url FROM pages WHERE page_id % 25 = 0
      UNION
      SELECT j.dst FROM reached r JOIN jumps j ON j.src = r.url)""",
)

def _approx(batches: int, capacity: int, rate: float) -> str:
    """The same growing filter, bit by bit: one CTE per batch, a layer's shape from its number."""
    layers = [scaling_bloom.layer_shape(i, capacity, rate) for i in range(10)]
    shapes = ", ".join(f"({i}, {capacity << i}, {b}, {k})" for i, (b, k) in enumerate(layers))

    def digits(start: int) -> str:
        return f"CAST('0x' || substr(m, {start}, 8) AS BIGINT)"

    ctes = [
        f"shapes(layer, capacity, blocks, hashes) AS (VALUES {shapes})",
        f"asked AS (SELECT DISTINCT id % {batches} AS batch, url FROM accepted)",
        # Bits of a URL in every layer, as numbers of the layer's whole bit string.
        f"""marks AS (
      SELECT url, layer, hashes, {digits(1)} % blocks AS block,
        unnest(list_transform(range(hashes), lambda i: ({digits(9)} % 4096 + i * (({digits(17)} % 2048) * 2 + 1)) % 4096)) AS p
      FROM (SELECT url, s.*, md5(layer || ':' || url) AS m FROM (SELECT DISTINCT url FROM asked), shapes s))""",
        "bits_0 AS (SELECT NULL::INTEGER AS layer, NULL::BIGINT AS block, NULL::BIGINT AS p, NULL::VARCHAR AS url LIMIT 0)",
    ]
    for b in range(batches):
        ctes += [
            f"""maybe_{b} AS (
      SELECT DISTINCT url FROM (
        SELECT m.url, m.layer FROM marks m JOIN (SELECT DISTINCT layer, block, p FROM bits_{b}) x USING (layer, block, p)
        WHERE m.url IN (SELECT url FROM asked WHERE batch = {b}) GROUP BY m.url, m.layer, m.hashes HAVING count(*) = m.hashes))""",
            f"fresh_{b} AS (SELECT url FROM asked WHERE batch = {b} AND url NOT IN (SELECT url FROM maybe_{b}))",
            f"""layer_{b} AS (
      SELECT min(s.layer) AS layer FROM shapes s
      WHERE s.layer >= coalesce((SELECT max(layer) FROM bits_{b}), 0)
        AND (SELECT count(*) FROM fresh_{b}) + (SELECT count(DISTINCT url) FROM bits_{b} x WHERE x.layer = s.layer) <= s.capacity)""",
            f"""bits_{b + 1} AS (
      SELECT layer, block, p, url FROM bits_{b}
      UNION ALL SELECT m.layer, m.block, m.p, m.url FROM marks m JOIN fresh_{b} USING (url) WHERE m.layer = (SELECT layer FROM layer_{b}))""",
        ]
    routed = " UNION ALL ".join(f"SELECT {b} AS batch, url FROM fresh_{b}" for b in range(batches))
    ctes.append(f"fetched AS ({routed})")
    return _with(REQUESTS, *[c.replace(" AS (", " AS MATERIALIZED (", 1) for c in ctes]) + """
      SELECT a.batch, count(*) AS n_urls, count(f.url) AS n_fetched,
        count(*) FILTER (f.url IS NULL AND NOT EXISTS (SELECT 1 FROM fetched e WHERE e.url = a.url AND e.batch < a.batch))
          AS n_false_positive,
        count(*) FILTER (f.url IS NOT NULL AND EXISTS (SELECT 1 FROM fetched e WHERE e.url = a.url AND e.batch < a.batch))
          AS n_false_negative
      FROM asked a LEFT JOIN fetched f ON f.url = a.url AND f.batch = a.batch GROUP BY a.batch"""


# Every hit takes a point; a full window hands on to the next one, which may lie ahead of the hit.
BOOKED = _recursive(
    """hits AS (
      SELECT event_id AS id, user_id AS client, epoch_us(ts) // 1000 AS ms,
        row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS rn FROM events)""",
    """booked AS (
      SELECT id, client, ms, rn, ms AS start, 1 AS used FROM hits WHERE rn = 1
      UNION ALL
      SELECT h.id, h.client, h.ms, h.rn,
        CASE WHEN h.ms >= b.start + 86400000 THEN h.ms WHEN b.used = 5 THEN b.start + 86400000 ELSE b.start END,
        CASE WHEN h.ms >= b.start + 86400000 OR b.used = 5 THEN 1 ELSE b.used + 1 END
      FROM booked b JOIN hits h ON h.client = b.client AND h.rn = b.rn + 1)""",
)


def _retries(cap: int, wait: str) -> str:
    return (
        _with(JOB_EVENTS)
        + f"""SELECT job_id, n AS attempt, error, verdict, at_ms FROM (
      SELECT job_id, n, error, CASE WHEN n = {cap} THEN 'dead' ELSE 'retry' END AS verdict,
        epoch_us(ts) // 1000 + CASE WHEN n = {cap} THEN 0 ELSE {wait} END AS at_ms
      FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, seq) AS n
            FROM job_events WHERE error IS NOT NULL) WHERE n <= {cap})
      WHERE verdict = 'dead' OR at_ms <= (SELECT epoch_us(max(ts)) // 1000 FROM job_events WHERE error IS NOT NULL)"""
    )


ORACLES: dict[str, str] = {
    "ingest_admit": _with(REQUESTS)
    + """SELECT id, CASE WHEN coalesce(url, '') = '' THEN 400 ELSE 202 END AS status,
      CASE WHEN coalesce(url, '') = '' THEN 'URL is required' ELSE 'queued' END AS reply FROM requests""",
    "url_validity": _with(REQUESTS, LINKS)
    + """SELECT text, regexp_matches(text, '^https?://[^/?#]+') AS valid, count(*) AS n FROM (
      SELECT url AS text FROM pages UNION ALL SELECT href FROM links UNION ALL SELECT url FROM accepted)
      GROUP BY ALL""",
    "frontier_route": _with(REQUESTS, ROUTED) + "SELECT id, url, seen_result, route FROM routes",
    "dedup_new_urls": _with(REQUESTS, FIRSTS) + "SELECT id, url, ts FROM firsts",
    "dedup_rejected": _with(REQUESTS, FIRSTS)
    + "SELECT id, url FROM accepted WHERE id NOT IN (SELECT id FROM firsts)",
    "ingest_counters": _with(REQUESTS, ROUTED)
    + """SELECT count(*) FILTER (route = 'fetch') AS urls_ingested,
      count(*) FILTER (route = 'reject') AS urls_rejected FROM routes""",
    "seen_cardinality": _with(REQUESTS)
    + "SELECT count(DISTINCT url) AS n_seen, true AS estimate_close FROM accepted",
    "distinct_urls": _with(REQUESTS, LINKS, QUEUE) + "SELECT DISTINCT url FROM queue",
    "accept_ratio": _with(REQUESTS)
    + """SELECT count(*) AS n_requests,
      round(count(*) FILTER (coalesce(url, '') <> '') / count(*), 9) AS accept_ratio FROM requests""",
    "frontier_union": _with(REQUESTS, LINKS, QUEUE) + "SELECT producer, url, ts, id FROM queue",
    "priority_frontier": _with(REQUESTS)
    + "SELECT id, row_number() OVER (ORDER BY value DESC, ts, id) AS position FROM accepted",
    "bloom_false_positive": _with(REQUESTS)
    + """SELECT count(*) FILTER (url IN (SELECT url FROM seen)) AS n_seen,
      count(*) FILTER (url NOT IN (SELECT url FROM seen)) AS n_unseen,
      0 AS n_false_negative, true AS rate_in_bound FROM (SELECT DISTINCT url FROM accepted)""",
    "rate_limit_first_hit": FIRST_HIT
    + """SELECT id, client, start AS window_start_ms, hit, hit <= 5 AS allowed,
      CASE WHEN hit > 5 THEN start + 86400000 - ms END AS ms_before_next FROM placed""",
    "rate_limit_stream": FIRST_HIT
    + """SELECT id, client, hit <= 5 AS allowed,
      CASE WHEN hit > 5 THEN start + 86400000 ELSE ms END AS ready_ms FROM placed""",
    "ingest_stream_urls": _with(REQUESTS) + "SELECT DISTINCT url FROM accepted",
    "ingest_stream_exact": _with(REQUESTS, FIRSTS)
    + """SELECT id, url, CASE WHEN id IN (SELECT id FROM firsts) THEN 'accepted' ELSE 'rejected' END AS route
      FROM accepted""",
    "crawl_stream": _with(LINKS)
    + """SELECT url, md5(html) AS html_md5, 1 AS n FROM pages
      UNION ALL SELECT dst, NULL, count(*) FROM edges GROUP BY dst""",
    "approx_route": _approx(3, 512, 0.2),
    "sketch_rollup": _with(REQUESTS)
    + """SELECT CAST(date_trunc('week', ts) AS DATE) AS period, count(*) AS n, count(DISTINCT client) AS exact,
      true AS distinct_within_3_pct, true AS ranks_within_2_pct FROM requests GROUP BY ALL""",
    "approx_top_throttled": _with(LOG)
    + """SELECT user_id AS client, count(*) AS n, true AS found FROM events WHERE event_type = 'signup'
      GROUP BY user_id QUALIFY rank() OVER (ORDER BY n DESC) <= 10""",
    "crawl_loop": CRAWL
    + f"""SELECT r.url, CASE WHEN NOT regexp_matches(r.url, '^https?://') THEN 'discarded'
        WHEN p.url IS NULL THEN 'failed' ELSE 'stored' END AS outcome,
      CASE WHEN p.url IS NOT NULL THEN {TITLE} END AS title
      FROM reached r LEFT JOIN pages p ON p.url = r.url""",
    "retry_stream": _retries(5, "CAST(2000 * power(2, n - 1) AS BIGINT)"),
    "retry_stream_fetch": _retries(
        25, "CASE WHEN error = 'DomainRateLimitError' THEN 1000 ELSE CAST(least(1000 * power(2, n), 30000) AS BIGINT) END"
    ),
    "rate_limit_delay_stream": BOOKED
    + """SELECT id, client, ms, greatest(ms, start) AS ready_ms FROM booked
      WHERE greatest(ms, start) <= (SELECT max(ms) FROM hits)""",
    "metrics_stream": _with(LOG)
    + """SELECT date_trunc('hour', ts) AS window_start, domain, status, count(*) AS n FROM log
      WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM log) - INTERVAL 1 MINUTE
      GROUP BY ALL""",
    "sliding_metrics_stream": _with(LOG)
    + """SELECT date_trunc('hour', ts) - to_hours(h) AS window_start, domain, status, count(*) AS n
      FROM log, range(24) AS hours(h)
      WHERE date_trunc('hour', ts) - to_hours(h) + INTERVAL 24 HOUR <= (SELECT max(ts) FROM log) - INTERVAL 1 MINUTE
      GROUP BY ALL""",
    "rate_limit_aligned": """SELECT id, client, w * 86400000 AS window_start_ms, hit <= 5 AS allowed,
      CASE WHEN hit > 5 THEN (w + 1) * 86400000 - ms END AS ms_before_next FROM (
        SELECT *, row_number() OVER (PARTITION BY client, w ORDER BY ts, id) AS hit FROM (
          SELECT event_id AS id, user_id AS client, ts, epoch_us(ts) // 1000 AS ms, epoch_us(ts) // 86400000000 AS w
          FROM events))""",
    "polite_plan": _with(REQUESTS, LINKS, QUEUE)
    + """SELECT host, url, id, slot, slot * 1000 AS ready_ms FROM (
      SELECT *, (row_number() OVER (PARTITION BY host ORDER BY ts, id) - 1) // 5 AS slot FROM queue)""",
    "crawl_delay_violations": _with(LOG)
    + """SELECT domain, event_id, ts, gap_us FROM (
      SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY domain ORDER BY ts, event_id)) AS gap_us
      FROM log) WHERE gap_us < 600000000""",
    "hot_domain_share": _with(REQUESTS, LINKS, QUEUE)
    + """SELECT host, CAST(sum(n) AS BIGINT) AS n_urls, CAST(sum(greatest(n - 5, 0)) AS BIGINT) AS n_wasted,
      round(sum(n) / (SELECT count(*) FROM queue), 9) AS share
      FROM (SELECT host, epoch_us(ts) // 3600000000 AS w, count(*) AS n FROM queue GROUP BY ALL)
      GROUP BY host""",
    "eligible_domains": _with(LOG)
    + """SELECT event_id, domain FROM log WHERE status = 'rate_limited' AND domain NOT IN (
      SELECT domain FROM log WHERE status <> 'rate_limited' GROUP BY domain
      HAVING max(ts) + INTERVAL 1 HOUR > (SELECT max(ts) FROM log))""",
    "fetch_outcome": _with(LOG) + "SELECT event_id, status FROM log",
    "fetches_by_domain_status": _with(LOG)
    + f"SELECT domain, status, count(*) AS n FROM log WHERE {DONE} GROUP BY ROLLUP (domain, status)",
    "throttles_by_domain": _with(LOG)
    + "SELECT domain, count(*) AS n FROM log WHERE status = 'rate_limited' GROUP BY domain",
    "success_rate": _with(LOG)
    + f"""SELECT {N_OK} AS n_success, count(*) FILTER (status = 'failed') AS n_failed,
      {PCT.format(N_OK, f"count(*) FILTER ({DONE})")} AS success_pct FROM log""",
    "rolling_success_rate": _with(LOG)
    + f"""SELECT DISTINCT domain, ts, n_success, n_done, {PCT.format("n_success", "n_done")} AS success_pct FROM (
      SELECT domain, ts, {N_OK} OVER w AS n_success, count(*) OVER w AS n_done FROM log WHERE {DONE}
      WINDOW w AS (PARTITION BY domain ORDER BY epoch_us(ts) RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW))""",
    "sliding_success_rate": _with(LOG)
    + f"""SELECT window_start, {N_OK} AS n_success, count(*) AS n_done,
      {PCT.format(N_OK, "count(*)")} AS success_pct
      FROM (SELECT status, date_trunc('hour', ts) - to_hours(unnest([0, 1, 2, 3, 4, 5])) AS window_start
            FROM log WHERE {DONE}) GROUP BY window_start""",
    "throttle_increase_1h": _with(LOG)
    + """SELECT domain, count(*) AS n FROM log WHERE status = 'rate_limited'
      AND ts > (SELECT max(ts) FROM log) - INTERVAL 1 HOUR GROUP BY domain""",
    "top_throttled_domains": _with(LOG)
    + """SELECT domain, count(*) AS n FROM log WHERE status = 'rate_limited'
      AND ts > (SELECT max(ts) FROM log) - INTERVAL 24 HOUR GROUP BY domain
      ORDER BY n DESC, domain LIMIT 10""",
    "latency_summary": _with(LOG)
    + """SELECT count(latency_ms) AS n_calls, max(latency_ms) AS max_ms,
      round(count(*) / ((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6), 9) AS calls_per_sec,
      quantile_disc(latency_ms, 0.5) AS p50_ms, quantile_disc(latency_ms, 0.95) AS p95_ms,
      quantile_disc(latency_ms, 0.99) AS p99_ms FROM log""",
    "failure_windows": _with(LOG)
    + """SELECT window_start, n_calls, n_errors, round(100.0 * n_errors / n_calls, 6) AS error_pct,
      n_errors * 2 > n_calls AS alert FROM (
        SELECT date_trunc('hour', ts) AS window_start, count(*) AS n_calls,
          count(*) FILTER (status = 'failed' OR latency_ms > 200) AS n_errors FROM log GROUP BY 1)""",
    "alert_openings": _recursive(
        LOG,
        """bad AS (SELECT date_trunc('hour', ts) AS t FROM log GROUP BY 1
      HAVING count(*) FILTER (status = 'failed' OR latency_ms > 200) * 2 > count(*))""",
        """openings AS (SELECT min(t) AS t FROM bad
      UNION ALL SELECT (SELECT min(b.t) FROM bad b WHERE b.t >= o.t + INTERVAL 6 HOUR) FROM openings o
      WHERE EXISTS (SELECT 1 FROM bad b WHERE b.t >= o.t + INTERVAL 6 HOUR))""",
    )
    + "SELECT t AS window_start, t IN (SELECT t FROM openings) AS opens FROM bad",
    "active_workers": _with(LOG, _workers(100_000)) + "SELECT domain, bucket, in_flight FROM in_flight",
    "queue_status": _with(JOBS)
    + "SELECT queue, "
    + ", ".join(
        f"count(*) FILTER (state = '{s}') AS {s}"
        for s in ["waiting", "active", "completed", "failed", "delayed"]
    )
    + " FROM jobs GROUP BY queue",
    "latest_job_states": _with(JOB_EVENTS)
    + """SELECT state, count(*) AS n FROM (
      SELECT state, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC) AS rn FROM job_events)
      WHERE rn = 1 GROUP BY state""",
    "queue_gauges": _with(GAUGES) + "SELECT queue, gauge, ts, level FROM gauges",
    "reconcile_loss": _with(REQUESTS, JOBS)
    + """SELECT coalesce(a.id, j.job_id) AS job_id, j.state,
      CASE WHEN a.id IS NULL THEN 'unrequested' WHEN j.job_id IS NULL THEN 'lost' ELSE 'accounted' END AS verdict
      FROM accepted a FULL OUTER JOIN (SELECT * FROM jobs WHERE queue = 'queue-urls-fetch') j ON a.id = j.job_id""",
    "log_level_counts": _with(LOG)
    + """SELECT CASE status WHEN 'success' THEN 'info' WHEN 'failed' THEN 'error' ELSE 'warn' END AS level,
      count(*) AS n FROM log GROUP BY 1""",
    "log_fields": """WITH lines AS (
        SELECT event_id, ts, event_type, user_id, props, event_id % 30 = 1 AS unfit FROM events WHERE event_id % 40 <> 0),
      known AS (
        SELECT event_id, ts, 'info' AS level, event_type AS msg, CASE WHEN NOT unfit THEN user_id END AS ms_before_next,
          CAST(NULL AS VARCHAR) AS broken, props FROM lines)
      SELECT * EXCLUDE props, 'event_id' AS field, 'BIGINT' AS kind, CAST(event_id AS VARCHAR) AS value FROM known
      UNION ALL SELECT * EXCLUDE props, 'props', 'OBJECT<k: BIGINT>', '{"k":' || json_extract_string(props, '$.k') || '}' FROM known
      UNION ALL SELECT * EXCLUDE props, 'msBeforeNext', 'STRING', '"soon"' FROM known WHERE ms_before_next IS NULL
      UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, '{"level":"info","event_id":' || CAST(event_id AS VARCHAR), NULL, NULL, NULL
        FROM events WHERE event_id % 40 = 0""",
    "log_field_kinds": "SELECT 'k' AS field, 'BIGINT' AS kind, count(json_extract(props, '$.k')) AS n FROM events",
    "metrics_export": _with(REQUESTS, ROUTED, LOG, GAUGES, _workers(3_600_000_000))
    + f"""SELECT max(ts) AS ts, 'urls_ingested_total' AS metric, '{{}}' AS labels,
        CAST(count(*) FILTER (route = 'fetch') AS DOUBLE) AS value FROM routes
      UNION ALL SELECT max(ts), 'urls_rejected_total', '{{}}', count(*) FILTER (route = 'reject') FROM routes
      UNION ALL SELECT ts, 'queue_' || gauge, '{{"queue":"' || queue || '"}}', level FROM gauges
      UNION ALL SELECT bucket, 'active_workers', '{{}}', sum(in_flight) FROM in_flight GROUP BY bucket
      UNION ALL SELECT max(ts), 'fetches_total', '{{"domain":"' || domain || '","status":"' || status || '"}}', count(*)
        FROM log WHERE {DONE} GROUP BY domain, status
      UNION ALL SELECT max(ts), 'rate_limits_total', '{{"domain":"' || domain || '"}}', count(*)
        FROM log WHERE status = 'rate_limited' GROUP BY domain""",
    "retention": _with(JOBS)
    + """SELECT job_id, queue, state FROM (
      SELECT *, row_number() OVER (PARTITION BY queue, state ORDER BY ts DESC, job_id DESC) AS rn FROM jobs)
      WHERE state NOT IN ('completed', 'failed') OR rn <= CASE state WHEN 'completed' THEN 1000 ELSE 5000 END""",
    "attempts": _with(JOB_EVENTS)
    + "SELECT job_id, seq, attempt, attempt >= 5 AS exhausted FROM attempts",
    "dead_letters": _with(JOB_EVENTS)
    + "SELECT job_id, seq, error FROM attempts WHERE attempt = 5 AND error IS NOT NULL",
    "retry_schedule": _with(JOB_EVENTS)
    + """SELECT job_id, seq, attempt, CAST(1000 * power(2, attempt) AS BIGINT) AS delay_ms,
      CAST(2000 * (power(2, attempt) - 1) AS BIGINT) AS total_ms
      FROM attempts WHERE error IS NOT NULL AND attempt < 5""",
    "fetch_backoff": _with(JOB_EVENTS)
    + """SELECT job_id, seq, error, attempt, CASE WHEN attempt >= 25 THEN NULL
      WHEN error = 'DomainRateLimitError' THEN 1000
      ELSE CAST(least(1000 * power(2, attempt), 30000) AS BIGINT) END AS delay_ms
      FROM attempts WHERE error IS NOT NULL""",
    "error_classes": _with(ERROR_CLASS)
    + """SELECT event_id,
      CASE WHEN k >= 90 THEN 'DomainRateLimitError' WHEN k >= 80 THEN 'DnsResolutionError'
        WHEN k >= 70 THEN 'ConnectionTimeoutError' WHEN k >= 60 THEN 'UnsupportedContentTypeError'
        WHEN k >= 50 THEN 'ResponseTooLargeError' WHEN k >= 40 THEN 'HtmlStorageError'
        WHEN k >= 30 THEN 'AppError' WHEN k >= 20 THEN 'Http5xxError'
        WHEN k >= 10 THEN 'Http404Error' ELSE 'Http429Error' END AS name,
      CASE WHEN k >= 90 THEN 'Domain ' || detail || ' is currently rate limited'
        WHEN k >= 80 THEN 'Failed to resolve hostname: ' || detail
        WHEN k >= 70 THEN 'Connection timed out while fetching ' || detail
        WHEN k >= 60 THEN 'Unsupported content type: ' || detail
        WHEN k >= 50 THEN 'Response size exceeded limit: ' || detail || ' bytes'
        WHEN k >= 40 THEN 'Failed to store HTML at ' || detail
        WHEN k >= 30 THEN detail
        WHEN k >= 20 THEN 'Server error (' || CAST(500 + k % 5 AS VARCHAR) || ') while fetching ' || detail
        WHEN k >= 10 THEN 'Page not found: ' || detail
        ELSE 'Target server rate limited request: ' || detail END AS message,
      CASE WHEN k >= 90 THEN 429 WHEN k >= 80 THEN 502 WHEN k >= 70 THEN 504 WHEN k >= 60 THEN 415
        WHEN k >= 50 THEN 413 WHEN k >= 30 THEN 500 WHEN k >= 20 THEN 500 + k % 5
        WHEN k >= 10 THEN 404 ELSE 429 END AS status_code
      FROM failures""",
    "url_host": f"SELECT page_id, {HOST.format('url')} AS host FROM pages",
    "host_forms": f"""WITH numbers AS (SELECT page_id, {HOST.format("url")} AS plain, page_id * 7919000003 % 8589934592 AS n FROM pages),
      forms AS (
        SELECT page_id, unnest(['whole', 'hexadecimal', 'octal', 'two']) AS form, unnest([n, n, n, n % 33554432]) AS x FROM numbers),
      hosts AS (
        SELECT page_id, form, CASE WHEN form = 'two' THEN
            CASE WHEN x < 16777216 THEN concat_ws('.', 10, x // 65536, x // 256 % 256, x % 256) END
          WHEN x < 4294967296 THEN concat_ws('.', x // 16777216, x // 65536 % 256, x // 256 % 256, x % 256) END AS host
        FROM forms
        UNION ALL SELECT page_id, 'escaped', plain FROM numbers)
      SELECT page_id, form, host, host IS NOT NULL AS valid FROM hosts""",
    "url_hash": "SELECT page_id, sha256(url) AS url_hash FROM pages",
    "shard_path": """SELECT page_id, 'html/' || substr(h, 1, 2) || '/' || substr(h, 3, 2) || '/' || h || '.html' AS path
      FROM (SELECT page_id, sha256(url) AS h FROM pages)""",
    "canonical_urls": f"SELECT page_id, {CANONICAL} AS canonical FROM pages",
    "rate_keys": f"SELECT page_id, 'ratelimit:domain:' || {HOST.format('url')} AS key FROM pages",
    "request_bodies": "SELECT page_id, url AS from_json, url AS from_form FROM pages",
    "html_store_layout": """SELECT h AS url_hash, substr(h, 1, 2) AS shard1, substr(h, 3, 2) AS shard2,
      'html/' || substr(h, 1, 2) || '/' || substr(h, 3, 2) || '/' || h || '.html' AS path, md5(html) AS html_md5
      FROM (SELECT sha256(url) AS h, html,
              row_number() OVER (PARTITION BY url ORDER BY page_id DESC) AS rn FROM pages) WHERE rn = 1""",
    "page_titles": f"SELECT page_id, {TITLE} AS title FROM pages",
    "extract_links": _with(LINKS) + "SELECT url, pos, href FROM links",
    "resolve_links": _with(LINKS) + "SELECT url, pos, href, resolved FROM links",
    "scheme_filter": _with(LINKS)
    + "SELECT url, pos, regexp_matches(resolved, '^https?://') AS kept FROM links",
    "link_edges": _with(LINKS) + "SELECT src, dst, pos FROM edges",
    "link_stats": _with(LINKS)
    + "SELECT src, count(*) AS n_links, count(DISTINCT dst) AS n_targets FROM edges GROUP BY src",
    "link_in_degree": _with(LINKS)
    + "SELECT dst, count(*) AS n_inbound, count(DISTINCT src) AS n_sources FROM edges GROUP BY dst",
    "top_hubs": _with(LINKS)
    + "SELECT src, count(*) AS n_links FROM edges GROUP BY src ORDER BY n_links DESC, src LIMIT 10",
    "crawl_depth": _recursive(GRAPH) + "SELECT url, depth FROM depths",
    "crawl_growth": _recursive(GRAPH)
    + """SELECT depth, new_urls, CAST(sum(new_urls) OVER (ORDER BY depth) AS BIGINT) AS seen_urls
      FROM (SELECT depth, count(*) AS new_urls FROM depths GROUP BY depth)""",
    "frontier_fetch": _with(LINKS)
    + """SELECT a.url, CASE WHEN p.url IS NULL THEN 'failed' ELSE 'success' END AS status, length(p.html) AS n_chars
      FROM (SELECT DISTINCT dst AS url FROM edges UNION ALL SELECT url FROM pages) a LEFT JOIN pages p USING (url)""",
    "new_links_by_host": _with(LINKS)
    + f"""SELECT *, 'html/' || substr(first_hash, 1, 2) || '/' || substr(first_hash, 3, 2) || '/' || first_hash || '.html'
        AS first_path FROM (
      SELECT {HOST.format("dst")} AS host, count(DISTINCT dst) AS n_urls, count(*) AS n_links,
        min(sha256(dst)) AS first_hash
      FROM edges WHERE dst NOT IN (SELECT url FROM pages) GROUP BY 1)""",
}
