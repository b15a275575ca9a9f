"""Literal cases: input and hand-written expected output."""

import pytest
from pyspark.sql import functions as F

from crawlkit.functions import html, retry, urls

BASE = "https://Ex.com:443/a/b?q=1#f"
RESOLVED = [
    ("/x", "https://ex.com/x"),
    ("c", "https://ex.com/a/c"),
    ("../c/./d", "https://ex.com/c/d"),
    ("/a/b/..", "https://ex.com/a/"),
    ("../../../c", "https://ex.com/c"),
    (".", "https://ex.com/a/"),
    ("?z=2", "https://ex.com/a/b?z=2"),
    ("#top", "https://ex.com/a/b?q=1#top"),
    ("//H.org", "https://h.org/"),
    ("\\\\h.org\\x", "https://h.org/x"),
    ("HTTP://H.org:80/P", "http://h.org/P"),
    ("http://h.org:8080", "http://h.org:8080/"),
    ("http://u:p@H/x?", "http://u:p@h/x?"),
    ("https:c", "https://ex.com/a/c"),
    ("http:c", "http://c/"),
    (" /s\tp ", "https://ex.com/sp"),
    ("/für x", "https://ex.com/f%C3%BCr%20x"),
    ("/é#ü", "https://ex.com/%C3%A9#%C3%BC"),
    ("/😀", "https://ex.com/%F0%9F%98%80"),
    ("/a%2fb", "https://ex.com/a%2fb"),
    ("/q?a=b c'd", "https://ex.com/q?a=b%20c%27d"),
    ("http://h/%2e%2E/x/.", "http://h/x/"),
    ("mailto:a@b.c", None),
    ("javascript:void(0)", None),
    ("ftp://h/x", None),
    ("http://[bad", None),
    ("http://h:99999/", None),
    ("http://256.1.1.1/", None),
    ("http://a b/", None),
]
HOSTS = [
    ("https://Docs.Ex.com:8080/x", "docs.ex.com"),
    ("http://u:p@h_1.com/a b|c", "h_1.com"),
    ("https://[2001:DB8::1]:443/", "[2001:db8::1]"),
    ("http://1.2.3.4?x", "1.2.3.4"),
    ("HTTPS:\\\\H.org\\p", "h.org"),
    ("http:///x", "x"),
    ("https://", None),
    ("http://300.1.1.1/", None),
    ("/relative", None),
    ("mailto:a@b.c", None),
    (None, None),
]
PAGES = [
    ("<A HREF=/p>x</A><a href='/q'>", ["/p", "/q"], "Untitled Document"),
    ('<!-- <a href="/n"> --><a href="/y">', ["/y"], "Untitled Document"),
    ('<!-- open <a href="/n">', [], "Untitled Document"),
    (
        """<script>"<a href='/n'>"</script><a href="/y?a=1&amp;b=2">""",
        ["/y?a=1&b=2"],
        "Untitled Document",
    ),
    ('<a name="t"><a href=""><a href="/d"><a href="/d">', ["/d", "/d"], "Untitled Document"),
    ('<abbr href="/n"><a data-href="/n">', [], "Untitled Document"),
    ("""<img alt="<a href='/n'>"><a title=x=y href="/z" href="/no">""", ["/z"], "Untitled Document"),
    ('<a href="" href="/x"><a href><a/href=/s>', ["/s"], "Untitled Document"),
    ('<a x="1"href="/k?a=1&copy=2&copy;">', ["/k?a=1&copy=2©"], "Untitled Document"),
    ("<title> A &amp; B </title>", [], "A & B"),
    ("<title>  </title>", [], "Untitled Document"),
    ("<title> a&#x41;&#66;&eacute;</title><svg><title>b</title></svg>", [], "aABéb"),
    ("<title>x<a href='/n'></title>", [], "x<a href='/n'>"),
    ("<title>&#0;&#x110000;&nosuch;</title>", [], "��&nosuch;"),
    (None, None, "Untitled Document"),
]


def test_resolve(spark):
    df = spark.createDataFrame([(h, BASE) for h, _ in RESOLVED], "href STRING, url STRING")
    out = urls.resolve_url(df).withColumn(
        "kept", F.when(urls.http_only(F.col("resolved")), F.col("resolved"))
    )
    assert {r.href: r.kept for r in out.collect()} == dict(RESOLVED)


def test_resolve_needs_a_valid_base(spark):
    df = spark.createDataFrame([("/x", "no url"), ("http://h/", None)], "href STRING, url STRING")
    assert [r.resolved for r in urls.resolve_url(df).collect()] == [None, None]


def test_host_and_validity(spark):
    df = spark.createDataFrame([(u,) for u, _ in HOSTS], "url STRING")
    out = df.select("url", urls.url_host(F.col("url")).alias("h"), urls.valid_url(F.col("url")).alias("v"))
    rows = {r.url: r for r in out.collect()}
    assert {u: rows[u].h for u, _ in HOSTS} == dict(HOSTS)
    assert rows["mailto:a@b.c"].v and not rows["/relative"].v and rows[None].v is False


def test_punycode(spark):
    df = spark.createDataFrame([("bücher.de",), ("ex.com",), (None,)], "h STRING")
    got = [r[0] for r in df.select(urls.punycode_host("h")).collect()]
    assert got == ["xn--bcher-kva.de", "ex.com", None]


def test_pages(spark):
    df = spark.createDataFrame([(h,) for h, _, _ in PAGES], "html STRING")
    out = df.select(
        "html",
        html.extract_hrefs(F.col("html")).alias("links"),
        html.page_title(F.col("html")).alias("title"),
    )
    got = {r.html: (r.links, r.title) for r in out.collect()}
    assert got == {h: (links, title) for h, links, title in PAGES}


def test_hostile_page_does_not_overflow_the_matcher(spark):
    page = "<a " + "x='1' y=2 \" " * 20000 + "<b>" + "<" * 20000 + "<!--" * 20000
    df = spark.createDataFrame([(page,), ('<a href="/ok">' * 5000,)], "html STRING")
    sizes = [len(r[0]) for r in df.select(html.extract_hrefs(F.col("html"))).collect()]
    assert sizes == [0, 5000]


def test_content_address(spark):
    digest = "100680ad546ce6a577f42f52df33b4cfdca756859e664b8d7de329b150d09ce9"
    row = spark.range(1).select(
        urls.url_hash(F.lit("https://example.com")).alias("h"),
        urls.shard_path(urls.url_hash(F.lit("https://example.com"))).alias("p"),
        urls.rate_key(F.lit("h")).alias("k"),
        urls.request_json(F.lit("http://h/")).alias("j"),
    ).first()
    assert row.h == digest and row.p == f"html/10/06/{digest}.html"
    assert row.k == "ratelimit:domain:h" and row.j == '{"url":"http://h/"}'


@pytest.mark.parametrize(
    "error, attempt, delay",
    [("DomainRateLimitError", 7, 1000), ("other", 1, 2000), ("other", 4, 16000),
     ("other", 5, 30000), ("other", 24, 30000), ("other", 25, None)],
)
def test_fetch_backoff(spark, error, attempt, delay):
    wait = retry.fetch_backoff_ms(F.lit(error), F.lit(attempt))
    assert spark.range(1).select(wait).first()[0] == delay


def test_ingest_backoff(spark):
    waits = spark.range(0, 7).select(retry.ingest_backoff_ms(F.col("id")))
    assert [r[0] for r in waits.collect()] == [None, 2000, 4000, 8000, 16000, None, None]


def test_error_class(spark):
    rows = [("dns", None, "h"), (None, 503, "u"), (None, 404, "u"), (None, 418, "odd")]
    df = spark.createDataFrame(rows, "kind STRING, status INT, detail STRING")
    out = df.select(retry.error_class(F.col("kind"), F.col("status"), F.col("detail")).alias("e"))
    assert [(r.e.name, r.e.status_code, r.e.message) for r in out.collect()] == [
        ("DnsResolutionError", 502, "Failed to resolve hostname: h"),
        ("Http5xxError", 503, "Server error (503) while fetching u"),
        ("Http404Error", 404, "Page not found: u"),
        ("AppError", 500, "odd"),
    ]


def test_tags_that_never_close_are_read_once(spark):
    import time

    page = "<a x " * 200_000
    df = spark.createDataFrame([(page,), ('<a href="/in"><a href="/out',)], "html STRING")
    began = time.time()
    found = df.select(html.extract_hrefs(F.col("html")).alias("links"), html.page_title(F.col("html")).alias("title")).collect()
    assert [r.links for r in found] == [[], ["/in"]] and time.time() - began < 10


# Written host, and what a browser makes of it.
FORMS = [
    ("127.1", "127.0.0.1"), ("0x7f000001", "127.0.0.1"), ("017700000001", "127.0.0.1"), ("2130706433", "127.0.0.1"),
    ("1.2.3", "1.2.0.3"), ("0x.0x0.0", "0.0.0.0"), ("1.2.3.4.", "1.2.3.4"), ("4294967295", "255.255.255.255"),
    ("4294967296", None), ("1.2.3.256", None), ("1.256.3.4", None), ("1.2.3.4.5", None), ("08", None), ("a.0x", None),
    ("1..2", None), ("0xffffffffff", None), ("99999999999999999999", None), ("256.1", None), ("255.16777215", "255.255.255.255"),
    ("%65x.com", "ex.com"), ("%45X.com", "ex.com"), ("e%2fx.com", None), ("e%zz.com", None), ("a+b.com", "a+b.com"), ("%31", "0.0.0.1"),
    ("a%20b.com", None), ("h1", "h1"),
]


def test_hosts_as_numbers_and_with_escapes(spark):
    df = spark.createDataFrame([(i, f"http://{h}:8080/") for i, (h, _) in enumerate(FORMS)], "i INT, url STRING")
    got = {r.i: r.h for r in df.select("i", urls.url_host(F.col("url")).alias("h")).collect()}
    assert {FORMS[i][0]: h for i, h in got.items()} == dict(FORMS)
