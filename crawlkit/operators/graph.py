"""The link graph: extraction, closure over it, and its statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlkit.functions.bind import let
from crawlkit.functions.html import extract_hrefs
from crawlkit.functions.urls import base_parts, http_only, resolve
from crawlkit.session import forget, materialize, scratch
from crawlkit.sources import keyed
from crawlkit.sources.files import size

#: Parts over which the edges of one hash prefix are dealt.
SPREAD = 16
#: Bytes of edges and visited URLs up to which a round reads them whole: asking what to leave out costs more.
WHOLE = 64 << 20


def page_links(
    pages: DataFrame,
    url: str = "url",
    html: str = "html",
    only_http: bool = False,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``(url, pos, href, resolved)`` of every non-empty link, in document order.

    ``keep`` names further page columns to carry along.

    Links are resolved inside the array: the page URL is parsed once per page, and links
    that are not kept never become rows. The outer inline plus a NULL filter stops the
    optimizer from adding a ``size(links) > 0`` test that would parse each page twice.
    """

    def resolve_all(base):
        links = F.transform(
            extract_hrefs(F.col(html)),
            lambda href, pos: F.struct(
                pos.alias("pos"), href.alias("href"), resolve(href, base).alias("resolved")
            ),
        )
        return F.filter(links, lambda link: http_only(link["resolved"])) if only_http else links

    links = let(base_parts(F.col(url)), resolve_all)
    return pages.select(F.col(url).alias("url"), *keep, F.inline_outer(links)).where(
        "pos is not null"
    )


def build_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(src, dst, pos)`` for every link that resolves to http or https."""
    return page_links(pages, url, html, only_http=True).select(
        F.col("url").alias("src"), F.col("resolved").alias("dst"), "pos"
    )


def crawl_closure(seeds: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``(url, depth)`` for every URL reachable from the seeds; depth of first discovery.

    The edges are written once as a key table by the hash of ``src``, a hub's edges over
    several files; the visited URLs are another one, a span per round. A round reads the
    hash prefixes of its own frontier from both, so late, narrow rounds touch little of
    them. Both lie in the shared scratch folder: the plan does not grow, pages are parsed
    once, and a lost executor costs one stage.
    """
    spark = seeds.sparkSession
    home = scratch(spark, "closure")
    links = keyed.keyed(edges.where("src <> dst"), F.col("src")).select("h", "dst").distinct()
    keyed.load(links, f"{home}/edges", "all", spread=[F.pmod(F.xxhash64("dst"), F.lit(SPREAD))])

    visited, values = f"{home}/visited", "url STRING, depth INT"
    found = keyed.keyed(seeds.select("url").where("url is not null").distinct(), F.col("url"))
    depth = 0
    while True:
        found = found.select("h", "url", F.lit(depth).alias("depth"))
        # Seeds may be many; what later rounds find is bounded by the edges.
        whole = depth > 0 and size(spark, home) <= WHOLE
        if whole:
            keyed.write(found.join(keyed.read(spark, visited, ""), "h", "left_anti"), visited, "all", depth)
        else:
            found = materialize(found, "found")
            fresh = found.join(keyed.candidates(found, visited), "h", "left_anti")
            bytes_found = size(spark, found.inputFiles()[0].rsplit("/", 1)[0])
            keyed.write(fresh, visited, "all", depth, total=bytes_found)
            forget(found)
        frontier = keyed.read_batch(spark, visited, values, "all", depth)
        if frontier is None or depth == max_depth:
            return keyed.read(spark, visited, values).select("url", "depth")
        near = (
            keyed.read(spark, f"{home}/edges", "dst STRING")
            if whole
            else keyed.candidates(frontier, f"{home}/edges", "dst STRING")
        )
        targets = near.join(frontier.select("h"), "h", "left_semi").select(F.col("dst").alias("url")).distinct()
        found = keyed.keyed(targets, F.col("url"))
        depth += 1
        # Merges the rounds before the frontier's.
        keyed.compact(spark, visited, values, "all", depth - 1)


def closure_growth(depths: DataFrame) -> DataFrame:
    """New and cumulative URLs per round. The running sum sees one row per round."""
    rounds = depths.groupBy("depth").agg(F.count("*").alias("new_urls"))
    upto = Window.orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rounds.withColumn("seen_urls", F.sum("new_urls").over(upto))


def out_degree(edges: DataFrame) -> DataFrame:
    """Links and distinct targets per page.

    Pre-aggregated by (src, dst): a page that holds a third of all links is counted by
    many tasks before its one total is formed.
    """
    return (
        edges.groupBy("src", "dst")
        .agg(F.count("*").alias("n"))
        .groupBy("src")
        .agg(F.sum("n").alias("n_links"), F.count("*").alias("n_targets"))
    )


def in_degree(edges: DataFrame) -> DataFrame:
    return (
        edges.groupBy("dst", "src")
        .agg(F.count("*").alias("n"))
        .groupBy("dst")
        .agg(F.sum("n").alias("n_inbound"), F.count("*").alias("n_sources"))
    )


def top_hubs(edges: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` pages with most outbound links, ties by URL."""
    return (
        edges.groupBy("src")
        .agg(F.count("*").alias("n_links"))
        .orderBy(F.desc("n_links"), "src")
        .limit(k)
    )
