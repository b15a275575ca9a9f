"""Admission, deduplication and routing of URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlkit.functions.urls import canonicalize
from crawlkit.operators.spread import first_per_key, ranked

# Answers of the ingest endpoint.
ACCEPTED = (202, "queued")
REFUSED = (400, "URL is required")


def admit(requests: DataFrame) -> DataFrame:
    """Answer each request: no URL is refused, anything else (even a space) is queued."""
    refused = F.coalesce(F.col("url"), F.lit("")) == ""
    return requests.withColumns(
        {
            "status": F.when(refused, REFUSED[0]).otherwise(ACCEPTED[0]),
            "reply": F.when(refused, REFUSED[1]).otherwise(ACCEPTED[1]),
        }
    )


def accepted(requests: DataFrame) -> DataFrame:
    return requests.where(F.coalesce(F.col("url"), F.lit("")) != "")


def new_urls(
    candidates: DataFrame, seen: DataFrame, ts: str = "ts", id: str = "id", canonical: bool = False
) -> DataFrame:
    """Candidates whose URL is not in ``seen``; the first occurrence of a URL wins.

    The raw string is the key. ``canonical=True`` compares normal forms instead.
    """
    if canonical:
        candidates = canonicalize(candidates).where("url is not null")
    firsts = first_per_key(candidates, ["url"], [F.col(ts), F.col(id)])
    return firsts.join(seen.select("url"), "url", "left_anti")


def duplicate_urls(
    candidates: DataFrame, seen: DataFrame, ts: str = "ts", id: str = "id"
) -> DataFrame:
    """The complement of ``new_urls``. Joined on the unique id, so no URL is hot."""
    return candidates.join(new_urls(candidates, seen, ts, id).select(id), id, "left_anti")


def distinct_urls(df: DataFrame) -> DataFrame:
    return df.select("url").dropDuplicates(["url"])


def seen_result(
    candidates: DataFrame, seen: DataFrame, available: str, ts: str = "ts", id: str = "id"
) -> DataFrame:
    """Add ``seen_result``: 1 new, 0 seen before, -1 where the look-up gave no answer.

    Rows without an answer (``available`` false or NULL) do not mark their URL as seen.
    """
    answered = F.coalesce(F.col(available), F.lit(False))
    asked = candidates.where(answered)
    fresh = new_urls(asked.select("url", ts, id), seen, ts, id).select(id, F.lit(1).alias("_new"))
    return candidates.join(fresh, id, "left").withColumn(
        "seen_result", F.when(~answered, -1).otherwise(F.coalesce("_new", F.lit(0)))
    ).drop("_new")


def route_seen(df: DataFrame) -> DataFrame:
    """1 goes to the fetch queue, 0 is rejected, anything else is retried."""
    return df.withColumn(
        "route",
        F.when(F.col("seen_result") == 1, "fetch")
        .when(F.col("seen_result") == 0, "reject")
        .otherwise("retry"),
    )


def ingest_counters(routed: DataFrame) -> DataFrame:
    return routed.agg(
        F.count_if(F.col("route") == "fetch").alias("urls_ingested"),
        F.count_if(F.col("route") == "reject").alias("urls_rejected"),
    )


def classify_outcome(df: DataFrame) -> DataFrame:
    """A throttled attempt (no points left) is not a failed fetch."""
    return df.withColumn(
        "status",
        F.when(F.col("remaining_points") == 0, "rate_limited")
        .when(F.col("error").isNotNull(), "failed")
        .otherwise("success"),
    )


def fetch_join(frontier: DataFrame, pages: DataFrame) -> DataFrame:
    """Put the page body next to each frontier URL; a missing page is a failed fetch.

    Of several versions of a page the newest counts (of equal or unnumbered ones the
    largest body), so a URL stays one row. Bodies are shuffled once, by URL.
    """
    newest = F.struct("version", "html") if "version" in pages.columns else F.struct("html")
    body = pages.groupBy("url").agg(F.max(newest).alias("page")).select("url", F.col("page.html").alias("html"))
    return frontier.join(body, "url", "left").withColumn(
        "status", F.when(F.col("html").isNull(), "failed").otherwise("success")
    )


def frontier_union(**producers: DataFrame) -> DataFrame:
    """All producers write one queue; the producer name is kept, nothing is removed."""
    tagged = [df.withColumn("producer", F.lit(name)) for name, df in producers.items()]
    union = tagged[0]
    for df in tagged[1:]:
        union = union.unionByName(df)
    return union


def priority_order(frontier: DataFrame, score: str, ts: str = "ts", id: str = "id") -> DataFrame:
    """Highest score first, then first come first served; ``position`` counts from 1."""
    return ranked(frontier, [], [F.desc(score), F.col(ts), F.col(id)], "position")


def eligible_urls(frontier: DataFrame, domain_state: DataFrame, now, delay_us: int) -> DataFrame:
    """URLs of domains whose last fetch lies at least ``delay_us`` before ``now``.

    Domains are decided first, one row each; only then are they joined to their URLs.
    ``domain_state`` holds ``domain, last_us``; a domain without a row is eligible.
    """
    blocked = domain_state.where(F.col("last_us") + delay_us > now).select("domain")
    return frontier.join(blocked, "domain", "left_anti")
