"""Time the headline queries; print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set the run.
Each query is executed in full (noop sink); the best of two runs counts, so that JVM
warm-up is left out.
"""

from __future__ import annotations

import json
import os
import sys
import time

from crawlkit.plans import catalogue
from crawlkit.session import local_session

HEADLINE = [
    "new_links_by_host", "link_edges", "page_titles", "html_store_layout", "dedup_new_urls",
    "dedup_rejected", "frontier_route", "ingest_counters", "seen_cardinality",
    "bloom_false_positive", "rate_limit_first_hit", "rate_limit_aligned", "polite_plan",
    "rolling_success_rate", "fetches_by_domain_status", "top_throttled_domains",
    "latency_summary", "queue_gauges", "attempts", "retention", "reconcile_loss",
    "crawl_depth", "ingest_stream_exact", "metrics_stream", "crawl_stream", "rate_limit_stream",
    "retry_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    requests = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        for _ in range(2):
            began = time.perf_counter()
            catalogue.run(name, spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - began
            times[name] = round(min(took, times.get(name, took)), 3)
    rates = {
        name: {"requests_per_sec": round(requests / times[name])}
        for name in ("dedup_new_urls", "frontier_route", "rate_limit_first_hit", "ingest_stream_exact")
        if name in times
    }
    if "link_edges" in times:
        rates["link_edges"] = {"pages_per_sec": round(pages / times["link_edges"])}
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "rates": rates,
                "sf": sf_dir.rsplit("/sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
