"""Crawl tables derived from the driver tables.

Each method is one view; the SQL twin of each is in ``oracles``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlkit.functions.times import micros
from crawlkit.functions.urls import url_host
from crawlkit.operators import frontier, graph
from crawlkit.session import prepare
from crawlkit.sources.files import is_folder

# Request template and id range of the load test, queue names.
RESOURCE = "https://docs.developer.com/api/v1/resource/"
RESOURCES = 20000
INGEST_QUEUE, FETCH_QUEUE = "queue-urls-ingestion", "queue-urls-fetch"
EPOCH = "2024-01-01 00:00:00"


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = prepare(spark)
        self.dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def stream(self, name: str) -> DataFrame:
        """The same table, one file or a folder of files, as a stream of files."""
        path = f"{self.dir}/{name}.parquet"
        source = self.spark.readStream.schema(self.table(name).schema)
        if is_folder(self.spark, path):
            return source.parquet(path)
        return source.option("pathGlobFilter", f"{name}.parquet").parquet(self.dir)

    def streaming(self, *names: str) -> Views:
        """These views with the named tables read as streams."""
        views = Views(self.spark, self.dir)
        views.table = lambda name: self.stream(name) if name in names else self.table(name)
        return views

    def pages(self) -> DataFrame:
        return self.table("pages")

    def requests(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("bigint")
        resource = F.pmod(k * 200 + F.col("user_id"), F.lit(RESOURCES)).cast("string")
        return self.table("events").select(
            F.col("event_id").alias("id"),
            "ts",
            F.col("user_id").alias("client"),
            F.when(F.col("event_id") % 97 != 0, F.concat(F.lit(RESOURCE), resource)).alias("url"),
            "value",
        )

    def accepted(self) -> DataFrame:
        return frontier.accepted(self.requests())

    def seen(self) -> DataFrame:
        return self.requests().where("md5(url) < '8'").select("url").distinct()

    def fetch_attempts(self) -> DataFrame:
        kind = F.col("event_type")
        return self.table("events").select(
            "event_id",
            "ts",
            F.concat(F.lit("d"), (F.col("user_id") % 20).cast("string"), F.lit(".example.com")).alias(
                "domain"
            ),
            F.when(kind == "signup", 0).otherwise(1).alias("remaining_points"),
            F.when(kind == "error", "fetch failed").alias("error"),
            F.col("value").alias("latency_ms"),
        )

    def fetch_log(self) -> DataFrame:
        return frontier.classify_outcome(self.fetch_attempts()).drop("remaining_points", "error")

    def jobs(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("job_id"),
            F.when(F.col("o_custkey") % 2 == 0, INGEST_QUEUE).otherwise(FETCH_QUEUE).alias("queue"),
            F.when(F.col("o_orderstatus") == "F", "completed")
            .when(F.col("o_orderstatus") == "O", "waiting")
            .when(F.col("o_orderstatus") == "P", "failed")
            .alias("state"),
            F.col("o_orderdate").alias("ts"),
        )

    def job_events(self) -> DataFrame:
        """One row per attempt; R is throttled, A timed out, N went well."""
        flag = F.col("l_returnflag")
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("job_id"),
            F.col("l_shipdate").alias("ts"),
            # Line, part and supplier in one number: lines of one job share dates.
            (
                F.col("l_linenumber") * F.lit(10**15)
                + F.col("l_partkey") * F.lit(10**7)
                + F.col("l_suppkey")
            ).alias("seq"),
            F.when(flag == "R", "DomainRateLimitError")
            .when(flag == "A", "ConnectionTimeoutError")
            .alias("error"),
            F.when(flag == "R", "delayed")
            .when(flag == "A", "failed")
            .when(F.col("l_linestatus") == "O", "active")
            .otherwise("completed")
            .alias("state"),
        )

    def edges(self) -> DataFrame:
        return graph.build_edges(self.pages())

    def graph_edges(self) -> DataFrame:
        """Edges with each target mapped onto a page: raw links never hit one."""
        n = self.pages().agg(F.count("*").alias("n")).scalar()
        number = F.conv(F.substring(F.md5("dst"), 1, 7), 16, 10).cast("bigint")
        pages = self.pages().select(F.col("page_id"), F.col("url").alias("target"))
        mapped = self.edges().withColumn("page_id", F.pmod(number, n))
        return mapped.join(pages, "page_id").select("src", F.col("target").alias("dst"))

    def linked_pages(self) -> DataFrame:
        """Pages with links to other pages written behind their own, so that a crawl gets on."""
        anchor = F.concat(F.lit('<a href="'), F.replace("dst", F.lit("&"), F.lit("&amp;")), F.lit('">next</a>'))
        more = self.graph_edges().groupBy(F.col("src").alias("url")).agg(F.array_join(F.array_sort(F.collect_set(anchor)), "").alias("more"))
        whole = F.concat("html", F.coalesce("more", F.lit("")))
        return self.pages().join(more, "url", "left").select("url", whole.alias("html"))

    def crawl_seeds(self) -> DataFrame:
        """Every 25th page, and as many lines that are no URL."""
        pages = self.pages().where("page_id % 25 = 0")
        both = F.explode(F.array("url", F.concat(F.lit("no url "), F.col("page_id").cast("string"))))
        return pages.select(F.col("page_id").cast("string").alias("id"), self._page_time(F.col("page_id")).alias("ts"), both.alias("url"))

    def graph_seeds(self) -> DataFrame:
        return self.pages().where("page_id % 25 = 0").select("url")

    def _page_time(self, page_id):
        return F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(mins=page_id)

    def queue(self) -> DataFrame:
        """All three producers of the ingest queue, with the host of each URL."""
        pages = self.pages().select("page_id", "url")
        seeds = pages.where("page_id % 25 = 0").select(
            "url", self._page_time(F.col("page_id")).alias("ts"), F.lit(0).cast("bigint").alias("id")
        )
        links = graph.page_links(self.pages(), only_http=True, keep=("page_id",))
        discovered = links.select(
            F.col("resolved").alias("url"),
            self._page_time(F.col("page_id")).alias("ts"),
            (F.col("pos") + 1).cast("bigint").alias("id"),
        )
        requests = self.accepted().select("url", "ts", "id")
        union = frontier.frontier_union(seeds=seeds, requests=requests, discovered=discovered)
        return union.withColumn("host", url_host(F.col("url")))

    def transitions(self) -> DataFrame:
        """Jobs wait from their order date to the first attempt, and run to the last one."""
        spans = self.job_events().groupBy("job_id").agg(
            F.min("ts").alias("first"), F.max("ts").alias("last")
        )
        moves = self.jobs().join(spans, "job_id")

        def move(gauge, ts, delta):
            return F.struct(
                F.lit(gauge).alias("gauge"),
                micros(F.col(ts)).alias("us"),
                F.lit(delta).cast("bigint").alias("delta"),
            )

        return moves.select(
            "queue",
            F.inline(
                F.array(
                    move("waiting", "ts", 1),
                    move("waiting", "first", -1),
                    move("active", "first", 1),
                    move("active", "last", -1),
                )
            ),
        )

    def failures(self) -> DataFrame:
        """Failed fetches with a cause read off the event payload."""
        k = F.get_json_object("props", "$.k").cast("int")
        return (
            self.table("events")
            .where("event_type = 'error'")
            .select(
                "event_id",
                F.when(k >= 90, "domain_limit")
                .when(k >= 80, "dns")
                .when(k >= 70, "timeout")
                .when(k >= 60, "content_type")
                .when(k >= 50, "too_large")
                .when(k >= 40, "storage")
                .alias("kind"),
                F.when(k < 10, 429).when(k < 20, 404).when(k < 30, 500 + k % 5).alias("http_status"),
                F.concat(F.lit("item "), F.col("user_id").cast("string")).alias("detail"),
            )
        )
