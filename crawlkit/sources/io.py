"""Requests, seeds, pages, logs and metrics in and out of storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlkit import schemas
from crawlkit.functions.urls import form_url, request_url, url_hash


def read_requests(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """JSON-lines requests as a table, or as a stream of new files.

    ``id``, which the operators go by, is the ``request_id`` as written.
    """
    reader = spark.readStream if stream else spark.read
    return reader.schema(schemas.REQUEST).json(path).withColumn("id", F.col("request_id"))


def parse_bodies(df: DataFrame, body: str = "body", form: bool = False) -> DataFrame:
    """Add ``url`` from a JSON or urlencoded request body, such as a queue message value."""
    return df.withColumn("url", form_url(F.col(body)) if form else request_url(F.col(body)))


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """One URL per line; blank lines are skipped."""
    return spark.read.text(path).select(F.trim("value").alias("url")).where("url <> ''")


def seed_frontier(seeds: DataFrame, ts: Column) -> DataFrame:
    """Seed URLs as ingest rows (``id, ts, url``), for one append; the id follows from the URL."""
    return seeds.select(F.concat(F.lit("seed#"), url_hash(F.col("url"))).alias("id"), ts.alias("ts"), "url")


def append_ingest(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Already fetched pages: ``page_id, url, html``."""
    return spark.read.schema(schemas.PAGE).parquet(path)


def read_crawl_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """JSON log lines as a table, or as a stream of new files; see ``parse_crawl_log``."""
    reader = spark.readStream if stream else spark.read
    return parse_crawl_log(reader.text(path).where(F.trim("value") != ""))


def parse_crawl_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """The known fields of JSON log lines, and all others in ``rest VARIANT``.

    A known field whose value does not fit its type is NULL and stays in ``rest`` as written.
    ``rest`` is an empty object if nothing is left over. A line that is no JSON object, or
    names a field twice, is kept whole in ``_corrupt_record``; its other columns are NULL.
    """
    *known, (corrupt, _) = [field.split() for field in schemas.LOG.split(",")]
    parsed = lines.select(F.col(column).alias("line"), F.try_parse_json(column).alias("v"))
    fields = F.try_variant_get("v", "$", "map<string,variant>")

    def left_over(name, value):
        unfit = F.lit(False)
        for kind in sorted({kind for _, kind in known}):
            named = name.isin(*[n for n, k in known if k == kind])
            unfit = unfit | (named & F.try_variant_get(value, "$", kind).isNull())
        return ~name.isin(*[n for n, _ in known]) | (unfit & ~F.is_variant_null(value))

    return parsed.select(
        *[F.try_variant_get("v", f"$.{name}", kind).alias(name) for name, kind in known],
        F.when(fields.isNull(), F.col("line")).alias(corrupt),
        F.to_variant_object(F.map_filter(fields, left_over)).alias("rest"),
    )


def write_metrics(df: DataFrame, path: str) -> None:
    """Append ``(ts, metric, labels, value)`` rows, one folder per metric; a long series is many files by time."""
    df.repartitionByRange("metric", "ts").write.mode("append").partitionBy("metric").parquet(path)
