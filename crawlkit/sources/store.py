"""The page store: raw HTML addressed by the SHA-256 of its URL.

Each write is a batch folder of its own and touches no other, so a failed or repeated
write cannot damage what is stored. A read takes the newest version of each page;
``compact_html_store`` writes those to a new path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crawlkit import schemas
from crawlkit.functions.urls import shard_columns, shard_path, url_hash
from crawlkit.session import forget, materialize

#: Bytes of html from which the tasks of a write get longer hash prefixes.
PREFIX_BYTES = 256 << 20


def latest_pages(pages: DataFrame, key: str = "url", version: str = "version") -> DataFrame:
    """Newest row per key; ``version`` must differ within a key.

    The newest version is found on narrow columns with partial aggregation; the pages
    then join on (key, version), so even a page fetched very often spreads over tasks.
    """
    newest = pages.groupBy(key).agg(F.max(version).alias(version))
    return pages.join(newest, [key, version], "left_semi")


def store_layout(pages: DataFrame) -> DataFrame:
    """Add ``url_hash``, ``shard1``, ``shard2`` and ``path``."""
    hashed = pages.withColumn("url_hash", url_hash(F.col("url")))
    return hashed.withColumns(
        {**shard_columns(F.col("url_hash")), "path": shard_path(F.col("url_hash"))}
    )


def _digits(total: int) -> int:
    """Hex digits of the hash that make prefixes of at most ``PREFIX_BYTES``; 4 at most."""
    digits = 1
    while digits < 4 and total > PREFIX_BYTES * 16**digits:
        digits += 1
    return digits


def _dealt(laid_out: DataFrame, winners: DataFrame, digits: int) -> DataFrame:
    """One row per page, in tasks by hash prefix, sorted by hash. Bodies are shuffled once."""
    several = winners.where("n > 1").select("url_hash", "best")
    # The prefix among the window's keys: the window and the writer keep the prefix's partitioning and order.
    inside = Window.partitionBy("shard1", "prefix", "url_hash").orderBy(F.desc("version"), F.desc("mark"), F.desc("html"))
    return (
        laid_out.join(several, "url_hash", "left")
        .where(F.col("best").isNull() | (F.col("best") == F.struct("version", "mark")))
        .withColumn("prefix", F.substring("url_hash", 1, digits))
        .select("url_hash", "url", "html", "version", "shard1", "prefix", "mark")
        .repartition("prefix")
        .withColumn("n", F.row_number().over(inside))
        .where("n = 1")
        .select("url_hash", "url", "html", "version", "shard1")
    )


def write_html_store(
    pages: DataFrame, path: str, batch: int, digits: int | None = None, run: str = "", replay: bool = False
) -> None:
    """Store ``url, html, version`` rows under ``run=r/batch=n/shard1=ab``, sorted by hash.

    A batch that is there already is an error; only a ``replay`` of it replaces it. Other
    batches and runs are never touched. Of a page's rows the newest version is stored, of
    equal versions the one whose html has the largest hash: one row per page.

    Bodies are shuffled once, by the first ``digits`` hex digits of the hash, which follow
    from the bytes if not given. A narrow table, one row per page, is found before; the pages
    in it that have several rows (few, or few pages with very many) thin the rows out ahead of
    the shuffle, so a page fetched very often fills no task with old versions.
    """
    laid_out = store_layout(pages).withColumns(
        {"version": F.col("version").cast("bigint"), "mark": F.xxhash64("html")}
    )
    winners = materialize(
        laid_out.groupBy("url_hash").agg(
            F.max(F.struct("version", "mark")).alias("best"),
            F.count("*").alias("n"),
            F.sum(F.octet_length("html")).alias("bytes"),
        ),
        "winners",
    )
    if digits is None:
        digits = _digits(winners.agg(F.sum("bytes")).first()[0] or 0)
    (
        _dealt(laid_out, winners, digits)
        .write.mode("overwrite" if replay else "error")
        .partitionBy("shard1")
        .parquet(f"{path}/run={run or 'none'}/batch={batch}")
    )
    forget(winners)


def read_html_store(
    spark: SparkSession, path: str, url: str | None = None, urls: DataFrame | None = None
) -> DataFrame:
    """Stored pages, newest version each; one folder only when ``url`` is given.

    With ``urls`` only the folders of its URLs (256 names at most) and only those pages.
    """
    stored = spark.read.schema(schemas.STORED_PAGE).parquet(path)
    if urls is not None:
        wanted = urls.select(url_hash(F.col("url")).alias("url_hash"))
        folders = wanted.select(F.substring("url_hash", 1, 2).alias("f")).distinct().collect()
        stored = stored.where(F.col("shard1").isin(*[r.f for r in folders] or [""]))
        stored = stored.join(wanted.distinct(), "url_hash", "left_semi")
    if url is not None:
        hashed = url_hash(F.lit(url))
        stored = stored.where(
            (F.col("shard1") == F.substring(hashed, 1, 2)) & (F.col("url_hash") == hashed)
        )
    newest = latest_pages(stored.withColumn("at", F.struct("version", "run", "batch")), "url_hash", "at")
    return newest.drop("at", "run", "batch", "shard1")


def compact_html_store(spark: SparkSession, path: str, target: str, digits: int | None = None) -> None:
    """Write the newest version of every page to a new store."""
    write_html_store(read_html_store(spark, path), target, 0, digits)
