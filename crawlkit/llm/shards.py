"""Two-pass external shuffle of a table into shards.

Pass one scatters rows into memory-sized buckets by a seeded hash of the row's place in
the input, so equal rows, equal ids or NULL ids cannot meet in one bucket. Pass two
shuffles each bucket with Fisher-Yates (``F.shuffle`` over the bucket's array) and writes
it. The written buckets, one after another, are a random order of all rows; dealing that
order out in turn gives shards whose row counts differ by one at most (law ``rows``).

The number of buckets follows from the bytes of the input, so a bucket stays as large as
``bucket_bytes`` at every size. The input must be a table or files (rows read again come
in the same order); pass anything else through ``common.written`` first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlkit.llm.common import packed, unpacked, written


def row_size(text: Column) -> Column:
    """UTF-8 bytes of the text (NULL: none) plus 8."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 8


#: Up to so many rows of 16 bytes each are broadcast.
BROADCAST_ROWS = 100_000


def bucket_count(df: DataFrame, text: str, bucket_bytes: int) -> int:
    total = df.agg(F.sum(row_size(F.col(text)))).first()[0] or 0
    return max(1, math.ceil(total / bucket_bytes))


def shuffled_buckets(df: DataFrame, n_buckets: int, seed: int = 0) -> DataFrame:
    """(bucket, pos, row): each bucket in random order, written to the scratch folder."""
    placed = packed(df).withColumn("at", F.monotonically_increasing_id())
    scattered = placed.select(
        F.pmod(F.xxhash64(F.lit(seed), "at"), F.lit(n_buckets)).alias("bucket"), F.struct("at", "row").alias("item")
    )
    # Sorted by place first: the order in which blocks arrive must not change the result.
    whole = scattered.groupBy("bucket").agg(F.array_sort(F.collect_list("item")).alias("items"))
    mixed = whole.select("bucket", F.posexplode(F.shuffle("items", seed)).alias("pos", "item"))
    return written(mixed.select("bucket", "pos", F.col("item.row").alias("row")), "buckets")


def shard(
    df: DataFrame, n_shards: int, text: str = "text", seed: int = 0, bucket_bytes: int = 16 << 20
) -> DataFrame:
    """All rows and columns of ``df`` in random order over ``n_shards``, with ``shard`` and ``slot``.

    Slots count from 0 without gaps inside a shard. NULL texts and ids are ordinary rows,
    repeated rows stay repeated, an empty table gives no rows; columns called ``shard`` or
    ``slot`` are replaced. Columns must be of types that can be ordered.
    """
    n_buckets = bucket_count(df, text, bucket_bytes)
    buckets = shuffled_buckets(df, n_buckets, seed)
    # One row per bucket: total bytes / bucket_bytes rows in this window.
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.groupBy("bucket").count().select(
        "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start")
    )
    if n_buckets <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    placed = buckets.join(starts, "bucket").withColumn("place", F.col("start") + F.col("pos"))
    return unpacked(
        placed,
        shard=F.pmod("place", F.lit(n_shards)).cast("int"),
        slot=F.floor(F.col("place") / n_shards).cast("bigint"),
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order; a large shard is many files, not one task."""
    ordered = sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(path)
