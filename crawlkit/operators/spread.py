"""Ordered per-key computations that no hot key can drag into one task.

A plain ``Window.partitionBy(key)`` sorts all rows of a key in one task. Here the rows
are range-partitioned by (key, order), so a hot key is cut into as many slices as it
fills; each slice is scanned on its own, and the running value of the earlier slices is
added from a table with one row per (key, slice). Slice numbers come from sampled
bounds, so the sliced rows are written once to the shared scratch folder and both
passes read the same table, also after an executor is lost.
Callers give columns that do not start with an underscore.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlkit.session import scratch


def _sliced(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    path = scratch(df.sparkSession, "slices")
    (
        df.repartitionByRange(*[F.col(k) for k in keys], *order)
        .withColumn("_slice", F.spark_partition_id())
        .write.parquet(path)
    )
    return df.sparkSession.read.parquet(path)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    sums: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
) -> DataFrame:
    """Add running totals (row included) and running maxima (row excluded) per key.

    ``order`` must be a total order within a key. Columns of ``maxima`` are NULL on the
    first row of a key. Output keeps all input columns.
    """
    sums, maxima = sums or {}, maxima or {}
    keys = list(keys)
    values = {f"_{n}": c for n, c in (sums | maxima).items()}
    rows = _sliced(df.withColumns(values), keys, order)
    totals = rows.groupBy(*keys, "_slice").agg(
        *[F.sum(f"_{n}").alias(f"_{n}") for n in sums], *[F.max(f"_{n}").alias(f"_{n}") for n in maxima]
    )
    # One row per (key, slice): a key has no more rows here than there are partitions.
    earlier = (
        Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = totals.select(
        *keys,
        "_slice",
        *[F.sum(f"_{n}").over(earlier).alias(f"_{n}") for n in sums],
        *[F.max(f"_{n}").over(earlier).alias(f"_{n}") for n in maxima],
    ).where(F.coalesce(*[F.col(v).cast("string") for v in values]).isNotNull())
    # The value carried into a slice becomes its first row: no join, one shuffle of the rows.
    stacked = rows.withColumn("_is_row", F.lit(1)).unionByName(
        carry.withColumn("_is_row", F.lit(0)), allowMissingColumns=True
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy("_is_row", *order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = stacked.withColumns(
        {n: F.coalesce(F.sum(f"_{n}").over(upto), F.lit(0)) for n in sums}
        | {n: F.max(f"_{n}").over(before) for n in maxima}
    )
    return out.where("_is_row = 1").select(*df.columns, *sums, *maxima)


def ranked(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "rank"
) -> DataFrame:
    """Exact row number per key (from 1) in ``order``, which must be total."""
    return running(df, keys, order, sums={out: F.lit(1).cast("bigint")})


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of each key. The planner limits groups before the shuffle as well."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: Column | int, salt: str, salts: int = 64
) -> DataFrame:
    """First ``n`` rows per key, in two rounds: per (key, salt), then per key.

    The second round sees at most ``salts * n`` rows of a key, whatever the key holds.
    """
    keys = list(keys)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)))
    for group in ([*keys, "_salt"], keys):
        w = Window.partitionBy(*group).orderBy(*order)
        salted = salted.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    return salted.drop("_n", "_salt")
