"""Daily sketches that answer for any span of days without the rows.

A day is one row of mergeable sketches: distinct URLs (HyperLogLog), latencies (KLL) and the
most throttled domains (frequent items). A month is 30 rows merged, whatever the traffic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Log2 of the registers, size of the quantile sketch, and counters kept for heavy hitters.
REGISTERS, QUANTILES, COUNTERS = 14, 400, 1024


def daily(rows: DataFrame, key: str, value: str, ts: str = "ts") -> DataFrame:
    """``day, n, distinct_sketch, value_sketch`` (BINARY): one pass, merged before the shuffle."""
    return rows.groupBy(F.to_date(ts).alias("day")).agg(
        F.count("*").alias("n"),
        F.hll_sketch_agg(key, REGISTERS).alias("distinct_sketch"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), QUANTILES).alias("value_sketch"),
    )


def rollup(sketches: DataFrame, every: str = "month", shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Distinct keys and quantiles per period, from the daily rows alone."""
    merged = sketches.groupBy(F.date_trunc(every, "day").cast("date").alias("period")).agg(
        F.sum("n").alias("n"),
        F.hll_union_agg("distinct_sketch").alias("d"),
        F.kll_merge_agg_double("value_sketch").alias("q"),
    )
    marks = [F.kll_sketch_get_quantile_double("q", F.lit(s)).alias(f"p{round(100 * s)}") for s in shares]
    return merged.select("period", "n", F.hll_sketch_estimate("d").alias("n_distinct"), *marks)


def heavy_sketches(rows: DataFrame, key: str, ts: str = "ts", counters: int = COUNTERS) -> DataFrame:
    """``day, heavy``: a day's frequent items with ``counters`` counters."""
    return rows.groupBy(F.to_date(ts).alias("day")).agg(F.call_function("approx_top_k_accumulate", F.col(key), F.lit(counters)).alias("heavy"))


def heavy_hitters(sketches: DataFrame, k: int = 10, counters: int = COUNTERS) -> DataFrame:
    """``item, n``: the ``k`` most frequent items over all days, from their sketches.

    Counts are upper bounds that are off by at most the number of rows over 0.375 times
    ``counters``, and exact while there are fewer items than three quarters of ``counters``.
    """
    merged = sketches.agg(F.call_function("approx_top_k_combine", F.col("heavy"), F.lit(counters)).alias("heavy"))
    top = F.call_function("approx_top_k_estimate", F.col("heavy"), F.lit(k))
    return merged.select(F.inline(top)).select("item", F.col("count").alias("n"))
