"""Counters over event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from crawlkit.functions.times import with_watermark


def metrics_stream(
    log: DataFrame, window: str = "5 seconds", slide: str | None = None, watermark: str = "1 minute"
) -> DataFrame:
    """Fetches per window, domain and status; rows later than the watermark are dropped."""
    return (
        with_watermark(log, watermark)
        .groupBy(F.window("ts", window, slide or window).alias("w"), "domain", "status")
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "domain", "status", "n")
    )


def sliding_metrics_stream(
    log: DataFrame, period: str = "5 minutes", step: str = "5 seconds", watermark: str = "1 minute"
) -> DataFrame:
    """Fetches per sliding window, domain and status, as two chained aggregations.

    The first counts panes one ``step`` wide, so a fetch is one row of one pane; only the
    pane counts enter every window that covers them. ``period`` must be a multiple of
    ``step``. A window comes out once the watermark has passed its end, with all its panes.
    Rows without a time count nowhere. The same call on a table counts all its windows.
    """
    panes = (
        with_watermark(log, watermark)
        .groupBy(F.window("ts", step).alias("pane"), "domain", "status")
        .agg(F.count("*").alias("n"))
    )
    return (
        panes.groupBy(F.window("pane", period, step).alias("w"), "domain", "status")
        .agg(F.sum("n").alias("n"))
        .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "domain", "status", "n")
    )


def late_groups(query: StreamingQuery) -> int:
    """Groups (pane, domain, status) that came too late, over the micro-batches still on record.

    Rows of a micro-batch are counted per group before the watermark is applied to them, so
    late rows of one group count once. The session keeps ``numRecentProgressUpdates`` batches.
    """
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
