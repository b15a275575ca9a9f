"""Epoch arithmetic on timestamps with or without a zone.

Zone-free timestamps are read as UTC; ``session.prepare`` pins the session zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def floor_to(value: Column, width: int) -> Column:
    """Largest multiple of ``width`` not above an integer ``value``."""
    return value - F.pmod(value, F.lit(width))


def with_watermark(df: DataFrame, delay: str, ts: str = "ts") -> DataFrame:
    """A watermark needs a timestamp with a zone."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
