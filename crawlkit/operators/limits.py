"""Per-key rate limits and polite fetch plans.

Times are whole milliseconds since the epoch, the clock unit of the limiter; ties are
broken by timestamp, then id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlkit.functions.times import floor_to, from_micros, micros, millis
from crawlkit.operators.spread import ranked, running

# Limiter defaults.
DOMAIN_POINTS, DOMAIN_DURATION_MS = 5, 1000
CLIENT_POINTS, CLIENT_DURATION_MS = 100, 60_000

HOUR_MS = 3_600_000


def rate_limit(
    df: DataFrame,
    key: str,
    ts: str = "ts",
    id: str = "id",
    points: int = DOMAIN_POINTS,
    duration_ms: int = DOMAIN_DURATION_MS,
) -> DataFrame:
    """Fixed windows that open at the first hit of a key.

    Hits 1..points of a window pass; later ones are rejected with ``ms_before_next`` and
    do not extend it. The next window opens at the first hit at or after the end. Adds
    ``window_start_ms``, ``hit``, ``allowed``, ``ms_before_next``; keyless rows pass.

    A window start depends on the one before it, so a key looks sequential. It is cut
    into time slices of at least two durations. Only hits in the first duration of a
    slice (or its first later hit) can open the slice's first window, so each slice is
    reduced, in parallel, to a step function: first opening -> end of the last window.
    Chaining those small functions per key gives every slice its entry state, and a
    second parallel pass marks the windows. A task holds one slice: at most one row per
    millisecond of it, whatever the number of hits.
    """
    slice_ms = max(2 * duration_ms, HOUR_MS)
    key_type = df.schema[key].dataType
    rows = df.withColumn("_ms", millis(F.col(ts)))
    hits = (
        rows.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("key"), F.col("_ms").alias("ms"))
        .agg(F.count("*").alias("n"))
        .withColumn("slice", floor_to(F.col("ms"), slice_ms))
        # Both passes read this one exchange, and the join below keeps its partitioning.
        .repartition("key", "slice")
    )
    steps = (
        hits.sortWithinPartitions("key", "slice", "ms")
        .mapInPandas(_step_functions(duration_ms, slice_ms), _schema(key_type, "slice", "opening", "end"))
    )
    entries = (
        steps.repartition("key")
        .sortWithinPartitions("key", "slice", "opening")
        .mapInPandas(_chain_slices, _schema(key_type, "slice", "open_until"))
    )
    marked = (
        hits.join(entries, ["key", "slice"], "left")
        .select("key", "slice", "ms", "n", F.coalesce("open_until", F.col("slice")).alias("open_until"))
        .sortWithinPartitions("key", "slice", "ms")
        .mapInPandas(_mark_windows(duration_ms, slice_ms), _schema(key_type, "ms", "n", "start"))
    )
    earlier = (
        Window.partitionBy("key", "start").orderBy("ms").rowsBetween(Window.unboundedPreceding, -1)
    )
    windows = marked.select(
        F.col("key").alias("_key"),
        F.col("ms").alias("_hit_ms"),
        F.col("start").alias("window_start_ms"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_earlier"),
    )
    same_ms = Window.partitionBy(key, "_ms").orderBy(ts, id)
    return (
        rows.join(windows, (F.col(key) == F.col("_key")) & (F.col("_ms") == F.col("_hit_ms")), "left")
        .withColumn("hit", F.col("_earlier") + F.row_number().over(same_ms))
        .withColumn("allowed", F.coalesce(F.col("hit") <= points, F.lit(True)))
        .withColumn(
            "ms_before_next",
            F.when(~F.col("allowed"), F.col("window_start_ms") + duration_ms - F.col("_ms")),
        )
        .select(*df.columns, "window_start_ms", "hit", "allowed", "ms_before_next")
    )


def _schema(key_type: T.DataType, *longs: str) -> T.StructType:
    return T.StructType(
        [T.StructField("key", key_type)] + [T.StructField(c, T.LongType()) for c in longs]
    )


def _whole_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Re-cut sorted batches so that no (key, slice) group spans two frames."""
    pending: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        last = batch.iloc[-1]
        in_last = (batch["key"] == last["key"]) & (batch["slice"] == last["slice"])
        cut = len(batch) - int(in_last.sum())
        if cut == 0 and pending:
            before = pending[-1].iloc[-1]
            if before["key"] != last["key"] or before["slice"] != last["slice"]:
                yield pd.concat(pending, ignore_index=True)
                pending = []
        elif cut > 0:
            yield pd.concat([*pending, batch.iloc[:cut]], ignore_index=True)
            pending = []
        pending.append(batch.iloc[cut:])
    if pending:
        yield pd.concat(pending, ignore_index=True)


def _group_numbers(frame: pd.DataFrame) -> np.ndarray:
    """Number of the (key, slice) group of each row; keys are compared in their own type."""
    key, part = frame["key"].to_numpy(), frame["slice"].to_numpy()
    changes = (key[1:] != key[:-1]) | (part[1:] != part[:-1])
    return np.concatenate([[0], np.cumsum(changes)])[: len(frame)]


class _Line:
    """All groups of a frame laid end to end on one axis, for one binary search."""

    def __init__(self, frame: pd.DataFrame, duration: int, slice_ms: int):
        self.group = _group_numbers(frame)
        self.ms = frame["ms"].to_numpy(np.int64)
        self.slice = frame["slice"].to_numpy(np.int64)
        self.duration = duration
        self.stride = slice_ms + 2 * duration
        self.at = self.group * self.stride + (self.ms - self.slice)

    def first_at(self, group: np.ndarray, offset: np.ndarray) -> np.ndarray:
        """Row of the first hit of ``group`` at or after ``offset``; -1 if none."""
        row = np.searchsorted(self.at, group * self.stride + offset)
        found = row < len(self.at)
        found[found] = self.group[row[found]] == group[found]
        return np.where(found, row, -1)

    def next_window(self, row: np.ndarray) -> np.ndarray:
        return self.first_at(self.group[row], self.ms[row] - self.slice[row] + self.duration)


def _step_functions(duration: int, slice_ms: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _whole_groups(batches):
            line = _Line(frame, duration, slice_ms)
            offset = line.ms - line.slice
            late = offset >= duration
            first_late = late & np.r_[True, ~late[:-1] | (line.group[1:] != line.group[:-1])]
            opening = np.flatnonzero(~late | first_late)
            row = opening.copy()
            walking = np.arange(len(row))
            while len(walking):
                following = line.next_window(row[walking])
                inside = following >= 0
                walking = walking[inside]
                row[walking] = following[inside]
            end = line.ms[row] + duration
            group = line.group[opening]
            # Of neighbours with one end, the latest opening stands for all.
            keep = np.r_[(end[1:] != end[:-1]) | (group[1:] != group[:-1]), True]
            yield pd.DataFrame(
                {
                    "key": frame["key"].to_numpy()[opening[keep]],
                    "slice": line.slice[opening[keep]],
                    "opening": line.ms[opening[keep]],
                    "end": end[keep],
                }
            )

    return run


def _chain_slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per key, carry the end of the open window from slice to slice."""
    key, open_until = None, None
    for frame in _whole_groups(batches):
        starts = np.flatnonzero(np.diff(_group_numbers(frame), prepend=-1))
        stops = np.r_[starts[1:], len(frame)]
        keys, slices = frame["key"].to_numpy(), frame["slice"].to_numpy()
        opening, end = frame["opening"].to_numpy(), frame["end"].to_numpy()
        out = []
        for lo, hi in zip(starts, stops):
            if key is None or keys[lo] != key:
                key, open_until = keys[lo], slices[lo]
            if open_until > slices[lo]:
                out.append((key, slices[lo], open_until))
            step = lo + np.searchsorted(opening[lo:hi], open_until)
            if step < hi:
                open_until = end[step]
        yield pd.DataFrame(out, columns=["key", "slice", "open_until"])


def _mark_windows(duration: int, slice_ms: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _whole_groups(batches):
            line = _Line(frame, duration, slice_ms)
            open_until = frame["open_until"].to_numpy(np.int64)
            heads = np.flatnonzero(np.diff(line.group, prepend=-1))
            row = line.first_at(line.group[heads], open_until[heads] - line.slice[heads])
            row = row[row >= 0]
            opens = np.zeros(len(frame), bool)
            while len(row):
                opens[row] = True
                row = line.next_window(row)
                row = row[row >= 0]
            latest = np.maximum.accumulate(np.where(opens, np.arange(len(frame)), -1))
            carried = (latest < 0) | (line.group[latest] != line.group)
            start = np.where(carried, open_until - duration, line.ms[latest])
            yield pd.DataFrame(
                {"key": frame["key"], "ms": line.ms, "n": frame["n"], "start": start}
            )

    return run


def rate_limit_aligned(
    df: DataFrame,
    key: str,
    ts: str = "ts",
    id: str = "id",
    points: int = DOMAIN_POINTS,
    duration_ms: int = DOMAIN_DURATION_MS,
) -> DataFrame:
    """The same limit on calendar-aligned windows.

    Only the ``points``-th hit of a window is looked up (the planner drops later hits
    before the shuffle); all rows are then compared to it in a join, which adaptive
    execution splits when one key is hot.
    """
    start = floor_to(millis(F.col(ts)), duration_ms)
    rows = df.withColumn("window_start_ms", start)
    w = Window.partitionBy(key, "window_start_ms").orderBy(ts, id)
    last = (
        rows.where(F.col(key).isNotNull())
        .select(key, "window_start_ms", ts, id)
        .withColumn("_n", F.row_number().over(w))
        .where(F.col("_n") <= points)
        .where(F.col("_n") == points)
        .select(key, "window_start_ms", F.struct(ts, id).alias("_last"))
    )
    return (
        rows.join(last, [key, "window_start_ms"], "left")
        .withColumn("allowed", F.coalesce(F.struct(ts, id) <= F.col("_last"), F.lit(True)))
        .withColumn(
            "ms_before_next",
            F.when(~F.col("allowed"), F.col("window_start_ms") + duration_ms - millis(F.col(ts))),
        )
        .select(*df.columns, "window_start_ms", "allowed", "ms_before_next")
    )


def polite_plan(
    urls: DataFrame,
    host: str = "host",
    ts: str = "ts",
    id: str = "id",
    points: int = DOMAIN_POINTS,
    duration_ms: int = DOMAIN_DURATION_MS,
) -> DataFrame:
    """Give each URL a fetch slot so that no host gets more than ``points`` per slot.

    Hosts do not wait for one another: every host starts in slot 0. ``ready_ms`` is the
    slot start in milliseconds after the start of the plan.
    """
    fifo = ranked(urls.where(F.col(host).isNotNull()), [host], [F.col(ts), F.col(id)], "_n")
    slot = F.floor((F.col("_n") - 1) / points).cast("bigint")
    return fifo.withColumn("slot", slot).withColumn("ready_ms", F.col("slot") * duration_ms).drop("_n")


def crawl_delay_gaps(
    fetches: DataFrame, key: str = "domain", ts: str = "ts", id: str = "id", delay_us: int = 1_000_000
) -> DataFrame:
    """Fetches that came sooner than ``delay`` after the one before on the same key."""
    timed = fetches.select(key, id, micros(F.col(ts)).alias("us"))
    gaps = running(timed, [key], [F.col("us"), F.col(id)], maxima={"before": F.col("us")})
    return gaps.where(F.col("us") - F.col("before") < delay_us).select(
        key, id, from_micros(F.col("us")).alias("ts"), (F.col("us") - F.col("before")).alias("gap_us")
    )
