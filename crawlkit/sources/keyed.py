"""A key table for streams: which keys were seen, and the newest value of each.

Rows are kept under the SHA-256 of their key, in folders named by the first hex digits of
it (the prefix). Hashes are uniform, so folders are even however the keys are skewed. A
micro-batch adds one span of rows and reads only the prefixes of its own keys. A span has as
many prefixes as its rows fill: a small batch writes 16 files, merged spans thousands.

Spans are folders ``run=r/span=lo-hi-digits`` that hold what batches lo to hi of a query wrote,
and count once their ``_SUCCESS`` mark is there. Whenever ``fan`` spans of one size are complete
they are merged into one, so after n batches a prefix has at most ``fan`` files per power of
``fan`` up to n. Names follow from the batch number: a replayed batch replaces its own
span, never sees it, and merges the same spans again. Only batches before the running one
are merged, because only that one can be replayed. One query at a time may write to a table.

Values must only ever grow (a count, a window's start and use): of several rows of a key the
largest stands.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlkit.session import forget, materialize
from crawlkit.sources.files import glob, remove, size

#: Bytes of a prefix folder from which a merged span gets longer prefixes; their most digits.
FULL = 64 << 20
MOST_DIGITS = 4
FAN = 8


class Span(NamedTuple):
    run: str
    lo: int
    hi: int
    digits: int

    @property
    def folder(self) -> str:
        return f"run={self.run}/span={self.lo}-{self.hi}-{self.digits}"


def keyed(df: DataFrame, key: Column) -> DataFrame:
    """Add ``h``, the 32 bytes that stand for ``key``."""
    return df.withColumn("h", F.unhex(F.sha2(key.cast("string"), 256)))


def _prefix(digits: int) -> Column:
    return F.lower(F.substring(F.hex(F.substring("h", 1, (digits + 1) // 2)), 1, digits))


def live(spark: SparkSession, path: str) -> list[Span]:
    """Complete spans, without those that a larger one of their run contains."""
    spans = []
    for mark in glob(spark, f"{path}/run=*/span=*/_SUCCESS"):
        run, span = mark.rsplit("/", 3)[1:3]
        spans.append(Span(run.removeprefix("run="), *map(int, span.removeprefix("span=").split("-"))))
    return [s for s in spans if not any(o.run == s.run and (o.lo, o.hi) != (s.lo, s.hi) and o.lo <= s.lo and s.hi <= o.hi for o in spans)]


def _schema(values: str) -> str:
    return "h BINARY" + (f", {values}" if values else "") + ", run STRING, span STRING, prefix STRING"


def _open(spark: SparkSession, path: str, values: str, spans: Sequence[Span]) -> DataFrame:
    if not spans:
        return spark.createDataFrame([], _schema(values))
    return spark.read.schema(_schema(values)).option("basePath", path).parquet(*[f"{path}/{s.folder}" for s in spans])


def _digits(total: int) -> int:
    digits = 1
    while digits < MOST_DIGITS and total > FULL * 16**digits:
        digits += 1
    return digits


def _write(
    rows: DataFrame, path: str, run: str, lo: int, hi: int, digits: int, spread: Sequence[Column] = ()
) -> None:
    (
        rows.withColumn("prefix", _prefix(digits))
        .repartition("prefix", *spread)
        .sortWithinPartitions("prefix", "h")
        .write.mode("overwrite")
        .partitionBy("prefix")
        .parquet(f"{path}/{Span(run, lo, hi, digits).folder}")
    )


def write(rows: DataFrame, path: str, run: str, batch: int, total: int = 0) -> None:
    """Write a batch's rows (``h`` and values) as a span; a replay replaces it.

    ``total``, the bytes of a batch that may be large, sets how long its prefixes are.
    """
    _write(rows, path, run, batch, batch, _digits(total))


def read_batch(spark: SparkSession, path: str, values: str, run: str, batch: int) -> DataFrame | None:
    """What a batch wrote, until it is merged; None if that was no row."""
    spans = [s for s in live(spark, path) if s.run == run and s.lo == s.hi == batch]
    if not any(glob(spark, f"{path}/{s.folder}/prefix=*") for s in spans):
        return None
    return _open(spark, path, values, spans).drop("run", "span", "prefix")


def read(spark: SparkSession, path: str, values: str) -> DataFrame:
    """The whole table."""
    return _open(spark, path, values, live(spark, path)).drop("run", "span", "prefix")


def load(rows: DataFrame, path: str, run: str, spread: Sequence[Column] = ()) -> None:
    """Write a table of any size as the only span of ``run``; nothing if it is there.

    Where a key has many rows, ``spread`` deals the rows of a prefix over several tasks and files.
    """
    if not has_run(rows.sparkSession, path, run):
        whole = materialize(rows, "load")
        folder = whole.inputFiles()[0].rsplit("/", 1)[0]
        _write(whole, path, run, 0, 0, _digits(size(rows.sparkSession, folder)), spread)
        forget(whole)


def has_run(spark: SparkSession, path: str, run: str) -> bool:
    return any(s.run == run for s in live(spark, path))


def compact(spark: SparkSession, path: str, values: str, run: str, batch: int, fan: int = FAN) -> None:
    """Merge what is due before ``batch`` runs; cheap when nothing is."""
    width = fan
    while batch and batch % width == 0:
        lo, hi = batch - width, batch - 1
        inside = [s for s in live(spark, path) if s.run == run and lo <= s.lo and s.hi <= hi]
        if len(inside) > 1:
            merged = newest(_open(spark, path, values, inside).drop("run", "span", "prefix"))
            _write(merged, path, run, lo, hi, _digits(sum(size(spark, f"{path}/{s.folder}") for s in inside)))
            for span in inside:
                remove(spark, f"{path}/{span.folder}")
        width *= fan


def newest(rows: DataFrame) -> DataFrame:
    """One row per key: the largest value."""
    values = [c for c in rows.columns if c != "h"]
    if not values:
        return rows.dropDuplicates(["h"])
    best = rows.groupBy("h").agg(F.max(F.struct(*values)).alias("v"))
    return best.select("h", *[F.col(f"v.{c}").alias(c) for c in values])


def candidates(
    keys: DataFrame, path: str, values: str = "", run: str | None = None, before: int | None = None
) -> DataFrame:
    """The table's rows in the folders that ``keys`` (``h``) fall into, without those of ``run`` from ``before`` on.

    The driver learns which prefixes the keys have: 16 ** digits strings at most.
    """
    spark = keys.sparkSession
    spans = [s for s in live(spark, path) if s.run != run or before is None or s.hi < before]
    table = _open(spark, path, values, spans)
    if spans:
        longest = max(s.digits for s in spans)
        long = [r.p for r in keys.select(_prefix(longest).alias("p")).distinct().collect()]
        wanted = {p[: s.digits] for s in spans for p in long} or {""}
        table = table.where(F.col("prefix").isin(*sorted(wanted)))
    return table.drop("run", "span", "prefix")


def lookup(
    keys: DataFrame, path: str, values: str = "", run: str | None = None, before: int | None = None
) -> DataFrame:
    """The newest row of each of ``keys`` (``h``) that the table has; the keys are the small side."""
    return newest(candidates(keys, path, values, run, before).join(keys.select("h"), "h", "left_semi"))
