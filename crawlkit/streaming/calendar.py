"""A calendar of rows that wait for their time: a timing wheel made of folders.

A waiting row lies in the folder of its due time (``bucket``, ``width_ms`` wide). When the
clock moves from ``since`` to ``now``, only the folders between the two are read; the rows in
them that are due by ``now`` come out, and folders the clock has left behind are removed. No
task looks at a key, keeps a timer or holds a row in memory, and a million rows that wait for
one host hold up no other.

Each batch writes folders of its own, named by bucket and batch, so a replay replaces them.
The clock of a batch is a table too: it is the event time reached, so a replay or a rerun
releases the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlkit.sources.files import exists, glob, remove

WIDTH_MS = 60_000
NEVER = -(1 << 62)


class Calendar:
    """Waiting rows of one query. They need a BIGINT ``due_ms``."""

    def __init__(self, spark: SparkSession, path: str, run: str, width_ms: int = WIDTH_MS):
        self.spark, self.path, self.width = spark, f"{path}/run={run}", width_ms

    def _bucket(self, ms: Column) -> Column:
        return F.floor(ms / self.width).cast("bigint")

    def latest(self, before: int = 1 << 62) -> int:
        """The clock after the batches before ``before``."""
        if not exists(self.spark, f"{self.path}/clock"):
            return NEVER
        seen = self.spark.read.schema("now BIGINT, batch BIGINT").parquet(f"{self.path}/clock")
        now = seen.where(F.col("batch") < before).agg(F.max("now")).first()[0]
        return NEVER if now is None else now

    def clock(self, batch: int, latest: int | None) -> tuple[int, int]:
        """(since, now) of a batch whose latest event is ``latest``; the clock never goes back."""
        since = self.latest(batch)
        now = since if latest is None else max(since, latest)
        row = self.spark.range(1).select(F.lit(now).cast("bigint").alias("now"))
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/clock/batch={batch}")
        return since, now

    def hold(self, rows: DataFrame, batch: int) -> None:
        """Put ``rows`` into the folders of their due times."""
        filed = rows.withColumns({"bucket": self._bucket(F.col("due_ms")), "batch": F.lit(batch).cast("bigint")})
        (
            filed.repartition("bucket", F.pmod(F.xxhash64(*rows.columns), F.lit(8)))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("bucket", "batch")
            .parquet(f"{self.path}/waiting")
        )

    def _buckets(self) -> list[int]:
        return [int(p.rsplit("=", 1)[1]) for p in glob(self.spark, f"{self.path}/waiting/bucket=*")]

    def _read(self, schema: str, buckets: list[int], batch: int) -> DataFrame:
        full = f"{schema}, bucket BIGINT, batch BIGINT"
        if not buckets:
            return self.spark.createDataFrame([], full).drop("bucket", "batch")
        home = f"{self.path}/waiting"
        rows = self.spark.read.schema(full).option("basePath", home).parquet(*[f"{home}/bucket={b}" for b in buckets])
        return rows.where(F.col("batch") < batch).drop("bucket", "batch")

    def due(self, schema: str, batch: int, since: int, now: int) -> DataFrame:
        """Rows held by earlier batches whose time came between ``since`` and ``now``."""
        between = [b for b in self._buckets() if since // self.width <= b <= now // self.width]
        return self._read(schema, between, batch).where((F.col("due_ms") > since) & (F.col("due_ms") <= now))

    def waiting(self, schema: str, now: int) -> DataFrame:
        """Rows whose time has not come at ``now``."""
        later = [b for b in self._buckets() if b >= now // self.width]
        return self._read(schema, later, 1 << 62).where(F.col("due_ms") > now)

    def tidy(self, since: int) -> None:
        """Remove folders whose rows all came out before this batch."""
        for bucket in self._buckets():
            if bucket < since // self.width:
                remove(self.spark, f"{self.path}/waiting/bucket={bucket}")


def fields(df: DataFrame) -> str:
    """The columns of ``df`` as a schema text."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
