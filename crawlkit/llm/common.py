"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlkit.functions.bind import let
from crawlkit.session import prepare, scratch

#: The one set of separators of "words" in the contracts: space and \t \n \v \f \r.
SPACES = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def packed(df: DataFrame, row: str = "row") -> DataFrame:
    """All columns of ``df`` in one struct, so that working columns can't clash with them."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias(row))


def unpacked(df: DataFrame, row: str = "row", **added: Column) -> DataFrame:
    """The columns of the struct, then ``added``; an added column replaces one of its name."""
    taken = {name.lower() for name in added}
    fields = [f for f in df.schema[row].dataType.names if f.lower() not in taken]
    return df.select(*[F.col(f"{row}.`{f}`").alias(f) for f in fields], *[c.alias(n) for n, c in added.items()])


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared scratch folder: later passes survive lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame, label: str) -> DataFrame:
    """``written``; shuffle files of the job go as it ends, not when the driver next collects garbage."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        return written(df, label)
    finally:
        if before is None:
            conf.unset(_CLEANUP)
        else:
            conf.set(_CLEANUP, before)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` once everything read from them is itself written."""
    for df in tables:
        jvm = df.sparkSession._jvm
        conf = df.sparkSession._jsc.hadoopConfiguration()
        for name in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


def hex_digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def pieces(text: Column, pattern: str) -> Column:
    """What stands before, between and after the matches; one more than there are matches."""
    return F.split(text, pattern, -1)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def clean_vectors(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose array ``vector`` is whole: no NULL, NaN or infinity in it, and not empty.

    Vectors of another length than the commonest (of equally common ones the longest) cannot
    be compared with the others and are left out too.
    """
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = rows.where((F.size(vector) > 0) & fine)
    commonest = whole.groupBy(F.size(vector).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return whole.where(F.size(vector) == (commonest["size"] if commonest else 0))


#: Tables of up to so many rows are broadcast; a key is heavy with more than 1 / HEAVY of all rows.
SMALL, HEAVY = 10_000, 1_000


def attach(rows: DataFrame, table: DataFrame, key: str, n: str = "n") -> DataFrame:
    """``rows`` joined with ``table``, which has one row per ``key`` and in ``n`` how many ``rows`` have it.

    A small table is broadcast. Of a large one only the heavy keys are, fewer than ``HEAVY``
    by their share, so no task of the shuffle join gets more than that share for one key.
    Both sides are read several times: give written tables. ``key`` must not be NULL.
    """
    if table.count() <= SMALL:
        return rows.join(F.broadcast(table), key)
    total = table.agg(F.sum(n)).first()[0] or 0
    heavy = table.where(F.col(n) * HEAVY > total)
    light = table.where(F.col(n) * HEAVY <= total)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return rows.join(F.broadcast(heavy), key).unionByName(rest.join(light, key))


__all__ = [
    "SPACES", "attach", "clean_vectors", "discard", "hex_digest", "let", "matches", "packed", "pieces", "scratch", "settled", "table", "unpacked",
    "written",
]
