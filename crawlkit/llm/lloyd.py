"""Vector codes by product quantisation, trained with member-resident Lloyd rounds.

Each vector is cut into consecutive parts, and every part is a row that lives with the owner
of the codebook entry it is assigned to: rows are partitioned by (position, entry, salt).
A round has two steps. Owners sum their resident members, which moves only one row of sums
per owner; the new entries (positions x entries rows, whatever the input) go to all tasks.
Then members look for their nearest entry where they are: those that keep theirs are
written without a shuffle, and only those that change entry migrate to their new owner.

The salt splits an owner by members, so an entry that holds a third of all rows is many
partitions. Members are kept as tables in the shared scratch folder; the one of the round
before is removed once the next is written.

Arithmetic is exact: whole numbers all through. Distances go through a float64 matrix
product where its sums stay below 2 ** 53, and through 64-bit integers otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlkit.llm.common import attach, clean_vectors, discard, packed, scratch, unpacked, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Members per (position, entry, salt).
MEMBERS = 4096
#: Largest whole number whose squared distances still fit 64 bits, for 256 dimensions.
LARGEST = 1 << 26


def nearest(members: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (the lower one of two) and the squared distance to it."""
    top = max(int(np.abs(members).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * members.shape[1] * top * top < 1 << 53 else np.int64
    m, e = members.astype(kind), entries.astype(kind)
    # Less the members' own squares, which do not change the order.
    far = (e * e).sum(axis=1) - 2 * (m @ e.T)
    best = far.argmin(axis=1)
    return best.astype(np.int32), (far[np.arange(len(m)), best] + (m * m).sum(axis=1)).astype(np.int64)


def _assigner(books: list[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Members with the entry that ``books`` gives them and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            position = batch.column("position").to_numpy()
            values = batch.column("part").flatten().to_numpy().reshape(batch.num_rows, -1)
            entry = np.empty(batch.num_rows, np.int32)
            far = np.empty(batch.num_rows, np.int64)
            for p in np.unique(position):
                mine = position == p
                entry[mine], far[mine] = nearest(values[mine], books[p])
            columns = [batch.column(c) for c in ("rid", "position", "entry", "part")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(entry), pa.array(far)], ["rid", "position", "entry", "part", "now", "far"])

    return run


def _assigned(members: DataFrame, books: list[np.ndarray]) -> DataFrame:
    schema = "rid bigint, position int, entry int, part array<bigint>, now int, far bigint"
    return members.select("rid", "position", "entry", "part").mapInArrow(_assigner(books), schema)


def _updated(members: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Entries after each owner has averaged its members; an owner without members keeps its entry."""
    width = books[0].shape[1]
    sums = members.groupBy("position", "entry").agg(
        F.count("*").alias("n"), F.array(*[F.sum(F.col("part")[i]) for i in range(width)]).alias("sums")
    )
    books = [book.copy() for book in books]
    for row in sums.collect():  # positions x entries rows at most
        books[row.position][row.entry] = [s // row.n for s in row.sums]
    return books


def _settled(spark, members: DataFrame, n_salts: int, label: str) -> DataFrame:
    """Members written with their new entry: stayers where they are, movers at their new owner."""
    path = scratch(spark, label)
    salt = F.pmod(F.xxhash64("rid"), F.lit(n_salts))
    out = ["rid", "position", F.col("now").alias("entry"), "part"]

    def write(df: DataFrame, name: str) -> None:
        df.select(*out).write.option("compression", "zstd").parquet(f"{path}/{name}")

    write(members.where("now = entry"), "stay")
    write(members.where("now <> entry").repartition("position", "now", salt), "moved")
    schema = "rid bigint, position int, entry int, part array<bigint>"
    return spark.read.schema(schema).parquet(f"{path}/stay", f"{path}/moved")


def _first_books(rows: DataFrame, parts: int, entries: int) -> list[np.ndarray]:
    first = rows.orderBy(F.col("vid").asc_nulls_last(), "x").limit(entries).select("x").collect()  # ``entries`` rows
    whole = np.array([r.x for r in first], np.int64)
    return np.split(whole, parts, axis=1)


def train(
    df: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES,
    rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, DataFrame, list[np.ndarray]]:
    """The clean rows (rid, row), their parts (rid, position, now, far) under the last codebooks, and those.

    Components become ``floor(scale * c)``; a codebook starts as that part of the vectors
    with the smallest ids (equal ids: the smaller vector; NULL ids last).
    """
    spark = df.sparkSession
    whole = packed(df).select("row", F.col(f"row.`{vec_id}`").alias("vid"), F.col(f"row.`{vector}`").alias("v"))
    whole = whole.withColumn("v", F.col("v").cast("array<double>"))
    clean = clean_vectors(whole, "v")
    checked = F.transform("v", lambda c: F.when(F.abs(c * scale) < LARGEST, F.floor(c * scale)).otherwise(
        F.raise_error(F.lit(f"components of {LARGEST // scale} or more have no 64-bit distances"))).cast("bigint"))
    rows = written(clean.select(F.monotonically_increasing_id().alias("rid"), "row", "vid", checked.alias("x")), "vectors")
    n = rows.count()
    if not n:
        return rows, spark.createDataFrame([], "rid bigint, position int, now int, far bigint"), []
    dims = F.size("x")
    if rows.select(dims).first()[0] % parts:
        raise ValueError(f"vectors cannot be cut into {parts} equal parts")
    books = _first_books(rows, parts, entries)
    width = F.lit(books[0].shape[1])
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice("x", p * width + 1, width))
    # -1: not with any owner yet, so every part migrates once.
    members = rows.select("rid", F.posexplode(cut).alias("position", "part")).withColumn("entry", F.lit(-1))
    n_salts = -(-n // MEMBERS)
    for number in range(rounds):
        assigned = _assigned(members, books)
        settled = _settled(spark, assigned, n_salts, f"members-{number}")
        if number:
            discard(members)
        members = settled
        books = _updated(members, books)
    final = written(_assigned(members, books).select("rid", "position", "now", "far"), "codes")
    if rounds:
        discard(members)
    return rows, final, books


def encode(df: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label", **options) -> tuple[DataFrame, list[np.ndarray]]:
    """Rows with a clean vector and their ``code`` (array of entry numbers), ``error`` and ``label_error``, and the codebooks.

    Rows whose vector is NULL, empty, of another length than most, or holds a NULL or
    non-finite component are left out. ``error`` is the squared distance to the coded
    vector; ``label_error`` sums it over equal labels, NULL being one. Repeated rows are
    rows of their own, columns of the three names are replaced, and an empty table gives
    no rows and no codebooks. Options are those of ``train``.
    """
    rows, parts, books = train(df, vector, vec_id, **options)
    found = parts.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("position", "now"))).alias("at"), F.sum("far").alias("error"))
    named = F.coalesce(F.concat(F.lit("="), F.col(f"row.`{label}`").cast("string")), F.lit(""))
    coded = rows.select("rid", "row", named.alias("named")).join(found, "rid")
    coded = written(coded.select("row", "named", F.col("at.now").alias("code"), "error"), "coded")
    sums = written(coded.groupBy("named").agg(F.count("*").alias("n"), F.sum("error").alias("label_error")), "label-errors")
    whole = attach(coded, sums, "named")
    discard(rows, parts)
    return unpacked(whole, code=F.col("code"), error=F.col("error"), label_error=F.col("label_error")), books
