"""Whitening of embeddings with a multiplicity covariance.

Vectors are put on a grid of whole numbers, and equal ones are grouped: each distinct vector
is centred, multiplied and projected once, whatever the number of its copies. Its weight in
the fit is the number of copies or one. Tasks add up weighted products of centred rows
(one matrix product per Arrow batch) and hand on one matrix each; these are added per cell
by Spark, so the driver gets dimensions x dimensions numbers. Components come from the
symmetric eigenproblem of that matrix. Whitened vectors are joined back to the rows by
vector; heavy vectors, a bounded number, are broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlkit.llm.common import attach, clean_vectors, discard, packed, unpacked, written

COMPONENTS, SCALE, SHIFT = 16, 64, 1_000_000
#: Components whose eigenvalue is below this share of the trace are noise of the arithmetic.
LEAST_SHARE = 1e-12
#: Grid values from here on are refused: their differences would leave 64 bits.
LARGEST = 1 << 52

Batches = Iterator[pa.RecordBatch]


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _offsets(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums``, exactly: whole numbers of 64 bits, or Python's where those are too short."""
    top = n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, sums))
    kind = np.int64 if top < 1 << 62 else object
    return n * x.astype(kind) - np.array(sums, kind)


def _products(vector: str, n: int, sums: list[int] | None) -> Callable[[Batches], Batches]:
    """Per task: cells (i, j) of the sum of weight * centred row * centred row."""

    def run(batches: Batches) -> Batches:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _matrix(batch, vector)
            centred = rows if sums is None else _offsets(rows, n, sums).astype(np.float64) / n
            weight = batch.column("w").to_numpy().astype(np.float64)
            part = centred.T @ (centred * weight[:, None])
            total = part if total is None else total + part
        if total is not None:
            d = len(total)
            i, j = np.divmod(np.arange(d * d, dtype=np.int64), d)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "value"])

    return run


def covariance(vectors: DataFrame, vector: str, n: int, sums: list[int] | None, dims: int) -> np.ndarray:
    """Weighted covariance (divisor ``n``) of ``vector`` with weights ``w``; None: already centred."""
    parts = vectors.select(vector, "w").mapInArrow(_products(vector, n, sums), "i bigint, j bigint, value double")
    out = np.zeros((dims, dims))
    for row in parts.groupBy("i", "j").agg(F.sum("value").alias("value")).collect():  # dims x dims rows
        out[row.i, row.j] = row.value / n
    return (out + out.T) / 2


def components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit eigenvectors as columns by falling eigenvalue, the eigenvalues, and which of them are no noise."""
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return vectors, values, values > LEAST_SHARE * max(np.trace(matrix), 0)


def _whitener(n: int, sums: list[int], basis: np.ndarray) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            if not batch.num_rows:
                continue
            offsets = _offsets(_matrix(batch, "x"), n, sums)
            white = (offsets.astype(np.float64) / n) @ basis
            # Squares may be longer than 64 bits although the offsets are not.
            short = offsets.dtype != object and offsets.shape[1] * max(abs(int(offsets.max())), abs(int(offsets.min()))) ** 2 < 1 << 63
            exact = offsets if short else offsets.astype(object)
            squares = (exact * exact).sum(axis=1)
            kind = pa.decimal128(38, 0)
            deviation = pa.array(squares).cast(kind) if short else pa.array(map(Decimal, squares.tolist()), kind)
            lists = pa.ListArray.from_arrays(np.arange(0, white.size + 1, white.shape[1], dtype=np.int32), pa.array(white.ravel()))
            columns = [batch.column("vid"), batch.column("w"), deviation, lists]
            yield pa.RecordBatch.from_arrays(columns, ["vid", "w", "deviation", "white"])

    return run


def whiten(
    df: DataFrame, vector: str = "embedding", k: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT, weights: str = "one"
) -> DataFrame:
    """Rows with a clean vector, with ``whitened`` (array), ``explained`` (array), ``n``, ``deviation``, ``identity_error``.

    A component c becomes ``floor(scale * c) + shift``. ``weights`` is ``one`` (each distinct
    vector counts once) or ``counts``; ``n`` is the sum of weights. ``deviation`` is the sum
    of ``(n * x - S) ** 2`` over the dimensions, exact. ``explained`` holds the eigenvalues'
    shares of the trace, and ``identity_error`` the largest difference between the whitened
    vectors' covariance and the identity, measured on the whitened vectors.

    There are ``min(k, dimensions)`` components. Those without variance (fewer distinct
    vectors than dimensions, constant ones) have NULL as whitened value and are left out of
    ``identity_error``; without any variance ``explained`` is NULL. Rows whose vector is NULL, empty, of another length than most, or holds a
    NULL or non-finite component are left out. Repeated rows are rows of their own, columns
    of the new names are replaced, and an empty table gives no rows.
    """
    whole = packed(df).select("row", F.col(f"row.`{vector}`").cast("array<double>").alias("v"))
    grid = F.transform("v", lambda c: F.when(F.abs(c * scale) < LARGEST, F.floor(c * scale) + shift).otherwise(
        F.raise_error(F.lit("a component is too large for the grid"))).cast("bigint"))
    rows = written(clean_vectors(whole, "v").select("row", grid.alias("x")), "grid")
    one = F.lit(1).cast("bigint") if weights == "one" else F.col("n")
    distinct = rows.groupBy("x").agg(F.count("*").alias("n")).withColumn("w", one)
    distinct = written(distinct.withColumn("vid", F.monotonically_increasing_id()), "distinct-vectors")
    sample = distinct.first()
    dims = len(sample.x) if sample else 0
    # A component is below 2 ** 53, so sums are exact as decimals for any number of rows.
    fit = distinct.agg(F.sum("w"), *[F.sum((F.col("x")[i] * F.col("w")).cast("decimal(28,0)")) for i in range(dims)]).first()
    n, sums = fit[0] or 1, [int(s) for s in fit[1:]]
    matrix = covariance(distinct, "x", n, sums, dims)
    vectors, values, real = components(matrix, k)
    trace = float(np.trace(matrix))
    basis = np.where(real, vectors / np.sqrt(np.where(real, values, 1)), 0) if dims else np.zeros((0, 0))
    white = distinct.select("vid", "w", "x").mapInArrow(
        _whitener(n, sums, basis), "vid bigint, w bigint, deviation decimal(38,0), white array<double>"
    )
    white = written(white, "whitened")
    width = min(k, dims)
    error = covariance(white, "white", n, None, width)[np.ix_(real, real)] - np.eye(int(real.sum()))
    keyed = written(distinct.select("vid", "x", "n").join(white.select("vid", "deviation", "white"), "vid").drop("vid"), "keyed")
    out = attach(rows, keyed, "x")
    shares = F.array(*[F.lit(float(v / trace) if trace > 0 else None).cast("double") for v in values])
    known = F.array(*[F.when(F.lit(bool(real[i])), F.col("white")[i]) for i in range(width)])
    discard(distinct, white)
    return unpacked(
        out,
        whitened=known,
        explained=shares,
        n=F.lit(n).cast("bigint"),
        deviation=F.col("deviation"),
        identity_error=F.lit(float(np.abs(error).max(initial=0.0))),
    )
