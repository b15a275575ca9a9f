"""Whitened vectors against numpy over the distinct vectors; edge cases."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from crawlkit.llm import queries, whitening

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>"


def grid(v):
    return tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)


def brute(vectors, weights=None):
    """n, S, V, eigenvalues falling and eigenvectors of the distinct grid vectors."""
    xs = sorted(set(vectors))
    w = [1 if weights is None else vectors.count(x) for x in xs]
    n = sum(w)
    s = [sum(a * x[i] for a, x in zip(w, xs)) for i in range(len(xs[0]))]
    centred = np.array([[(n * c - t) / n for c, t in zip(x, s)] for x in xs])
    v = (centred * np.array(w)[:, None]).T @ centred / n
    values, basis = np.linalg.eigh(v)
    return n, s, v, values[::-1], basis[:, ::-1]


def check(rows, vectors, weights=None, k=16):
    n, s, v, values, basis = brute(list(vectors.values()), weights)
    signs = {}
    for r in rows:
        x = vectors[r.vec_id]
        assert r.n == n
        assert int(r.deviation) == sum((n * c - t) ** 2 for c, t in zip(x, s))
        assert len(r.whitened) == min(k, len(x))
        for i, (white, share) in enumerate(zip(r.whitened, r.explained)):
            assert abs(share - values[i] / np.trace(v)) < 1e-9
            expected = float(np.dot([(n * c - t) / n for c, t in zip(x, s)], basis[:, i])) / math.sqrt(values[i])
            sign = signs.setdefault(i, 1 if abs(white - expected) <= abs(white + expected) else -1) if abs(expected) > 1e-6 else signs.get(i, 1)
            assert abs(white - sign * expected) < 1e-6
        assert r.identity_error < 1e-8


def sample(n, dims, seed):
    draw = random.Random(seed)
    return [[draw.gauss(0, 0.2 + i) for i in range(dims)] for _ in range(n)]


def test_distinct_vectors_count_once_and_copies_are_joined_back(spark):
    vectors = sample(40, 5, 1)
    vectors += [vectors[0]] * 30 + vectors[:10]  # one vector holds a third of all rows
    rows = [(i, v) for i, v in enumerate(vectors)]
    rows += [(100, None), (101, [1.0, None, 1.0, 1.0, 1.0]), (102, [float("nan")] * 5), (103, [-float("inf")] * 5), (104, []), (105, [1.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = {i: grid(v) for i, v in rows[: len(vectors)]}
    out = whitening.whiten(df).collect()
    assert sorted(r.vec_id for r in out) == sorted(kept)
    check(out, kept)
    check(whitening.whiten(df, weights="counts").collect(), kept, weights="counts")


def test_heavy_vectors_are_broadcast_and_light_ones_shuffled(spark, monkeypatch):
    """The same rows by the path of large tables."""
    from crawlkit.llm import common

    vectors = sample(50, 3, 2) + [[1.0, 2.0, 3.0]] * 25
    df = spark.createDataFrame(list(enumerate(vectors)), SCHEMA)
    expected = sorted((r.vec_id, [round(c, 9) for c in r.whitened]) for r in whitening.whiten(df).collect())
    monkeypatch.setattr(common, "SMALL", 0)
    monkeypatch.setattr(common, "HEAVY", 10)
    got = sorted((r.vec_id, [round(c, 9) for c in r.whitened]) for r in whitening.whiten(df).collect())
    assert got == expected


def test_no_variance_and_fewer_vectors_than_dimensions(spark):
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)).collect()
    assert [(r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, [None, None], [None, None], 0.0)] * 2
    two = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0, 0.0]), (2, [4.0, 6.0, 0.0])], SCHEMA)).collect()
    assert [[c is None for c in r.whitened] for r in two] == [[False, True, True]] * 2
    assert sorted(round(r.whitened[0], 9) for r in two) == [-1.0, 1.0]
    assert all(r.identity_error < 1e-12 for r in two)


def test_empty_table_and_clashing_names(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(i, v, 9, "y") for i, v in enumerate(sample(6, 2, 3))]
    out = whitening.whiten(spark.createDataFrame(rows, f"{SCHEMA}, N int, x string"))
    assert out.columns == ["vec_id", "embedding", "x", "whitened", "explained", "n", "deviation", "identity_error"]
    assert {r.x for r in out.collect()} == {"y"}


def test_long_sums_stay_exact(spark):
    """Deviations beyond 64 bits, and offsets beyond them."""
    x = np.array([[10**6 + 5], [10**6 - 7]], np.int64)
    assert whitening._offsets(x, 3, [3 * 10**6]).tolist() == [[15], [-21]]
    n = 1 << 50
    assert whitening._offsets(x, n, [n * 10**6]).tolist() == [[5 * n], [-7 * n]]
    far = spark.createDataFrame([(1, [3e7, 1.0]), (2, [-3e7, 2.0]), (3, [0.0, 3.0])], SCHEMA)
    kept = {r.vec_id: grid(r.embedding) for r in far.collect()}
    n, s, *_ = brute(list(kept.values()))
    got = {r.vec_id: int(r.deviation) for r in whitening.whiten(far).collect()}
    assert got == {i: sum((n * c - t) ** 2 for c, t in zip(x, s)) for i, x in kept.items()}
    assert max(got.values()) > 1 << 64


def test_query_equals_numpy_on_the_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    vectors = {r.vec_id: grid(r.embedding) for r in table}
    out = queries.op12_whitening(spark, SF)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert dict(out.dtypes)["deviation"] == "bigint" and dict(out.dtypes)["component"] == "int"
    per_row = out.groupBy("vec_id", "n", "deviation", "identity_error").agg(F.array_sort(F.collect_list(F.struct("component", "whitened", "explained"))).alias("c"))
    rows = per_row.withColumns({"whitened": F.col("c.whitened"), "explained": F.col("c.explained")}).collect()
    assert len(rows) == len(vectors)
    check(rows, vectors)
