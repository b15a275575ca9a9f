"""Codes and codebooks against plain Python; edge cases."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from crawlkit.llm import lloyd, queries

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    """Codes, errors and books of (vec_id, vector, label) rows, by whole-number loops."""
    kept = [(i, [math.floor(scale * c) for c in v], lab) for i, v, lab in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    if not kept:
        return {}, []
    width = len(kept[0][1]) // parts
    cut = lambda x, p: x[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(x, p) for _, x, _ in first] for p in range(parts)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            owned = {}
            for _, x, _ in kept:
                owned.setdefault(near(cut(x, p), books[p])[1], []).append(cut(x, p))
            for k, members in owned.items():
                books[p][k] = [sum(c) // len(members) for c in zip(*members)]
    out = []
    for i, x, lab in kept:
        found = [near(cut(x, p), books[p]) for p in range(parts)]
        out.append((i, tuple(k for _, k in found), sum(d for d, _ in found), lab))
    sums = {}
    for _, _, e, lab in out:
        sums[lab] = sums.get(lab, 0) + e
    return sorted(((i, code, e, sums[lab]) for i, code, e, lab in out), key=str), books


def spark_rows(df):
    return sorted(((r.vec_id, tuple(r.code), r.error, r.label_error) for r in df.collect()), key=str)


def test_codes_equal_brute_force_with_ties_nulls_and_repeats(spark):
    draw = random.Random(3)
    vectors = [[draw.choice([-0.5, 0.0, 0.25, 1.5]) + draw.random() * 0.002 for _ in range(8)] for _ in range(90)]
    vectors += vectors[:20] + [vectors[0]] * 40
    rows = [(i if i % 9 else None, [float(np.float32(c)) for c in v], draw.choice([0, 1, None])) for i, v in enumerate(vectors)]
    rows += [(500, None, 1), (501, [1.0, None] * 4, 1), (502, [float("nan")] * 8, 1), (503, [float("inf")] * 8, 1), (504, [], 1), (505, [1.0], 1)]
    rows += [rows[5], rows[5]]
    expected, books = brute([r for r in rows if r[0] != 505], entries=7, rounds=4)
    coded, got = lloyd.encode(spark.createDataFrame(rows, SCHEMA), entries=7, rounds=4)
    assert spark_rows(coded) == expected
    assert [b.tolist() for b in got] == books


def test_rounds_and_parts_are_options(spark):
    draw = random.Random(4)
    rows = [(i, [float(np.float32(draw.gauss(0, 1))) for _ in range(6)], 0) for i in range(50)]
    for parts, rounds in ((2, 1), (3, 0), (1, 2)):
        expected, _ = brute(rows, parts, 5, rounds)
        assert spark_rows(lloyd.encode(spark.createDataFrame(rows, SCHEMA), parts=parts, entries=5, rounds=rounds)[0]) == expected


def test_one_vector_holds_a_third_of_all_rows(spark):
    """The salt splits the owner; results are those of one owner."""
    draw = random.Random(5)
    rows = [(i, [0.5] * 4 if i % 3 == 0 else [float(np.float32(draw.gauss(0, 1))) for _ in range(4)], i % 2) for i in range(300)]
    whole, kept = lloyd.MEMBERS, lloyd.encode(spark.createDataFrame(rows, SCHEMA), entries=9)[0]
    expected = spark_rows(kept)
    lloyd.MEMBERS = 10
    try:
        assert spark_rows(lloyd.encode(spark.createDataFrame(rows, SCHEMA), entries=9)[0]) == expected
    finally:
        lloyd.MEMBERS = whole
    assert expected == brute(rows, entries=9)[0]


def test_nearest_takes_the_lower_of_equals_and_stays_exact():
    entries = np.array([[4], [0], [4], [2]])
    assert lloyd.nearest(np.array([[4], [3], [1]]), entries)[0].tolist() == [0, 0, 1]
    big = 1 << 25
    at, far = lloyd.nearest(np.array([[big, big - 1]]), np.array([[-big, big], [-big, big - 1]]))
    assert (at.tolist(), far.tolist()) == ([1], [(2 * big) ** 2])


def test_empty_table_clashing_names_and_odd_lengths(spark):
    empty, books = lloyd.encode(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and books == []
    rows = [(i, [0.1 * i] * 4, 0, "x", 7) for i in range(5)]
    coded, _ = lloyd.encode(spark.createDataFrame(rows, f"{SCHEMA}, Code string, rid int"))
    assert coded.columns == ["vec_id", "embedding", "label", "rid", "code", "error", "label_error"]
    assert [r.rid for r in coded.collect()] == [7] * 5
    with pytest.raises(ValueError):
        lloyd.encode(spark.createDataFrame([(1, [1.0, 2.0], 0)], SCHEMA))


def test_only_members_that_change_entry_are_shuffled(spark):
    """The plan that writes the stayers has no exchange."""
    rows = spark.range(100).select(F.col("id").alias("rid"), F.lit(0).alias("position"), F.lit(0).alias("entry"), F.array(F.col("id")).alias("part"))
    assigned = lloyd._assigned(rows, [np.array([[10], [90]])])
    plan = assigned.where("now = entry")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_query_equals_brute_force_on_the_table(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding, label FROM '{SF}/embeddings.parquet' ORDER BY vec_id").fetchall()[:]
    sample = queries.op11_lloyd(spark, SF).collect()
    assert len(sample) == len(rows)
    books = sample[0].codebooks_sha256
    x = np.floor(np.array([r[1] for r in rows], np.float64) * 1024).astype(np.int64)
    parts = np.split(x, 4, axis=1)
    entries = [p[:256].copy() for p in parts]

    def assign():
        return [((p[:, None, :] - e[None]) ** 2).sum(axis=2) for p, e in zip(parts, entries)]

    for _ in range(4):
        for p, far in enumerate(assign()):
            at = far.argmin(axis=1)
            for k in np.unique(at):
                entries[p][k] = np.floor_divide(parts[p][at == k].sum(axis=0), (at == k).sum())
    far = assign()
    codes = {r[0]: "".join(f"{f[i].argmin():02x}" for f in far) for i, r in enumerate(rows)}
    errors = {r[0]: int(sum(f[i].min() for f in far)) for i, r in enumerate(rows)}
    assert {r.vec_id: r.code for r in sample} == codes
    assert {r.vec_id: r.error for r in sample} == errors
    numbers = ",".join(str(c) for e in entries for c in e.ravel())
    assert books == hashlib.sha256(numbers.encode()).hexdigest()
