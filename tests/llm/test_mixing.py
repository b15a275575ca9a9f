"""Targets against plain Python, and what a mix must keep to."""

import random
import re

import pytest
from pyspark.sql import functions as F

from crawlkit.llm import mixing, queries

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, source string, size long"


def water(sizes, weights=(1, 2, 3), repeats=3, budget=None):
    """Targets by whole rounds of resharing; ``sizes`` maps source to size."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = sum(sizes.values()) if budget is None else budget, set(order), {}
    while free:
        total = sum(weight[s] for s in free)
        above = {s for s in free if left * weight[s] > repeats * sizes[s] * total}
        if not above:
            out.update({s: left * weight[s] / total for s in free})
            break
        for s in above:
            out[s] = float(repeats * sizes[s])
        left -= sum(repeats * sizes[s] for s in above)
        free -= above
    return out


def by_source(rows):
    out = {}
    for r in rows:
        out.setdefault(r.source, []).append(r)
    return out


def held(rows, tolerance=0.001):
    """The contract's conditions; returns targets."""
    groups = by_source(rows)
    sizes = {s: sum(r.size or 0 for r in g) for s, g in groups.items()}
    expected = water(sizes)
    for s, group in groups.items():
        assert {r.source_size for r in group} == {sizes[s]}
        assert all(abs(r.target - expected[s]) <= 1e-9 * max(1, expected[s]) for r in group)
        assert all(0 <= r.taken <= 3 * (r.size or 0) for r in group)
        assert all(r.taken == r.copies * (r.size or 0) for r in group)
        copies = {r.copies for r in group if r.size}
        assert len(copies) <= 2 and (not copies or max(copies) - min(copies) <= 1)
        taken = sum(r.taken for r in group)
        # A row left out would not bring the source nearer.
        gap = expected[s] - taken
        spare = [r.size for r in group if r.size and r.copies == min(copies)] if len(copies) == 2 or gap > 0 else []
        assert abs(gap) <= max(tolerance * expected[s] + 1, min(spare, default=0) if gap > 0 else max((r.size for r in group if r.size), default=0))
    return expected


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def drawn(n, sources, seed):
    draw = random.Random(seed)
    return [(i, draw.choice(sources), int(draw.expovariate(1 / 200))) for i in range(n)]


def test_targets_stop_at_three_times_and_reshare(spark):
    for sizes in (
        {"a": 1000, "b": 10, "c": 10, None: 0},
        {"a": 5, "b": 1, "é": 1, "z": 1000, "￿": 3, "\U0001f600": 7},
        {"a": 0, "b": 0},
        {str(i): i * i for i in range(30)},
    ):
        rows = [(f"0{s}" if s is not None else "1", 1, n) for s, n in sizes.items()]
        got = {r.src: r.target for r in mixing.targets(spark.createDataFrame(rows, "src string, n long, source_size long"), (1, 2, 3), 3).collect()}
        expected = {f"0{s}" if s is not None else "1": t for s, t in water(sizes).items()}
        assert got == pytest.approx(expected, rel=1e-12)


def test_sources_come_near_their_targets(spark):
    docs = drawn(2000, ["a", "a", "a", "b", "c", "d", None], 1) + [(9000 + i, "b", 20000) for i in range(3)]
    held(mixing.mix(spark.createDataFrame(docs, SCHEMA)).collect())


def test_a_long_row_at_the_threshold_does_not_leave_the_source_short(spark):
    docs = [(i, "a", 100) for i in range(200)] + [(1000 + i, "a", 15_000) for i in range(4)] + [(2000, "b", 60_000)]
    for seed in range(4):
        out = mixing.mix(spark.createDataFrame(docs, SCHEMA), seed=seed).where("source = 'a'").collect()
        assert abs(sum(r.taken for r in out) - out[0].target) <= 100


def test_placement_does_not_depend_on_partitions_or_order(spark):
    docs = drawn(800, ["a", "b", "c"], 2)
    one = rows_of(mixing.mix(spark.createDataFrame(docs, SCHEMA).coalesce(1)))
    assert rows_of(mixing.mix(spark.createDataFrame(docs[::-1], SCHEMA).repartition(7))) == one
    assert rows_of(mixing.mix(spark.createDataFrame(docs, SCHEMA), seed=5)) != one


def test_equal_rows_are_parted_by_place(spark):
    """One key holds nearly all rows: the hash line of the place goes on where that of the values ends."""
    docs = [(None, "a", 7)] * 500 + [(1, "b", 5000)] * 2
    out = mixing.mix(spark.createDataFrame(docs, SCHEMA)).collect()
    held(out)
    again = mixing.mix(spark.createDataFrame(docs, SCHEMA).repartition(3)).collect()
    assert sorted(r.taken for r in again) == sorted(r.taken for r in out)


def test_smaller_budgets_choose_from_what_larger_ones_take(spark):
    """Thresholds are nested: with equal sizes no row closes a gap out of turn."""
    docs = spark.createDataFrame([(i, "ab"[i % 2], 10) for i in range(600)], SCHEMA)
    taken = [{(r.doc_id, c) for r in mixing.mix(docs, budget=b).collect() for c in range(r.copies)} for b in (600, 1800, 4500, 9000)]
    assert all(a < b for a, b in zip(taken, taken[1:]))


def test_nulls_empty_tables_and_clashing_names(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, None, None), (None, None, 5), (2, "a", -3), (2, "a", 0)]
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(r.taken for r in out if r.source is None) == 5 and len(out) == 4
    extra = spark.createDataFrame([(1, "a", 4, "x", 2.0)], f"{SCHEMA}, src string, Target double")
    assert mixing.mix(extra).columns == ["doc_id", "source", "size", "src", "source_size", "target", "copies", "taken"]


def test_many_sources_are_joined_without_a_broadcast(spark, monkeypatch):
    from crawlkit.llm import common

    docs = spark.createDataFrame(drawn(600, ["a", "a", "b", "c", None], 6), SCHEMA)
    expected = rows_of(mixing.mix(docs))
    monkeypatch.setattr(common, "SMALL", 0)
    monkeypatch.setattr(common, "HEAVY", 3)
    assert rows_of(mixing.mix(docs)) == expected


def test_query_holds_on_the_table(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text")
    out = queries.op13_mixing(spark, SF)
    assert out.columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]
    joined = out.join(table.select("doc_id", "source", "text"), "doc_id").collect()
    assert len(joined) == table.count()
    assert all(r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in joined)
    held(joined)
    assert rows_of(out.where(F.col("doc_id") < 100)) == rows_of(queries.op13_mixing(spark, SF).where(F.col("doc_id") < 100))
