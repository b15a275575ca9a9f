"""Near-duplicates and components against brute force."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from crawlkit.llm import minhash
from crawlkit.llm.common import written
from crawlkit.llm.components import components


def words(text):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    clean = (text or "").translate(table)
    for c in "\t\n\x0b\x0c\r":
        clean = clean.replace(c, " ")
    return [w for w in clean.split(" ") if w]


def shingles(text):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute(rows):
    """doc_id -> (n_shingles, component_id)"""
    sets = {}
    for doc, text in rows:
        sets.setdefault(shingles(text), []).append(doc)
    distinct = [s for s in sets if s]
    parent = {s: s for s in distinct}

    def root(s):
        while parent[s] is not s:
            s = parent[s]
        return s

    by_shingle = {}
    for s in distinct:
        for g in s:
            by_shingle.setdefault(g, []).append(s)
    for a, b in {(a, b) for group in by_shingle.values() for a, b in combinations(group, 2)}:
        both = len(a & b)
        if 100 * both >= 75 * (len(a) + len(b) - both):
            parent[root(a)] = root(b)
    least = {}
    for s in distinct:
        least[root(s)] = min([least.get(root(s), sets[s][0]), *sets[s]])
    return {doc: (len(shingles(t)), least[root(shingles(t))] if shingles(t) else doc) for doc, t in rows}


def result(docs):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs).collect()}


def test_equals_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert result(docs) == brute(rows)


def test_groups_of_near_copies_and_a_common_passage(docs_of):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(120)]
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(150):
        copy = list(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(120)] = word()
        texts.append(" ".join(copy))
    for _ in range(150):
        texts.append(" ".join([word() for _ in range(rng.randrange(5, 60))] + passage))
    chain = [word() for _ in range(200)]
    texts += [" ".join(chain[5 * i : 5 * i + 100]) for i in range(20)]
    texts += ["one two", "One  TWO", "two one", "", None, " \n", "a b c d e", "a b c d e f"]
    docs = docs_of(texts)
    assert result(docs) == brute(list(enumerate(texts)))


def test_null_ids_repeated_rows_and_clashing_columns(spark):
    rows = [(None, "a b c d e f", 1, "x"), (7, "a b c d e f", 2, "y"), (7, "a b c d e f", 2, "y"), (3, None, 3, "z"), (None, "q r", 4, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int, row string")
    out = minhash.near_duplicates(docs)
    assert set(out.columns) == {"doc_id", "text", "node", "row", "n_shingles", "component_id", "kept", "first"}
    got = sorted(((r["node"], r["component_id"], r["kept"], r["row"]) for r in out.collect()), key=str)
    assert got == [(1, 7, False, "x"), (2, 7, True, "y"), (2, 7, True, "y"), (3, 3, True, "z"), (4, None, True, "w")]
    assert out.where("first").count() == 3


def test_empty_table(docs_of, spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components(spark, shape):
    rng = random.Random(3)
    edges = {
        "chain": [(i, i + 1) for i in range(60)],
        "star": [(30, i) for i in range(60) if i != 30],
        "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(50)],
    }[shape]
    got = components(spark.createDataFrame(edges, "a long, b long"))
    comp = {r["node"]: r["comp"] for r in got.collect()}
    label = {n: n for e in edges for n in e}
    for _ in range(100):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    assert set(comp) == nodes
    for x in nodes:
        for y in nodes:
            assert (comp[x] == comp[y]) == (label[x] == label[y])


def test_long_text(docs_of):
    text = " ".join(f"w{i}" for i in range(100_000))
    docs = docs_of([text, text + " end"])
    assert [r["component_id"] for r in minhash.near_duplicates(docs).collect()] == [0, 0]
    assert minhash.near_duplicates(docs).select(F.sum("n_shingles")).first()[0] == 99_996 + 99_997


@pytest.mark.parametrize("small", [10_000, 0])
def test_rows_are_picked_by_number(spark, monkeypatch, small):
    monkeypatch.setattr(minhash, "SMALL", small)
    ids = [*range(40), *range(32760, 32780), *range((1 << 33) - 9, (1 << 33) + 70_000, 997)]
    rows = spark.createDataFrame([(i, str(i)) for i in ids], "rid long, t string")
    for wanted in ([i for i in ids if i % 3 == 1], []):
        picked = written(spark.createDataFrame([(i,) for i in wanted], "rid long"), "picked")
        inside, outside = minhash._parted(rows, picked)
        assert sorted(r.rid for r in inside.collect()) == sorted(wanted)
        assert sorted((r.rid, r.t) for r in outside.collect()) == sorted((i, str(i)) for i in set(ids) - set(wanted))


def test_texts_without_copies_are_not_shuffled(spark):
    docs = spark.createDataFrame([(i, f"w{i} only here {i * 7} and nowhere else") for i in range(50)], "doc_id long, text string")
    plan = minhash.near_duplicates(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and len(minhash.near_duplicates(docs).collect()) == 50
