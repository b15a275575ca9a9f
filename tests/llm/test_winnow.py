"""Decontamination against brute force."""

import hashlib
import random
import re

import pytest

from crawlkit.llm import queries, winnow

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        k = min(13, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows.setdefault((k, tuple(w[i : i + k])), set()).add(str(item))
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for k in range(1, 14):
            for i in range(len(w) - k + 1):
                names = windows.get((k, tuple(w[i : i + k])))
                if names:
                    hit.update(range(i, i + k))
                    found |= names
        names = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[doc] = (len(w), len(hit), len(found), names, len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def rows(df):
    return {r["doc_id"]: tuple(r[c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in df.collect()}


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute(docs, items)
    assert sum(v[4] for v in want.values()) > 0
    assert rows(queries.op5_winnow(spark, sf)) == want


@pytest.mark.parametrize("seed", range(3))
def test_random_words(spark, docs_of, seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "C", "été", "d1", "e"]
    some = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, some(n)) for i, n in enumerate([13, 14, 30, 13, 5, 12, 4, 20])] + [(8, ""), (9, None)]
    docs = [some(rng.randrange(80)) for _ in range(60)]
    docs += [some(7) + " " + items[rng.randrange(8)][1] + " " + some(9) for _ in range(30)] + [None, "", "!!"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert rows(winnow.report(winnow.contamination(docs_of(docs), bench))) == brute(list(enumerate(docs)), items)


def test_empty_tables_repeated_rows_and_clashing_columns(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert rows(winnow.report(winnow.contamination(docs_of(["a b"]), none)))[0][:2] == (2, 0)
    items = spark.createDataFrame([(None, "x y"), (1, "a b"), (1, "a b")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b x y", 5, "r"), (1, "a b x y", 5, "r"), (None, "q", 6, None)], "doc_id long, text string, rid int, key string")
    out = winnow.contamination(docs, items)
    assert {"rid", "key"} <= set(out.columns)
    assert sorted((r["rid"], r["n_hit"], r["items"]) for r in out.collect()) == [(5, 4, ["1"]), (5, 4, ["1"]), (6, 0, [])]
    assert winnow.contamination(docs.limit(0), items).count() == 0
