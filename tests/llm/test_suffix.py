"""Repeated strings against brute force."""

import hashlib
import random
import time

import numpy as np
import pyarrow as pa
import pytest

from crawlkit.llm import common, queries, suffix


def brute(texts):
    """(n_bytes, n_removed, n_spans, kept) per text."""
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d in data:
        for i in range(len(d) - 399):
            key = hashlib.md5(d[i : i + 400]).digest()
            seen[key] = seen.get(key, 0) + 1
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - 399):
            if seen[hashlib.md5(d[i : i + 400]).digest()] > 1:
                gone[i : i + 400] = b"\x01" * 400
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(d)))
        out.append((len(d), sum(gone), spans, bytes(b for b, g in zip(d, gone) if not g)))
    return out


def result(docs):
    out = {}
    for r in suffix.remove_repeats(docs).collect():
        out[r["doc_id"]] = (r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), bytes(r["kept"]))
    return [out[i] for i in range(len(out))]


@pytest.mark.parametrize("seed", range(2))
def test_random_texts_with_shared_passages(docs_of, seed):
    rng = random.Random(seed)
    some = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    pool = [some(rng.choice([350, 390, 399, 400, 401, 450, 700, 1500])) for _ in range(12)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(4)):
            parts += [some(rng.randrange(120)), rng.choice(pool)]
        texts.append("".join(parts) + some(rng.randrange(40)))
    base = some(3000)
    for _ in range(25):
        copy = list(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(3000)] = "x"
        texts.append("".join(copy))
    texts += ["ab" * 900, "a" * 1500, "a" * 400, "a" * 401, "b" * 400, None, "", "short", pool[7] * 2, texts[3]]
    assert result(docs_of(texts)) == brute(texts)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = brute([r["text"] for r in rows])
    got = {r["doc_id"]: r for r in queries.op10_suffix(spark, sf).collect()}
    assert sum(w[1] for w in want) > 0
    for row, (n, removed, spans, kept) in zip(rows, want):
        r = got[row["doc_id"]]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (n, removed, spans, hashlib.sha256(kept).hexdigest())


def test_choices_are_the_last_of_the_smallest():
    rng = np.random.default_rng(1)
    for top in (3, 50, 1 << 60):
        grams = rng.integers(0, top, 700, dtype=np.uint64)
        want = [i + 127 - int(np.argmin(grams[i : i + 128][::-1])) for i in range(700 - 127)]
        assert suffix.choices(grams).tolist() == want


def test_null_ids_repeated_rows_and_clashing_columns(spark):
    long = "lorem ipsum " * 10 + "".join(chr(97 + i * i % 23) for i in range(500))
    rows = [(None, long, 1, "x"), (1, long, 2, "y"), (1, None, 3, "z"), (2, "abc", 4, None)]
    out = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, n int, hi string"))
    got = sorted((r["n"], r["n_bytes"], len(r["spans"]), bytes(r["kept"])) for r in out.collect())
    assert got == [(1, 620, 1, b""), (2, 620, 1, b""), (3, 0, 0, b""), (4, 3, 0, b"abc")]
    assert suffix.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_files_of_earlier_jobs_are_gone_before_the_texts_are_shuffled(spark, docs_of, tmp_path, monkeypatch):
    rng = random.Random(5)
    pool = ["".join(rng.choice("abcdefgh ") for _ in range(2000)) for _ in range(40)]
    docs = docs_of([rng.choice(pool)[:1500] + str(i) * 99 + rng.choice(pool) for i in range(300)]).repartition(2)
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    tables = iter(range(100))
    monkeypatch.setattr(common, "scratch", lambda _, label: (tmp_path / f"{label}-{next(tables)}").as_uri())

    def shuffled():
        files = disk.getAllFiles()
        files = [files.apply(i) for i in range(files.size())]
        return {f.getPath(): f.length() for f in files if f.getName().startswith("shuffle_") and f.getName().endswith(".data")}

    before = shuffled()
    out = suffix.remove_repeats(docs)  # all jobs but the last
    for _ in range(50):  # files are deleted a little later
        left = sum(size for path, size in shuffled().items() if path not in before)
        if left < 2000:
            break
        time.sleep(0.2)
    assert left < 2000  # one sum that is read at once
    assert sorted(p.name.split("-")[0] for p in tmp_path.iterdir()) == ["marks", "symbols"]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") != "true"  # as it was
    assert out.where("n_bytes > octet_length(kept)").count() == 300


def test_very_long_text(docs_of):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_000_000))
    got = result(docs_of([long, "x" + long[500_000:501_000] + "y", "z" * 300_000]))
    assert [g[1] for g in got] == [1000, 1000, 300_000]


def test_cells_and_entries_come_in_bounded_blocks():
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh") for _ in range(900))
    place = np.unique(suffix.choices(suffix.Hashes(text.encode()).grams())).tolist()
    found = [[{"pos": p, "reach": suffix.FAR} for p in place]] * 3000
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("reach", pa.int32())]))
    rows = pa.RecordBatch.from_arrays([pa.array(range(3000), pa.int64()), pa.array([text] * 3000), pa.array(found, kind)], ["rid", "t", "r"])
    blocks = list(suffix._cells(iter([rows])))
    assert len(blocks) >= 3000 // 256 and sorted({i for b in blocks for i in b["rid"].to_pylist()}) == list(range(3000))
    assert len({tuple(r.values()) for b in blocks for r in b.drop_columns("rid").to_pylist()}) == blocks[0].num_rows // 256

    n = 3 * suffix.BLOCK
    named = [{"run": 0, "pos": i, "len": 1, "sym": i % 5, "name": i % 7} for i in range(n)]
    kind = pa.list_(pa.struct([("run", pa.int32()), ("pos", pa.int32()), ("len", pa.int32()), ("sym", pa.int64()), ("name", pa.int64())]))
    rows = pa.RecordBatch.from_arrays([pa.array([9], pa.int64()), pa.array([named], kind)], ["rid", "named"])
    seen = 0
    for b in suffix._entries(iter([rows])):
        assert b.num_rows <= suffix.BLOCK
        seen += b.num_rows
        for r in b.slice(0, 5).to_pylist():
            i, which = r["pos"], r["list"]
            assert r["sym"] == [k % 5 for k in range(i, min(n, i + suffix.DEPTH))] and i % 3 != (0, 2, 1)[which]
            assert r["names"] == ([k % 7 for k in range(i, i + suffix.DEPTH, 3)] if which == 0 else [])
            assert (r["k1"], r["k2"]) == (i % 5 if which else 0, (i + 1) % 5 if which == 2 else 0)
    assert seen == 2 * n


def test_runs_end_at_gaps_and_texts():
    live = [[(t, 60 * t, 60, t) for t in (0, 1, 2, 3, 5, 6)], [(t, 60 * t, 60, -t) for t in range(7, 10)]]
    names = ("t", "pos", "len", "sym")
    kind = pa.list_(pa.struct([("t", pa.int32()), ("pos", pa.int32()), ("len", pa.int32()), ("sym", pa.int64())]))
    rows = pa.RecordBatch.from_arrays([pa.array([4, 8], pa.int64()), pa.array([[dict(zip(names, x)) for x in r] for r in live], kind)], ["rid", "live"])
    got = [tuple(r.values()) for b in suffix._runs(iter([rows])) for r in b.to_pylist()]
    end = int(suffix.END)
    assert got == [
        (4, 0, 0, 0, 60, 0, 1, 2), (4, 0, 1, 60, 60, 1, 2, 3), (4, 0, 2, 120, 60, 2, 3, end), (4, 0, 3, 180, 60, 3, end, end),
        (8, 7, 0, 420, 60, -7, -8, -9), (8, 7, 1, 480, 60, -8, -9, end), (8, 7, 2, 540, 60, -9, end, end),
    ]
