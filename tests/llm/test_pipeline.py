"""The pipeline against brute force, stage by stage."""

import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.llm import test_bpe, test_minhash, test_winnow

import corpus_pipeline
from crawlkit import session
from crawlkit.llm import bpe, fertility, minhash, pii, queries, suffix, winnow

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows after each stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out, columns = [docs.collect()], docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        out.append(docs.collect())
    out.append(corpus_pipeline.tokenize(spark, docs, SF).collect())
    return out


def ids(rows):
    return sorted(r["doc_id"] for r in rows)


def test_names_and_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "near duplicates", "decontamination", "pseudonyms", "tokens"]


def test_quality_rules(spark, stages):
    kept = [r["doc_id"] for r in queries.op2_fertility(spark, SF).where("kept").collect()]  # has its own brute force
    assert ids(stages[1]) == sorted(kept) and len(kept) < len(stages[0])


def test_near_duplicates(stages):
    want = test_minhash.brute([(r["doc_id"], r["text"]) for r in stages[1]])
    assert ids(stages[2]) == sorted(doc for doc, (_, component) in want.items() if doc == component)
    assert len(stages[2]) < len(stages[1])


def test_decontamination(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = test_winnow.brute([(r["doc_id"], r["text"]) for r in stages[2]], items)
    assert ids(stages[3]) == sorted(doc for doc, row in want.items() if not row[4])
    assert len(stages[3]) < len(stages[2])


def test_pseudonyms(spark, stages):
    before = {r["doc_id"]: r for r in stages[3]}
    assert ids(stages[4]) == ids(stages[3])
    after = spark.createDataFrame(stages[4])
    back = {r["doc_id"]: r["text"] for r in pii.pseudonymize(after, queries.PII_KEY, undo=True).collect()}
    changed = 0
    for r in stages[4]:
        text = before[r["doc_id"]]["text"]
        assert back[r["doc_id"]] == text and r["n_chars"] == len(r["text"])
        changed += r["text"] != text
    assert changed > 0


def test_tokens(stages):
    texts = {r["doc_id"]: r["text"] for r in stages[4]}
    assert ids(stages[5]) == ids(stages[4])
    for r in stages[5]:
        want, decoded = test_bpe.expect(texts[r["doc_id"]] or "")
        assert r["ids"] == want and r["n_tokens"] == len(want)
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_run(spark, stages):
    got = {tuple(r[c] for c in ("doc_id", "n_tokens", "ids_sha256")) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {tuple(r[c] for c in ("doc_id", "n_tokens", "ids_sha256")) for r in stages[5]}


def test_empty_and_null_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for some in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[1:]:
            assert stage(spark, some, SF).count() <= some.count()


def test_batches_of_long_texts_are_bounded_by_bytes(spark):
    """10,000 long texts at once filled an executor's memory."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 2000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("many words "), 1000).alias("text"), F.lit("en").alias("lang"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["bytes"])

    had = spark.conf.get(key, None)
    operators = (
        lambda d: fertility.measure(d, *queries.FERTILITY), minhash.near_duplicates, lambda d: suffix.remove_repeats(d),
        lambda d: bpe.encode(d, queries.WORD_BPE), lambda d: winnow.contamination(d, spark.createDataFrame([("1", "a b")], "item_id string, text string")),
    )
    try:
        for operator in operators:
            spark.conf.unset(key)
            operator(docs.limit(0))
            assert docs.select("text").mapInArrow(sizes, "bytes long").agg(F.max("bytes")).first()[0] < 8 << 20
        spark.conf.set(key, "1048576")
        session.prepare(spark)
        assert spark.conf.get(key) == "1048576"
    finally:
        spark.conf.set(key, had) if had else spark.conf.unset(key)
