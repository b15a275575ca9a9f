"""Co-training: held-out accuracy, calibration, odd inputs."""

import numpy as np
from pyspark.sql import functions as F

from crawlkit.llm import cotrain


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    seen = labels.where(F.pmod(F.hash("doc_id"), F.lit(5)) > 0)
    out = cotrain.classify(docs, seen).join(labels.subtract(seen).select("doc_id", "quality"), "doc_id")
    by = {(r["quality"], r["good"]): r["count"] for r in out.groupBy("quality", "good").count().collect()}
    good, bad = by.get((1, True), 0), by.get((0, False), 0)
    assert good / (good + by.get((1, False), 0)) > 0.98
    assert bad / (bad + by.get((0, True), 0)) > 0.9
    scores = out.select("quality", "quality_score").toPandas()
    assert ((scores.quality_score - scores.quality) ** 2).mean() < 0.05


def test_monotone():
    share = cotrain.monotone(np.array([0.0, 3, 1, 4, 4]), np.array([4.0, 4, 4, 4, 4]))
    assert share.tolist() == [0, 0.5, 0.5, 1, 1]


def test_no_labels_null_rows_repeats_and_clashes(spark):
    docs = spark.createDataFrame(
        [(None, None, None, None, 1, 2), (1, "a b", "en", "s", 3, 4), (1, "a b", "en", "s", 3, 4)],
        "doc_id long, text string, lang string, source string, key int, label int",
    )
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = cotrain.classify(docs, none)
    assert {"key", "label"} <= set(out.columns)
    assert [(r["quality_score"], r["key"]) for r in out.orderBy("key").collect()] == [(0.5, 1), (0.5, 3), (0.5, 3)]
    labels = spark.createDataFrame([(1, 0, 0), (1, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert cotrain.classify(docs, labels).count() == 3
    assert cotrain.classify(docs.limit(0), labels).count() == 0


def test_long_text_bins():
    assert len(cotrain.text_bins("é! " * 100_000)) == len(cotrain.TEXT)
    assert len(cotrain.page_bins("")) + 2 == len(cotrain.PAGE)


def test_every_source_has_its_own_odds(spark):
    many = 200
    rows = [(i, "the same words", "en", f"s{i % many}") for i in range(40 * many)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = docs.select("doc_id", F.substring("source", 2, 9).cast("int").alias("n"))
    labels = labels.where("doc_id < 32 * " + str(many)).select("doc_id", (F.col("n") % 2).alias("quality"))
    more = spark.createDataFrame([(-1, "the same words", "en", "unseen"), (-2, "the same words", "en", None)], docs.schema)
    out = cotrain.classify(docs.union(more), labels).select("doc_id", "source", "page_score").collect()
    assert len(out) == 40 * many + 2
    for r in out:
        if r["doc_id"] < 0:
            assert 0.2 < r["page_score"] < 0.8
        else:
            assert (r["page_score"] > 0.9) == (int(r["source"][1:]) % 2 == 1), r
