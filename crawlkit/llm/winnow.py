"""Benchmark decontamination by winnowing.

A span of 13 words shared by a document and a benchmark item has 9 runs of 5 words. The
document keeps, of every 9 runs in a row, the one with the smallest hash; so at least
one kept run lies inside each shared span, and the item, which posts all its runs, has
it too. Items of fewer words (one window each) are shorter than a winnowing window, so
for each of their lengths (1 to 12) all windows of the document count as kept.

Documents first drop the fingerprints that no item has, by a bitmap of fixed size
(2 MiB; no false negatives), and most documents stop there. The rest join the items'
fingerprints by hash. Each hit is extended on the full word sequences of the pair, where
whole windows are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlkit.llm.common import hex_digest, packed, unpacked, written
from crawlkit.llm.words import ALNUM, hashed, windows, words
from crawlkit.session import prepare

WINDOW = 13
RUN = 5
_BITS = 24


def _runs(h: np.ndarray) -> np.ndarray:
    """What an item posts: all runs, or its one window if it is short."""
    if not len(h):
        return np.empty(0, np.uint64)
    return np.unique(windows(h, RUN if len(h) >= WINDOW else len(h)))


def winnowed(runs: np.ndarray, size: int = WINDOW - RUN + 1) -> np.ndarray:
    """The smallest of every ``size`` hashes in a row, distinct."""
    if len(runs) < size:
        return np.empty(0, np.uint64)
    return np.unique(np.lib.stride_tricks.sliding_window_view(runs, size).min(axis=1))


def _fingerprints(h: np.ndarray, lengths: tuple[int, ...]) -> np.ndarray:
    return np.concatenate([winnowed(windows(h, RUN)), *[np.unique(windows(h, k)) for k in lengths]])


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate([*arrays, np.empty(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _item_posts(texts: pa.Array) -> pa.Array:
    hs = [hashed(words(t.as_py(), ALNUM)) for t in texts]
    return pa.StructArray.from_arrays(
        [pa.array([len(h) for h in hs], pa.int64()), _lists([_runs(h) for h in hs])], ["n", "posts"]
    )


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - _BITS)).astype(np.int64)


def _bitmap(posts: DataFrame) -> np.ndarray:
    """One bit per slot that a fingerprint falls in; 2 MiB however many there are."""
    byte = F.shiftrightunsigned("post", 64 - _BITS + 3)
    bit = F.pmod(F.shiftrightunsigned("post", 64 - _BITS), F.lit(8))
    by_byte = posts.groupBy(byte.alias("byte")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), bit.cast("int"))).alias("bits"))
    bits = np.zeros(1 << (_BITS - 3), np.uint8)
    for row in by_byte.toLocalIterator():  # at most 2^21 rows
        bits[row["byte"]] = row["bits"]
    return bits


def _covered(doc: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Starts and ends (flat) of the runs of document words inside the item's windows."""
    k = min(WINDOW, len(item))
    at = np.flatnonzero(np.isin(windows(doc, k), windows(item, k)))
    if not len(at):
        return np.empty(0, np.int64)
    breaks = np.flatnonzero(np.diff(at) > k)
    starts, ends = at[np.concatenate([[0], breaks + 1])], at[np.concatenate([breaks, [len(at) - 1]])] + k
    return np.column_stack([starts, ends]).ravel()


def _extended(doc_texts: pa.Array, item_texts: pa.Array) -> pa.Array:
    out = []
    for doc, item in zip(doc_texts, item_texts, strict=True):
        spans = _covered(hashed(words(doc.as_py(), ALNUM)), hashed(words(item.as_py(), ALNUM)))
        out.append([{"start": int(s), "end": int(e)} for s, e in spans.reshape(-1, 2)])
    return pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))


def contamination(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """Every row of ``docs`` with ``n_words``, ``n_hit``, ``items`` (sorted array of strings), ``contaminated``.

    Contaminated: a word is hit and at least one word in twenty is. NULL texts have no
    words, on both sides; an item without words matches nothing. Items with the same id
    are one item, a NULL item id counts in ``n_hit`` but is not listed. No documents or
    no items: no hits. Existing columns of the four names are replaced.
    """
    spark = prepare(docs.sparkSession)
    bench = items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("item_text"))
    bench = bench.withColumn("p", F.arrow_udf(_item_posts, "struct<n:bigint,posts:array<bigint>>")("item_text"))
    bench = written(bench.select("item", "item_text", F.monotonically_increasing_id().alias("key"), "p.*").where("n > 0"), "items")
    posts = bench.select(F.explode("posts").alias("post"), "key").distinct()
    lengths = tuple(sorted(r[0] for r in bench.where(F.col("n") < WINDOW).select("n").distinct().collect()))  # 12 at most
    bitmap = spark.sparkContext.broadcast(_bitmap(posts.select("post").distinct()))

    def scan(texts: pa.Array) -> pa.Array:
        bits, counts, kept = bitmap.value, [], []
        for t in texts:
            h = hashed(words(t.as_py(), ALNUM))
            prints = _fingerprints(h, lengths)
            slot = _slots(prints)
            counts.append(len(h))
            kept.append(prints[(bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1])
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), _lists(kept)], ["n", "prints"])

    whole = packed(docs).withColumns({"t": F.col(f"row.`{text}`"), "rid": F.monotonically_increasing_id()})
    scanned = whole.withColumn("s", F.arrow_udf(scan, "struct<n:bigint,prints:array<bigint>>")("t"))
    rows = written(scanned.select("rid", "row", F.col("s.n").alias("n"), F.col("s.prints").alias("prints")), "scanned")

    near = rows.select("rid", F.explode("prints").alias("post")).join(posts, "post").select("rid", "key").distinct()
    pairs = near.join(rows.where(F.size("prints") > 0).select("rid", F.col(f"row.`{text}`").alias("t")), "rid").join(bench, "key")
    hits = pairs.select(
        "rid", "item", F.arrow_udf(_extended, "array<struct<start:bigint,end:bigint>>")("t", "item_text").alias("spans")
    ).where(F.size("spans") > 0)
    # Spans of a document: no more than its words per item that occurs in it.
    by_doc = hits.groupBy("rid").agg(
        F.array_sort(F.collect_set("item")).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")
    )
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("to"))
    union = F.aggregate(
        "spans", zero,
        lambda a, s: F.struct(
            (a.n + F.greatest(s.end - F.greatest(s.start, a.to), F.lit(0))).alias("n"), F.greatest(a.to, s.end).alias("to")
        ),
        lambda a: a.n,
    )
    joined = rows.join(by_doc.select("rid", "items", union.alias("hit")), "rid", "left")
    hit = F.coalesce("hit", F.lit(0)).cast("bigint")
    return unpacked(
        joined,
        n_words=F.col("n"),
        n_hit=hit,
        items=F.coalesce("items", F.array().cast("array<string>")),
        contaminated=(hit > 0) & (20 * hit >= F.col("n")),
    )


def report(checked: DataFrame) -> DataFrame:
    return checked.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        hex_digest(F.array_join("items", ",")).alias("items_sha256"), "contaminated",
    )
