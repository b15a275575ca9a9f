"""Approximate membership: a Bloom filter kept as a table of blocks.

Each URL lives in one block, so a probe is one equi-join on the block number and no
task ever needs the whole filter. Blocks are small rows; whether they are broadcast is
left to the planner, which knows their size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 4096
WORD_BITS = 64


def shape(expected: int, fpr: float) -> tuple[int, int]:
    """Number of blocks and of hash positions for ``expected`` URLs.

    Blocks fill unevenly; sizing for 90% of the rate pays for that.
    """
    bits_per_url = -math.log(0.9 * fpr) / math.log(2) ** 2
    blocks = max(1, math.ceil(expected * bits_per_url / BLOCK_BITS))
    return blocks, max(1, round(bits_per_url * math.log(2)))


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url, F.lit("block")), F.lit(blocks))


def _positions(url: Column, hashes: int) -> Column:
    first = F.pmod(F.xxhash64(url, F.lit("first")), F.lit(BLOCK_BITS))
    step = F.pmod(F.xxhash64(url, F.lit("step")), F.lit(BLOCK_BITS // 2)) * 2 + 1
    return F.transform(
        F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(first + i * step, F.lit(BLOCK_BITS))
    )


def _word(position: Column) -> Column:
    return F.floor(position / WORD_BITS).cast("int")


def _mask(position: Column) -> Column:
    return F.call_function(
        "shiftleft", F.lit(1).cast("bigint"), F.pmod(position, F.lit(WORD_BITS)).cast("int")
    )


def build(urls: DataFrame, expected: int, fpr: float = 0.01) -> DataFrame:
    """``(block, words)`` rows. At most 64 words per block, whatever the input."""
    blocks, hashes = shape(expected, fpr)
    bits = urls.select(
        _block(F.col("url"), blocks).alias("block"),
        F.explode(_positions(F.col("url"), hashes)).alias("p"),
    )
    words = bits.groupBy("block", _word(F.col("p")).alias("word")).agg(
        F.bit_or(_mask(F.col("p"))).alias("bits")
    )
    return words.groupBy("block").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words")
    )


def approx_seen(
    candidates: DataFrame, bloom: DataFrame, expected: int, fpr: float = 0.01
) -> DataFrame:
    """Add ``maybe_seen``: false is certain, true is wrong at about the given rate."""
    blocks, hashes = shape(expected, fpr)
    hit = F.forall(
        _positions(F.col("url"), hashes),
        lambda p: F.coalesce(F.try_element_at("words", _word(p)), F.lit(0).cast("bigint")).bitwiseAND(
            _mask(p)
        )
        != 0,
    )
    probe = candidates.withColumn("block", _block(F.col("url"), blocks))
    return (
        probe.join(bloom, "block", "left")
        .withColumn("maybe_seen", F.coalesce(hit, F.lit(False)))
        .drop("block", "words")
    )


def measure(candidates: DataFrame, seen: DataFrame, fpr: float = 0.01) -> DataFrame:
    """Compare the filter with the exact set over the distinct candidate URLs."""
    expected = seen.count()
    tested = approx_seen(
        candidates.select("url").distinct(), build(seen, expected, fpr), expected, fpr
    )
    exact = tested.join(
        seen.select("url", F.lit(True).alias("is_seen")), "url", "left"
    ).withColumn("is_seen", F.coalesce("is_seen", F.lit(False)))
    return exact.agg(
        F.count_if("is_seen").alias("n_seen"),
        F.count_if(~F.col("is_seen")).alias("n_unseen"),
        F.count_if(F.col("is_seen") & ~F.col("maybe_seen")).alias("n_false_negative"),
        F.count_if(~F.col("is_seen") & F.col("maybe_seen")).alias("n_false_positive"),
    )
