"""An approximate seen set that grows: layers of Bloom filters, kept as tables.

A layer is built for a number of URLs. When the next batch would not fit, a layer of twice
the size is opened and the old ones are only read from then on, so no layer is ever
overfilled. Layer i may err at ``fpr / 2 ** (i + 1)``, which adds up to less than ``fpr``
over any number of layers. A URL is taken for seen if any layer has all its bits.

The bits of a batch are a folder of their own; the words of a layer merge by ``bit_or``, in
any order, so batches add to a layer without rewriting it and a replay replaces its own.
Positions come from MD5, which other systems have too, so a filter can be recomputed there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from crawlkit.operators.bloom import BLOCK_BITS, WORD_BITS, shape
from crawlkit.operators.frontier import accepted
from crawlkit.operators.spread import first_per_key
from crawlkit.session import forget, materialize
from crawlkit.sources.files import exists, glob, remove

CAPACITY, FPR = 1 << 20, 0.01
BITS = "block BIGINT, word INT, bits BIGINT, layer INT, batch BIGINT"


def layer_shape(layer: int, capacity: int = CAPACITY, fpr: float = FPR) -> tuple[int, int]:
    """Number of blocks and of hash positions of a layer."""
    return shape(capacity << layer, fpr / 2 ** (layer + 1))


def _number(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint")


def _places(digest: Column, blocks: int, hashes: int) -> Column:
    """(block, word, mask) of each position of a URL, words joined."""
    block = F.pmod(_number(digest, 1), F.lit(blocks))
    first, step = F.pmod(_number(digest, 9), F.lit(BLOCK_BITS)), F.pmod(_number(digest, 17), F.lit(BLOCK_BITS // 2)) * 2 + 1

    def place(i: Column) -> Column:
        p = F.pmod(first + i * step, F.lit(BLOCK_BITS))
        mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(p, F.lit(WORD_BITS)).cast("int"))
        return F.struct(block.alias("block"), F.floor(p / WORD_BITS).cast("int").alias("word"), mask.alias("mask"))

    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), place)


class ScalingBloom:
    """The layers under ``path``; ``capacity`` is the first one's."""

    def __init__(self, spark: SparkSession, path: str, capacity: int = CAPACITY, fpr: float = FPR):
        self.spark, self.path, self.capacity, self.fpr = spark, path, capacity, fpr

    def filled(self, before: int) -> dict[int, int]:
        """URLs per layer after the batches before ``before``."""
        if not exists(self.spark, f"{self.path}/filled"):
            return {}
        rows = self.spark.read.schema("layer INT, n BIGINT, batch BIGINT").parquet(f"{self.path}/filled")
        sums = rows.where(F.col("batch") < before).groupBy("layer").agg(F.sum("n").alias("n"))
        return {r.layer: r.n for r in sums.collect()}  # one row per layer

    def _marked(self, urls: DataFrame, layer: int) -> DataFrame:
        blocks, hashes = layer_shape(layer, self.capacity, self.fpr)
        digest = F.md5(F.concat(F.lit(f"{layer}:"), F.col("url")))
        return urls.select("url", F.inline(_places(digest, blocks, hashes)))

    def words(self, layer: int, before: int) -> DataFrame:
        """(block, word, bits) of a layer: all batches' bits merged."""
        rows = self.spark.read.schema(BITS).parquet(f"{self.path}/bits")
        mine = rows.where((F.col("layer") == layer) & (F.col("batch") < before))
        return mine.groupBy("block", "word").agg(F.bit_or("bits").alias("bits"))

    def maybe_seen(self, urls: DataFrame, before: int) -> DataFrame:
        """Those of the distinct ``urls`` that some layer has: all truly seen ones, and a few more."""
        hits = [urls.select("url").limit(0)]
        for layer in sorted(self.filled(before)):
            hashes = layer_shape(layer, self.capacity, self.fpr)[1]
            met = self._marked(urls, layer).join(self.words(layer, before), ["block", "word"])
            bits = met.where(F.col("bits").bitwiseAND(F.col("mask")) != 0).groupBy("url").agg(F.count("*").alias("n"))
            hits.append(bits.where(F.col("n") == hashes).select("url"))
        out = hits[0]
        for part in hits[1:]:
            out = out.unionByName(part)
        return out.distinct()

    def add(self, urls: DataFrame, batch: int) -> int:
        """Put distinct ``urls`` into the first layer with room for all of them; returns the layer.

        ``urls`` is read twice: give a written table.
        """
        n, filled = urls.count(), self.filled(batch)
        layer = max(filled, default=0)
        while filled.get(layer, 0) + n > self.capacity << layer:
            layer += 1
        words = self._marked(urls, layer).groupBy("block", "word").agg(F.bit_or("mask").alias("bits"))
        words.write.mode("overwrite").parquet(f"{self.path}/bits/layer={layer}/batch={batch}")
        told = self.spark.range(1).select(F.lit(layer).alias("layer"), F.lit(n).cast("bigint").alias("n"))
        told.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/filled/batch={batch}")
        return layer

    def compact(self, before: int, most: int = 32) -> None:
        """Merge the folders of each layer that has more than ``most`` of them, batches before ``before``."""
        for layer in self.filled(before):
            folders = [int(p.rsplit("=", 1)[1]) for p in glob(self.spark, f"{self.path}/bits/layer={layer}/batch=*")]
            old = [b for b in folders if b < before]
            if len(old) > most:
                merged = materialize(self.words(layer, before), "layer")
                # Bits are only ever added: the oldest folder may hold all of them before the others go.
                merged.write.mode("overwrite").parquet(f"{self.path}/bits/layer={layer}/batch={min(old)}")
                forget(merged)
                for b in set(old) - {min(old)}:
                    remove(self.spark, f"{self.path}/bits/layer={layer}/batch={b}")


def route_approx(requests: DataFrame, seen: ScalingBloom, batch: int, path: str) -> None:
    """Write ``requests`` (``id, ts, url``) as routed rows, and mark the new URLs as seen.

    The first request of a URL that no layer knows is fetched, all else is rejected. A seen
    URL is never fetched again; a new one is rejected at the filter's rate. Folders are
    named by batch, so a replay gives the same rows.
    """
    asked = accepted(requests).select("id", "ts", "url", F.monotonically_increasing_id().alias("row"))
    rows = materialize(asked, "asked")
    firsts = first_per_key(rows, ["url"], [F.col("ts"), F.col("id"), F.col("row")]).select("url", "row")
    distinct = materialize(firsts, "firsts")
    fresh = materialize(distinct.join(seen.maybe_seen(distinct, batch), "url", "left_anti"), "fresh")
    marked = rows.join(fresh.select("row", F.lit("fetch").alias("route")), "row", "left")
    marked.select("id", "ts", "url", F.coalesce("route", F.lit("reject")).alias("route")).write.mode("overwrite").parquet(
        f"{path}/batch={batch}"
    )
    seen.add(fresh.select("url"), batch)
    for df in (rows, distinct, fresh):
        forget(df)


def ingest_stream_approx(
    requests: DataFrame, path: str, checkpoint: str, capacity: int = CAPACITY, fpr: float = FPR
) -> StreamingQuery:
    """Route each micro-batch by the filter under ``<path>/seen``; rows go to ``<path>/routed``."""

    def route(batch: DataFrame, batch_id: int) -> None:
        seen = ScalingBloom(batch.sparkSession, f"{path}/seen", capacity, fpr)
        seen.compact(batch_id)
        route_approx(batch, seen, batch_id, f"{path}/routed")

    return (
        requests.writeStream.foreachBatch(route)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_approx(spark: SparkSession, path: str) -> DataFrame:
    """``id, ts, url, route, batch`` of everything routed."""
    return spark.read.parquet(f"{path}/routed")
