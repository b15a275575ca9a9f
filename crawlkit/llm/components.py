"""Connected components by repeated contraction, over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlkit.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b); ``comp`` is one node of the component.

    Each round sends every node to the first, in the order of a hash, among itself and its
    neighbours, and relabels the edges. The order is random, so a constant share of the
    nodes goes in each round, chains included. The tables of a round are written to
    shared storage; no list of links or nodes reaches the driver.
    """
    left = written(edges.where("a <> b").select("a", "b").distinct(), "edges")
    labels = left.select(F.col("a").alias("node"), F.col("b").alias("comp")).limit(0)
    first = True
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        both = both.select("a", F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("node")).alias("other"))
        nearest = both.groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        own = F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("node"))
        to = written(nearest.select("node", F.least(own, F.col("other"))["node"].alias("to")), "step")
        if first:
            labels, first = to.select("node", F.col("to").alias("comp")), False
        else:
            moved = labels.join(to.withColumnRenamed("node", "comp"), "comp", "left")
            labels = written(moved.select("node", F.coalesce("to", "comp").alias("comp")), "labels")
        ends = left.join(to.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(
            to.select(F.col("node").alias("b"), F.col("to").alias("y")), "b"
        )
        left = written(ends.select(F.col("x").alias("a"), F.col("y").alias("b")).where("a <> b").distinct(), "edges")
    return labels
