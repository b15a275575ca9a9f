"""Mixing sources to target weights by hash-threshold histograms.

Every row has a fixed place on a line of hashes (of its key, source and size). Words are
summed per source and hash bucket; the running sum over the buckets of a source tells in
which bucket its budget ends, and only the rows of that bucket are summed again, in 4096
finer buckets, until one row is left. The budget of a source has become a threshold on the
hash, and choosing rows is a comparison: nothing is sorted.

A target above a source's size is several passes over it. The thresholds of the passes are
nested: passes before the last take everything, and the last takes the rows below its
threshold, so a row taken n + 1 times is among those taken n times.

The row at the threshold does not fit. Where it leaves more than ``tolerance`` of the target
open, the line is walked again over the rows left that do fit, until the gap is small or no
row fits; at the very end one more row is taken if that brings the source nearer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlkit.llm.common import attach, discard, packed, unpacked, written
from crawlkit.operators.spread import ranked

#: A hash has DIGITS digits of BITS bits; a histogram has 2 ** BITS buckets per source.
BITS, DIGITS = 12, 5
PICK = "struct<least: bigint, most: bigint, a: bigint, b: bigint>"


def _line(*parts: Column) -> Column:
    """A place on the line: 60 bits."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 64 - BITS * DIGITS)


def _exact(value: Column | int) -> Column:
    """A number whose products are exact."""
    return (value if isinstance(value, Column) else F.lit(str(value))).cast("decimal(19,0)")


def _prepared(df: DataFrame, size: str, source: str, key: str, seed: int) -> DataFrame:
    """(row, src, size, h, g): ``h`` follows from the row's values, ``g`` parts equal rows by place."""
    row = packed(df)
    plain = row.select(
        "row",
        # Sorts by code point, NULL last.
        F.coalesce(F.concat(F.lit("0"), F.col(f"row.`{source}`").cast("string")), F.lit("1")).alias("src"),
        F.greatest(F.coalesce(F.col(f"row.`{size}`"), F.lit(0)).cast("bigint"), F.lit(0)).alias("size"),
        F.monotonically_increasing_id().alias("at"),
    )
    return plain.select(
        "row",
        "src",
        "size",
        _line(F.lit(seed), F.col(f"row.`{key}`").cast("string"), "src", "size").alias("h"),
        _line(F.lit(seed), "at").alias("g"),
    )


def targets(sources: DataFrame, weights: Sequence[int], repeats: int, budget: int | None = None) -> DataFrame:
    """(src, n, source_size, target) for sources with ``src, n, source_size``.

    Weights go round in the order of ``src``. Targets share ``budget`` words (default: all
    there are); one above ``repeats`` times its source stops there, and what it leaves is
    shared by the others by weight, until none is above. A share rises with every
    source that stops, so each round is one sum over the sources and the loop ends.
    """
    turn = F.array(*[F.lit(w).cast("bigint") for w in weights])
    order = ranked(sources, [], [F.col("src")], "rank")
    weighed = written(order.withColumn("weight", turn[((F.col("rank") - 1) % len(weights)).cast("int")]).drop("rank"), "weights")
    most = F.col("source_size") * repeats
    whole, weight = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = min((whole or 0) * repeats, whole or 0 if budget is None else budget)
    left, weight = budget, weight or 1
    while True:
        above = _exact(left) * _exact(F.col("weight")) > _exact(most) * _exact(weight)
        stopped, sharing = weighed.agg(F.sum(F.when(above, most)), F.sum(F.when(~above, F.col("weight")))).first()
        again = (budget - (stopped or 0), sharing or 1)
        if again == (left, weight):
            break
        left, weight = again
    share = (_exact(left) * _exact(F.col("weight"))).cast("double") / F.lit(float(weight))
    return weighed.withColumn("target", F.when(above, most.cast("double")).otherwise(share)).drop("weight")


def _picked() -> Column:
    """Whether one of the walks over the line took the row."""

    def takes(p: Column) -> Column:
        below = (F.col("h") < p.a) | ((F.col("h") == p.a) & (F.col("g") < p.b))
        return F.col("size").between(p.least, p.most) & below

    return F.exists("picks", takes)


def _free() -> Column:
    """Rows that the current walk may take."""
    return (F.col("size") > 0) & (F.col("size") <= F.col("most")) & ~_picked()


def _histogram(rows: DataFrame, state: DataFrame, level: int) -> DataFrame:
    """Words and rows per source and bucket, of the free rows in the open interval of ``level``."""
    digit = level if level < DIGITS else level - DIGITS
    shift = BITS * (DIGITS - 1 - digit)
    line, start = ("h", "a") if level < DIGITS else ("g", "b")
    inside = _free() & (F.shiftright(line, shift + BITS) == F.shiftright(start, shift + BITS))
    if level >= DIGITS:
        inside = inside & (F.col("h") == F.col("a"))
    near = attach(rows.select("src", "size", "h", "g"), state.where("open"), "src").where(inside)
    bucket = F.shiftright(line, shift).bitwiseAND((1 << BITS) - 1)
    return near.groupBy("src", bucket.alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("rows"))


def _narrowed(state: DataFrame, histogram: DataFrame, level: int) -> DataFrame:
    """Move every open source to the bucket where its gap ends (or behind the last bucket)."""
    digit = level if level < DIGITS else level - DIGITS
    shift = BITS * (DIGITS - 1 - digit)
    start = "a" if level < DIGITS else "b"
    # At most 2 ** BITS rows of a source.
    upto = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = histogram.withColumn("upto", F.sum("words").over(upto)).join(state.where("open").select("src", "gap"), "src")
    fits = F.col("upto") <= F.col("gap")
    found = sums.groupBy("src").agg(
        F.coalesce(F.max(F.when(fits, F.col("upto"))), F.lit(0)).alias("fitting"),
        F.min(F.when(~fits, F.struct("bucket", "rows"))).alias("edge"),
    )
    joined = state.join(found, "src", "left")
    here = F.col("open") & F.col("fitting").isNotNull()
    step = F.coalesce(F.col("edge.bucket"), F.lit(1 << BITS)).cast("bigint")
    return joined.select(
        *[c for c in state.columns if c not in (start, "gap", "open")],
        F.when(here, F.col(start) + F.shiftleft(step, shift)).otherwise(F.col(start)).alias(start),
        F.when(here, F.col("gap") - F.col("fitting")).otherwise(F.col("gap")).alias("gap"),
        (here & (F.coalesce(F.col("edge.rows"), F.lit(0)) > 1)).alias("open"),
    )


def _kept(new: DataFrame, old: DataFrame) -> DataFrame:
    """``new`` written in place of ``old``."""
    out = written(new, "mix-state")
    discard(old)
    return out


def thresholds(rows: DataFrame, first: DataFrame, state: DataFrame, tolerance: float) -> DataFrame:
    """``state`` with ``picks``: what the last pass over each source takes.

    ``first`` is the coarsest histogram of all rows.
    """
    none = F.array().cast(f"array<{PICK}>")
    zero, limit = F.lit(0).cast("bigint"), F.lit((1 << 62) - 1)
    state = written(state.withColumns({"picks": none, "a": zero, "b": zero, "most": limit, "open": F.col("gap") > 0}), "mix-state")
    walk = 0
    while state.where("open").limit(1).count():
        level = 0
        while level < 2 * DIGITS and state.where("open").limit(1).count():
            histogram = first if walk == level == 0 else _histogram(rows, state, level)
            state = _kept(_narrowed(state, histogram, level), state)
            level += 1
        moved = (F.col("a") > 0) | (F.col("b") > 0)
        taken = F.struct(zero.alias("least"), F.col("most"), F.col("a"), F.col("b"))
        wide = moved & (F.col("gap") > F.col("target") * tolerance)
        after = state.select(
            "src", "n", "source_size", "target", "full",
            F.when(moved, F.concat("picks", F.array(taken))).otherwise(F.col("picks")).alias("picks"),
            zero.alias("a"), zero.alias("b"), F.col("gap").alias("most"), "gap", wide.alias("open"),
        )
        state = _kept(after, state)
        walk += 1
        # A source stays open only while some row fits its gap.
        fitting = attach(rows.select("src", "size", "h", "g"), state.where("open"), "src").where(_free()).select("src").distinct()
        state = _kept(state.drop("open").join(fitting.withColumn("open", F.lit(True)), "src", "left").fillna(False, "open"), state)
    return _nearest(rows, state)


def _nearest(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Take the smallest row left where that ends nearer to the target."""
    waiting = attach(rows.select("src", "size", "h", "g"), state.where("gap > 0"), "src").where((F.col("size") > 0) & ~_picked())
    least = waiting.groupBy("src").agg(F.min(F.struct("size", "h", "g")).alias("least"))
    one = F.struct(
        F.col("least.size").alias("least"), F.col("least.size").alias("most"), F.col("least.h").alias("a"), (F.col("least.g") + 1).alias("b")
    )
    nearer = F.abs(F.col("gap") - F.col("least.size")) < F.col("gap")
    joined = state.join(least, "src", "left")
    return joined.select(
        "src", "n", "source_size", "target", "full", F.when(nearer, F.concat("picks", F.array(one))).otherwise(F.col("picks")).alias("picks")
    )


def mix(
    df: DataFrame, size: str = "size", source: str = "source", key: str = "doc_id", weights: Sequence[int] = (1, 2, 3),
    repeats: int = 3, budget: int | None = None, tolerance: float = 0.001, seed: int = 0,
) -> DataFrame:
    """Every row of ``df`` with ``source_size``, ``target`` (its source's), ``copies`` and ``taken``.

    ``copies`` says how often the mix takes the row and ``taken`` how many words that makes.
    NULL and negative sizes are 0; NULL sources are one source, the last. Rows with the same
    key, source and size share a hash and are told apart by their place in the input, so
    any of them may be taken, but always the same number. An empty table gives no rows;
    columns called like the new ones are replaced. Which rows are taken depends on nothing
    but their values and ``seed``.
    """
    rows = written(_prepared(df, size, source, key, seed), "mix-rows")
    bucket = F.shiftright("h", BITS * (DIGITS - 1))
    first = rows.groupBy("src", bucket.alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
    first = written(first, "mix-histogram")
    sources = first.groupBy("src").agg(F.sum("rows").alias("n"), F.sum("words").alias("source_size"))
    shared = targets(sources, weights, repeats, budget)
    full = F.coalesce(F.least(F.floor(F.try_divide("target", "source_size")), F.lit(repeats)), F.lit(0)).cast("bigint")
    state = shared.withColumn("full", full)
    state = state.withColumn("gap", F.round(F.col("target") - F.col("full") * F.col("source_size")).cast("bigint"))
    chosen = written(thresholds(rows, first, state, tolerance), "mix-thresholds")
    joined = attach(rows, chosen, "src").withColumn("copies", F.col("full") + _picked().cast("bigint"))
    return unpacked(
        joined,
        source_size=F.col("source_size"),
        target=F.col("target"),
        copies=F.col("copies"),
        taken=F.col("copies") * F.col("size"),
    )
