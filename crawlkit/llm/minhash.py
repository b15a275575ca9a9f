"""Near-duplicates by an inverted join over MinHash signature coordinates.

A document's set holds its distinct 5-word shingles. Equal sets are one node. Each node
posts itself under its 64 pairs (coordinate, minimum); two sets of similarity 0.75 agree
in 48 of them on average, and pairs below ``MATCHES`` agreements are not looked at (a
link of similarity 0.75 is missed with a chance of about 1e-7).

- *Prefix*: pairs are ordered from rare to frequent. Nodes with that many agreements
  share one of their first ``64 - MATCHES + 1`` pairs, so only those are joined. Pairs
  that only one node has still fill the prefix, hence most documents post nothing.
- *Bound*: a node of which over a quarter is its own posts nothing. Shingles of exactly two
  nodes name their pair themselves, and are counted per pair. All other pairs have only
  shingles in common that three nodes or more have. These are counted in 64 classes of
  the hash; the sum of the smaller counts bounds what a pair can share, and a pair is
  only made if that could reach the threshold for both sizes.
- *Skip*: a posting list inside one component is passed over as a whole. Star rounds
  compare every component with one leader per list, and contract; only what is left is
  joined list by list, and only across components. Groups of near copies therefore
  cost about their size per round, not its square.

Agreements of a candidate pair are counted over both whole signatures, and links are
confirmed on the full sets (64-bit shingle hashes) before they contract anything.

Whole texts go through no shuffle but those of documents in groups, once: rows are picked where
they lie by bitmaps of their numbers, a bit per row.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlkit.llm.common import SMALL, discard, packed, unpacked, written
from crawlkit.llm.components import components
from crawlkit.llm.words import LOWER, hashed, mixed, windows, words
from crawlkit.session import prepare

SHINGLE = 5
PERCENT = 75
COORDINATES = 64
#: Least agreements of a candidate pair.
MATCHES = 30
STAR_ROUNDS = 2
#: Classes of shingles that the bound counts in.
CLASSES = 64
_BLOCK = 4096


@cache
def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    draw = rng.integers(0, 1 << 63, (2, COORDINATES, 1), dtype=np.uint64)
    return draw[0], draw[1] | np.uint64(1)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter text is one shingle, no words give none."""
    h = hashed(words(text, LOWER))
    return np.unique(windows(h, min(SHINGLE, max(len(h), 1))))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum under each hash function; the low 6 bits name the coordinate."""
    xor, odd = _functions()
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), _BLOCK):
        v = (shingles[None, at : at + _BLOCK] ^ xor) * odd
        v ^= v >> np.uint64(32)
        least = np.minimum(least, (v * odd).min(axis=1))
    return (least & ~np.uint64(COORDINATES - 1)) | np.arange(COORDINATES, dtype=np.uint64)


SIGNED = "struct<n:bigint,hi:bigint,lo:bigint,sig:array<bigint>>"


def _signed(texts: pa.Array) -> pa.Array:
    n, hi, lo, sig = [], [], [], []
    for text in texts:
        s = shingle_set(text.as_py())
        n.append(len(s))
        digest = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
        hi.append(int(digest[0]))
        lo.append(int(digest[1]))
        sig.append(signature(s).view(np.int64) if len(s) else np.empty(0, np.int64))
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in sig])]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*sig, np.empty(0, np.int64)])))
    return pa.StructArray.from_arrays(
        [pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), lists], ["n", "hi", "lo", "sig"]
    )


SETS = "struct<shingles:array<bigint>,classes:array<int>>"


def _sets(texts: pa.Array) -> pa.Array:
    """Full sets, and how many shingles fall in each class."""
    sets = [shingle_set(t.as_py()).view(np.int64) for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
    shingles = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*sets, np.empty(0, np.int64)])))
    classes = [np.bincount(x & (CLASSES - 1), minlength=CLASSES).tolist() for x in sets]
    return pa.StructArray.from_arrays([shingles, pa.array(classes, pa.list_(pa.int32()))], ["shingles", "classes"])


def _parted(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose ``rid`` is in ``ids`` (written, no repeats), and the others; none is shuffled.

    A bitmap of 4 KiB marks up to 32768 rows of a part, and they are broadcast. Of more than
    SMALL bitmaps none is made use of: then the rows are joined by ``rid``.
    """
    chunked = ids.select("rid", F.shiftright("rid", 15).alias("chunk")).repartition("chunk")
    marks = written(chunked.groupBy("chunk").agg(F.bitmap_construct_agg(F.col("rid").bitwiseAND(32767)).alias("bits")), "marks")
    if marks.count() > SMALL:
        return rows.join(ids, "rid", "left_semi"), rows.join(ids, "rid", "left_anti")
    byte = "conv(hex(substring(bits, cast(shiftright(rid & 32767, 3) as int) + 1, 1)), 16, 10)"
    inside = F.expr(f"coalesce(shiftright(cast({byte} as int), cast(rid & 7 as int)) & 1, 0) = 1")
    marked = rows.withColumn("chunk", F.shiftright("rid", 15)).join(F.broadcast(marks), "chunk", "left").withColumn("inside", inside)
    return marked.where("inside").select(*rows.columns), marked.where("not inside").select(*rows.columns)


def _confirmed(pairs: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) that agree often enough and whose full sets are similar enough."""
    side = nodes.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"), F.col("n").alias("n_a"))
    other = nodes.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"), F.col("n").alias("n_b"))
    agree = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda e: e))
    near = pairs.join(side, "a").join(other, "b").where(agree >= MATCHES).select("a", "b", "n_a", "n_b")
    near = written(near, "near")
    full = near.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b"
    )
    common = full.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("set_a", "set_b")).cast("bigint").alias("c"))
    return written(common.where(100 * F.col("c") >= PERCENT * (F.col("n_a") + F.col("n_b") - F.col("c"))).select("a", "b"), "links")


def _shared(sets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per node (n, shared, common): its shingles, those of two candidates or more, and those of
    three or more by class; and per pair (a, b, both) the shingles that only these two have; and the table both are read from."""
    each = sets.select("node", F.explode("shingles").alias("shingle"))
    lists = each.groupBy("shingle").agg(F.count("*").alias("f"), F.min("node").alias("a"), F.max("node").alias("b"))
    kind = F.pmod("shingle", F.lit(CLASSES)).cast("int").alias("class")
    few = written(lists.where("f < 3").groupBy("a", "b", kind).agg(F.count("*").cast("int").alias("k")), "few")
    own = few.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("k").alias("own"))
    pairs = few.where("a < b").groupBy("a", "b").agg(F.sum("k").alias("both"))
    # At most two entries per shingle of a node, and one per class and partner.
    rare = few.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("node"), "class", "k")
    rare = rare.groupBy("node", "class").agg(F.sum("k").cast("int").alias("k"))
    rare = rare.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("class", "k"))).alias("rare"))
    sizes = sets.select("node", "classes", F.size("shingles").cast("bigint").alias("n"))
    sizes = sizes.join(own, "node", "left").join(rare, "node", "left")
    common = F.transform("classes", lambda c, i: c - F.coalesce(F.try_element_at("rare", i), F.lit(0)))
    return sizes.select("node", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("shared"), common.alias("common")), pairs, few


def _overlap(a: str, b: str) -> Column:
    """Most shingles that two nodes can share, from their counts by class."""
    least = F.zip_with(a, b, lambda x, y: F.least(x, y))
    return F.aggregate(least, F.lit(0), lambda total, x: total + x)


def _possible(most: Column, n: str = "n", n_b: str = "n_b") -> Column:
    """Whether ``most`` common shingles c could give c / (n + n_b - c) >= PERCENT / 100."""
    return (100 + PERCENT) * most >= PERCENT * (F.col(n) + F.col(n_b))


def _open_lists(posts: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Posts (v, node, n, shared, common, comp) of the lists that still hold more than one component."""
    if comps is None:
        placed = posts.withColumn("comp", F.col("node"))
    else:
        placed = posts.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    spread = placed.groupBy("v").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("v")
    return written(placed.join(spread, "v", "left_semi"), "lists")


def _star(lists: DataFrame, salt: int) -> DataFrame:
    """For each component the pair (a, b) of one of its nodes and a list's leader that collides most.

    The first leaders are the nodes with the least of their own, which copies are made of;
    later ones are drawn by a hash.
    """
    first = F.when(F.lit(salt == 0), (F.col("n") - F.col("shared")) / F.col("n")).otherwise(0.0)
    order = F.struct(first.alias("own"), F.xxhash64("node", F.lit(salt)).alias("h"), "node", "comp", "n", "shared")
    leader = lists.groupBy("v").agg(F.min(order).alias("l"))
    met = lists.join(leader, "v").where(
        (F.col("comp") != F.col("l.comp")) & _possible(F.least("shared", "l.shared"), "n", "l.n")
    )
    counted = met.groupBy("comp", F.col("node").alias("a"), F.col("l.node").alias("b")).agg(F.count("*").alias("hits"))
    best = counted.groupBy("comp").agg(F.max(F.struct("hits", "a", "b")).alias("m"))
    return best.select(F.least("m.a", "m.b").alias("a"), F.greatest("m.a", "m.b").alias("b")).distinct()


def _across(lists: DataFrame) -> DataFrame:
    """Pairs (a, b) that share a list, lie in different components and may be linked by common shingles."""
    other = lists.select("v", *[F.col(c).alias(f"{c}_b") for c in ("node", "comp", "n", "common")])
    pairs = lists.join(other, "v").where(
        (F.col("comp") < F.col("comp_b")) & _possible(F.least("n", "n_b")) & _possible(_overlap("common", "common_b"))
    )
    return pairs.select(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b")).distinct()


def _by_two(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs (a, b) that may be linked with the shingles that only they have."""
    a = sizes.select(F.col("node").alias("a"), "n", "common")
    b = sizes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("common").alias("common_b"))
    both = pairs.join(a, "a").join(b, "b")
    return both.where(_possible(_overlap("common", "common_b") + F.col("both"))).select("a", "b")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with ``n_shingles``, ``component_id``, ``kept`` and ``first``.

    ``component_id`` is the smallest id among the rows reachable over links, itself
    included; ``kept`` says whether it is the row's own; ``first`` marks exactly one row
    of each component (of rows with the same id the first read). Texts that are NULL or
    have no words link with nothing. A NULL id never is a component's id unless all of
    its rows have none; such rows count as kept. Existing columns of the four names are
    replaced. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    whole = packed(docs).withColumns({"rid": F.monotonically_increasing_id(), "t": F.col(f"row.`{text}`")})
    signed = whole.select("rid", "row", F.arrow_udf(_signed, SIGNED)("t").alias("s"))
    rows = written(signed.select("rid", "row", "s.*"), "signed")
    rows = rows.withColumns({"id": F.col(f"row.`{doc_id}`"), "t": F.col(f"row.`{text}`")})
    place = F.struct(F.col("id").isNull().alias("none"), "id", "rid")
    nodes = written(
        rows.where("n > 0").groupBy("hi", "lo").agg(
            F.min("rid").alias("node"), F.min(place).alias("place"), F.min_by("sig", "rid").alias("sig"), F.min("n").alias("n"),
            F.count("*").alias("copies"),
        ),
        "nodes",
    )

    posted = nodes.select("node", F.explode("sig").alias("v"))
    shared = posted.join(posted.groupBy("v").agg(F.count("*").alias("f")).where("f > 1"), "v")
    # At most 64 pairs per node; its other pairs are its own and stand first.
    ordered = shared.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("f", "v"))).alias("e"))
    free = F.size("e") - (MATCHES - 1)
    posts = written(ordered.where(free > 0).select("node", F.explode(F.slice("e", F.lit(1), free)).alias("e")).select("node", "e.v"), "posts")

    wanted = written(posts.select(F.col("node").alias("rid")).distinct(), "wanted")
    texts, _ = _parted(rows.select("rid", "t"), wanted)
    sets = written(texts.select(F.col("rid").alias("node"), F.arrow_udf(_sets, SETS)("t").alias("s")).select("node", "s.*"), "sets")
    sizes, pairs, few = _shared(sets)
    sizes = written(sizes, "sizes")
    by_two = written(_by_two(pairs, sizes), "by-two")
    prefixes = posts
    posts = written(prefixes.join(sizes.where(100 * F.col("shared") >= PERCENT * F.col("n")), "node"), "posts")
    discard(wanted, few, prefixes)

    links, comps = None, None
    for round_ in range(STAR_ROUNDS + 1):
        lists = _open_lists(posts, comps)
        if round_ < STAR_ROUNDS:
            pairs = _star(lists, round_)
        else:
            end = comps.select(F.col("node").alias("a"), F.col("comp").alias("x"))
            other = comps.select(F.col("node").alias("b"), F.col("comp").alias("y"))
            apart = by_two.join(end, "a", "left").join(other, "b", "left").where("x is null or y is null or x <> y")
            pairs = _across(lists).unionByName(apart.select("a", "b")).distinct()
        found = _confirmed(pairs, nodes, sets)
        discard(lists)
        links = found if links is None else links.unionByName(found)
        comps = components(links)

    # A text without copies or links is its own group.
    grouped = nodes.join(comps, "node", "left").where("comp is not null or copies > 1").withColumn("comp", F.coalesce("comp", "node"))
    least = grouped.groupBy("comp").agg(F.min("place").alias("best"))
    homes = grouped.join(least, "comp").select("hi", "lo", "best")
    members = written(rows.where("n > 0").select("rid", "hi", "lo").join(homes, ["hi", "lo"]).select("rid", "best"), "members")
    discard(nodes, sets, sizes, by_two, posts)
    inside, outside = _parted(rows.select("rid", "row", "n", "id"), members.select("rid"))
    alone = outside.withColumn("best", F.lit(None).cast(members.schema["best"].dataType))
    placed = inside.join(members, "rid").unionByName(alone)
    component = F.when(F.col("best").isNotNull(), F.col("best.id")).otherwise(F.col("id"))
    return unpacked(
        placed,
        n_shingles=F.col("n"),
        component_id=component,
        kept=component.eqNullSafe(F.col("id")),
        first=F.coalesce(F.col("best.rid") == F.col("rid"), F.lit(True)),
    )
