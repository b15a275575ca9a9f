"""Removal of repeated byte strings with a distributed difference-cover suffix sort.

Every byte covered by a string of ``LENGTH`` bytes that starts anywhere else too is
removed. A suffix per byte would shuffle many times the corpus, so suffixes start at
anchors instead, and bytes come in again where the sort found repeats:

1. *Symbols.* Of every 128 consecutive 16-byte grams the one with the smallest hash (the
   last of equals) is an anchor. The choice depends on those 143 bytes alone, so equal
   strings of 400 bytes have the same anchors from their first 143 bytes to their last,
   and the same chunks between them. A chunk's hash is a symbol. Symbols that occur once
   end a run; texts that are equal as a whole count once from here on.
2. *Sample.* Suffixes at positions 1 and 2 modulo 3 of a run are named by triples of
   symbols. The recursion works on the string of names: its suffixes are sorted by their
   next names, far enough for 400 bytes or 24 symbols, which gives their ranks.
3. *Merge.* A suffix at position 0 is its symbol followed by a sampled suffix, hence the
   pair (symbol, rank) orders it among the suffixes at position 1, and (symbol, symbol,
   rank) among those at position 2. The three orders (sample; 0 with 1; 0 with 2) are
   sorted together as one table, and each suffix stands in two of them, so its longest
   common prefix with any other suffix is one with a neighbour.
4. *Adjacent prefixes* are compared in sorted order; partition edges are compared with
   each other. A string can only be repeated if the suffix at its first anchor has a
   common prefix up to its last anchor. That leaves few strings besides repeated ones.
5. *Check.* Those are compared on whole bytes by 128-bit hashes: first in cells of up to 32
   strings around an anchor (a cell that recurs as a whole is repeated, a cell whose
   common core does not recur is not), then the strings of the other cells one by one.

Any order of the symbols makes equal prefixes neighbours, so symbols sort by their value
as hashes; names are numbers in the sorted order of the triples. Equal keys are told apart by row, so no group has to fit in a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlkit.llm.common import HEAVY, discard, packed, settled, unpacked
from crawlkit.session import prepare

LENGTH = 400
GRAM = 16
SPACE = 128
#: Bytes of one choice of an anchor.
REACH = SPACE + GRAM - 1
#: Symbols compared at most; agreement in all of them counts as far enough.
DEPTH = 24
CELL = 32
FAR = 1 << 30
#: Tasks over which the rows of one heavy symbol are dealt.
SALTS = 64

_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_BYTES = np.random.default_rng(11).integers(1, 1 << 63, (2, 256), dtype=np.uint64)


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of both bases and of their inverses modulo 2^64."""

    def series(base: int) -> np.ndarray:
        factors = np.full(size, base, np.uint64)
        factors[0] = 1
        return np.cumprod(factors)

    return np.stack([series(b) for b in _BASES]), np.stack([series(pow(b, -1, 1 << 64)) for b in _BASES])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Hashes:
    """Hashes of any stretch of a text's bytes, from prefix sums."""

    def __init__(self, data: bytes, which: tuple[int, ...] = (0, 1)):
        n = len(data)
        power, self.inverse = _powers(1 << max(17, n.bit_length()))
        codes = np.frombuffer(data, np.uint8)
        self.sums = {}
        for w in which:
            self.sums[w] = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTES[w][codes] * power[w][:n], out=self.sums[w][1:])

    def of(self, w: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[w][end] - self.sums[w][start]) * self.inverse[w][start]
        return _mix(raw + (end - start).astype(np.uint64) * np.uint64(_BASES[1]))

    def grams(self) -> np.ndarray:
        raw = (self.sums[0][GRAM:] - self.sums[0][:-GRAM]) * self.inverse[0][: len(self.sums[0]) - GRAM]
        return _mix(raw)


def choices(grams: np.ndarray) -> np.ndarray:
    """For each window of SPACE grams the place of its smallest hash, the last of equals."""
    m = len(grams) - SPACE + 1
    padded = np.full(-(-len(grams) // SPACE) * SPACE, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(grams)] = grams
    blocks = padded.reshape(-1, SPACE)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:m], ahead[SPACE - 1 : SPACE - 1 + m])
    enters = grams[SPACE - 1 :] == least
    marks = enters.copy()
    marks[0] = True
    marks[1:] |= least[1:] != least[:-1]
    at = np.flatnonzero(marks)
    place = at + SPACE - 1
    again = np.flatnonzero(~enters[at])
    view = np.lib.stride_tricks.sliding_window_view(grams, SPACE)
    for some in np.array_split(again, max(1, len(again) // 4096)):  # memory stays bounded in long texts
        equal = view[at[some]] == least[at[some], None]
        place[some] = at[some] + SPACE - 1 - np.argmax(equal[:, ::-1], axis=1)
    return place[np.cumsum(marks) - 1]


def _lists(arrays: list[np.ndarray], kind: type) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.empty(0, kind)]).astype(kind)))


def _bytes(text: pa.Scalar) -> bytes:
    return (text.as_py() or "").encode()


SYMBOLS = "struct<n:bigint,hi:bigint,lo:bigint,pos:array<int>,len:array<int>,sym:array<bigint>>"


def _symbols(texts: pa.Array) -> pa.Array:
    n, digests, pos, size, sym = [], [], [], [], []
    none = np.empty(0, np.int64)
    for text in texts:
        data = _bytes(text)
        n.append(len(data))
        digests.append(np.frombuffer(xxhash.xxh3_128_digest(data), np.int64))
        if len(data) < LENGTH:
            pos.append(none), size.append(none), sym.append(none)
            continue
        hashes = Hashes(data, (0,))
        anchors = np.unique(choices(hashes.grams()))
        pos.append(anchors[:-1])
        size.append(np.diff(anchors))
        sym.append(hashes.of(0, anchors[:-1], anchors[1:]).view(np.int64))
    return pa.StructArray.from_arrays(
        [pa.array(n, pa.int64()), pa.array([int(d[0]) for d in digests], pa.int64()), pa.array([int(d[1]) for d in digests], pa.int64()),
         _lists(pos, np.int32), _lists(size, np.int32), _lists(sym, np.int64)],
        ["n", "hi", "lo", "pos", "len", "sym"],
    )


RUNS = "rid bigint, run int, i int, pos int, len int, sym bigint, s1 bigint, s2 bigint"
ENTRIES = (
    "rid bigint, pos int, list int, k1 bigint, k2 bigint, nh bigint, own bigint, names array<bigint>, sym array<bigint>, len array<int>"
)
#: Follows the last symbol of a run and sorts before all symbols.
END = np.iinfo(np.int64).min


#: Suffixes of one block of entries.
BLOCK = 1 << 15


def _members(rows: pa.RecordBatch, lists: str, *names: str) -> list[np.ndarray]:
    """The row number and the fields of each struct in the lists of a batch."""
    column = rows[lists]
    flat = column.flatten()
    row = np.repeat(np.arange(rows.num_rows), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return [row, *[flat.field(n).to_numpy(zero_copy_only=False) for n in names]]


def _cut_at(*columns: np.ndarray) -> np.ndarray:
    """Where a stretch begins: at the first row, and where a column differs from the row before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of symbols in a row that are long enough to hold the anchors of a repeated string."""
    for rows in batches:
        row, t, pos, size, sym = _members(rows, "live", "t", "pos", "len", "sym")
        if not len(row):
            continue
        # Symbols of one run follow each other: the place less the number of the symbol stays the same.
        starts = _cut_at(row, t - np.arange(len(t)))
        counts = np.diff(starts, append=len(t))
        long = np.add.reduceat(size.astype(np.int64), starts) >= LENGTH - REACH - SPACE + 1
        first = np.repeat(starts, counts)
        end = first + np.repeat(counts, counts)
        at = np.flatnonzero(np.repeat(long, counts))
        padded = np.concatenate([sym, [END, END]])
        ahead = [np.where(at + k < end[at], padded[at + k], END) for k in (1, 2)]
        rid = rows["rid"].to_numpy()[row[at]]
        columns = [rid, t[first[at]], at - first[at], pos[at], size[at], sym[at], *ahead]
        yield _batch(RUNS, columns)


_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    """Columns as a batch of the Spark schema; a pair is a list column of (flat values, size of each list)."""
    names, kinds = zip(*[f.split(" ") for f in schema.split(", ")], strict=True)
    arrays = []
    for c, kind in zip(columns, kinds, strict=True):
        if isinstance(c, tuple):
            offsets = np.concatenate([[0], np.cumsum(c[1])]).astype(np.int32)
            arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(c[0], _ARROW[kind].value_type)))
        else:
            arrays.append(pa.array(c, _ARROW[kind]))
    return pa.RecordBatch.from_arrays(arrays, names=list(names))


def _stretches(start: np.ndarray, size: np.ndarray, step: int = 1) -> np.ndarray:
    """start, start + step, ...: ``size`` places of each."""
    before = np.cumsum(size) - size
    return np.repeat(start, size) + step * (np.arange(int(size.sum())) - np.repeat(before, size))


def _chain_hashes(name: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash, never 0, of the ``size`` names from ``at`` on, three places from one to the next."""
    h = np.full(len(at), _BASES[0], np.uint64)
    for k in range(-(-DEPTH // 3)):
        on = np.flatnonzero(size > k)
        value = _mix(name[at[on] + 3 * k].astype(np.uint64) + np.uint64(_BASES[1]))
        h[on] = _mix((h[on] ^ value) * np.uint64(_BASES[0]) + value)
    h[h == 0] = 1  # 0: past the end
    return h.view(np.int64)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The two list entries of each suffix, in blocks of a bounded number of suffixes."""
    for rows in batches:
        row, run, pos, size, sym, name = _members(rows, "named", "run", "pos", "len", "sym", "name")
        n = len(row)
        if not n:
            continue
        rid = rows["rid"].to_numpy()[row]
        starts = _cut_at(row, run)
        counts = np.diff(starts, append=n)
        first = np.repeat(starts, counts)
        end = first + np.repeat(counts, counts)
        number = np.arange(n) - first
        total = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        last = np.minimum(np.searchsorted(total, total[:-1] + LENGTH), np.minimum(np.arange(n) + DEPTH, end))
        hashes = np.zeros(n, np.int64)
        sampled = np.flatnonzero(number % 3)
        hashes[sampled] = _chain_hashes(name, sampled, -(-(last[sampled] - sampled) // 3))
        hashes = np.concatenate([hashes, [0, 0]])
        following = np.concatenate([sym, [END]])
        for at in range(0, n, BLOCK):
            some = np.arange(at, min(n, at + BLOCK))
            for which in range(3):
                i = some[number[some] % 3 != (0, 2, 1)[which]]
                nh = np.where(i + which < end[i], hashes[i + which], 0)
                k1 = sym[i] if which else np.zeros(len(i), np.int64)
                k2 = np.where(i + 1 < end[i], following[i + 1], END) if which == 2 else np.zeros(len(i), np.int64)
                names = -(-(last[i] - i) // 3) if which == 0 else np.zeros(len(i), np.int64)
                own = nh if which == 0 else np.zeros(len(i), np.int64)
                reach = last[i] - i
                places = _stretches(i, reach)
                yield _batch(
                    ENTRIES,
                    [rid[i], pos[i], np.full(len(i), which), k1, k2, nh, own, (name[_stretches(i, names, 3)], names),
                     (sym[places], reach), (size[places], reach)],
                )


def _common(sym: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes of the common chunks of two suffixes each; FAR if they agree up to the bound.

    ``a`` and ``b`` have a row (start, end) per suffix, into the flat ``sym`` and ``size``.
    """
    reached = np.zeros(len(a), np.int64)
    alive = np.arange(len(a))
    for k in range(DEPTH):
        alive = alive[(a[alive, 0] + k < a[alive, 1]) & (b[alive, 0] + k < b[alive, 1])]
        alive = alive[sym[a[alive, 0] + k] == sym[b[alive, 0] + k]]
        reached[alive] += size[a[alive, 0] + k]
    reached[alive] = FAR
    return np.where(reached >= LENGTH, FAR, reached)


def _flat(sym: pa.Array, size: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat symbols and sizes of two list arrays, and (start, end) of each row."""
    ends = np.cumsum(sym.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    bounds = np.column_stack([np.concatenate([[0], ends[:-1]]), ends]).astype(np.int64)
    return sym.flatten().to_numpy(), size.flatten().to_numpy(), bounds


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reach of each sorted entry next to its neighbours; first and last also as edges."""
    lists = [pa.list_(pa.int64()), pa.list_(pa.int32())]
    schema = pa.schema(
        [("rid", pa.int64()), ("pos", pa.int32()), ("reach", pa.int32()), ("edge", pa.int32()), ("part", pa.int32()),
         ("sym", lists[0]), ("len", lists[1])]
    )

    def made(rows: pa.RecordBatch, reach: np.ndarray, edge: int | None) -> pa.RecordBatch:
        n = rows.num_rows
        kept = [rows["sym"], rows["len"]] if edge is not None else [pa.nulls(n, t) for t in lists]
        numbers = [pa.array(reach, pa.int32()), pa.array([edge] * n, pa.int32())]
        return pa.RecordBatch.from_arrays([rows["rid"], rows["pos"], *numbers, rows["part"], *kept], schema=schema)

    before = None  # the last row, whose next neighbour is not known yet
    for batch in batches:
        if not batch.num_rows:
            continue
        if before is None:
            yield made(batch.slice(0, 1), np.zeros(1), 0)
            rows, reach_before = batch, 0
        else:
            rows = pa.concat_batches([before, batch])
        sym, size, bounds = _flat(rows["sym"], rows["len"])
        met = _common(sym, size, bounds[:-1], bounds[1:])
        each = np.maximum(np.concatenate([[reach_before], met]), np.concatenate([met, [0]]))
        yield made(rows.slice(0, rows.num_rows - 1), each[:-1], None)
        before, reach_before = rows.slice(rows.num_rows - 1), each[-1]
    if before is not None:
        yield made(before, np.array([reach_before]), None)
        yield made(before, np.zeros(1), 1)


def _edges(sorted_rows: DataFrame) -> DataFrame:
    """Reach of the rows at partition edges: two rows per partition in one window."""
    order = Window.orderBy("part", "edge")
    edges = sorted_rows.where("edge is not null")
    pairs = edges.select("rid", "pos", "sym", "len", *[F.lag(c).over(order).alias(f"{c}_0") for c in ("rid", "pos", "sym", "len")])

    def met(*sides: pa.Array) -> pa.Array:
        (sym, size, a), (other, other_size, b) = _flat(*sides[:2]), _flat(*sides[2:])
        both, sizes = np.concatenate([sym, other]), np.concatenate([size, other_size])
        return pa.array(_common(both, sizes, a, b + len(sym)), pa.int32())

    known = pairs.where(F.col("rid_0").isNotNull()).withColumn("reach", F.arrow_udf(met, "int")("sym_0", "len_0", "sym", "len"))
    return known.select("rid", "pos", "reach").unionByName(known.select(F.col("rid_0").alias("rid"), F.col("pos_0").alias("pos"), "reach"))


def _ranked(distinct: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Rows with a number that grows with their global order."""
    placed = distinct.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return settled(placed.withColumn(out, F.monotonically_increasing_id()), "ranks")


def _repeating(each: DataFrame, often: DataFrame) -> DataFrame:
    """Rows of ``each`` whose symbol is in ``often`` (one row per symbol, ``f`` times in ``each``).

    A symbol with more than 1 / HEAVY of these rows is dealt over SALTS tasks. There are
    fewer than HEAVY of them, so the table that marks them is broadcast.
    """
    total = often.agg(F.sum("f")).first()[0] or 0
    heavy = often.where(F.col("f") * HEAVY > total).select("sym", F.lit(SALTS).alias("salts"))
    every = F.coalesce("salts", F.lit(1))
    dealt = each.join(F.broadcast(heavy), "sym", "left").withColumn("salt", F.pmod(F.xxhash64("rid", "t"), every).cast("int"))
    copies = often.select("sym", F.when(F.col("f") * HEAVY > total, SALTS).otherwise(1).alias("n"))
    copies = copies.select("sym", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("salt"))
    return dealt.drop("salts").join(copies, ["sym", "salt"]).drop("salt")


def reaches(symbols: DataFrame) -> DataFrame:
    """(rid, pos, reach) of the suffixes at anchors, from ``rid, pos, len, sym`` arrays per text."""
    each = symbols.select("rid", F.posexplode(F.arrays_zip("pos", "len", "sym")).alias("t", "x")).select("rid", "t", "x.*")
    often = settled(each.groupBy("sym").agg(F.count("*").alias("f")).where("f > 1"), "often")
    live = _repeating(each, often).groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("t", "pos", "len", "sym"))).alias("live"))
    runs = settled(live.mapInArrow(_runs, RUNS), "runs")

    triple = ["sym", "s1", "s2"]
    sampled = runs.where(F.col("i") % 3 != 0)
    names = _ranked(sampled.select(*triple).distinct(), triple, "name")
    named = sampled.join(names, triple).unionByName(runs.where(F.col("i") % 3 == 0).withColumn("name", F.lit(-1).cast("bigint")))
    by_text = named.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("run", "i", "pos", "len", "sym", "name"))).alias("named"))
    entries = settled(by_text.mapInArrow(_entries, ENTRIES), "entries")
    discard(often, runs, names)
    chains = entries.where("own <> 0").groupBy("own").agg(F.first("names").alias("names"))
    ranks = _ranked(chains.withColumnRenamed("own", "nh"), ["names", "nh"], "rank")

    keyed = entries.drop("own", "names").join(ranks.select("nh", "rank"), "nh", "left").withColumn("rank", F.coalesce("rank", F.lit(-1)))
    keys = ["list", "k1", "k2", "rank", "rid", "pos"]
    in_order = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    met = in_order.select("rid", "pos", F.spark_partition_id().alias("part"), "sym", "len").mapInArrow(
        _neighbours, "rid bigint, pos int, reach int, edge int, part int, sym array<bigint>, len array<int>"
    )
    met = settled(met, "reach")
    discard(entries, ranks)
    both = met.where("edge is null").select("rid", "pos", "reach").unionByName(_edges(met))
    return both.groupBy("rid", "pos").agg(F.max("reach").alias("reach")).where("reach > 0")


#: Rows of one block of cells or strings, unless a single text has more.
ROWS = 1 << 16
CELLS = "rid bigint, first int, last int, f1 bigint, f2 bigint, k1 bigint"


def _in_blocks(schema: str, each: Iterator[tuple[int, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
    """Batches of about ROWS rows from (rid, columns) per text; nothing older than a batch is held."""
    block, rows = [], 0

    def made() -> pa.RecordBatch:
        rids = np.repeat([rid for rid, _ in block], [len(columns[0]) for _, columns in block])
        return _batch(schema, [rids, *map(np.concatenate, zip(*[columns for _, columns in block], strict=True))])

    for rid, columns in each:
        block.append((rid, columns))
        rows += len(columns[0])
        # Small arrays that stay between the large ones of the next text cost its memory again.
        if rows >= ROWS or len(block) >= 256:
            yield made()
            block, rows = [], 0
    if block:
        yield made()


def _text_cells(data: bytes, places: np.ndarray, reach: np.ndarray) -> list[np.ndarray]:
    """Cells of strings that may be repeated, with hashes of the whole and of the core."""
    hashes = Hashes(data)
    choice = choices(hashes.grams())
    far = np.zeros(len(data), np.int64)
    far[places] = reach
    starts = np.arange(len(data) - LENGTH + 1)
    first = choice[: len(starts)]
    last = choice[LENGTH - REACH : LENGTH - REACH + len(starts)]
    starts = starts[far[first] >= last - first]
    first = first[starts]
    cell = (first - starts) // CELL
    new = np.flatnonzero(np.concatenate([[True], (np.diff(first) != 0) | (np.diff(cell) != 0) | (np.diff(starts) != 1)])[: len(starts)])
    end = np.concatenate([new[1:], [len(starts)]])[: len(new)] - 1
    a, b, anchor, c = starts[new], starts[end], first[new], cell[new]
    tag = ((anchor - b) * 256 + (anchor - a)).astype(np.uint64) * np.uint64(_BASES[0])
    core, stop = anchor - c * CELL, anchor - c * CELL - CELL + 1 + LENGTH
    whole = [_mix(hashes.of(w, a, b + LENGTH) + tag).view(np.int64) for w in (0, 1)]
    inner = _mix(hashes.of(0, core, stop) + c.astype(np.uint64) + np.uint64(1)).view(np.int64)
    return [a, b, *whole, inner]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def each() -> Iterator[tuple[int, list[np.ndarray]]]:
        for rows in batches:
            for rid, text, r in zip(rows["rid"].to_pylist(), rows["t"], rows["r"], strict=True):
                yield rid, _text_cells(_bytes(text), *[f.to_numpy(zero_copy_only=False) for f in (r.values.field("pos"), r.values.field("reach"))])

    return _in_blocks(CELLS, each())


STRINGS = "rid bigint, start int, f1 bigint, f2 bigint"


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of every string of the given cells."""

    def each() -> Iterator[tuple[int, list[np.ndarray]]]:
        for rows in batches:
            for rid, text, spans in zip(rows["rid"].to_pylist(), rows["t"], rows["cells"], strict=True):
                hashes = Hashes(_bytes(text))
                first, last = (spans.values.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("first", "last"))
                starts = _stretches(first, last - first + 1)
                yield rid, [starts, *[hashes.of(w, starts, starts + LENGTH).view(np.int64) for w in (0, 1)]]

    return _in_blocks(STRINGS, each())


RESULT = "struct<spans:array<struct<start:int,end:int>>,kept:binary>"


def _cut(texts: pa.Array, firsts: pa.Array) -> pa.Array:
    """Maximal removed runs and the bytes that stay; input: first and last start of repeated strings.

    A NULL list gives NULL: that row's text is not cut.
    """
    rows = []
    for text, spans in zip(texts, firsts, strict=True):
        if not spans.is_valid:
            rows.append(None)
            continue
        data = _bytes(text)
        change = np.zeros(len(data) + 1, np.int64)
        np.add.at(change, np.asarray(spans.values.field("first")), 1)
        np.add.at(change, np.asarray(spans.values.field("last")) + LENGTH, -1)
        covered = np.cumsum(change[:-1]) > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
        kept = np.frombuffer(data, np.uint8)[~covered].tobytes()
        rows.append({"spans": [{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)], "kept": kept})
    kind = pa.struct([("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("kept", pa.binary())])
    return pa.array(rows, kind)


def _repeated(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("f")).where("f > 1").select(*keys)


def remove_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row with ``n_bytes``, ``spans`` (removed runs of bytes) and ``kept`` (binary).

    NULL texts are empty; texts shorter than LENGTH keep all bytes; a repeated row is a
    repeated text. A cut may fall inside a character, hence binary. Existing columns of
    the three names are replaced; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    whole = packed(docs).withColumns({"rid": F.monotonically_increasing_id(), "t": F.col(f"row.`{text}`")})
    rows = settled(whole.select("rid", "row", F.arrow_udf(_symbols, SYMBOLS)("t").alias("s")).select("rid", "row", "s.*"), "symbols")
    texts = rows.select("rid", F.col(f"row.`{text}`").alias("t"))
    equal = settled(
        rows.where(F.col("n") >= LENGTH).groupBy("hi", "lo").agg(F.min("rid").alias("rid"), F.count("*").alias("copies")), "equal"
    )
    firsts = rows.select("rid", "pos", "len", "sym").join(equal.select("rid"), "rid", "left_semi")

    reach = reaches(firsts).groupBy("rid").agg(F.collect_list(F.struct("pos", "reach")).alias("r"))
    cells = settled(texts.join(reach, "rid").select("rid", "t", "r").mapInArrow(_cells, CELLS), "cells")
    whole_again = _repeated(cells, "f1", "f2").withColumn("again", F.lit(True))
    core_again = _repeated(cells, "k1").withColumn("some", F.lit(True))
    judged = cells.join(core_again, "k1").join(whole_again, ["f1", "f2"], "left")
    judged = settled(judged.withColumn("again", F.coalesce("again", F.lit(False))), "judged")
    discard(reach, cells)

    # The strings of an open cell may recur in cells that are repeated as a whole: one of each is a witness.
    undecided = judged.where("not again")
    witness = judged.where("again").join(undecided.select("k1").distinct(), "k1", "left_semi")
    witness = witness.groupBy("f1", "f2").agg(F.min(F.struct("rid", "first", "last")).alias("w")).select("w.*")
    open_cells = undecided.select("rid", "first", "last").unionByName(witness)
    open_cells = open_cells.groupBy("rid").agg(F.collect_list(F.struct("first", "last")).alias("cells"))
    strings = settled(texts.join(open_cells, "rid").select("rid", "t", "cells").mapInArrow(_strings, STRINGS), "strings")
    single = strings.join(_repeated(strings, "f1", "f2"), ["f1", "f2"]).select("rid", F.col("start").alias("first"), F.col("start").alias("last"))

    found = judged.where("again").select("rid", "first", "last").unionByName(single)
    found = found.groupBy("rid").agg(F.collect_list(F.struct("first", "last")).alias("found"))
    # A text with copies goes as a whole, and all of its rows with it.
    many = equal.where("copies > 1").select("hi", "lo", F.lit(True).alias("many"))
    marks = rows.select("rid", "hi", "lo").join(many, ["hi", "lo"]).select("rid", "many").join(found, "rid", "full_outer")
    # Written, so that nothing but the texts is on the disk when they are shuffled.
    marks = settled(marks, "marks")
    discard(equal, judged, strings)
    joined = rows.select("rid", "row", "n").join(marks, "rid", "left")
    gone = F.coalesce("many", F.lit(False))
    touched = ~gone & F.col("found").isNotNull()
    # Only texts that lose some of their bytes go to the workers.
    cut = F.arrow_udf(_cut, RESULT)(F.when(touched, F.col(f"row.`{text}`")), F.when(touched, F.col("found")))
    joined = joined.withColumns({"cut": cut, "touched": touched})
    all_of_it = F.array(F.struct(F.lit(0).alias("start"), F.col("n").cast("int").alias("end")))
    none = F.array().cast("array<struct<start:int,end:int>>")
    whole = F.coalesce(F.col(f"row.`{text}`"), F.lit("")).cast("binary")
    return unpacked(
        joined,
        n_bytes=F.col("n"),
        spans=F.when(gone, all_of_it).when(F.col("touched"), F.col("cut.spans")).otherwise(none),
        kept=F.when(gone, F.lit(b"")).when(F.col("touched"), F.col("cut.kept")).otherwise(whole),
    )
