"""Quality classifier by co-training of a text view and a page view.

The text view sees how words are written and repeated; the page view sees metadata and
layout (language, source, length, lines). Measures are put into bins of fixed edges, and
each view is a naive Bayes model over the bins, so training is counting: one aggregate over
all rows, whose result is no larger than features x bins x 2. Languages and sources are
counted by value, however many there are: their odds are a table, joined back by value.

In each round both views are trained and calibrated, then each hands the labels it is
sure of, on rows without a label, to the other view (never to itself). There is no limit
on how many rows are handed over. At the end the calibrated views are combined by adding
their log-odds over the prior, and every row is scored.

Calibration uses labelled rows that training leaves out (a quarter, by a hash of the id):
the score is cut into bins and the share of good rows per bin is made monotone.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlkit.llm.common import unpacked, written

BINS = 32
ROUNDS = 3
#: Calibrated probability from which a view is sure of a label.
SURE = 0.97
SCORE_BINS = 64
SCORE_RANGE = 24.0
VIEWS = ("text", "page")

TEXT = (
    "word_length", "upper", "digits", "symbols", "distinct", "adjacent", "top_word", "marked_words",
    "loose_symbols", "lower_start", "stops", "char_entropy",
)
NAMES = ("lang", "source")
LAYOUT = ("length", "lines", "line_length", "equal_lines")
PAGE = (*NAMES, *LAYOUT)
#: A name's odds start from so many rows of the prior: unseen names say nothing, rare ones little.
NAME_PRIOR = 2.0


def _share(part: float, whole: float) -> int:
    """Bin of a share; square roots spread the small ones."""
    return min(BINS - 1, int(math.sqrt(part / whole) * BINS)) if whole else 0


def _octave(x: float, steps: int = 2) -> int:
    return min(BINS - 1, int(steps * math.log2(1 + x)))


def text_bins(text: str) -> list[int]:
    words = text.split()
    n = len(words)
    counts = Counter(words)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    letters = sum(map(len, words))
    is_upper = int(((codes >= 65) & (codes <= 90)).sum()) + (0 if text.isascii() else sum(c.isupper() for c in text if c > "\x7f"))
    digits = int(((codes >= 48) & (codes <= 57)).sum())
    symbols = int(((codes > 32) & (codes < 128)).sum()) - int((((codes | 32) >= 97) & ((codes | 32) <= 122)).sum()) - digits
    shares = np.unique(codes, return_counts=True)[1] / max(len(codes), 1)
    return [
        _octave(letters / n if n else 0, 6),
        _share(is_upper, letters),
        _share(digits, letters),
        _share(symbols, letters),
        _octave(len(counts) / math.sqrt(n) if n else 0, 5),
        _share(sum(a == b for a, b in zip(words, words[1:], strict=False)), n),
        _share(max(counts.values(), default=0), n),
        _share(sum(c for w, c in counts.items() if w[-1] in "!#$%&*|<>=~^"), n),
        _share(sum(c for w, c in counts.items() if not w[0].isalnum()), n),
        _share(sum(c for w, c in counts.items() if w[0].islower()), n),
        _share(sum(c for w, c in counts.items() if w[-1] in ".?!:"), n),
        min(BINS - 1, int(4 * -float((shares * np.log2(shares)).sum()))) if len(codes) else 0,
    ]


def page_bins(text: str) -> list[int]:
    """Layout; language and source are counted by value."""
    lines = text.split("\n")
    return [_octave(len(text)), _octave(len(lines)), _octave(len(text) / len(lines), 3), _share(len(lines) - len(set(lines)), len(lines))]


def _binned(texts: pa.Array) -> pa.Array:
    strings = [t.as_py() or "" for t in texts]
    kind = pa.list_(pa.int32())
    return pa.StructArray.from_arrays([pa.array(map(text_bins, strings), kind), pa.array(map(page_bins, strings), kind)], ["text", "page"])


def _named(name: str, row: str) -> Column:
    """A name as text; NULL is a name of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"{row}.`{name}`").cast("string")), F.lit(""))


def _cells(view: str) -> Column:
    """Number of the (feature, bin) cell of each feature."""
    return F.transform(view, lambda b, i: i * BINS + b)


def _ratios(rows: DataFrame, view: str, label: str) -> tuple[list[float], float]:
    """Log-odds (good over bad) per cell, and of the prior; one is added to every count."""
    size = len(TEXT if view == "text" else LAYOUT) * BINS
    counts = np.ones((2, size))
    classes = np.ones(2)
    cells = rows.where(F.col(label).isNotNull()).select(label, F.explode(_cells(view)).alias("cell"))
    for r in cells.groupBy(label, "cell").count().collect():  # features * BINS * 2 rows at most
        counts[r[label], r["cell"]] += r["count"]
        classes[r[label]] += r["count"] * BINS / size
    shares = counts.reshape(2, -1, BINS) / counts.reshape(2, -1, BINS).sum(axis=2, keepdims=True)
    return np.log(shares[1] / shares[0]).ravel().round(5).tolist(), float(np.log(classes[1] / classes[0]))


def _name_odds(rows: DataFrame, label: str, prior: float) -> DataFrame:
    """Log-odds over the prior of every value of every name: table of feature, name, odds."""
    base = 1 / (1 + math.exp(-prior))
    names = rows.where(F.col(label).isNotNull()).select(F.col(label).alias("one"), F.posexplode("names").alias("feature", "name"))
    counts = names.groupBy("feature", "name").agg(F.sum("one").alias("good"), F.count("*").alias("n"))
    odds = F.log((F.col("good") + NAME_PRIOR * base) / (F.col("n") - F.col("good") + NAME_PRIOR * (1 - base))) - prior
    return written(counts.select("feature", "name", F.round(odds, 5).alias("odds")), "name-odds")


def _with_names(rows: DataFrame, odds: DataFrame) -> DataFrame:
    """``rows`` with ``named``: the sum of the odds of their names."""
    out, columns = rows, rows.columns
    for i in range(len(NAMES)):
        part = odds.where(F.col("feature") == i).select(F.col("name").alias(f"name_{i}"), F.col("odds").alias(f"odds_{i}"))
        out = out.join(part, F.col("names")[i] == F.col(f"name_{i}"), "left")
    return out.select(*columns, sum((F.coalesce(f"odds_{i}", F.lit(0.0)) for i in range(len(NAMES))), F.lit(0.0)).alias("named"))


def _literal(values: list[float]) -> Column:
    """An array literal, folded once when the plan is made."""
    return F.split(F.lit(",".join(f"{v:.6f}" for v in values)), ",").cast("array<double>")


def _raw(view: str, ratios: list[float]) -> Column:
    model = _literal(ratios)
    start = F.col("named") if view == "page" else F.lit(0.0)
    return F.aggregate(_cells(view), start, lambda total, cell: total + F.element_at(model, cell + 1))


def _score_bin(raw: Column) -> Column:
    inside = F.greatest(F.lit(0.0), F.least(F.lit(0.9999), raw / (2 * SCORE_RANGE) + 0.5))
    return F.floor(inside * SCORE_BINS).cast("int")


def monotone(good: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Shares of good that do not fall from bin to bin (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for g, t in zip(good, total, strict=True):
        blocks.append([g, t, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            g, t, n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + g, blocks[-1][1] + t, blocks[-1][2] + n]
    return np.concatenate([np.full(int(n), g / t) for g, t, n in blocks])


def _calibrated(rows: DataFrame, view: str, ratios: list[float], prior: float) -> Column:
    """Calibrated log-odds of a view."""
    base = 1 / (1 + math.exp(-prior))
    good, total = np.full(SCORE_BINS, base), np.ones(SCORE_BINS)
    held = rows.where("held and label is not null").select("label", _score_bin(_raw(view, ratios)).alias("bin"))
    for r in held.groupBy("label", "bin").count().collect():  # 2 * SCORE_BINS rows at most
        total[r["bin"]] += r["count"]
        good[r["bin"]] += r["count"] * r["label"]
    share = monotone(good, total).clip(0.002, 0.998)
    return F.element_at(_literal(np.log(share / (1 - share)).tolist()), _score_bin(_raw(view, ratios)) + 1)


def classify(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
    source: str = "source", label: str = "quality", rounds: int = ROUNDS,
) -> DataFrame:
    """Every row with ``text_score``, ``page_score``, ``quality_score`` (probabilities) and ``good``.

    Labels are 1 or 0; of several for one id the majority counts (a tie is 1), NULL ids
    and labels are left out. NULL texts are empty; NULL languages and sources are values
    of their own. Without labels every score is one half. Existing columns of the four
    names are replaced; an empty table gives no rows. The text itself is not handed on.
    """
    given = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("key"))
    given = given.agg((F.avg(label) >= 0.5).cast("int").alias("label"))
    # The text ends with the bins: what is joined, shuffled and written is narrow.
    rest = F.struct(*[docs[f"`{c}`"] for c in docs.columns if c.lower() != text.lower()])
    whole = docs.select(rest.alias("row"), docs[f"`{text}`"].alias("t")).withColumn("key", F.col(f"row.`{doc_id}`"))
    binned = whole.select("row", "key", F.arrow_udf(_binned, "struct<text:array<int>,page:array<int>>")("t").alias("b"))
    binned = binned.select(
        "row", "key", "b.text", "b.page", F.array(_named(lang, "row"), _named(source, "row")).alias("names")
    )
    rows = binned.join(given, "key", "left").withColumn("held", F.pmod(F.xxhash64("key"), F.lit(4)) == 0)
    rows = written(rows, "views")
    trained = F.when(~F.coalesce("held", F.lit(False)), F.col("label"))
    known = rows.withColumns({f"to_{v}": trained for v in VIEWS})
    for number in range(rounds):
        scores, priors, ratios = {}, {}, {}
        for view in VIEWS:
            ratios[view], priors[view] = _ratios(known, view, f"to_{view}")
        scored = _with_names(rows, _name_odds(known, "to_page", priors["page"]))
        for view in VIEWS:
            scores[view] = _calibrated(scored, view, ratios[view], priors[view])
        if number == rounds - 1:
            break
        sure = math.log(SURE / (1 - SURE))
        handed = {
            f"to_{other}": F.when(F.col("label").isNotNull(), trained)
            .when(scores[view] >= sure, 1)
            .when(scores[view] <= -sure, 0)
            for view, other in zip(VIEWS, VIEWS[::-1], strict=True)
        }
        known = scored.withColumns(handed)
    prior = sum(priors.values()) / len(priors)

    def chance(odds: Column) -> Column:
        return F.round(1 / (1 + F.exp(-odds)), 6)

    both = scores["text"] + scores["page"] - prior
    return unpacked(
        scored,
        text_score=chance(scores["text"]),
        page_score=chance(scores["page"]),
        quality_score=chance(both),
        good=both >= 0,
    )
