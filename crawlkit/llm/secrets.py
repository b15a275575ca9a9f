"""Secrets in texts: fixed rules, plus random-looking strings by two Markov models.

Rules give spans of the kinds ``assign``, ``access`` and ``hex``. For the rest, two
first-order character models are trained from labelled samples, one on random strings
(what the rules caught) and one on ordinary identifiers and words (everything else of the
same alphabet). A run of the alphabet is a secret of kind ``random`` when its
log-likelihood ratio between the two models exceeds a threshold in total and per step.

A model has one cell per pair of alphabet characters, a fixed bound (4,489 cells), so it
enters the plan as a literal. Counts run over all documents. Python runs on the driver
only, over those cells.

NULL texts count as empty: no spans. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlkit.llm.common import hex_digest, let, matches, packed, pieces, unpacked, written

# The rules of the contract, in its order.
ASSIGN = (
    r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WIDTH = len(ALPHABET) + 1
RUN = r"[A-Za-z0-9+/_=-]{%d,}"
#: Weight of the single characters in the ordinary model, as a share of all its steps: a
#: character that words rarely hold has a row of its own only from wrongly labelled samples.
BACK_OFF = 0.01
SPAN = "struct<start:int,rank:int,end:int>"


def _spans(text: Column, pattern: str, rank: int, group: int = 0, least: int = 1) -> Column:
    """Spans of the matches whose ``group`` has ``least`` characters or more."""
    parts = F.zip_with(
        pieces(text, pattern),
        F.arrays_zip(matches(text, pattern).alias("m"), matches(text, pattern, group).alias("g")),
        lambda p, m: F.struct(F.length(p).alias("skip"), F.length(m.m).alias("size"), F.length(m.g).alias("value")),
    )
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(done: Column, part: Column) -> Column:
        start = done.at + part.skip
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + part.size).alias("end")).cast(SPAN)
        return F.struct(
            (start + F.coalesce(part.size, F.lit(0))).alias("at"),
            F.when(part.value >= least, F.concat(done.out, F.array(span))).otherwise(done.out).alias("out"),
        )

    found = F.aggregate(parts, zero, step, lambda done: done.out)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def rule_spans(text: Column) -> Column:
    """Spans of the three rules; NULL texts have none."""
    text = F.coalesce(text, F.lit(""))
    return F.concat(_spans(text, ASSIGN, 0, 2, 8), _spans(text, ACCESS, 1), _spans(text, HEX, 2))


def samples(docs: DataFrame, text: str = "text", least: int = 10) -> DataFrame:
    """Labelled distinct strings (``value, random``) from all documents.

    Random: what the rules caught. Ordinary: every other run of ``least`` characters or
    more. A string that was caught anywhere is random everywhere.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    caught = F.concat(matches(whole, ASSIGN, 2), matches(whole, ACCESS), matches(whole, HEX))
    any_rule = whole.rlike(ASSIGN) | whole.rlike(ACCESS) | whole.rlike(HEX)
    strings = docs.select(
        F.when(any_rule, F.filter(caught, lambda v: F.length(v) >= 8)).alias("random"),
        F.array_distinct(matches(whole, RUN % least)).alias("runs"),
    )
    both = F.concat(
        F.transform(F.coalesce("random", F.array().cast("array<string>")), lambda v: F.struct(v.alias("value"), F.lit(True).alias("random"))),
        F.transform("runs", lambda v: F.struct(v.alias("value"), F.lit(False).alias("random"))),
    )
    rows = strings.select(F.inline(both))
    # An assignment is also part of a run ("password=..."): only its value is a sample.
    rows = rows.where(F.col("random") | ~F.col("value").rlike("(?i)(password|passwd|secret|token|api_?key)[:=]"))
    return rows.groupBy("value").agg(F.max("random").alias("random"))


def _codes(value: Column) -> Column:
    return F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def _steps(value: Column) -> Column:
    """Cell numbers of the character pairs; characters outside the alphabet share code 0."""
    return let(
        _codes(value),
        lambda codes: F.zip_with(
            F.slice(codes, 1, F.greatest(F.size(codes) - 1, F.lit(0))),
            F.slice(codes, 2, F.greatest(F.size(codes) - 1, F.lit(0))),
            lambda a, b: a * WIDTH + b,
        ),
    )


def train(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratio (random over ordinary) of each cell, trained twice.

    Texts hold random strings that no rule caught, so some ordinary samples carry the
    wrong label: those that the first models take for random are left out of the second.
    """
    labelled = written(labelled, "samples")
    first = _fit(labelled)
    return _fit(labelled.where(F.col("random") | (score(F.col("value"), first) <= 0)))


def _fit(labelled: DataFrame) -> list[float]:
    """Both models from the counts of their samples.

    The random model is mixed half and half with a uniform one. The ordinary model backs
    off to how often a character occurs at all, so characters that words rarely hold
    count for the other side. Without random samples the uniform half remains; without
    ordinary samples all ratios are near 0 and nothing is found.
    """
    cells = labelled.select("random", F.explode(_steps(F.col("value"))).alias("cell"))
    counts: dict[bool, dict[int, int]] = {True: {}, False: {}}
    for row in cells.groupBy("random", "cell").count().collect():  # at most 2 * WIDTH^2 rows
        counts[row["random"]][row["cell"]] = row["count"]
    ratios = []
    seen = {k: [[counts[k].get(a * WIDTH + b, 0) for b in range(WIDTH)] for a in range(WIDTH)] for k in counts}
    words = seen[False]
    alone = [1 + sum(row[b] for row in words) for b in range(WIDTH)]
    every = sum(alone)
    for a in range(WIDTH):
        total = {k: sum(seen[k][a]) for k in seen}
        for b in range(WIDTH):
            drawn = seen[True][a][b] / total[True] if total[True] else 1 / WIDTH
            random = 0.5 * drawn + 0.5 / WIDTH
            ordinary = (words[a][b] + BACK_OFF * alone[b]) / (total[False] + BACK_OFF * every)
            ratios.append(round(math.log(random / ordinary), 4))
    return ratios


def score(value: Column, ratios: list[float]) -> Column:
    """Log-likelihood ratio of a string: the sum over its steps."""
    model = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")  # folded to one literal
    return F.aggregate(_steps(value), F.lit(0.0), lambda total, cell: total + F.element_at(model, cell + 1))


def _random_spans(text: Column, ratios: list[float], base: Column, least: int, total: float, mean: float) -> Column:
    pattern = RUN % least
    runs = F.zip_with(_spans(text, pattern, 3), matches(text, pattern), lambda s, v: F.struct(s.alias("span"), v.alias("value")))
    free = F.filter(runs, lambda r: ~F.exists(base, lambda s: (s.start < r.span.end) & (r.span.start < s.end)))
    high = F.filter(free, lambda r: let(score(r.value, ratios), lambda s: (s >= total) & (s >= mean * F.length(r.value))))
    return F.transform(high, lambda r: r.span)


def find_secrets(
    docs: DataFrame, ratios: list[float], text: str = "text", least: int = 16, total: float = 12.0, mean: float = 0.5
) -> DataFrame:
    """Every row of ``docs`` with ``spans``: array of (start, rank, end), sorted.

    ``rank`` numbers KINDS. Runs that overlap a rule's span are not reported again. An
    existing column ``spans`` is replaced.
    """
    whole = packed(docs).withColumn("t", F.coalesce(F.col(f"row.`{text}`"), F.lit("")))
    based = whole.withColumn("base", rule_spans(F.col("t")))
    spans = F.array_sort(F.concat("base", _random_spans(F.col("t"), ratios, F.col("base"), least, total, mean)))
    return unpacked(based, spans=spans)


def digest_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s.rank + 1), s.start.cast("string"), s.end.cast("string"))), ","
    )


def report(found: DataFrame) -> DataFrame:
    def count(rank: int) -> Column:
        return F.size(F.filter("spans", lambda s: s.rank == rank)).cast("bigint")

    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        hex_digest(digest_text(F.filter("spans", lambda s: s.rank < 3))).alias("base_sha256"),
        digest_text(F.col("spans")).alias("spans"),
        count(3).alias("n_random"),
    )
