"""Quality rules: word rules, then bands on how public tokenisers see a text.

Measured per whole text:

- characters per token and token entropy (bits), by a byte-level vocabulary for many languages
- byte-fallback share: pieces that a second vocabulary can only spell in bytes

Ordinary prose of one language needs about the same number of tokens per character, so
the bands come from the corpus itself: median plus or minus a number of robust standard
deviations (1.4826 times the median distance from the median, at least a floor) per
language. Entropy grows with length, so its band is also per half octave of the token
count. Groups of fewer than ``LEAST_DOCS`` documents use the group of their script, and
if that is small too, that band rejects nothing. All documents count.
"""

from __future__ import annotations

import base64
import re
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from crawlkit.llm.common import packed, unpacked, written
from crawlkit.llm.resident import occupy
from crawlkit.session import prepare

LEAST_DOCS = 30
#: Half octaves of the token count from here on share one group.
LAST_OCTAVE = 26
#: Widths in robust deviations and the floors of a deviation, in the units of ``measure``.
WIDTHS = {"per_token": 6, "fallback": 10, "entropy": 6}
FLOORS = {"per_token": 20, "fallback": 20, "entropy": 30}
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"
#: How a piece vocabulary writes a space.
_BLANK = "\u2581"
_SEGMENTS = re.compile(" +[^ ]*")
#: Segments of a text that are remembered, and their longest length.
REMEMBERED = 200_000
_LONG = 64

#: First code points of blocks, and the script from there on.
SCRIPTS = [
    (0x0000, ""), (0x0041, "latin"), (0x005B, ""), (0x0061, "latin"), (0x007B, ""), (0x00C0, "latin"),
    (0x0250, ""), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0780, ""), (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, ""), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, ""), (0x3040, "kana"), (0x3100, ""), (0x3400, "han"), (0xA000, ""),
    (0xAC00, "hangul"), (0xD7B0, ""), (0x20000, "han"), (0x32000, ""),
]
_STARTS = np.array([s for s, _ in SCRIPTS], np.uint32)
_NAMES = [n for _, n in SCRIPTS]

MEASURES = (
    "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,"
    "n_tokens:bigint,per_token:bigint,fallback:bigint,entropy:bigint,script:string>"
)


@cache
def _bytes_vocabulary(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@cache
def _piece_vocabulary(path: str) -> tuple[sentencepiece.SentencePieceProcessor, np.ndarray]:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return model, np.array([model.is_byte(i) for i in range(model.get_piece_size())])


class PieceCounts:
    """Pieces and byte pieces of a text, whose segments are remembered.

    A segment is a run of spaces and what follows it up to the next one. No piece spans two
    segments if it has spaces only at its start and the text is taken as it is, so each is
    merged for itself; a vocabulary that is not so gets its texts whole.
    """

    def __init__(self, path: str):
        self.model, self.is_byte = _piece_vocabulary(path)
        pieces = [self.model.id_to_piece(i) for i in range(len(self.is_byte))]
        self.starts = np.array([p.startswith(_BLANK) for p in pieces])
        spec = sentencepiece_model_pb2.ModelProto.FromString(self.model.serialized_model_proto())
        form, trained, kind = spec.normalizer_spec, spec.trainer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        self.apart = (
            trained.model_type == trained.BPE
            and not (form.precompiled_charsmap or form.remove_extra_whitespaces or trained.treat_whitespace_as_suffix)
            and form.add_dummy_prefix
            and form.escape_whitespaces
            and _BLANK in pieces
            and {p.type for p in spec.pieces} <= {kind.NORMAL, kind.UNKNOWN, kind.CONTROL, kind.BYTE}
            and not any(_BLANK in p.lstrip(_BLANK) for p in pieces)
        )
        self.known: dict[str, int] = {}

    def _whole(self, text: str) -> tuple[int, int]:
        ids = np.array(self.model.encode(text), np.int64)
        return len(ids), int(self.is_byte[ids].sum())

    def of(self, text: str) -> tuple[int, int]:
        if not (text and self.apart):
            return self._whole(text)
        text = text.replace(_BLANK, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            # Such segments are counted one by one; a space that ends the text is a piece.
            parts = [s[1:] for s in _SEGMENTS.findall(f" {text}")]
            plain = [s for s in parts if s and s[0] != " "]
            rest = [self._whole(s) if s else (1, 0) for s in parts if not s or s[0] == " "]
        else:
            plain, rest = text.split(" "), []
        known = self.known
        new = [s for s in dict.fromkeys(plain) if s not in known]
        if new:
            self._learn(new)
        total = sum(map(known.__getitem__, plain))
        if len(known) > REMEMBERED or any(len(s) > _LONG for s in new):
            self._forget(new)
        return (total & 0xFFFFFFFF) + sum(n for n, _ in rest), (total >> 32) + sum(b for _, b in rest)

    def _learn(self, new: list[str]) -> None:
        """Count segments of one space each, all in one call; bytes stand above the lowest 32 bits."""
        ids = np.array(self.model.encode(" ".join(new)), np.int64)
        at = np.flatnonzero(self.starts[ids])
        counts = np.diff(at, append=len(ids)) + (np.add.reduceat(self.is_byte[ids].astype(np.int64), at) << 32)
        self.known.update(zip(new, counts.tolist(), strict=True))

    def _forget(self, new: list[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        for s in new:
            if len(s) > _LONG:
                self.known.pop(s, None)


@cache
def _piece_counts(path: str) -> PieceCounts:
    return PieceCounts(path)


def _release() -> None:
    _bytes_vocabulary.cache_clear()
    _piece_vocabulary.cache_clear()
    _piece_counts.cache_clear()


def word_rules(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    tokens = text.encode().split()
    n = len(tokens)
    repeated = 0
    if len(set(zip(tokens, tokens[1:], tokens[2:], strict=False))) < n - 2:
        threes = list(zip(tokens, tokens[1:], tokens[2:], strict=False))
        number = {w: i for i, w in enumerate(dict.fromkeys(threes))}
        ids = np.fromiter(map(number.__getitem__, threes), np.int64, len(threes))
        often = np.flatnonzero(np.bincount(ids)[ids] > 1)
        inside = np.zeros(n, bool)
        for j in range(3):
            inside[often + j] = True
        repeated = int(inside.sum())
    lines = [line for line in text.split("\n") if line.strip(_SPACES)]
    return (
        n,
        len(text) - sum(map(text.count, _SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
    )


def script_of(text: str) -> str:
    """The script with most letters; empty if no letter is of a known one."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    counts = np.bincount(np.searchsorted(_STARTS, codes, side="right") - 1, minlength=len(_NAMES))
    total: dict[str, int] = {}
    for name, count in zip(_NAMES, counts, strict=True):
        if name:
            total[name] = total.get(name, 0) + int(count)
    best = max(total, key=total.__getitem__)
    return best if total[best] else ""


def measure(docs: DataFrame, multi: str, pattern: str, pieces: str, text: str = "text") -> DataFrame:
    """Every row with a struct ``m`` of MEASURES; NULL counts as an empty text.

    Shares are in thousandths (characters per token, byte fallback, entropy in bits), so
    that statistics over them are exact. ``multi`` and ``pieces`` are paths of vocabulary
    files, ``pattern`` splits text for the first. A column ``m`` is replaced.
    """

    def measured(texts: pa.Array) -> pa.Array:
        occupy("fertility", _release)
        first = _bytes_vocabulary(multi, pattern)
        second = _piece_counts(pieces)
        rows = []
        for t in texts:
            s = t.as_py() or ""
            ids = np.sort(np.array(first.encode_ordinary(s), np.int32))
            own, in_bytes = second.of(s)
            bounds = np.flatnonzero(ids[1:] != ids[:-1]) + 1
            share = np.diff(bounds, prepend=0, append=len(ids)) / max(len(ids), 1)
            rows.append((
                *word_rules(s), len(ids), round(1000 * len(s) / max(len(ids), 1)),
                round(1000 * (in_bytes / own)) if own else 0,
                round(-1000 * float((share * np.log2(share)).sum())) if len(ids) else 0, script_of(s),
            ))
        names = [f.split(":")[0] for f in MEASURES[7:-1].split(",")]
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.StructArray.from_arrays(
            [pa.array(c, pa.string() if n == "script" else pa.int64()) for n, c in zip(names, columns, strict=True)], names
        )

    prepare(docs.sparkSession)
    whole = packed(docs).withColumn("t", F.col(f"row.`{text}`"))
    return unpacked(whole, m=F.arrow_udf(measured, MEASURES)("t"))


def _base_failed() -> Column:
    return (F.col("m.n_words") < 50) | (100 * F.col("m.n_repeat_words") > 50 * F.col("m.n_words"))


def _octave() -> Column:
    return F.least(F.floor(2 * F.log2(F.greatest(F.col("m.n_tokens"), F.lit(1)))).cast("int"), F.lit(LAST_OCTAVE))


def _band(rows: DataFrame, keys: list[str], name: str, out: str) -> DataFrame:
    """Median and deviation of a measure per group, for groups of LEAST_DOCS or more.

    The measures are whole thousandths, so rows are first counted per value: a group of
    any size reaches its task as one row per distinct value.
    """
    values = rows.groupBy(*keys, F.col(f"m.{name}").alias("v")).agg(F.count("*").alias("f"))
    centre = values.groupBy(*keys).agg(F.percentile("v", 0.5, F.col("f")).alias("centre"), F.sum("f").alias("n"))
    near = values.join(centre.where(F.col("n") >= LEAST_DOCS), keys)
    spread = near.groupBy(*keys).agg(
        F.first("centre").alias("centre"), F.percentile(F.abs(F.col("v") - F.col("centre")), 0.5, F.col("f")).alias("d")
    )
    width = WIDTHS[name] * F.greatest(1.4826 * F.col("d"), F.lit(float(FLOORS[name])))
    return spread.select(*keys, F.struct((F.col("centre") - width).alias("low"), (F.col("centre") + width).alias("high")).alias(out))


def judge(measured: DataFrame, lang: str = "lang") -> DataFrame:
    """Every row of ``measure`` with ``base_failed`` and ``kept`` (never NULL).

    A NULL language is a language of its own. Bands are taken over the rows that pass the
    word rules; ``measured`` should be a written table, since it is read several times.
    An empty table gives no rows.
    """
    rows = packed(measured).select(
        "row", F.col("row.m").alias("m"), F.coalesce(F.col(f"row.`{lang}`").cast("string"), F.lit("")).alias("lang")
    )
    rows = rows.withColumns({"octave": _octave(), "script": F.col("m.script")})
    sound = rows.where(~_base_failed())
    groups = {"per_token": [], "fallback": [], "entropy": ["octave"]}
    joins = [
        (["lang", *more], name, f"{name}_lang") for name, more in groups.items()
    ] + [(["script", *more], name, f"{name}_script") for name, more in groups.items()]
    judged = reduce(lambda df, j: df.join(written(_band(sound, *j), "band"), j[0], "left"), joins, rows)

    def edge(name: str, side: str) -> Column:
        return F.coalesce(F.col(f"{name}_lang.{side}"), F.col(f"{name}_script.{side}"))

    outside = (
        (F.col("m.per_token") < edge("per_token", "low"))
        | (F.col("m.per_token") > edge("per_token", "high"))
        | (F.col("m.fallback") > edge("fallback", "high"))
        | (F.col("m.entropy") < edge("entropy", "low"))
    )
    failed = _base_failed()
    return unpacked(judged, base_failed=failed, kept=~failed & ~F.coalesce(outside, F.lit(False)))
