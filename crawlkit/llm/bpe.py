"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

The vocabulary is a public file of the ``tokenizers`` library: byte-level BPE with a mark
at the end of each word. Text is cut at special tokens, put in composed lower-case form,
and split into pieces; each piece is merged on its own.

A piece keeps one leaf per symbol: the rank of the pair that starts there, with its place
as the tie-break. The root of a minimum tree over the leaves is the leftmost pair of the
lowest rank. A node has FAN children, so most words are one node. A merge changes three
leaves, each in logarithmic time, until the root says that no pair can merge; so a piece
of a million characters costs n log n.

No piece has white space in it, so text is first cut there into words, and a word is cut into
pieces when it is new. Words and pieces repeat, so a worker remembers both, in two generations
of bounded size.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlkit.llm.common import packed, unpacked
from crawlkit.llm.resident import occupy
from crawlkit.session import prepare

_NONE = 1 << 62
#: Children of a node of the tree.
FAN = 16
#: Pieces remembered in each generation, and their longest length.
GENERATION = 400_000
_LONG = 64
_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space to Python's split, part of pieces to the vocabulary.
_NO_SPACE = "\x1c\x1d\x1e\x1f"
#: Fixed value: how the vocabulary's file splits text.
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")

#: The same split for ASCII text in lower case.
ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r\x20a-z0-9]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(kept) else chr(next(spare)) for b in range(256)]


def lowered(text: str) -> str:
    """Lower case character by character: a final sigma is no special case."""
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


def split(text: str) -> list[str]:
    """Pieces of text in its composed lower-case form."""
    return (ASCII_PIECES if text.isascii() else PIECES).findall(text)


class _Remembered(dict):
    """Ids of words and of their pieces as bytes. A miss asks the older generation, then the merges."""

    def __init__(self, merge):
        super().__init__()
        self.merge, self.older = merge, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            one = word.isascii() and word.isalpha()
            pieces = [word] if one else split(word)
            if len(pieces) == 1 and pieces[0] == word:
                ids = array("i", self.merge(word)).tobytes()
            else:
                ids = b"".join(map(self.__getitem__, pieces))
            if len(word) > _LONG:
                return ids
        if len(self) >= GENERATION:
            self.older.clear()  # before the copy: never more than two generations
            self.older.update(self)
            self.clear()
        self[word] = ids
        return ids


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        self.suffix = spec["model"]["end_of_word_suffix"] or ""
        self.pairs = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.pairs[vocab[left], vocab[right]] = (rank, vocab[left + right])
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.last = [vocab[s + self.suffix] for s in symbols]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        by_id = {i: t for t, i in vocab.items()} | {i: t for t, i in special.items()}
        self.tokens = np.array([by_id.get(i, "") for i in range(max(by_id) + 1)], dtype=object)
        self.remembered = _Remembered(self.merge)

    def merge(self, piece: str) -> tuple[int, ...]:
        """Ids of one piece, by the segment tree."""
        data = piece.encode()
        n = len(data)
        ids = [self.inner[b] for b in data]
        ids[-1] = self.last[data[-1]]
        if n == 1:
            return (ids[0],)
        pairs, get = self.pairs, self.pairs.get
        leaves = [found[0] * n + i if (found := get(pair)) else _NONE for i, pair in enumerate(zip(ids, ids[1:], strict=False))]
        levels = [leaves]
        while len(levels[-1]) > FAN:
            below = levels[-1]
            levels.append([min(below[k : k + FAN]) for k in range(0, len(below), FAN)])
        top = levels[-1]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (root := min(top)) != _NONE:
            i = root % n
            gone = after[i]
            new = ids[i] = pairs[ids[i], ids[gone]][1]
            ids[gone] = -1
            right = after[i] = after[gone]
            left = before[i]
            leaves[i] = _NONE
            if gone < n - 1:
                leaves[gone] = _NONE
            if right < n:
                before[right] = i
                if found := get((new, ids[right])):
                    leaves[i] = found[0] * n + i
            if left >= 0:
                leaves[left] = found[0] * n + left if (found := get((ids[left], new))) else _NONE
            if top is not leaves:
                nodes = {i // FAN, min(gone, n - 2) // FAN, max(left, 0) // FAN}
                for below, above in zip(levels, levels[1:], strict=False):
                    for node in nodes:
                        above[node] = min(below[node * FAN : (node + 1) * FAN])
                    nodes = {node // FAN for node in nodes}
        return tuple(x for x in ids if x >= 0)

    def _plain(self, text: str) -> list[str]:
        """Words of the composed lower-case text, or its pieces where words are cut at other characters."""
        text = text.lower() if text.isascii() else lowered(unicodedata.normalize("NFC", text))
        return split(text) if any(c in text for c in _NO_SPACE) else text.split()

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        parts = self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]
        ids = []
        for i, part in enumerate(parts):
            if i % 2:
                ids.append(np.int32(self.special[part]).tobytes())
            else:
                ids += map(self.remembered.__getitem__, self._plain(part))
        return np.frombuffer(b"".join(ids), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """Tokens as the vocabulary writes them, a space between; unknown ids are left out."""
        known = ids[(ids >= 0) & (ids < len(self.tokens))]
        return " ".join(filter(None, self.tokens[known].tolist()))


@cache
def _loaded(path: str) -> Bpe:
    return Bpe(path)


def load(path: str) -> Bpe:
    """The vocabulary of this worker, which the vocabularies and memories of other operators leave."""
    occupy("bpe", _loaded.cache_clear)
    return _loaded(path)


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Every row with ``ids``, an array of integers; NULL and empty texts have none."""

    def encoded(texts: pa.Array) -> pa.Array:
        model = load(path)
        ids = [model.encode(t.as_py()) for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.empty(0, np.int32)])))

    prepare(docs.sparkSession)
    whole = packed(docs).withColumn("t", F.col(f"row.`{text}`"))
    return unpacked(whole, ids=F.arrow_udf(encoded, "array<int>")("t"))


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Every row with ``decoded``; NULL or empty ``ids`` give an empty text."""

    def decoded(lists: pa.Array) -> pa.Array:
        model, none = load(path), np.empty(0, np.int32)
        return pa.array([model.decode(x.values.to_numpy(zero_copy_only=False) if x.is_valid else none) for x in lists], pa.string())

    prepare(encoded.sparkSession)
    whole = packed(encoded).withColumn("t", F.col(f"row.`{ids}`"))
    return unpacked(whole, decoded=F.arrow_udf(decoded, "string")("t"))
