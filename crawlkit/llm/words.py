"""Words and word windows of whole texts as 64-bit hashes, for use inside Arrow functions."""

from __future__ import annotations

import numpy as np
import xxhash

from crawlkit.llm.resident import occupy

#: A-Z to a-z, all else as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: As LOWER, and ASCII other than digits and letters to spaces; bytes from 0x80 belong to words.
ALNUM = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in LOWER)

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)
CACHE = 100_000


class _Hashes(dict):
    """Hash of each word seen; emptied when it holds ``CACHE`` of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _Hashes()


def words(text: str | None, table: bytes) -> list[bytes]:
    """Words between ASCII white space after ``table`` has been applied; NULL has none."""
    return text.encode().translate(table).split() if text else []


def hashed(tokens: list[bytes]) -> np.ndarray:
    occupy("words", _hashes.clear)
    return np.fromiter(map(_hashes.__getitem__, tokens), np.uint64, len(tokens))


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * _MIX2
    return h ^ (h >> np.uint64(27))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each window of ``k`` words, in order; none if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = out * _MIX + h[j : j + n]
    return mixed(out)
