"""Words, word hashes and rolling windows shared by the text operators.

A word is a longest run of letters or digits, case ignored. Word hashes are 64-bit and the same in every
process; they are looked up in a per-process memo, so that a batch costs one dictionary access a word.
"""

from __future__ import annotations

import numpy as np
import regex
import xxhash

WORD = regex.compile(r"[\p{L}\p{N}]+")
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MEMO_LIMIT = 2_000_000
_memo: dict[str, int] = {}


def split_words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class _Memo(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= _MEMO_LIMIT:  # only forgets, never changes a hash
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_hashes = _Memo()


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, in place on a copy."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of ``width`` successive values, in order."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            total = total * MULTIPLIER + values[j : j + n]
        return mix(total)
