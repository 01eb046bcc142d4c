"""Languages of short texts, by word and letter-sequence profiles learned from texts with a language label.

A text's score in a language is the sum of the log shares of its known words, or of its sequences of three letters, in
that language's sample. Labels are read by their first two letters, case ignored, and may be wrong now and then. The
profiles are fitted on at most 2 * ``per_language`` texts of a language on average, and only labels with at least
``least`` texts count; without any labelled text no text has a language.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.words import split_words


def trigrams(words: list[str]) -> list[str]:
    """Sequences of three letters of the words that have no digit, their ends marked."""
    return [p[i : i + 3] for w in words if w.isalpha() for p in (f" {w} ",) for i in range(len(p) - 2)]


class Profile:
    """Log shares of features (words or trigrams) by language, relative to their mean over the languages."""

    def __init__(self, counts: dict[str, Counter], least: int = 3):
        self.names = sorted(counts)
        total = sum(counts.values(), Counter())
        kept = sorted(k for k, n in total.items() if n >= least)
        self.at = {k: i for i, k in enumerate(kept)}
        table = np.array([[counts[c][k] for c in self.names] for k in kept], dtype=np.float64).reshape(len(kept), len(self.names))
        logs = np.log((table + 0.1) / (table.sum(0) + 0.1 * max(1, len(kept))))
        self.table = (logs - logs.sum(1, keepdims=True) / max(1, len(self.names))).astype(np.float32)

    def scores(self, features: list[str]) -> np.ndarray:
        rows = [self.at[k] for k in features if k in self.at]
        return self.table[rows].sum(0) if rows else np.zeros(len(self.names), np.float32)


class Languages:
    """Three views of a text: by its words, by its letters, and by both."""

    #: Odds of 20 to 1; trigrams overlap, so their odds count a third.
    LEAD = 3.0

    def __init__(self, texts: list[tuple[str, str]]):
        words: dict[str, Counter] = {}
        letters: dict[str, Counter] = {}
        for text, name in texts:
            w = split_words(text)
            words.setdefault(name, Counter()).update(x for x in w if x.isalpha())
            letters.setdefault(name, Counter()).update(trigrams(w))
        self.words, self.letters = Profile(words), Profile(letters)

    def _clear(self, s: np.ndarray) -> str | None:
        if len(s) < 2:
            return None
        first, second = np.argsort(-s, kind="stable")[:2]
        return self.words.names[first] if s[first] - s[second] >= self.LEAD else None

    def of(self, text: str | None) -> tuple[str | None, str | None, str | None]:
        """The language that leads the others clearly in each view, None where none does."""
        w = split_words(text)
        a, b = self.words.scores(w), self.letters.scores(trigrams(w)) / 3
        return self._clear(a), self._clear(b), self._clear(a + b)


def learn_languages(
    samples: DataFrame | None,
    more: list[str] | None = None,
    text: str = "text",
    lang: str = "lang",
    per_language: int = 1000,
    least: int = 20
) -> Languages:
    """Profiles from labelled texts, and from the texts of ``more`` whose language those tell by letters and by both."""
    if samples is None:
        return Languages([])
    rows = samples.select(
        F.col(text).alias("t"), F.lower(F.substring(F.trim(lang), 1, 2)).alias("l")
    ).where("t is not null and length(l) = 2")
    sizes = {r.l: r["count"] for r in rows.groupBy("l").count().where(F.col("count") >= least).collect()}  # at most 36 ** 2 labels
    if not sizes:
        return Languages([])
    keep = F.element_at(
        F.create_map(*[F.lit(x) for name, n in sorted(sizes.items()) for x in (name, max(1, n // per_language))]), F.col("l")
    )
    some = rows.where(F.col("l").isin(*sizes)).where(F.pmod(F.xxhash64("t"), keep) == 0)
    told = [(r.t, r.l) for r in some.limit(2 * per_language * len(sizes)).collect()]
    first = Languages(told)
    seen = [(t, first.of(t)) for t in more or ()]
    return Languages(told + [(t, x[2]) for t, x in seen if x[2] and x[1] == x[2]]) if seen else first
