"""Problem 4: splitting oversized texts at natural boundaries.

Balanced targets: the least number of pieces is computed, equal-length targets are placed, each is snapped to the
strongest boundary near it, and a piece is added whenever a limit fails. Every piece after the first repeats up to the
last ``overlap`` tokens of the one before, begun after a natural boundary where one lies in that stretch.

A token is a longest run of characters that are not (Unicode) whitespace. Concatenating the own parts of the pieces
(``text`` from ``own_start``) in order gives back the text. One narrow pass: no shuffle, a text never leaves its row.

Defined results: null and blank texts and texts within the limit give no rows; a text without any boundary is cut
between tokens, exactly at the targets; repeated keys with equal content are split once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = regex.compile(r"\S+")
#: Strength of the pause after a token: blank line, line, sentence, clause, none.
PARAGRAPH, LINE, SENTENCE, CLAUSE = 4, 3, 2, 1
_ABBREVIATIONS = frozenset(
    "inc. corp. co. ltd. vs. no. mr. mrs. ms. dr. st. e.g. i.e. etc. approx. fig. jan. feb. mar. apr. jun. jul. aug. sep. sept. oct. nov. dec. mio. mrd. thsd. z.b. ca. bzw.".split()
)
_OPENING = regex.compile(r"^[\p{Ps}\p{Pi}\"'#*•\-–—]*[\p{Lu}\p{N}\p{Lo}]")


def pause_strengths(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Strength of the boundary behind each token."""
    out = np.zeros(len(spans), dtype=np.int8)
    for i in range(len(spans) - 1):
        start, end = spans[i]
        nxt = spans[i + 1]
        gap = text[end : nxt[0]]
        breaks = gap.count("\n") or gap.count("\r")
        if breaks > 1 or "\u2029" in gap or "\f" in gap:
            out[i] = PARAGRAPH
        elif breaks or "\u2028" in gap:
            out[i] = LINE
        else:
            tail = text[max(start, end - 12) : end].rstrip("\"')]}»”’")
            if tail[-1:] in ("!", "?", "…", "。", "！", "？"):
                out[i] = SENTENCE
            elif tail[-1:] == ".":
                if text[start:end].lower() not in _ABBREVIATIONS and _OPENING.match(text[nxt[0] : nxt[0] + 8]):
                    out[i] = SENTENCE
            elif tail[-1:] in (";", ":", ",", "–", "—") or text[start:end] == "--":
                out[i] = CLAUSE
    return out


def _begin_of_overlap(cut: int, strength: np.ndarray, overlap: int, floor: int) -> int:
    """Where the piece after ``cut`` begins: after the earliest sentence end within the overlap, else the full overlap."""
    first = max(cut - overlap, floor)
    inside = np.flatnonzero(strength[first : cut - 1] >= SENTENCE)
    if first > floor and strength[first - 1] >= SENTENCE:
        return first
    return first + int(inside[0]) + 1 if len(inside) else first


def plan_pieces(n: int, strength: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(begin, own begin, end) in tokens of each piece, for n > limit."""
    count = 1 + -(-(n - limit) // limit)
    while True:
        cuts, begins, last, ok = [], [0], 0, True
        for j in range(1, count):
            target = round(n * j / count)
            latest = begins[-1] + limit  # the current piece may end here at most
            window = max(8, n // count // 3)
            lo, hi = max(last + 1, target - window), min(target + window, latest, n - 1)
            if hi < lo:
                ok = False
                break
            near = strength[lo - 1 : hi].astype(np.int32)  # near[i]: boundary behind token lo-1+i, a cut at lo+i
            away = np.abs(np.arange(lo, hi + 1) - target)
            cut = lo + int(np.lexsort((away, -near))[0]) if near.max() > 0 else int(min(max(target, lo), hi))
            begins.append(_begin_of_overlap(cut, strength, overlap, last))
            cuts.append(cut)
            last = cut
        if ok and n - begins[-1] <= limit:
            edges = [0, *cuts, n]
            return [(begins[i], edges[i], edges[i + 1]) for i in range(count)]
        count += 1


def split_text(text: str, limit: int = 512, overlap: int = 64) -> list[tuple[int, int, int, str, int, int]]:
    """(ord, start, own_start, text, tokens, strength of the cut behind it) of each piece; empty within the limit."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half the limit")
    spans = [m.span() for m in TOKEN.finditer(text)]
    if len(spans) <= limit:
        return []
    strength = pause_strengths(text, spans)
    pieces = plan_pieces(len(spans), strength, limit, overlap)
    out = []
    for i, (begin, own, end) in enumerate(pieces):
        stop = len(text) if i == len(pieces) - 1 else spans[end][0]
        start = spans[begin][0] if i else 0
        own_start = spans[own][0] if i else 0
        out.append((i, start, own_start, text[start:stop], end - begin, int(strength[end - 1])))
    return out


PIECES = "record_kind string, record_key string, ord int, pieces int, start_char int, own_start_char int, text string, token_count int, cut_strength int"


def split_oversized(texts: DataFrame, kind: str, key: str, text: str, limit: int = 512, overlap: int = 64) -> DataFrame:
    """Ordered pieces of every text of more than ``limit`` tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PIECES.split(", ")]
        for b in batches:
            rows = []
            for k, t in zip(b["k"], b["t"]):
                got = split_text(t, limit, overlap)
                rows += [(kind, k, i, len(got), s, o, piece, n, c) for i, s, o, piece, n, c in got]
            if rows:
                yield pd.DataFrame(rows, columns=names)

    # limit + 1 tokens need 2 * limit + 1 characters: shorter texts never reach Python
    long = texts.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).where(F.length("t") > 2 * limit)
    return long.where("k is not null").mapInPandas(run, PIECES)
