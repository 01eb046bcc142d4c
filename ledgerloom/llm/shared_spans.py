"""Problem 9: long exact spans shared between records.

Seeds are winnowed k-mers: of every ``window`` successive k-mers the one of least hash is kept, with
k + window - 1 = ``least``, so that every shared stretch of ``least`` characters has a common seed. Seeds are joined,
the matches of a pair are chained in order with gap costs through a Fenwick tree, and each chain is aligned: exact
stretches are extended to their full length and the gaps between them are compared word by word (fuzzy passages).

Two kinds of seeds would meet too often. In periodic text (rules of dashes, tables) a window's seed is chosen again every
period: such a run is one seed with its period, and two runs are matched on the few shifts that can hold a longest
stretch, those that align their ends. A seed that more than ``hot`` places carry, as that of a disclaimer just longer
than the seed, is replaced by longer ones: a stretch of ``least`` characters has so many (0 to least - k) of them before
the seed, and each part of that range has its own longer seed, of ten characters less than ``least`` in the end. So
hardly any two records meet often without sharing a stretch, and none is missed.

Records of equal text form one class beforehand: copies share everything and take part once.

A gap between two stretches of a chain counts as unlike, without comparing its words, where it has 20,000 characters or
more; a chain ends at gaps of more than ``max_gap`` characters, and the rest is another chain. Neither loses a stretch.

Defined results: null and blank texts and texts shorter than ``least`` share nothing; a character is a code point;
a repeated (id, text) row counts once; stretches within one record don't count.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.words import mix
from ledgerloom.session import checkpointed

_BASE = 0x5851F42D4C957F2D  # odd: its powers have inverses modulo 2**64
_BACK = pow(_BASE, -1, 2**64)
_TIE = 22  # low bits of a window's key, for the place


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def _sliding(f: np.ufunc, x: np.ndarray, w: int, fill: int) -> np.ndarray:
    """f over every window of w successive values."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, fill, dtype=x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    ahead = f.accumulate(blocks, axis=1).reshape(-1)
    behind = f.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return f(behind[:n], ahead[w - 1 : w - 1 + n])


def winnow(texts: list[str], k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash) of the seeds. Near the ends of a text there may be more than the windows ask for."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.array([len(t) for t in texts])
    n = len(flat) - k + 1
    none = np.empty(0, np.int64)
    if n < 1:
        return none, none, np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.concatenate(
            [np.zeros(1, np.uint64), np.cumsum((flat + np.uint64(1)) * _powers(_BASE, len(flat)), dtype=np.uint64)]
        )
        h = mix((sums[k:] - sums[:-k]) * _powers(_BACK, n))
    key = (h >> np.uint64(_TIE) << np.uint64(_TIE)) | (np.uint64(2**_TIE - 1) - np.arange(n, dtype=np.uint64) % np.uint64(2**_TIE))
    ends = np.cumsum(lengths)
    owner = np.searchsorted(ends, np.arange(n), side="right")
    key[np.arange(n) + k > ends[owner]] = np.uint64(2**64 - 1)  # runs over the end of its text
    w = min(window, n)
    least = _sliding(np.minimum, key, w, 2**64 - 1)
    if len(least) >= w:
        chosen = np.concatenate(
            [
                np.maximum.accumulate(least[: w - 1]),
                _sliding(np.maximum, least, w, 0),
                np.maximum.accumulate(least[: -w : -1])[::-1]
            ]
        )[:n] if w > 1 else least
    else:
        chosen = np.array([least[max(0, i - w + 1) : i + 1].max() for i in range(n)], dtype=np.uint64)
    at = np.flatnonzero((chosen == key) & (key != np.uint64(2**64 - 1)))
    return owner[at], at - (ends - lengths)[owner[at]], h[at]


def collapse_runs(owner: np.ndarray, place: np.ndarray, h: np.ndarray, k: int) -> tuple[
    np.ndarray, np.ndarray, np.ndarray, np.ndarray
]:
    """(text, place, hash, period): of three or more seeds of one hash in a row, evenly spaced by at most k / 2, the first
    stays with that period; others have the period 0."""
    n = len(h)
    period = np.zeros(n, dtype=np.int64)
    if n < 3:
        return owner, place, h, period
    step = np.where((owner[1:] == owner[:-1]) & (h[1:] == h[:-1]) & (place[1:] - place[:-1] <= k // 2), place[1:] - place[:-1], 0)
    inner = np.zeros(n, dtype=bool)  # seeds that continue a run
    inner[2:] = (step[1:] == step[:-1]) & (step[1:] > 0)
    inner[1:-1] |= inner[2:]
    first = np.zeros(n, dtype=bool)
    first[:-1] = inner[1:] & ~inner[:-1]
    period[:-1][first[:-1]] = step[first[:-1]]
    keep = ~inner
    return owner[keep], place[keep], h[keep], period[keep]


def periodic_part(x: str, i: int, period: int) -> tuple[int, int]:
    """Ends of the part of the given period around the place i."""
    return i - _backward(x, x, i, i + period), i + period + _forward(x, x, i, i + period)


def least_period(t: str) -> int:
    """Length of the shortest stretch that t repeats."""
    border, k = [0] * len(t), 0
    for i in range(1, len(t)):
        while k and t[i] != t[k]:
            k = border[k - 1]
        k += t[i] == t[k]
        border[i] = k
    return len(t) - border[-1]


def run_anchors(x: str, y: str, i: int, j: int, k: int, period: int, least: int) -> list[tuple[int, int]]:
    """Places on the shifts that can hold a longest common stretch of two periodic parts.

    A stretch that leaves a part leaves the other at the same end, so its shift aligns these ends; one that doesn't is
    no longer than that of a shift of the same phase next to such an alignment. Shifts in between, each by the length of
    the shorter part, tell what else of the longer one stands there.
    """
    (l, r), (m, q) = periodic_part(x, i, period), periodic_part(y, j, period)
    out = set()
    step = max(period, min(r - l, q - m) // period * period)
    first, last = sorted((l - m, r - q))
    between = range(i - j + -(-(first - (i - j)) // period) * period, last + 1, step) if last - first > step >= least else ()
    out |= {(max(l, m + d), max(l, m + d) - d) for d in between if min(r, q + d) - max(l, m + d) >= k}
    for shift in (l - m, r - q):
        least = i - j + (shift - (i - j)) // period * period
        for d in (least, least + period):
            start, end = max(l, m + d), min(r, q + d)
            if end - start >= k:
                out.add((start, start - d))
    return sorted(out)


class Fenwick:
    """Prefix maxima."""

    def __init__(self, n: int):
        self.best = [(-1e18, -1)] * (n + 1)

    def put(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def top(self, i: int) -> tuple[float, int]:
        """The greatest of the values at places below i."""
        out = (-1e18, -1)
        while i > 0:
            if self.best[i] > out:
                out = self.best[i]
            i -= i & -i
        return out


def chain(anchors: list[tuple[int, int]], k: int, gap_cost: float = 0.01, max_gap: int = 2000) -> list[list[tuple[int, int]]]:
    """Collinear chains of the matches (place in a, place in b), best first; each match is in one chain.

    Gap costs are linear in the distance along both texts, so that the best predecessor is a prefix maximum of
    score + gap_cost * (a + b) over the places in b.
    """
    anchors = sorted(set(anchors))
    if not anchors:
        return []
    place = {b: i for i, b in enumerate(sorted({b for _, b in anchors}))}
    tree, score, before = Fenwick(len(place)), [0.0] * len(anchors), [-1] * len(anchors)
    i = 0
    while i < len(anchors):
        j = i
        while j < len(anchors) and anchors[j][0] == anchors[i][0]:
            a, b = anchors[j]
            value, p = tree.top(place[b])
            gain = value - gap_cost * (a + b) if p >= 0 else -1e18
            near = p >= 0 and max(a - anchors[p][0], b - anchors[p][1]) <= max_gap
            score[j] = k + (gain if near and gain > 0 else 0.0)
            before[j] = p if near and gain > 0 else -1
            j += 1
        for m in range(i, j):
            a, b = anchors[m]
            tree.put(place[b], (score[m] + gap_cost * (a + b), m))
        i = j
    used, out = [False] * len(anchors), []
    for m in sorted(range(len(anchors)), key=lambda x: -score[x]):
        path = []
        while m >= 0 and not used[m]:
            used[m] = True
            path.append(anchors[m])
            m = before[m]
        if path:
            out.append(path[::-1])
    return out


def _forward(x: str, y: str, i: int, j: int) -> int:
    """Length of the common stretch that starts at x[i:] and y[j:]."""
    n, top, step = 0, min(len(x) - i, len(y) - j), 64
    while n < top:
        m = min(step, top - n)
        if x[i + n : i + n + m] == y[j + n : j + n + m]:
            n, step = n + m, step * 2
        elif m == 1:
            break
        else:
            step = max(1, m // 2)
            top = min(top, n + m)
    return n


def _backward(x: str, y: str, i: int, j: int) -> int:
    """Length of the common stretch that ends before x[i] and y[j]."""
    n, top, step = 0, min(i, j), 64
    while n < top:
        m = min(step, top - n)
        if x[i - n - m : i - n] == y[j - n - m : j - n]:
            n, step = n + m, step * 2
        elif m == 1:
            break
        else:
            step = max(1, m // 2)
            top = min(top, n + m)
    return n


def align(x: str, y: str, anchors: list[tuple[int, int]], k: int) -> tuple[list[tuple[int, int, int]], float]:
    """Maximal exact stretches (start in x, start in y, length) along a chain, and the share of like words around them."""
    stretches: list[tuple[int, int, int]] = []
    for i, j in anchors:
        if stretches and stretches[-1][0] - stretches[-1][1] == i - j and i < stretches[-1][0] + stretches[-1][2]:
            continue
        if x[i : i + k] != y[j : j + k]:
            continue  # equal hashes of different texts
        back = _backward(x, y, i, j)
        stretches.append((i - back, j - back, back + k + _forward(x, y, i + k, j + k)))
    same = total = 0
    for (s, t, n), nxt in zip(stretches, [*stretches[1:], None]):
        same, total = same + n, total + n
        if nxt and nxt[0] > s + n and nxt[1] > t + n:
            u, v = x[s + n : nxt[0]], y[t + n : nxt[1]]
            like = SequenceMatcher(None, u.split(), v.split(), autojunk=False).ratio() if len(u) + len(v) < 20_000 else 0.0
            same, total = same + like * max(len(u), len(v)), total + max(len(u), len(v))
    return stretches, same / total if total else 0.0


def text_classes(docs: DataFrame, doc_id: str, text: str, least: int) -> DataFrame:
    """(record, class_id, text): class_id is a hash of the text; texts too short to share anything are left out."""
    rows = docs.select(F.col(doc_id).alias("record"), F.col(text).alias("text")).where("record is not null and text is not null")
    return rows.where(F.length("text") >= least).withColumn("class_id", F.xxhash64("text"))


SPANS = "a bigint, b bigint, chain int, start_a int, start_b int, length int, identity double"
#: hash, class and place of a seed; its length and the period of a run; the range of the characters that a stretch has
#: before it; ``run`` marks those that hold whole stretches
SEEDS = "seed bigint, class_id bigint, place int, size int, period int, low int, high int, run boolean"
Seed = tuple[int, int, int, int, int, int, bool]  # without the class


def _hash(t: str) -> int:
    return xxhash.xxh64_intdigest(t.encode("utf-32-le", "surrogatepass")) - 2**63


def longer_seeds(text: str, place: int, size: int, low: int, high: int, least: int, parts: int) -> list[Seed]:
    """Seeds for one that too many places carry.

    A stretch has ``low`` to ``high`` characters before the seed. Each of ``parts`` parts of that range has a longer seed,
    of all that its stretches have in common. A seed in a periodic part becomes the ends of this part, as a stretch that
    leaves the part contains one of them, and one seed more where the part may hold whole stretches.
    """
    period = least_period(text[place : place + size]) if size else 0
    if period and period <= size // 2:
        l, r = periodic_part(text, place, period)
        whole = [(_hash(f"run {text[place : place + size]}"), place, size, period, 0, 0, True)] if r - l >= least else []
        return whole + [s for at in (l, r) for s in longer_seeds(text, at, 0, 0, least, least, parts)]
    out, n = [], min(parts, high - low + 1)
    for part in range(n):
        a, b = low + (high - low + 1) * part // n, low + (high - low + 1) * (part + 1) // n - 1
        start, end = place - a, place + least - b
        if start >= 0 and end <= len(text):
            out.append((_hash(f"{a} {text[start:end]}"), place, size, 0, a, b, False))
    return out


def shared_spans(classes: DataFrame, least: int = 300, k: int = 120, hot: int = 64) -> DataFrame:
    """Exact stretches of at least ``least`` characters (and their chain) of every pair of classes a < b."""
    window = least - k + 1

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # classes of this task: a copy has the same seeds
        for whole in batches:
            texts, ids = [], []
            for i, c in enumerate(whole.column("class_id").to_pylist()):
                if c not in done:
                    done.add(c)
                    ids.append(c)
                    texts.append(whole.column("text")[i].as_py())
            ids, at = np.array(ids, dtype=np.int64), 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (size == 0 or size + len(texts[end]) < 1_000_000):
                    size += len(texts[end])
                    end += 1
                owner, place, h, period = collapse_runs(*winnow(texts[at:end], k, window), k)
                yield pa.record_batch(
                    [
                        pa.array(h.view(np.int64)),
                        pa.array(ids[at:end][owner], pa.int64()),
                        pa.array(place, pa.int32()),
                        pa.array(period, pa.int32())
                    ],
                    names=["seed", "class_id", "place", "period"]
                )
                at = end

    level = classes.select("class_id", "text").mapInArrow(seeds, "seed bigint, class_id bigint, place int, period int")
    level = level.select(
        "seed",
        "class_id",
        "place",
        F.lit(k).alias("size"),
        "period",
        F.lit(0).alias("low"),
        F.lit(least - k).alias("high"),
        F.lit(False).alias("run")
    )
    # copies are combined before the shuffle, so that a class of very many is a few rows in its task
    texts = classes.groupBy("class_id").agg(F.min("text").alias("text"))
    matches = None
    for parts in (2, 9, 0):
        # rows are spread by all their columns, counts are combined before their shuffle, and the join can split a hot seed
        once = level.distinct()
        often = once.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        live = checkpointed(once.join(often, "seed"))
        few = F.col("run") | (F.col("n") <= hot) if parts else F.lit(True)
        found = _meet(live.where(few), least, k)
        matches = found if matches is None else matches.unionByName(found)
        rest = live.where(~few)
        if not parts or not rest.limit(1).count():
            break

        def refine(batches: Iterator[pd.DataFrame], parts=parts) -> Iterator[pd.DataFrame]:
            for df in batches:
                rows = [
                    (s[0], c, *s[1:])
                    for c, *seed in df.itertuples(index=False, name=None)
                    for s in longer_seeds(*seed, least, parts)
                ]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in SEEDS.split(", ")])

        level = rest.join(texts, "class_id").select("class_id", "text", "place", "size", "low", "high").mapInPandas(refine, SEEDS)
    pairs = checkpointed(matches.groupBy("a", "b").agg(F.collect_set(F.struct("i", "j", "p", "q")).alias("anchors")))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).distinct()
    texts = texts.join(ends, "class_id", "left_semi")
    both = pairs.join(texts.select(F.col("class_id").alias("a"), F.col("text").alias("x")), "a").join(
        texts.select(F.col("class_id").alias("b"), F.col("text").alias("y")), "b"
    )

    def chains(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for a, b, anchors, x, y in zip(df["a"], df["b"], df["anchors"], df["x"], df["y"]):
                at = [(m["i"], m["j"]) for m in anchors if not m["p"] and not m["q"]]
                for m in anchors:
                    for period in {m["p"], m["q"]} - {0}:
                        at += run_anchors(x, y, m["i"], m["j"], k, period, least)
                seen: set[tuple[int, int, int]] = set()
                for c, path in enumerate(chain(at, k)):
                    stretches, identity = align(x, y, path, k)
                    for s in stretches:
                        if s[2] >= least and s not in seen:
                            seen.add(s)
                            rows.append((a, b, c, *s, identity))
            if rows:
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in SPANS.split(", ")])

    return both.select("a", "b", "anchors", "x", "y").mapInPandas(chains, SPANS)


def _meet(seeds: DataFrame, least: int, k: int) -> DataFrame:
    """Matches (a, b, i, j) of the classes a < b that carry one seed, at places with k equal characters, and the periods."""
    at = F.when((F.col("size") > 0) | (F.col("high") <= least - k), F.col("place")).otherwise(F.col("place") - k)
    left = seeds.select("seed", F.col("class_id").alias("a"), at.alias("i"), F.col("period").alias("p"))
    right = seeds.select("seed", F.col("class_id").alias("b"), at.alias("j"), F.col("period").alias("q"))
    return left.join(right.hint("shuffle_merge"), "seed").where("a < b").select("a", "b", "i", "j", "p", "q")


def shared_report(classes: DataFrame, spans: DataFrame, least: int) -> DataFrame:
    """(record, chars, shared_chars, spans, copies): how much of each record stands elsewhere too."""
    sides = spans.select(F.col("a").alias("class_id"), F.col("start_a").alias("s"), (F.col("start_a") + F.col("length")).alias("e")).unionByName(
        spans.select(F.col("b").alias("class_id"), F.col("start_b").alias("s"), (F.col("start_b") + F.col("length")).alias("e"))
    )
    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct("s", "e"))),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("at")),
        lambda t, x: F.struct(
            (t["n"] + F.greatest(x["e"] - F.greatest(x["s"], t["at"]), F.lit(0))).alias("n"),
            F.greatest(x["e"], t["at"]).alias("at")
        ),
        lambda t: t["n"],
    )
    per_class = sides.distinct().groupBy("class_id").agg(covered.alias("covered"), F.count(F.lit(1)).alias("spans"))
    rows = classes.select("record", "class_id", F.length("text").alias("chars")).distinct()
    copies = rows.groupBy("class_id").agg(F.count(F.lit(1)).alias("copies"))
    return rows.join(copies, "class_id").join(per_class, "class_id", "left").select(
        "record", "chars", F.when(
            F.col("copies") > 1, F.col("chars")
        ).otherwise(F.coalesce("covered", F.lit(0))).alias("shared_chars"), F.coalesce("spans", F.lit(0)).alias("spans"), "copies"
    )
