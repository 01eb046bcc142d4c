"""Problem 7: evaluation texts leaking into training text.

The normalised word n-grams of all evaluation items form a hash set; every document's token windows are scanned
against it, hits are verified word by word, and the spans (or the documents) can be removed. The set is broadcast only
when its size, counted first, is within ``broadcast_grams``; beyond it the windows, as hashes and places, are joined to the
set by hash and what meets is verified against the text.

Defined results: an item field of fewer than n words can't leak; null or blank texts leak nothing; a repeated row
leaks what its text leaks; an empty evaluation table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.words import WORD, split_words, window_hashes, word_hashes

_BITS = np.uint64(44)  # the top 20 bits address the bitmap

HITS = ["doc_id", "item_id", "first_word", "last_word", "start_char", "end_char"]


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


class GramIndex:
    """Hash set of the n-grams of the items, with the words for verification."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        self.n = n
        self.at: dict[int, dict[tuple[object, tuple[str, ...]], None]] = defaultdict(dict)  # in order, each once
        for item, text in items:
            w = split_words(text)
            for i, h in enumerate(window_hashes(word_hashes(w), n).tolist()):
                self.at[h][item, tuple(w[i : i + n])] = None
        self.keys = np.sort(np.fromiter(self.at, dtype=np.uint64, count=len(self.at)))
        self.bitmap = np.zeros(1 << 20, dtype=bool)
        self.bitmap[self.keys >> _BITS] = True

    def scan(self, texts: list[str]) -> list[tuple[int, int, int, int]]:
        """(text, item, first word, last word + 1), maximal runs of hits."""
        words = [split_words(t) for t in texts]
        flat = word_hashes([w for ws in words for w in ws])
        grams = window_hashes(flat, self.n)
        if not len(grams) or not len(self.keys):
            return []
        maybe = np.flatnonzero(self.bitmap[grams >> _BITS])
        maybe = maybe[self.keys[np.minimum(np.searchsorted(self.keys, grams[maybe]), len(self.keys) - 1)] == grams[maybe]]
        offsets = np.cumsum([0, *map(len, words)])
        runs: list[tuple[int, int, int, int]] = []
        open_runs: dict[tuple[int, int], int] = {}
        for p in maybe.tolist():
            doc = int(np.searchsorted(offsets, p, side="right")) - 1
            at = p - int(offsets[doc])
            window = tuple(words[doc][at : at + self.n])
            if len(window) < self.n:
                continue  # runs over the end of its text
            for item, gram in self.at.get(int(grams[p]), ()):
                if gram != window:
                    continue
                k = open_runs.get((doc, item))
                if k is not None and runs[k][3] >= at:
                    runs[k] = (doc, item, runs[k][2], at + self.n)
                else:
                    open_runs[doc, item] = len(runs)
                    runs.append((doc, item, at, at + self.n))
        return runs


def item_texts(items: DataFrame, item_id: str, fields: list[str]) -> DataFrame:
    return items.select(F.col(item_id).alias("item_id"), F.explode(F.array(*fields)).alias("t")).where(
        "item_id is not null and t is not null"
    ).distinct()


def _spans(texts: list[str], runs: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    out, at, places = [], -1, []
    for doc, item, a, b in sorted(runs, key=lambda r: (r[0], r[2], r[3])):
        if doc != at:
            at, places = doc, [m.span() for m in WORD.finditer(texts[doc].lower())]
        out.append((doc, item, a, b, places[a][0], places[b - 1][1]))
    return out


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    fields: tuple[str, ...] = ("question", "passage"),
    n: int = 12,
    broadcast_grams: int = 2_000_000
) -> DataFrame:
    """One row per maximal run of leaked words: document, item, word and character span."""
    texts = item_texts(items, item_id, list(fields))
    size = texts.select(F.sum(F.length("t")).alias("c")).first().c or 0
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, item_id {_kind(texts, 'item_id')}, first_word int, last_word int, start_char int, end_char int"
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    if size // 2 > broadcast_grams:  # at most one gram a word, a word has a character and a gap
        return _find_by_join(base, texts, n, schema)
    index = docs.sparkSession.sparkContext.broadcast(GramIndex([(r.item_id, r.t) for r in texts.collect()], n))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = _spans(b["text"].tolist(), index.value.scan(b["text"].tolist()))
            if found:
                ids = b["doc_id"].to_numpy()
                yield pd.DataFrame([(ids[d], *rest) for d, *rest in found], columns=HITS)

    return base.mapInPandas(run, schema)


def _grams(rows: DataFrame, key: str, text: str, n: int, words: bool) -> DataFrame:
    """(key, h, at) of every window of n words, with the window itself if ``words``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, t in zip(b[key], b[text]):
                w = split_words(t)
                h = window_hashes(word_hashes(w), n).view(np.int64)
                if len(h):
                    out = pd.DataFrame({key: k, "h": h, "at": np.arange(len(h), dtype=np.int32)})
                    yield out.assign(gram=[" ".join(w[i : i + n]) for i in range(len(h))]) if words else out

    return rows.select(key, text).mapInPandas(
        run, f"{key} {_kind(rows, key)}, h bigint, at int" + (", gram string" if words else "")
    )


def _find_by_join(base: DataFrame, texts: DataFrame, n: int, schema: str) -> DataFrame:
    """The same runs for an evaluation set too large to broadcast; one row per item and gram keeps hot grams apart."""
    items = _grams(texts.withColumnRenamed("t", "text"), "item_id", "text", n, True).select("item_id", "h", "gram").distinct()
    hits = _grams(base, "doc_id", "text", n, False).join(items, "h").select("doc_id", "item_id", "at", "gram")
    per_doc = hits.groupBy("doc_id").agg(F.collect_set(F.struct("at", "item_id", "gram")).alias("hits")).join(base, "doc_id")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, found, t in zip(b["doc_id"], b["hits"], b["text"]):
                w, runs, last = split_words(t), [], {}
                for x in sorted(found, key=lambda x: x["at"]):
                    at, item = x["at"], x["item_id"]
                    if " ".join(w[at : at + n]) != x["gram"]:
                        continue
                    k = last.get(item)
                    if k is not None and runs[k][3] >= at:
                        runs[k] = (0, item, runs[k][2], at + n)
                    else:
                        last[item] = len(runs)
                        runs.append((0, item, at, at + n))
                rows += [(d, *rest) for _, *rest in _spans([t], runs)]
            yield pd.DataFrame(rows, columns=HITS)

    return per_doc.select("doc_id", "hits", "text").mapInPandas(place, schema).distinct()


def remove_leaks(docs: DataFrame, hits: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with the leaked spans cut out, and how many characters and items that were."""
    spans = hits.groupBy("doc_id").agg(
        F.array_sort(F.collect_set(F.struct("start_char", "end_char"))).alias("spans"), F.count_distinct("item_id").alias("items")
    )
    merged = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("kept"), F.lit(0).alias("at")),
        lambda acc, s: F.when(s["end_char"] <= acc["at"], acc).otherwise(
            F.struct(
                F.concat(
                    acc["kept"], F.substring(F.col("_t"), acc["at"] + 1, F.greatest(s["start_char"] - acc["at"], F.lit(0)))
                ).alias("kept"),
                s["end_char"].alias("at")
            )
        ),
        lambda acc: F.concat(acc["kept"], F.substring(F.col("_t"), acc["at"] + 1, F.length("_t"))),
    )
    joined = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_t")).join(spans, "doc_id", "left")
    return joined.select(
        "doc_id",
        F.when(F.col("spans").isNull(), F.col("_t")).otherwise(merged).alias("text"),
        F.coalesce("items", F.lit(0)).alias("items_removed"),
        F.length("_t").alias("chars_before")
    )
