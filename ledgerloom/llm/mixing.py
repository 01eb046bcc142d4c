"""Problem 8: mixing sources to target weights.

Documents are aggregated by membership pattern (the set of sources in which a text stands), and a min-cost flow routes
the patterns' tokens to the sources' quotas. The k-th use of a pattern's tokens costs k, so costs are convex and uses
are spread before anything is repeated; a source draws at most max_repeats times on what it has. Documents are then
chosen in a seeded order: a pattern's documents lie on a circle of their tokens, and each source takes an arc of the
length that the flow gives it.

Only the pattern table (at most one row for each set of sources that occurs) and the targets reach the driver.

Defined results: texts that are null or blank and documents whose source is null or has no target take no part; equal
texts of one source are one document (the least id); a target without documents gets nothing and the others' shares are
scaled to what remains; targets of no, negative or null share get nothing; empty tables give empty results.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import checkpointed

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenizer pattern of that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def make_tokenizer(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, source, text_key, tokens) of the documents with a text and a source.

    The vocabulary, a file of one to two MB on the driver, is broadcast.
    """
    with open(path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_tokenizer(sent.value).encode_ordinary
        for b in batches:
            n = [len(encode(t)) for t in b.column("text").to_pylist()]
            yield pa.record_batch(
                [b.column("doc_id"), b.column("source"), b.column("text_key"), pa.array(n, pa.int64())],
                names=["doc_id", "source", "text_key", "tokens"]
            )

    live = docs.where("text is not null and source is not null and doc_id is not null").where(F.length(F.trim("text")) > 0)
    rows = live.select("doc_id", "source", F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source string, text_key bigint, tokens bigint"
    )


class Flow:
    """Min-cost flow by successive shortest paths; capacities and costs are integers, graphs are small."""

    def __init__(self):
        self.to: list[int] = []
        self.cap: list[int] = []
        self.cost: list[int] = []
        self.out: dict[int, list[int]] = {}

    def arc(self, a: int, b: int, cap: int, cost: int = 0) -> int:
        for x, y, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.out.setdefault(x, []).append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def run(self, s: int, t: int) -> int:
        total = 0
        while True:
            dist, via, queue, queued = {s: 0}, {}, deque([s]), {s}
            while queue:
                x = queue.popleft()
                queued.discard(x)
                for e in self.out.get(x, ()):
                    y = self.to[e]
                    if self.cap[e] > 0 and dist[x] + self.cost[e] < dist.get(y, 1 << 60):
                        dist[y], via[y] = dist[x] + self.cost[e], e
                        if y not in queued:
                            queue.append(y)
                            queued.add(y)
            if t not in dist:
                return total
            path, x = [], t
            while x != s:
                path.append(via[x])
                x = self.to[via[x] ^ 1]
            push = min(self.cap[e] for e in path)
            for e in path:
                self.cap[e] -= push
                self.cap[e ^ 1] += push
            total += push


def route(patterns: dict[tuple[str, ...], int], shares: dict[str, float], repeats: dict[str, int], total: int) -> tuple[
    dict[tuple[tuple[str, ...], str], int], int
]:
    """Tokens that each source takes of each pattern for a mix of ``total`` tokens, and how many were placed."""
    flow, sources = Flow(), sorted(shares)
    node = {s: 2 + i for i, s in enumerate(sources)}
    taken = {}
    for i, (p, n) in enumerate(sorted(patterns.items())):
        here = 2 + len(sources) + i
        for k in range(1, max([repeats[s] for s in p if s in node], default=0) + 1):
            flow.arc(0, here, n, k)
        for s in p:
            if s in node:
                taken[p, s] = flow.arc(here, node[s], n * repeats[s])
    for s in sources:
        flow.arc(node[s], 1, int(total * shares[s]))
    placed = flow.run(0, 1)
    return {k: flow.cap[e ^ 1] for k, e in taken.items() if flow.cap[e ^ 1]}, placed


def largest_total(patterns: dict[tuple[str, ...], int], shares: dict[str, float], repeats: dict[str, int]) -> int:
    """The most tokens of which every source can have its share."""
    low, high = 0, sum(n * max([repeats.get(s, 0) for s in p], default=0) for p, n in patterns.items())
    while low < high:
        mid = (low + high + 1) // 2
        _, placed = route(patterns, shares, repeats, mid)
        if placed >= sum(int(mid * w) for w in shares.values()):
            low = mid
        else:
            high = mid - 1
    return low


def mix_sources(
    docs: DataFrame,
    targets: DataFrame,
    seed: int = 17,
    total_tokens: int | None = None,
    tokenizer: str = f"{TOKENIZERS}/{VOCABULARY}",
    order_bits: int = 12
) -> tuple[DataFrame, DataFrame]:
    """(chosen, report): chosen has (doc_id, source, tokens, repeats), report each source's target and real share.

    Without ``total_tokens`` the mix is the largest in which every source that has documents gets its share (scaled, if
    targets have no documents). With a larger total the caps hold and the report shows what is short.
    """
    spark = docs.sparkSession
    goal = [
        r
        for r in targets.select("source", "target_share", "max_repeats").dropDuplicates(["source"]).collect()
        if r.source is not None
    ]
    goals = spark.createDataFrame(
        [(r.source, float(r.target_share or 0), int(r.max_repeats or 0)) for r in goal],
        "source string, target_share double, max_repeats int"
    )
    counted = count_tokens(docs.join(F.broadcast(goals.select("source")), "source", "left_semi"), tokenizer)
    own = counted.groupBy("text_key", "source").agg(F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens"))
    texts = checkpointed(
        own.groupBy("text_key").agg(
            F.sort_array(F.collect_list(F.struct("source", "doc_id"))).alias("members"), F.max("tokens").alias("tokens")
        )
    )
    texts = texts.withColumn("pattern", F.array_join("members.source", "\u0000")).withColumn(
        "h", F.xxhash64("text_key", F.lit(seed))
    )
    texts = texts.withColumn("bucket", F.shiftrightunsigned("h", 64 - order_bits))
    patterns = {
        tuple(r.pattern.split("\u0000")): int(r.n)
        for r in texts.groupBy("pattern").agg(F.sum("tokens").alias("n")).where("n > 0").collect()
    }
    have = {s for p in patterns for s in p}
    raw = {
        r.source: float(r.target_share)
        for r in goal
        if r.target_share and r.target_share > 0 and (r.max_repeats or 0) > 0 and r.source in have
    }
    shares = {s: w / sum(raw.values()) for s, w in raw.items()}
    repeats = {r.source: int(r.max_repeats or 0) for r in goal}
    total = largest_total(patterns, shares, repeats) if total_tokens is None else total_tokens
    taken, _ = route(patterns, shares, repeats, total) if shares else ({}, 0)
    arcs, at = [], {}
    for (p, s), n in sorted(taken.items()):
        start = at.get(p, 0)
        at[p] = start + n
        arcs.append(("\u0000".join(p), s, start, start + n, patterns[p]))
    arcs = spark.createDataFrame(arcs, "pattern string, source string, arc_start bigint, arc_end bigint, round bigint")
    # place of each text on its pattern's circle: sums by hash bucket first, then within a bucket
    sums = texts.groupBy("pattern", "bucket").agg(F.sum("tokens").alias("n"))
    before = F.sum("n").over(Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("pattern", "bucket", F.coalesce(before, F.lit(0)).alias("base"))
    inside = F.sum("tokens").over(
        Window.partitionBy("pattern", "bucket").orderBy("h", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = texts.withColumn("inner", F.coalesce(inside, F.lit(0))).join(sums, ["pattern", "bucket"]).withColumn(
        "place", F.col("base") + F.col("inner")
    )
    used = placed.join(F.broadcast(arcs), "pattern")
    laps = F.expr("ceil((arc_end - place) / double(round)) - ceil((arc_start - place) / double(round))").cast("int")
    doc = F.filter("members", lambda m: m["source"] == F.col("source"))[0]["doc_id"]
    chosen = used.select(doc.alias("doc_id"), "source", "tokens", laps.alias("repeats")).where("repeats > 0")
    size = {s: sum(n for p, n in patterns.items() if s in p) for s in have}
    known = spark.createDataFrame(
        [(r.source, float(r.target_share or 0), int(r.max_repeats or 0), size.get(r.source, 0)) for r in goal],
        "source string, target_share double, max_repeats int, available_tokens bigint"
    )
    spent = chosen.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("repeats")).alias("used_tokens"),
        F.count(F.lit(1)).alias("documents"),
        F.max("repeats").alias("most_repeats")
    )
    everything = F.sum("used_tokens").over(Window.partitionBy())  # one row a source
    report = known.join(spent, "source", "left").na.fill(0, ["used_tokens", "documents", "most_repeats"])
    report = report.withColumn("actual_share", F.coalesce(F.try_divide("used_tokens", everything), F.lit(0.0)))
    report = report.withColumn("times_over", F.coalesce(F.try_divide("used_tokens", "available_tokens"), F.lit(0.0)))
    return chosen, report
