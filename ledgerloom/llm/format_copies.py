"""Problem 1: duplicates hidden by formatting.

Passages are brought to canonical bytes (letters and digits in order, points between digits; labelled field
lists as sorted label/value pairs), partitioned by recursive radix splits of those bytes until every bucket fits,
and counted in a byte trie per bucket whose terminals carry the counters.

A bucket whose bytes are used up (copies of one passage) is salted by the record's key; the partial terminals of the
salts, one row each, are merged afterwards. Prefixes of oversized buckets, at most rows / bucket_rows, are a table that
is joined to the rows, by a broadcast only below a checked size.

Defined results: a null text or key takes no part; a text without letters or digits has empty canonical bytes and
equals every other such text; repeated (key, text) rows count once; a key with several texts is a copy of each, and is
counted in each class; an empty table gives an empty result. Numbers keep their digits: 1.50 and 1.5 differ in every
notation. A field may occur several times, and JSON lists keep the order of their elements.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.session import checkpointed, shuffle_width

_POINT = regex.compile(r"(?<=\p{Nd})\.(?=\p{Nd})")
_NOISE = regex.compile(r"[^\p{L}\p{N}]+")
# A label takes all it can, without backtracking, so its length needs no limit; it may take the first half of "->".
_LABEL = r"\p{L}[\p{L}\p{N}_ /()%-]*+"
_IS = r"[\"'*_\s]*+(?::=|=>|->|(?<=-)>|[:=])"
_SEGMENTS = regex.compile(rf"[\n\r|;&]+|,\s*+(?=[\"'*_]*+{_LABEL}{_IS})")
_FIELD = regex.compile(rf"^[^\p{{L}}\p{{N}}]*({_LABEL}){_IS}\s*(.*?)[\s.]*$", regex.DOTALL)
_TAGGED = regex.compile(r"<(\p{L}[\w.-]*)[^<>]*>([^<>]*)</\1>")


def content(text: str) -> str:
    """Letters and digits in order, case folded, with the points that stand between digits."""
    text = unicodedata.normalize("NFC", text).casefold()
    return ".".join(_NOISE.sub("", x) for x in _POINT.split(text))


class Fields(list):
    """Label and value pairs of one JSON object, as often and in the order in which they stand there."""


_JSON = json.JSONDecoder(object_pairs_hook=Fields, parse_float=str, parse_int=str, parse_constant=str)


def _value(value: object) -> str:
    """Canonical value of a field: its content, or that of nested objects (fields in any order) and lists (in theirs)."""
    if isinstance(value, Fields):
        return "\x03" + "\x01".join(sorted(f"{content(k)}\x02{_value(v)}" for k, v in value)) + "\x04"
    if isinstance(value, list):
        if any(isinstance(x, list) for x in value):
            return "\x05" + "\x01".join(map(_value, value)) + "\x06"
        return content(" ".join(x if isinstance(x, str) else json.dumps(x) for x in value))
    return content(value if isinstance(value, str) else json.dumps(value))


def _parsed(body: str) -> object:
    try:
        return _JSON.decode(body)
    except (ValueError, RecursionError):
        return None


def fields(text: str) -> list[tuple[str, object]] | None:
    """Label and value pairs when the whole text is a list of at least two labelled fields, else None.

    A JSON list whose objects have one field each and different labels is such a list too. Another JSON list with
    objects is one value without a label: their order stays, that of the fields in each does not count.
    """
    body = text.strip()
    if body[:1] in "{[" and body[-1:] in "}]":
        parsed = _parsed(body)
        if isinstance(parsed, list) and not isinstance(parsed, Fields):
            if not any(isinstance(x, Fields) for x in parsed):
                return None
            if not all(isinstance(x, Fields) and len(x) == 1 for x in parsed) or len({x[0][0] for x in parsed}) < len(parsed):
                return [("", parsed)]
            parsed = Fields(x[0] for x in parsed)
        if parsed is not None:
            return list(parsed) if isinstance(parsed, Fields) and len(parsed) > 1 else None
        body = body[1:-1]
    tags = _TAGGED.findall(body)
    if len(tags) > 1 and not content(regex.sub(r"<[^<>]*>", "", _TAGGED.sub("", body))):
        return tags
    found = []
    for part in _SEGMENTS.split(body):
        if not part or not content(part):
            continue
        m = _FIELD.match(part)
        if not m:
            return None
        found.append((m[1], m[2]))
    return found if len(found) > 1 else None


def canonical(text: str) -> bytes:
    pairs = fields(text) if any(c in text for c in ":=>") else None
    if pairs is None:
        return content(text).encode()
    return ("\x01" + "\x01".join(sorted(f"{content(k)}\x02{_value(v)}" for k, v in pairs))).encode()


@F.pandas_udf(T.BinaryType())
def canonical_udf(texts: pd.Series) -> pd.Series:
    codes, once = pd.factorize(texts)  # a passage is listed in many samples
    made = np.array([canonical(t) for t in once] + [None], dtype=object)
    return pd.Series(made[codes])


BROADCAST_BYTES = 16_000_000


class CountingTrie:
    """Byte trie with terminal counters; a node holds suffixes until there are too many, then bursts by their next bytes."""

    __slots__ = ("suffixes", "children", "burst", "stride")

    def __init__(self, burst: int = 512, stride: int = 4):
        self.suffixes: dict[bytes, list] = {}
        self.children: dict[bytes, CountingTrie] | None = None
        self.burst, self.stride = burst, stride

    def add(self, key: bytes, record: str) -> None:
        node = self
        while node.children is not None and len(key) >= node.stride:
            head, key = key[: node.stride], key[node.stride :]
            nxt = node.children.get(head)
            if nxt is None:
                nxt = node.children[head] = CountingTrie(self.burst, self.stride)
            node = nxt
        node.suffixes.setdefault(key, []).append(record)
        if node.children is None and len(node.suffixes) > node.burst:
            node._split()

    def _split(self) -> None:
        held, self.suffixes, self.children = self.suffixes, {}, {}
        for key, records in held.items():
            if len(key) < self.stride:
                self.suffixes[key] = records
            else:
                child = self.children.setdefault(key[: self.stride], CountingTrie(self.burst, self.stride))
                child.suffixes[key[self.stride :]] = records

    def terminals(self, prefix: bytes = b"") -> Iterator[tuple[bytes, list]]:
        for key, records in self.suffixes.items():
            yield prefix + key, records
        for head, child in (self.children or {}).items():
            yield from child.terminals(prefix + head)


def _radix_buckets(df: DataFrame, bucket_rows: int) -> DataFrame:
    """Adds ``bucket``: the shortest canonical prefix whose bucket fits, and ``salt`` where the bytes are used up.

    A level's prefixes are split further in the next one; only their number comes to the driver. They are broadcast up
    to BROADCAST_BYTES and joined by a shuffle beyond.
    """
    depth, levels, rest = 4, [], df.select("canon")
    while True:
        prefix = F.expr(f"substring(canon, 1, {depth})").alias("_p")
        sizes = rest.groupBy(prefix).agg(
            F.count(F.lit(1)).alias("n"), F.max(F.length("canon")).alias("longest")
        ).where(F.col("n") > bucket_rows)
        big = checkpointed(
            sizes.select(
                "_p", F.when(F.col("longest") <= depth, F.ceil(F.col("n") / bucket_rows)).otherwise(0).cast("int").alias("_s")
            )
        )
        many = big.count()
        if not many:
            break
        big = F.broadcast(big) if many * (depth + 16) <= BROADCAST_BYTES else big
        levels.append((depth, big))
        rest = rest.join(big.where("_s = 0").select("_p"), F.expr(f"substring(canon, 1, {depth}) = _p"), "left_semi")
        depth *= 3
    out = df.withColumn("bucket", F.expr("substring(canon, 1, 4)")).withColumn("salts", F.lit(0))
    for d, big in levels:
        hit = out.join(big, F.expr(f"substring(canon, 1, {d}) = _p"), "left")
        out = hit.withColumn(
            "bucket", F.when(F.col("_s") == 0, F.expr(f"substring(canon, 1, {d * 3})")).otherwise(F.col("bucket"))
        ).withColumn(
            "salts", F.coalesce(F.nullif("_s", F.lit(0)), "salts")
        ).drop("_p", "_s")
    salt = F.when(F.col("salts") > 0, F.pmod(F.xxhash64("record"), F.col("salts"))).otherwise(0)
    return out.withColumn("salt", salt.cast("int")).withColumn("salted", F.col("salts") > 0).drop("salts")


def _count_in_tries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by bucket and salt; one trie at a time is held."""
    import hashlib

    trie, at, salted = None, None, False

    def flush() -> pd.DataFrame | None:
        rows = []
        for key, records in trie.terminals() if trie else ():
            digest, least = hashlib.md5(key, usedforsecurity=False).digest(), min(records)
            # the first row of a terminal carries its counter
            rows += [(digest, r, least, len(records), salted, i == 0) for i, r in enumerate(records)]
        return pd.DataFrame(rows, columns=["digest", "record", "least", "copies", "salted", "terminal"]) if rows else None

    for batch in batches:
        for canon, record, bucket, salt, s in zip(batch["canon"], batch["record"], batch["bucket"], batch["salt"], batch["salted"]):
            if at != (bucket, salt):
                if (done := flush()) is not None:
                    yield done
                trie, at, salted = CountingTrie(), (bucket, salt), bool(s)
            trie.add(bytes(canon), record)
    if (done := flush()) is not None:
        yield done


def format_copies(records: DataFrame, key: str, text: str, bucket_rows: int = 50_000) -> DataFrame:
    """One row per record and class: (record, digest, least, copies): the class, its least key and its number of records."""
    base = records.select(F.col(key).cast("string").alias("record"), F.col(text).alias("text")).where(
        "record is not null and text is not null"
    )
    canon = checkpointed(base.select("record", canonical_udf("text").alias("canon")).distinct())
    buckets = _radix_buckets(canon, bucket_rows)
    width = shuffle_width(records.sparkSession)
    counted = (
        buckets.repartition(width, "bucket", "salt")
        .sortWithinPartitions("bucket", "salt")
        .mapInPandas(_count_in_tries, "digest binary, record string, least string, copies bigint, salted boolean, terminal boolean")
    )
    if not buckets.where("salted").limit(1).count():
        return counted.select("record", "digest", "least", "copies")
    counted = checkpointed(counted)
    # one row per salt of a class: at most twice rows / bucket_rows in all
    merged = counted.where("salted and terminal").groupBy("digest").agg(
        F.min("least").alias("least"), F.sum("copies").alias("copies")
    )
    parts = counted.where("salted").select("record", "digest").join(merged, "digest").select("record", "digest", "least", "copies")
    return counted.where(~F.col("salted")).select("record", "digest", "least", "copies").unionByName(parts)


def passages(rag: DataFrame) -> DataFrame:
    """(chunk_id, text) of the gold and retrieved elements whose chunk_id is not null, as often as listed."""
    both = F.concat(F.coalesce("gold_chunks", F.array()), F.coalesce("retrieved_chunks", F.array()))
    return rag.select(F.explode(both).alias("c")).select("c.chunk_id", "c.text").where("chunk_id is not null and text is not null")
