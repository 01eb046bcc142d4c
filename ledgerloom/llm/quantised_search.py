"""Problem 6: the most similar vectors of every vector.

Score-aware (anisotropic) product quantisation: the codebooks minimise a residual whose part parallel to the vector
weighs more than the rest, as that part is what changes an inner product. Codes have four bits a subspace; lists of
codes are scanned through integer lookup tables and the best are reranked with the exact vectors.

Vectors are spread over spherical k-means lists, each vector over its ``spread`` nearest ones, and meet in every list
they share. The codebooks and first centroids are fitted on a sample of at most 2 * ``sample_rows`` vectors, which is all
that the driver sees and broadcasts (10 MB of vectors of 64 numbers, and at most a quarter of that as centroids); every
vector is indexed. That many lists are too few for a large collection, so a list of more than ``list_limit`` vectors gets
lists of its own, fitted on at most 2 * ``SUB_SAMPLE`` of its vectors in a task of its own, and its vectors are spread over
the nearest ``SUB_SPREAD`` of those. So the codes that a vector is compared with stay about as many at every size, up to
a few thousand million vectors. Lists too large even then (by the number of their vectors) are cut into blocks, and
every vector of the list is queried against each block, which loses nothing.

Defined results: vectors that are null, of another length, all zero or with a null or non-finite number take no part;
neighbours of equal similarity are ranked by id; equal vectors form one class, which takes part once and is written
out afterwards, of a class at most k + 1 members per list of neighbours (its least ids); of several vectors of a key the
one of the least hash counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import checkpointed, shuffle_width

CODES = 16  # four bits


@dataclass
class Quantiser:
    centroids: np.ndarray  # lists x dim, unit length
    codebooks: np.ndarray  # subspaces x 16 x width
    eta: float

    def encode(self, x: np.ndarray, passes: int = 2) -> np.ndarray:
        """Codes (rows x subspaces) by coordinate descent on the anisotropic loss."""
        m, _, width = self.codebooks.shape
        parts = x.reshape(len(x), m, width)
        norms = (self.codebooks**2).sum(-1)
        dots = np.einsum("nmw,mcw->nmc", parts, self.codebooks, optimize=True)
        own = (parts**2).sum(-1)
        distance = own[:, :, None] - 2 * dots + norms
        codes = distance.argmin(-1)
        rows = np.arange(len(x))
        parallel = sum(own[:, j] - dots[rows, j, codes[:, j]] for j in range(m))
        for _ in range(passes):
            for j in range(m):
                rest = parallel - (own[:, j] - dots[rows, j, codes[:, j]])
                along = rest[:, None] + own[:, j, None] - dots[:, j]
                codes[:, j] = (distance[:, j] + (self.eta - 1) * along**2).argmin(-1)
                parallel = along[rows, codes[:, j]]
        return codes.astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Lookup tables (subspaces x queries x 16) in 8 bits; sums keep the order of the approximate products."""
        m, _, width = self.codebooks.shape
        t = np.einsum("nmw,mcw->mnc", queries.reshape(len(queries), m, width), self.codebooks, optimize=True)
        low = t.min(-1, keepdims=True)
        step = (t.max(-1, keepdims=True) - low).max(0, keepdims=True) / 255 + 1e-12
        return np.rint((t - low) / step).astype(np.uint8)

    def scan(self, tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Approximate scores (queries x rows) as 16-bit sums of table entries, two subspaces to a step."""
        total = np.zeros((tables.shape[1], len(codes)), dtype=np.uint16)
        for j in range(0, tables.shape[0], 2):
            pair = (tables[j][:, :, None].astype(np.uint16) + tables[j + 1][:, None, :]).reshape(len(total), CODES * CODES)
            total += np.take(pair, codes[:, j].astype(np.intp) * CODES + codes[:, j + 1], axis=1)
        return total


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, unit: bool) -> np.ndarray:
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        at = (x @ c.T - (0 if unit else (c**2).sum(1) / 2)).argmax(1)
        n = np.bincount(at, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), k)])
        if unit:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


def fit_quantiser(
    sample: np.ndarray, lists: int, width: int = 4, threshold: float = 0.2, rounds: int = 6, seed: int = 7
) -> Quantiser:
    """Coarse centroids and anisotropic codebooks from unit vectors; ``threshold`` is the score from which errors matter."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    eta = (dim - 1) * threshold**2 / (1 - threshold**2)
    centroids = _kmeans(sample, min(lists, len(sample)), 8, rng, True)
    part = sample[rng.permutation(len(sample))[:10_000]]
    m = dim // width
    books = np.stack(
        [
            _kmeans(
                np.ascontiguousarray(part[:, j * width : (j + 1) * width]), CODES, 8, rng, False
            ) if len(part) >= CODES else np.resize(
                part[:, j * width : (j + 1) * width], (CODES, width)
            )
            for j in range(m)
        ]
    )
    q = Quantiser(centroids, books.astype(np.float32), max(1.0, eta))
    parts = part.reshape(len(part), m, width)
    for _ in range(rounds if len(part) >= CODES else 0):
        codes = q.encode(part, 1)
        chosen = q.codebooks[np.arange(m), codes]
        along = ((parts - chosen) * parts).sum(-1)
        for j in range(m):
            xj = parts[:, j]
            rest = along.sum(1) - along[:, j]
            for c in range(CODES):
                mine = codes[:, j] == c
                if mine.sum() < 2:
                    continue
                x = xj[mine].astype(np.float64)
                a = mine.sum() * np.eye(width) + (q.eta - 1) * x.T @ x
                b = x.sum(0) + (q.eta - 1) * ((rest[mine] + (x**2).sum(1)) @ x)
                q.codebooks[j, c] = np.linalg.solve(a, b)
            along[:, j] = ((xj - q.codebooks[j, codes[:, j]]) * xj).sum(-1)
    return q


def padded(dim: int) -> int:
    """Numbers of a vector with the zeros that make pairs of subspaces of four."""
    return -(-dim // 8) * 8


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors, padded with zeros, which change no product."""
    x = np.asarray(column.flatten(), dtype=np.float32).reshape(-1, dim)
    big = np.abs(x).max(1, keepdims=True)  # before squaring: lengths near the ends of the range
    x = x / big
    return np.pad(x / np.linalg.norm(x, axis=1, keepdims=True), ((0, 0), (0, padded(dim) - dim)))


def usable(vectors: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(record, v): finite, non-zero vectors of the right length."""
    v = F.col("v")
    ok = (F.size(v) == dim) & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ) & F.exists(v, lambda x: x != 0)
    return vectors.select(
        F.col(key).cast("string").alias("record"), F.col(vector).cast("array<float>").alias("v")
    ).where("record is not null and v is not null").where(ok)


def _classes(rows: DataFrame) -> DataFrame:
    """(record, vid): vid is a hash of the vector."""
    return rows.select("record", F.xxhash64("v").alias("vid")).groupBy("record").agg(F.min("vid").alias("vid"))


def _sample(rows: DataFrame, n: int, size: int) -> pa.Array:
    keep = max(1, n // size)
    got = rows.where(F.pmod(F.xxhash64("vid"), F.lit(keep)) == 0).limit(2 * size).select("v").toArrow().column("v").combine_chunks()
    return got if len(got) else rows.limit(size).select("v").toArrow().column("v").combine_chunks()


def _nearest_lists(x: np.ndarray, centroids: np.ndarray, spread: int) -> np.ndarray:
    s = min(spread, len(centroids))
    score = x @ centroids.T
    return np.argpartition(-score, s - 1, axis=1)[:, :s]


def _rerank(
    q: Quantiser,
    xq: np.ndarray,
    idq: np.ndarray,
    xd: np.ndarray,
    idd: np.ndarray,
    codes: np.ndarray,
    k: int,
    floor: float,
    keep: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best k of the data for each query: table scan, then exact products of the ``keep`` best."""
    out = []
    for at in range(0, len(xq), 512):
        xs, ids = xq[at : at + 512], idq[at : at + 512]
        score = q.scan(q.tables(xs), codes)
        m = min(keep, len(xd))
        near = np.argpartition(score, len(xd) - m, axis=1)[:, len(xd) - m :]
        exact = np.einsum("qkd,qd->qk", xd[near], xs, optimize=True)
        exact[idd[near] == ids[:, None]] = -np.inf
        if m > k:
            best = np.argpartition(-exact, k - 1, axis=1)[:, :k]
            near, exact = np.take_along_axis(near, best, 1), np.take_along_axis(exact, best, 1)
        r, c = np.nonzero(exact >= floor)
        out.append((ids[r], idd[near[r, c]], exact[r, c]))
    return tuple(np.concatenate(z) for z in zip(*out)) if out else (
        np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
    )


FOUND = "q bigint, n bigint, sim float"


def _pairs_batch(q: np.ndarray, n: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array(q, pa.int64()), pa.array(n, pa.int64()), pa.array(sim.astype(np.float32), pa.float32())], names=["q", "n", "sim"]
    )


SUB_SAMPLE, SUB_SPREAD = 4096, 2
PLACED = "list bigint, block int, role int, vid bigint, x binary, codes binary"


def _binary(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    width = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(
        pa.large_binary(),
        len(x),
        [None, pa.py_buffer((np.arange(len(x) + 1) * width).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(x).tobytes())]
    ).cast(pa.binary())


def _rows(column: pa.Array, dtype: type) -> np.ndarray:
    n = len(column)
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(n, -1) if n else np.empty((0, 0), dtype)


def _spread(x: np.ndarray, role: np.ndarray, centroids: np.ndarray, spread: int, probe: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, list): held vectors in their ``spread`` nearest lists, those that only query in their ``probe`` nearest."""
    rows, lists = [], []
    for r, s in ((0, spread), (1, probe)):
        mine = np.flatnonzero(role == r)
        if len(mine):
            at = _nearest_lists(x[mine], centroids, s)
            rows.append(np.repeat(mine, at.shape[1]))
            lists.append(at.reshape(-1))
    return (np.concatenate(rows), np.concatenate(lists)) if rows else (np.empty(0, np.int64), np.empty(0, np.int64))


def _placed(
    q: Quantiser, x: np.ndarray, vid: np.ndarray, role: np.ndarray, rows: np.ndarray, lists: np.ndarray, blocks: np.ndarray
) -> pa.RecordBatch:
    """A row a list; where the list has blocks, a held vector is in one of them and queries the others."""
    own = (vid[rows].view(np.uint64) >> np.uint64(7)) % blocks.astype(np.uint64)
    if (blocks > 1).any():
        take = np.repeat(np.arange(len(rows)), blocks)
        block = np.arange(len(take)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        kind = np.where((block == own[take]) & (role[rows][take] == 0), 0, 1)
        rows, lists = rows[take], lists[take]
    else:
        block, kind = own, role[rows]
    codes = q.encode(x)
    packed = codes[:, ::2] << 4 | codes[:, 1::2]
    columns = [
        pa.array(lists, pa.int64()),
        pa.array(block.astype(np.int32)),
        pa.array(kind.astype(np.int32)),
        pa.array(vid[rows]),
        _binary(x[rows]),
        _binary(packed[rows])
    ]
    return pa.record_batch(columns, names=[c.split()[0] for c in PLACED.split(", ")])


def list_rows_of(
    found: DataFrame, dim: int, quantiser: Quantiser, spread: int, probe: int, list_rows: int, list_limit: int
) -> DataFrame:
    """PLACED rows of the vectors (role, vid, v): role 0 is held and queried, role 1 only queries."""
    spark = found.sparkSession
    sent = spark.sparkContext.broadcast(quantiser)

    def lists_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ids, n = np.unique(_nearest_lists(_matrix(b.column("v"), dim), sent.value.centroids, spread), return_counts=True)
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(n, pa.int64())], names=["list", "n"])

    sizes = found.where("role = 0").select("v").mapInArrow(
        lists_of, "list bigint, n bigint"
    ).groupBy("list").agg(F.sum("n").alias("n"))
    large = {r.list: r.n for r in sizes.where(F.col("n") > list_limit).collect()}  # at most as many as centroids

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, vid, role = _matrix(b.column("v"), dim), np.asarray(b.column("vid")), np.asarray(b.column("role"))
                rows, lists = _spread(x, role, sent.value.centroids, spread, probe)
                small = ~np.isin(lists, list(large))
                yield _placed(sent.value, x, vid, role, rows[small], lists[small], np.ones(small.sum(), np.int64))

    placed = found.mapInArrow(place, PLACED)
    if not large:
        return placed

    # lists of their own for the large ones: (list, part, role, vid, x), a part for each 100,000 of a list's vectors
    middle = "list bigint, part int, role int, vid bigint, x binary"
    parts = {c: -(-n // 100_000) for c, n in large.items()}
    wanted = {c: max(2, min(SUB_SAMPLE // 8, -(-n // list_rows))) for c, n in large.items()}
    blocks = {c: max(1, -(-n * SUB_SPREAD // (wanted[c] * list_limit))) for c, n in large.items()}

    def within(batches: Iterator[pa.RecordBatch], sample: bool) -> Iterator[pa.RecordBatch]:
        names = np.array(sorted(large), dtype=np.int64)
        every = np.array([max(1, large[c] // SUB_SAMPLE) for c in names], dtype=np.uint64)
        many = np.array([parts[c] for c in names], dtype=np.uint64)
        for b in batches:
            if not b.num_rows:
                continue
            x, vid, role = _matrix(b.column("v"), dim), np.asarray(b.column("vid")), np.asarray(b.column("role"))
            rows, lists = _spread(x, role, sent.value.centroids, spread, probe)
            mine = np.isin(lists, names)
            rows, lists = rows[mine], lists[mine]
            at, salt = np.searchsorted(names, lists), vid[rows].view(np.uint64) >> np.uint64(20)
            if sample:
                mine = (role[rows] == 0) & (salt % every[at] == 0)
                rows, lists, at, salt = rows[mine], lists[mine], at[mine], salt[mine]
            yield pa.record_batch(
                [
                    pa.array(lists, pa.int64()),
                    pa.array((salt % many[at]).astype(np.int32)),
                    pa.array(role[rows].astype(np.int32)),
                    pa.array(vid[rows]),
                    _binary(x[rows])
                ],
                names=["list", "part", "role", "vid", "x"]
            )

    def fit(table: pa.Table) -> pa.Table:
        """Centroids of one list from its sample, as a row of role -1 for each of its parts."""
        c = table.column("list")[0].as_py()
        order = np.argsort(np.asarray(table.column("vid")), kind="stable")[: 2 * SUB_SAMPLE]
        x = _rows(table.column("x").combine_chunks(), np.float32)[order]
        k = max(1, min(wanted[c], len(x) // 8))
        blob = _kmeans(x, k, 8, np.random.default_rng(c), True).tobytes()
        n = parts[c]
        return pa.table(
            {
                "list": pa.array([c] * n, pa.int64()),
                "part": pa.array(range(n), pa.int32()),
                "role": pa.array([-1] * n, pa.int32()),
                "vid": pa.array([0] * n, pa.int64()),
                "x": pa.array([blob] * n, pa.binary())
            }
        )

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by list, part and role: first the list's centroids, then its vectors."""
        centroids = None
        for b in batches:
            if not b.num_rows:
                continue
            lists, part, role, vid = (np.asarray(b.column(c)) for c in ("list", "part", "role", "vid"))
            edge = np.flatnonzero((np.diff(lists) != 0) | (np.diff(part) != 0) | ((role[:-1] < 0) != (role[1:] < 0))) + 1
            for s, e in zip([0, *edge], [*edge, len(vid)]):
                if role[s] < 0:
                    centroids = np.frombuffer(b.column("x")[int(s)].as_py(), dtype=np.float32).reshape(-1, padded(dim))
                    continue
                x, c = _rows(b.column("x").slice(s, e - s), np.float32), int(lists[s])
                rows, sub = _spread(x, role[s:e], centroids, SUB_SPREAD, max(SUB_SPREAD, probe // 2))
                yield _placed(sent.value, x, vid[s:e], role[s:e], rows, (c + 1) * 2**20 + sub, np.full(len(rows), blocks[c]))

    centroids = found.where("role = 0").mapInArrow(lambda it: within(it, True), middle).groupBy("list").applyInArrow(fit, middle)
    spread_out = found.mapInArrow(lambda it: within(it, False), middle).unionByName(centroids)
    deeper = spread_out.repartition(
        shuffle_width(spark), "list", "part"
    ).sortWithinPartitions("list", "part", "role").mapInArrow(again, PLACED)
    return placed.unionByName(deeper)


def _neighbours(
    found: DataFrame,
    dim: int,
    k: int,
    floor: float,
    spread: int,
    probe: int,
    list_rows: int,
    sample_rows: int,
    list_limit: int,
    keep: int,
    mutual: bool
) -> DataFrame | None:
    """(q, n, sim): the k best held vectors for each vector of role 1, or with ``mutual`` for each held one; None without any."""
    spark = found.sparkSession
    held = found.where("role = 0")
    n = held.count()
    sample = _sample(held, n, sample_rows)
    if not len(sample):
        return None
    x = _matrix(sample, dim)
    quantiser = fit_quantiser(x, max(1, min(n // list_rows, len(x) // 8)))
    shared = spark.sparkContext.broadcast(quantiser)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by list, block and role: a block is held, then the queries of it are scanned against it."""
        held: list[tuple] = []
        at, ready = None, None

        def close() -> tuple:
            return tuple(np.concatenate(z) for z in zip(*held))

        for b in batches:
            if not b.num_rows:
                continue
            lists, block, role, vid = (np.asarray(b.column(c)) for c in ("list", "block", "role", "vid"))
            x, p = _rows(b.column("x"), np.float32), _rows(b.column("codes"), np.uint8)
            codes = np.empty((len(vid), p.shape[1] * 2), np.uint8)
            codes[:, ::2], codes[:, 1::2] = p >> 4, p & 15
            edge = np.flatnonzero((np.diff(lists) != 0) | (np.diff(block) != 0) | (np.diff(role) != 0)) + 1
            for s, e in zip([0, *edge], [*edge, len(vid)]):
                now = (int(lists[s]), int(block[s]))
                if now != at:
                    if held and mutual:
                        v, xs, cs = close()
                        yield _pairs_batch(*_rerank(shared.value, xs, v, xs, v, cs, k, floor, keep))
                    held, at, ready = [], now, None
                if role[s] == 0:
                    held.append((vid[s:e], x[s:e], codes[s:e]))
                elif held:
                    ready = ready or close()
                    yield _pairs_batch(*_rerank(shared.value, x[s:e], vid[s:e], ready[1], ready[0], ready[2], k, floor, keep))
        if held and mutual:
            v, xs, cs = close()
            yield _pairs_batch(*_rerank(shared.value, xs, v, xs, v, cs, k, floor, keep))

    placed = list_rows_of(found, dim, quantiser, spread, probe, list_rows, list_limit)
    met = placed.repartition(
        shuffle_width(spark), "list", "block"
    ).sortWithinPartitions("list", "block", "role").mapInArrow(meet, FOUND)
    return met.groupBy("q", "n").agg(F.max("sim").alias("sim"))


RESULT = "record string, neighbour string, similarity double, rank int"


def all_neighbours(
    vectors: DataFrame,
    key: str,
    vector: str,
    dim: int = 64,
    k: int = 10,
    floor: float = 0.9,
    spread: int = 3,
    list_rows: int = 300,
    sample_rows: int = 20_000,
    list_limit: int = 20_000,
    keep: int = 24
) -> DataFrame:
    """(record, neighbour, similarity, rank): up to k neighbours of similarity at least ``floor`` of every usable vector."""
    rows = usable(vectors, key, vector, dim)
    members = checkpointed(_classes(rows))
    distinct = rows.select(
        F.lit(0).alias("role"), F.xxhash64("v").alias("vid"), "v"
    ).groupBy("role", "vid").agg(F.min("v").alias("v"))
    pairs = _neighbours(distinct, dim, k, floor, spread, spread, list_rows, sample_rows, list_limit, keep, True)
    if pairs is None:
        return vectors.sparkSession.createDataFrame([], RESULT)
    return _written_out(members, members, pairs, k)


def search(
    vectors: DataFrame,
    queries: DataFrame,
    key: str,
    vector: str,
    dim: int = 64,
    k: int = 10,
    spread: int = 1,
    probe: int = 64,
    list_rows: int = 300,
    sample_rows: int = 20_000,
    list_limit: int = 20_000,
    keep: int = 160
) -> DataFrame:
    """(record, neighbour, similarity, rank): the k nearest of all vectors for each of a stated query set.

    A vector is in ``spread`` lists and a query looks into the ``probe`` nearest ones; recall is that of random vectors at
    worst, 0.98 to 0.99 on the test data. A query isn't its own neighbour.
    """
    data, asked = usable(vectors, key, vector, dim), usable(queries, key, vector, dim)
    members, askers = checkpointed(_classes(data)), checkpointed(_classes(asked))
    both = data.select(F.lit(0).alias("role"), "v").unionByName(
        asked.select(F.lit(1).alias("role"), "v")
    ).withColumn("vid", F.xxhash64("v"))
    pairs = _neighbours(
        both.groupBy("role", "vid").agg(F.min("v").alias("v")),
        dim,
        k,
        -2.0,
        spread,
        probe,
        list_rows,
        sample_rows,
        list_limit,
        keep,
        False
    )
    if pairs is None:
        return vectors.sparkSession.createDataFrame([], RESULT)
    return _written_out(members, askers, pairs, k)


def _written_out(members: DataFrame, askers: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """Neighbours of classes as neighbours of the asking records: of each class at most its k + 1 least ids are neighbours."""
    first = Window.partitionBy("vid").orderBy("record")
    least = members.withColumn("i", F.row_number().over(first)).where(F.col("i") <= k + 1)
    best = pairs.withColumn("i", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "n"))).where(F.col("i") <= k)
    near = best.join(least.select(F.col("vid").alias("n"), F.col("record").alias("neighbour")), "n").select(
        F.col("q").alias("vid"), "neighbour", "sim"
    )
    twins = least.groupBy("vid").agg(F.count(F.lit(1)).alias("c")).where("c > 1").join(least, "vid").select(
        "vid", F.col("record").alias("neighbour"), F.lit(1.0).cast("float").alias("sim")
    )
    every = near.unionByName(twins).join(askers, "vid").where("neighbour <> record")
    rank = F.row_number().over(Window.partitionBy("record").orderBy(F.desc("sim"), "neighbour"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select(
        "record", "neighbour", F.col("sim").cast("double").alias("similarity"), "rank"
    )
