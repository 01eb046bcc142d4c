"""Vector collection: embedding, upsert by chunk, exact cosine search of a query set."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.ports import Embedder, HashEmbedder
from ledgerloom.session import checkpointed, shuffle_width
from ledgerloom.settings import DEFAULT

CHUNK_TYPES = ("mda", "risk_factors", "financial_statements", "general")


def embed(chunks: DataFrame, text: str = "text", embedder: Embedder | None = None) -> DataFrame:
    return chunks.withColumn("embedding", (embedder or HashEmbedder()).embed(F.col(text)))


def collection_rows(chunks: DataFrame) -> DataFrame:
    """Rows as the collection keeps them: embedded chunks only, defaults for missing metadata, known types."""
    kind = F.when(F.col("chunk_type").isin(*CHUNK_TYPES), F.col("chunk_type")).otherwise("general")
    put = {
        "ticker": F.coalesce("ticker", F.lit("unknown")), "chunk_type": kind, "page_number": F.coalesce("page_number", F.lit(-1))
    }
    if "fiscal_period" in chunks.columns:
        put["fiscal_period"] = F.coalesce("fiscal_period", F.lit("unknown"))
    return chunks.where("chunk_id is not null and embedding is not null").withColumns(put)


def upsert(old: DataFrame, new: DataFrame, key: str = "chunk_id", version: str | None = None) -> DataFrame:
    """The old rows whose key has no new row, and the new rows (of several for a key the latest ``version``)."""
    if version:
        others = [c for c in new.columns if c != key]
        # ties of the version are settled by the rows' content, so that the result doesn't depend on their order
        latest = F.max_by(F.struct(*others), F.struct(version, F.xxhash64(*others)))
        new = new.groupBy(key).agg(latest.alias("_r")).select(key, *[F.col("_r")[c].alias(c) for c in others])
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


class VectorIndex:
    """A collection in a folder: Parquet files in buckets by a hash of the key, and manifests that name the files in force.

    An upsert reads and writes only the buckets that its keys fall into, then makes a manifest, which is what readers
    start from: they see a whole version or the one before. Two writers that start from one version both try to make the
    same manifest, and the second one fails. The files of all but the last two versions are removed.
    """

    def __init__(self, spark: SparkSession, path: str, embedder: Embedder | None = None, buckets: int = 64):
        self.spark, self.path, self.embedder, self.buckets = spark, path, embedder or HashEmbedder(), buckets
        self._jvm = spark.sparkContext._jvm
        folder = self._path(path)
        self._fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _versions(self) -> list[int]:
        folder = self._path(f"{self.path}/manifests")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def _manifest(self, version: int) -> dict:
        """{"buckets": number, "files": {bucket: folder}, "schema": ...} of a version."""
        stream = self._fs.open(self._path(f"{self.path}/manifests/{version}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, version: int, manifest: dict) -> None:
        # written aside, then renamed, which fails where the version is there already
        part = self._path(f"{self.path}/manifests/.{version}-{uuid.uuid4().hex}")
        stream = self._fs.create(part, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        target = self._path(f"{self.path}/manifests/{version}.json")
        if self._fs.exists(target) or not self._fs.rename(part, target):
            self._fs.delete(part, False)
            raise RuntimeError(f"version {version} of {self.path} was written by another one")

    def _current(self) -> tuple[int, dict]:
        v = self._versions()
        return (v[-1], self._manifest(v[-1])) if v else (0, {"buckets": self.buckets, "files": {}, "schema": None})

    def _rows(self, manifest: dict, buckets: list[str]) -> DataFrame | None:
        folders = [f"{self.path}/data/{manifest['files'][b]}" for b in buckets if b in manifest["files"]]
        if not manifest["schema"]:
            return None
        schema = T.StructType.fromJson(json.loads(manifest["schema"]))
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame | None:
        _, manifest = self._current()
        return self._rows(manifest, sorted(manifest["files"]))

    def upsert(self, chunks: DataFrame, version: str | None = None) -> None:
        """Replaces and adds by ``chunk_id``; of several new rows of a key the one of the greatest ``version`` stays, of
        equal ones the one whose content has the greatest hash."""
        number, manifest = self._current()
        rows = chunks if "embedding" in chunks.columns else embed(chunks, embedder=self.embedder)
        bucket = F.pmod(F.xxhash64("chunk_id"), F.lit(manifest["buckets"])).cast("int")
        rows = checkpointed(collection_rows(rows).withColumn("_bucket", bucket))
        touched = [str(r._bucket) for r in rows.select("_bucket").distinct().collect()]  # at most as many as buckets
        if not touched:
            return
        ordered = rows.drop("_bucket").withColumn("_order", F.col(version) if version else F.lit(0))
        old = self._rows(manifest, touched)
        start = ordered.drop("_order").limit(0) if old is None else old
        merged = upsert(start, ordered, version="_order").drop("_order").withColumn("_bucket", bucket)
        label = f"{number + 1}-{uuid.uuid4().hex}"
        merged.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{label}")
        files = manifest["files"] | {b: f"{label}/_bucket={b}" for b in touched}
        self._commit(number + 1, {"buckets": manifest["buckets"], "files": files, "schema": merged.drop("_bucket").schema.json()})
        self._vacuum()

    def clear(self) -> None:
        number, manifest = self._current()
        if manifest["files"]:
            self._commit(number + 1, manifest | {"files": {}})

    def _vacuum(self, keep: int = 2) -> None:
        """Removes the manifests of all but the last versions, and the files that the removed ones alone named."""
        versions = self._versions()
        live = {f for v in versions[-keep:] for f in self._manifest(v)["files"].values()}
        for v in versions[:-keep]:
            for f in set(self._manifest(v)["files"].values()) - live:
                self._fs.delete(self._path(f"{self.path}/data/{f}"), True)
            self._fs.delete(self._path(f"{self.path}/manifests/{v}.json"), False)

    def search(self, queries: DataFrame, k: int = DEFAULT.top_k, floor: float = DEFAULT.similarity_floor) -> DataFrame:
        """(query_id, rank, id, similarity) for queries (query_id, query, ticker or null)."""
        asked = queries.withColumn("embedding", self.embedder.embed(F.col("query")))
        return search(self.read(), asked, "chunk_id", "query_id", k=k, floor=floor, group="ticker")


def _unit(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, and which rows are usable (first row's length, finite, not zero)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths().fill_null(0))
    dim = int(lengths[lengths > 0][0]) if (lengths > 0).any() else 0
    ok = lengths == dim if dim else np.zeros(len(column), dtype=bool)
    x = np.zeros((len(column), dim))
    if ok.any():
        x[ok] = np.asarray(column.filter(pa.array(ok)).flatten().cast(pa.float64()).fill_null(np.nan)).reshape(-1, dim)
    with np.errstate(all="ignore"):
        norm = np.sqrt((x * x).sum(1))
    ok = ok & np.isfinite(norm) & (norm > 0)
    x[~ok] = 0
    return x / np.where(ok, norm, 1)[:, None], ok


#: Queries that are broadcast at once or held at once in a task, and rows of a group that one task scans.
BLOCK_QUERIES, BLOCK_ROWS = 10_000, 200_000


def _best(
    xq: np.ndarray, xd: np.ndarray, allowed: np.ndarray | None, k: int, floor: float | None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, similarity) of the k greatest products of each query; ties at the edge are kept for the final rank."""
    s = xq @ xd.T
    if allowed is not None:
        s[~allowed] = -np.inf
    if floor is not None:
        s[s < floor - 1e-12] = -np.inf
    m = min(s.shape[1], k)
    edge = np.partition(s, s.shape[1] - m, axis=1)[:, s.shape[1] - m]
    r, c = np.nonzero((s >= edge[:, None]) & np.isfinite(s))
    return r, c, s[r, c]


def search(
    index: DataFrame,
    queries: DataFrame,
    id_col: str,
    query_col: str,
    k: int = DEFAULT.top_k,
    floor: float | None = None,
    group: str | None = None,
    vector: str = "embedding",
    exclude_self: bool = False,
    block_queries: int = BLOCK_QUERIES
) -> DataFrame:
    """(query, rank, id, similarity): the k rows of greatest cosine for each query of a stated set, exactly.

    With ``group`` a query sees the rows of its own group only, and all rows where its group is null. Up to
    ``block_queries`` queries are broadcast and the index is scanned once; beyond that, grouped queries meet the rows of
    their group in tasks by group (large groups in several), and ungrouped ones are broadcast block by block. Every
    batch keeps its k best, so only k rows a batch and query are shuffled. Unusable vectors take no part; equal
    similarities rank by id.
    """
    key = (F.col(group) if group else F.lit(None)).cast("string").alias("g")
    rows = index.select(F.col(id_col).alias("id"), key, F.col(vector).alias("v")).where("v is not null")
    asked = queries.select(F.col(query_col).alias("q"), key, F.col(vector).alias("v")).where("v is not null")
    schema = f"query {asked.schema['q'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, similarity double"
    n = asked.count()
    if n <= block_queries:
        found = _scan(rows, asked, schema, k, floor, exclude_self)
    else:
        found = _by_group(rows, asked.where("g is not null"), schema, k, floor, exclude_self, block_queries)
        apart = asked.where("g is null")
        parts = -(-apart.count() // block_queries)
        for i in range(parts):
            found = found.unionByName(
                _scan(rows, apart.where(F.pmod(F.xxhash64("q"), F.lit(parts)) == i), schema, k, floor, exclude_self)
            )
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "id", "similarity")


def _scan(rows: DataFrame, asked: DataFrame, schema: str, k: int, floor: float | None, exclude_self: bool) -> DataFrame:
    """Every row against a broadcast block of queries."""
    block = asked.toArrow()
    kind = block.column("q").type
    x, ok = _unit(block.column("v"))
    names = block.column("g").to_pylist()
    known = {g: j for j, g in enumerate(sorted({g for g in names if g is not None}))}
    codes = np.array([-1 if g is None else known[g] for g in names], dtype=np.int64)  # -1: every row
    sent = rows.sparkSession.sparkContext.broadcast(
        (np.array(block.column("q").to_pylist(), dtype=object)[ok], codes[ok], known, x[ok])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, groups, known, xq = sent.value
        for b in batches:
            xd, good = _unit(b.column("v"))
            own = np.array(b.column("id").to_pylist(), dtype=object)
            if not len(ids) or not good.any() or xd.shape[1] != xq.shape[1]:
                continue
            mine = np.array([known.get(g, -2) for g in b.column("g").to_pylist()], dtype=np.int64)
            allowed = good[None, :] & ((groups[:, None] == mine[None, :]) | (groups < 0)[:, None])
            if exclude_self:
                allowed &= ids[:, None] != own[None, :]
            r, c, s = _best(xq, xd, allowed, k, floor)
            yield pa.record_batch(
                [pa.array(ids[r].tolist(), kind), pa.array(own[c].tolist(), b.column("id").type), pa.array(s)],
                names=["query", "id", "similarity"]
            )

    return rows.mapInArrow(run, schema)


def _by_group(
    rows: DataFrame, asked: DataFrame, schema: str, k: int, floor: float | None, exclude_self: bool, block_queries: int
) -> DataFrame:
    """Queries against the rows of their group, in a cell for each block of a group's queries and part of its rows."""
    spark = rows.sparkSession
    sizes = asked.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / block_queries).cast("int").alias("_q"))
    sizes = checkpointed(sizes.join(rows.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("_r")), "g"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    q, r = F.pmod(F.xxhash64("q"), F.col("_q")).cast("int"), F.pmod(F.xxhash64("id"), F.col("_r")).cast("int")
    left = asked.join(sizes, "g").select(
        "g",
        q.alias("block"),
        spread(F.col("_r")).alias("part"),
        F.lit(0).alias("role"),
        "q",
        F.lit(None).cast(rows.schema["id"].dataType).alias("id"),
        "v"
    )
    right = rows.join(sizes, "g").select(
        "g",
        spread(F.col("_q")).alias("block"),
        r.alias("part"),
        F.lit(1).alias("role"),
        F.lit(None).cast(asked.schema["q"].dataType).alias("q"),
        "id",
        "v"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells come one after the other, their queries first."""
        at, ids, held = None, [], []
        xq = None
        for b in batches:
            if not b.num_rows:
                continue
            cells = list(
                zip(
                    b.column("g").to_pylist(),
                    b.column("block").to_pylist(),
                    b.column("part").to_pylist(),
                    b.column("role").to_pylist()
                )
            )
            edges = [0, *[i for i in range(1, len(cells)) if cells[i] != cells[i - 1]], len(cells)]
            for s, e in zip(edges, edges[1:]):
                if cells[s][:3] != at:
                    at, ids, held, xq = cells[s][:3], [], [], None
                if cells[s][3] == 0:
                    x, ok = _unit(b.column("v").slice(s, e - s))
                    if ok.any():
                        ids += [i for i, good in zip(b.column("q").slice(s, e - s).to_pylist(), ok) if good]
                        held.append(x[ok])
                    continue
                if xq is None and held:
                    width = held[0].shape[1]
                    xq = np.concatenate([h for h in held if h.shape[1] == width])
                    names = np.array(ids, dtype=object)
                xd, good = _unit(b.column("v").slice(s, e - s))
                if xq is None or not good.any() or xd.shape[1] != xq.shape[1]:
                    continue
                own = np.array(b.column("id").slice(s, e - s).to_pylist(), dtype=object)
                allowed = np.broadcast_to(good[None, :], (len(xq), len(own))).copy()
                if exclude_self:
                    allowed &= names[:, None] != own[None, :]
                i, j, sim = _best(xq, xd, allowed, k, floor)
                yield pa.record_batch(
                    [pa.array(names[i].tolist(), b.column("q").type), pa.array(own[j].tolist(), b.column("id").type), pa.array(sim)],
                    names=["query", "id", "similarity"]
                )

    cells = left.unionByName(right).repartition(
        shuffle_width(spark), "g", "block", "part"
    ).sortWithinPartitions("g", "block", "part", "role")
    return cells.mapInArrow(run, schema)
