import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import retrieval as rt
from ledgerloom.operators import vectors as vx
from ledgerloom.pipeline import AnalysisPipeline
from ledgerloom.settings import DEFAULT, Settings
from ledgerloom.streaming.drop_folder import index_drop_folder


def test_settings_guard():
    with pytest.raises(ValueError):
        Settings(similarity_floor=0.6, routing_similarity=0.6)


@pytest.mark.parametrize(
    ("n", "score", "retries", "again"),
    [(0, 0.2, 0, True), (5, 0.9, 0, False), (5, 0.55, 0, True), (1, 0.95, 0, True), (0, 0.0, 2, False)]
)
def test_routing(spark, n, score, retries, again):
    assert spark.range(1).select(rt.routing(F.lit(n), F.lit(score), F.lit(retries)).alias("x")).first().x is again


def test_reformulation(spark):
    df = spark.createDataFrame([("What is the revenue?",), ("What is the?",)], "q string")
    rows = df.select(*[rt.reformulate(F.col("q"), F.lit(i)).alias(f"a{i}") for i in range(3)]).collect()
    assert tuple(rows[0]) == ("What is the revenue?", "Provide detailed information about: What is the revenue?", "revenue")
    assert rows[1].a2 == "What is the?"


@pytest.mark.parametrize(("queries", "rows"), [(100, 200_000), (7, 200_000), (3, 11)])
def test_search_is_exact(spark, monkeypatch, queries, rows):
    """Broadcast at once, and by groups and blocks."""
    monkeypatch.setattr(vx, "BLOCK_ROWS", rows)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    data = [(i, x[i].astype("float32").tolist(), i % 3) for i in range(300)] + [
        (900, None, 0), (901, [0.0] * 8, 0), (902, [float("nan")] * 8, 1), (903, [1.0], 1), (904, [1.0] * 8, None)
    ]
    df = spark.createDataFrame(data, "id int, embedding array<float>, g int").repartition(5)
    asked = df.where("id < 20").select(F.col("id").alias("q"), "embedding", F.when(F.col("id") < 10, F.col("g")).alias("g"))
    got = vx.search(df, asked, "id", "q", k=4, group="g", exclude_self=True, block_queries=queries).collect()
    u = np.vstack([x.astype("float32").astype(float), np.ones(8)])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    ids = np.array([*range(300), 904])
    for q in range(20):
        s = u @ u[q]
        s[q] = -9
        if q < 10:
            s[(ids % 3 != q % 3) | (ids == 904)] = -9
        assert [r.id for r in sorted((r for r in got if r.query == q), key=lambda r: r.rank)] == ids[np.argsort(-s)[:4]].tolist()


def test_index_upserts_and_clears(spark, tmp_path):
    index = vx.VectorIndex(spark, str(tmp_path / "index"))
    make = lambda rows: spark.createDataFrame(
        rows, "chunk_id string, doc_id string, ticker string, chunk_type string, page_number int, text string"
    )
    index.upsert(make([("a", "d", None, "odd", None, "net sales rose"), ("b", "d", "T", "mda", 3, "costs fell")]))
    index.upsert(make([("b", "d", "T", "mda", 4, "costs fell again")]))
    rows = {r.chunk_id: r for r in index.read().collect()}
    assert (rows["a"].ticker, rows["a"].chunk_type, rows["a"].page_number, rows["b"].page_number) == ("unknown", "general", -1, 4)
    asked = spark.createDataFrame([("q", "net sales rose", None)], "query_id string, query string, ticker string")
    assert [r.id for r in index.search(asked, k=1).collect()] == ["a"]
    index.clear()
    assert index.read().count() == 0


def test_upserts_touch_only_their_buckets(spark, tmp_path):
    index = vx.VectorIndex(spark, str(tmp_path / "index"), buckets=8)
    rows = [(f"c{i}", f"text {i}", 1) for i in range(200)]
    index.upsert(
        spark.createDataFrame(rows, "chunk_id string, text string, v int").selectExpr(
            "*", "'T' AS ticker", "'mda' AS chunk_type", "1 AS page_number"
        )
    )
    _, first = index._current()
    again = spark.createDataFrame(
        [("c7", "old", 2), ("c7", "new", 3), (None, "x", 1)], "chunk_id string, text string, v int"
    ).selectExpr(
        "*", "'U' AS ticker", "'mda' AS chunk_type", "2 AS page_number", "'more' AS extra"
    )
    index.upsert(again, version="v")
    _, second = index._current()
    assert sum(first["files"][b] != second["files"][b] for b in first["files"]) == 1
    got = {r.chunk_id: (r.text, r.extra) for r in index.read().collect()}
    assert len(got) == 200 == index.read().count() and got["c7"] == ("new", "more") and got["c8"] == ("text 8", None)
    index.upsert(again.limit(0))
    for i in range(3):
        index.upsert(again, version="v")
    assert index.read().count() == 200 and len(index._versions()) == 2
    folders = {f.split("/")[0] for v in index._versions() for f in index._manifest(v)["files"].values()}
    assert len(folders) <= 3
    with pytest.raises(RuntimeError):
        index._commit(index._versions()[-1], second)


def test_a_node_takes_supplied_hits_first(spark):
    line = AnalysisPipeline()
    docs = spark.createDataFrame(
        [(f"d{i}", "T", f"net sales rose in region {i} and margins grew") for i in range(6)],
        "doc_id string, ticker string, cleaned_text string"
    )
    chunks = line.chunks(docs)
    ids = [r.chunk_id for r in chunks.orderBy("chunk_id").collect()]
    asked = spark.createDataFrame(
        [("q1", "net sales rose in region", "T"), ("q2", "net sales rose in region", "T"), ("q3", "xyz", "T")],
        "query_id string, query string, ticker string"
    )
    given = spark.createDataFrame(
        [("q1", i + 1, c, 0.9) for i, c in enumerate(ids[:3])] + [("q3", 1, ids[0], 0.1)],
        "query_id string, rank int, id string, similarity double"
    )
    hits = {}
    for r in line.retrieve(chunks, asked, given).collect():
        hits.setdefault((r.query_id, r.attempt), []).append(r.id)
    assert hits[("q1", 0)] == ids[:3] and len(hits[("q2", 0)]) == 5 and not any(q == "q3" for q, _ in hits)  # q3's last attempt finds nothing
    once = {(r.query_id, r.attempt) for r in line.retrieve(chunks, asked, given, loop=False).collect()}
    assert once == {("q1", 0), ("q2", 0), ("q3", 0)}
    same = line.retrieve(chunks, asked).groupBy("query_id").agg(F.sort_array(F.collect_list("id")).alias("x")).collect()
    assert {r.query_id for r in same} == {"q1", "q2"} and same[0].x == same[1].x
    said = {r.query_id: r.answer for r in line.answer(chunks, asked, given).collect()}
    assert len(said) == 3 and said["q2"].startswith("net sales rose")


def test_requery_stops(spark):
    asked = spark.createDataFrame([(1,), (2,)], "query int")
    seen = []

    def search(left, attempt):
        seen.append((attempt, left.count()))
        return left.join(spark.range(5).select(F.col("id").alias("rank")), F.lit(True)).select(
            "query", "rank", F.col("rank").alias("id"), F.when((F.col("query") == 1), 0.9).otherwise(0.1).alias("similarity")
        )

    out = rt.requery(asked, search)
    assert {(r.query, r.attempt) for r in out.collect()} == {(1, 0), (2, 2)}
    assert seen == [(0, 2), (1, 1), (2, 1)]


def test_pipeline_makes_a_report_for_each_question(spark):
    docs = spark.createDataFrame(
        [("d", "TICK", "earnings_call", "FY2024", "Revenue of $5.00B rose. Velholm Energy grew."), ("e", None, "10-K", None, "")],
        "doc_id string, ticker string, doc_type string, fiscal_period string, cleaned_text string"
    )
    asked = docs.select("doc_id", F.col("doc_id").alias("query_id"), F.lit("What was revenue?").alias("query"), "ticker")
    rows = {r.doc_id: r for r in AnalysisPipeline().analyze(docs, asked).collect()}
    assert rows["d"].financial_metrics.kpi_count == 1
    assert rows["e"].retrieval.chunks_retrieved <= 1 and rows["e"].retrieval.retries_performed == DEFAULT.max_retries
    assert all(r.key_findings for r in rows.values())


def test_drop_folder(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("Revenue rose. " * 30)
    index = vx.VectorIndex(spark, str(tmp_path / "index"))
    index_drop_folder(spark, str(folder), index, str(tmp_path / "cp")).awaitTermination(120)
    assert index.read().count() == 1
    (folder / "ABC_10-K_FY2021.html").write_text("<p>Costs &amp; fees fell.</p>")
    (folder / "c.json").write_text("{broken")
    (folder / "d.xyz").write_text("?")
    index_drop_folder(spark, str(folder), index, str(tmp_path / "cp"), rejects=str(tmp_path / "no")).awaitTermination(120)
    rows = {r.text: r.ticker for r in index.read().collect()}
    assert len(rows) == 2 and rows["Costs & fees fell."] == "ABC"
    assert {r.reason for r in spark.read.json(str(tmp_path / "no")).collect()} == {"not readable", "unsupported format"}
