"""Readers and writers of evaluation sets, figures and pages through ports, predictions, medians, sessions."""

import json
import statistics
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from ledgerloom import __main__ as cli
from ledgerloom import session
from ledgerloom.metrics import evaluators as ev
from ledgerloom.operators import entities, preparation, vectors
from ledgerloom.pipeline import AnalysisPipeline
from ledgerloom.plans.prep_queries import _Amounts
from ledgerloom.sources import documents, sinks


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't see the folder of the tests


class Pdf:
    """Pages by form feeds; a line with bars is a table."""

    def pages(self, content):
        if content.startswith(b"broken"):
            raise OSError("no PDF")
        return content.decode().split("\f")

    def tables(self, content):
        return [
            (n + 1, [line.split("|") for line in p.splitlines() if "|" in line])
            for n, p in enumerate(self.pages(content))
            if "|" in p
        ]


def test_pdf_files_through_a_port(spark, tmp_path):
    (tmp_path / "ABC_10-K_FY2020.pdf").write_bytes(b"one\ftwo a|b\nc|d\f")
    (tmp_path / "bad.pdf").write_bytes(b"broken")
    docs, rejects = documents.read_documents(spark, str(tmp_path), Pdf())
    row = docs.collect()
    assert [(r.raw_text, r.ticker, r.doc_type) for r in row] == [("one\ntwo a|b\nc|d\n", "ABC", "10-K")]
    assert [r.reason for r in rejects.collect()] == ["not readable"]
    assert [r.reason for r in documents.read_documents(spark, str(tmp_path))[1].collect()] == ["no PDF reader"] * 2
    files = spark.createDataFrame([(1, b"one\ftwo a|b\nc|d\f"), (2, b"broken"), (3, None)], "k int, content binary")
    tables = documents.pdf_tables(files, "k", "content", Pdf()).orderBy("row_ord").collect()
    assert [(r.k, r.page, r.table_ord, r.cells, r.source) for r in tables] == [
        (1, 2, 0, ["two a", "b"], "pdf"), (1, 2, 0, ["c", "d"], "pdf")
    ]
    pages = files.select("k", documents.pdf_pages(F.col("content"), Pdf()).alias("p"))
    assert {r.k: r.m for r in pages.select("k", documents.page_map(F.col("p")).alias("m")).collect()} == {
        1: {"page_1": 3, "page_2": 14, "page_3": 14}, 2: None, 3: None
    }
    offsets = documents.page_offsets(
        spark.createDataFrame([("d", 1, "one"), ("d", 2, None), ("d", 3, "three")], "k string, n int, t string"), "k", "n", "t"
    )
    assert [(r.start, r.end) for r in offsets.orderBy("n").collect()] == [(0, 3), (4, 4), (5, 10)]


def test_samples_can_be_read_back(spark, tmp_path):
    rows = spark.range(50).selectExpr("id", "concat('text \"', id, '\"') AS text", "array(id, 2) AS x").repartition(4)
    sinks.write_samples(rows, str(tmp_path / "set"), 'said "so"')
    part = next(p for p in (tmp_path / "set").iterdir() if p.name.startswith("part") and p.stat().st_size)
    assert json.loads(part.read_text())["_comment"] == 'said "so"'
    back = documents.read_eval_set(spark, str(tmp_path / "set/part*")).collect()
    assert sorted(r.sample_id for r in back) == list(range(50))
    assert {json.loads(r.sample)["text"] for r in back} == {f'text "{i}"' for i in range(50)}
    assert documents.read_eval_set(spark, str(tmp_path / "set/part*"), 7).count() == 7
    sinks.write_samples(rows.limit(0), str(tmp_path / "none"))


def test_readers_of_evaluation_sets(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    spark.createDataFrame([("up", 2), ("?", 7)], "sentence string, label int").write.parquet(at("s"))
    assert {tuple(r) for r in preparation.read_sentiment_set(spark, at("s")).collect()} == {("up", "positive"), ("?", None)}
    (tmp_path / "e.jsonl").write_text(
        "\n".join(
            json.dumps(x)
            for x in [
                {
                    "financebench_id": "f1",
                    "question": "q",
                    "answer": "a",
                    "evidence": [{"evidence_text": "t"}, {"evidence_text": ""}]
                },
                {"financebench_id": "f2", "question": "", "answer": "a", "evidence": [{"evidence_text": "t"}]}
            ]
        )
    )
    got = preparation.read_evidence_set(spark, at("e.jsonl")).collect()
    assert [(r.id, [(g.chunk_id, g.text) for g in r.gold_chunks]) for r in got] == [("f1", [("f1-0", "t")])]
    spark.createDataFrame(
        [
            ("q", ["a"] * 3000, ["b"], "", "add(1, 2)", "3"),
            ("r", None, ["x"], "exp(1, 2)", None, "1"),
            ("s", None, None, "divide(6, 3)", "", "2%")
        ],
        "question string, pre_text array<string>, post_text array<string>, program_re string, program string, answer string"
    ).write.parquet(at("p"))
    got = {r.question: r for r in preparation.read_program_set(spark, at("p")).collect()}
    assert set(got) == {"q", "s"} and len(
        got["q"].text
    ) == 4000 and got["s"].text == "" and got["s"].calculation_steps[0].operator == "/"
    spark.createDataFrame(
        [("d1", "T", "x"), ("d2", None, "y")], "_id string, title string, text string"
    ).write.parquet(at("corpus.parquet"))
    spark.createDataFrame([("q1", "ask")], "_id string, text string").write.parquet(at("queries.parquet"))
    spark.createDataFrame(
        [("q1", "d1", 1), ("q1", "d2", 0)], "`query-id` string, `corpus-id` string, score int"
    ).write.parquet(at("qrels.parquet"))
    corpus, queries, qrels = preparation.read_retrieval_set(spark, str(tmp_path))
    assert {
        tuple(r) for r in preparation.training_pairs(qrels, queries, corpus.withColumnRenamed("passage", "p")).collect()
    } == {("d1", "q1", "ask", "T x")}
    spark.createDataFrame([(["a", "b"], [0, 1])], "tokens array<string>, ner_tags array<int>").write.parquet(at("t"))
    assert [tuple(r) for r in preparation.read_tagging_set(spark, at("t"), ["O", "B-X"]).collect()] == [(["a", "b"], ["O", "B-X"])]


def test_tagged_figures_replace_revenue(spark):
    docs = spark.createDataFrame(
        [("d", "T", "10-K", "FY2024", "revenue of 7. Total assets $1,500 grew."), ("e", "T", "10-K", None, " ")],
        "doc_id string, ticker string, doc_type string, fiscal_period string, cleaned_text string"
    )
    assert entities.tag_figures(docs, "doc_id", [], "cleaned_text").count() == 0
    found = entities.tag_figures(docs, "doc_id", ["ticker"], "cleaned_text", _Amounts()).collect()
    assert [(r.doc_id, r.text, r.tag, r.value) for r in found] == [("d", "$1,500", "Revenues", 1500.0)]
    asked = docs.select("doc_id", F.col("doc_id").alias("query_id"), F.lit("revenue?").alias("query"), "ticker")
    rows = {r.doc_id: r for r in AnalysisPipeline(figures=_Amounts()).analyze(docs, asked).collect()}
    assert rows["d"].financial_metrics.kpi_count == 1


def test_predictions_of_answers_and_tags(spark, tmp_path):
    samples = spark.createDataFrame(
        [
            (
                0,
                json.dumps(
                    {
                        "question": "net sales of Velholm",
                        "answer": "net sales of Velholm rose",
                        "gold_chunks": [{"chunk_id": "a", "text": "net sales of Velholm rose"}]
                    }
                )
            ),
            (1, json.dumps({"question": "", "answer": "x", "gold_chunks": [{"chunk_id": "b", "text": "other words stand here"}]}))
        ],
        "sample_id int, sample string",
    )
    row = cli.evaluate(samples, "rag", predict=True).first()
    assert row.samples == 2 and row.hit_rate_top1 == 0.5 and row.exact_match == 0.5
    tags = spark.createDataFrame(
        [(0, json.dumps({"tokens": ["paid", "$5", "today"], "tags": ["O", "B-Revenues", "O"]}))], "sample_id int, sample string"
    )
    assert cli.evaluate(tags, "finer", predict=True).first().f1_score == 0.0
    assert cli.evaluate(tags, "finer", predict=True, figures=_Spans()).first().f1_score == 1.0
    index = vectors.VectorIndex(spark, str(tmp_path / "corpus"), buckets=2)
    rag = spark.createDataFrame(
        [(1, [("a", "text a"), (None, "text b")]), (2, [("a", "text a")])],
        "sample_id int, gold_chunks array<struct<chunk_id:string,text:string>>"
    )
    for _ in range(2):
        preparation.index_corpus(index, rag)
    assert index.read().count() == 2 and index.read().select("ticker").distinct().first().ticker == "eval"


class _Spans:
    def tag(self, text):
        at = F.locate("$", text) - 1
        return F.array(
            F.struct(
                F.substr(text, at + 1, F.lit(2)).alias("word"),
                F.lit("Revenues").alias("entity_group"),
                F.lit(1.0).alias("score"),
                at.alias("start"),
                (at + 2).alias("end")
            )
        )


def test_matrix_has_all_classes(spark):
    rows = spark.createDataFrame([("positive", "negative"), ("positive", None)], "reference string, predicted string")
    assert {r.reference: tuple(r)[1:] for r in ev.confusion_matrix(rows).collect()} == {
        "negative": (0, 0, 0), "neutral": (0, 0, 0), "positive": (1, 1, 0)
    }
    assert ev.confusion_matrix(rows.limit(0)).count() == 3


def test_figures_given_as_text_count(spark):
    rows = spark.createDataFrame(
        [(1, {"revenue": "5", "eps": "x", "roe": None}, {"revenue": "5.01"})], "k int, r map<string,string>, e map<string,string>"
    )
    got = ev.kpi_scores(rows, "k", "r", "e").first()
    assert (got.total_kpis, got.numeric_accuracy) == (1, 1.0)


@pytest.mark.parametrize("n", [1, 2, 7, 50_001])
def test_exact_median(spark, n):
    values = [float((i * 7919) % 1000) for i in range(n)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    assert ev.exact_median(df, "v") == statistics.median(values)
    assert ev.exact_median(df.limit(0), "v") is None


def test_tags_of_overlapping_and_empty_entities(spark):
    df = spark.createDataFrame(
        [(1, ["ab", "cd", "ef"], [(0, 4, "X"), (3, 8, "Y"), (5, 5, "Z")]), (2, None, []), (3, ["a"], None), (4, [], [])],
        "k int, tokens array<string>, e array<struct<start:int,end:int,tag:string>>"
    )
    got = [(r.k, r.token, r.tag) for r in ev.spans_to_tags(df, "k", "tokens", "e").orderBy("k", "i").collect()]
    assert got == [(1, "ab", "B-X"), (1, "cd", "B-Y"), (1, "ef", "I-Y"), (3, "a", "O")]


class _Context:
    def __init__(self, master):
        self.master = master

    def getCheckpointDir(self):
        return None

    def getConf(self):
        return {}

    def setCheckpointDir(self, path):
        self.path = path


@pytest.mark.parametrize(
    ("master", "fine"),
    [
        ("local", True),
        ("local[4]", True),
        ("local[*]", True),
        ("local-cluster[2,1,1024]", False),
        ("spark://host:7077", False),
        ("yarn", False)
    ]
)
def test_a_cluster_needs_a_shared_folder(master, fine):
    spark = type("Session", (), {"sparkContext": _Context(master), "conf": {}})()
    if fine:
        session._ensure_checkpoint_dir(spark)
        assert spark.sparkContext.path
    else:
        with pytest.raises(RuntimeError):
            session._ensure_checkpoint_dir(spark)
