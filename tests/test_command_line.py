import json

import pytest

from ledgerloom.__main__ import analyze, evaluate
from ledgerloom.operators import preparation as pr
from ledgerloom.sources.documents import read_eval_set
from ledgerloom.sources.sinks import write_metrics, write_samples


def samples(spark, tmp_path, rows):
    (tmp_path / "set.json").write_text(json.dumps({"samples": rows}))
    return read_eval_set(spark, str(tmp_path / "set.json"))


def test_ner(spark, tmp_path):
    rows = [
        {
            "text": "x",
            "references": [{"word": "a", "entity": "ORG"}, {"text": "b", "label": "LOC"}],
            "predictions": [{"word": "a", "entity_group": "ORG"}]
        },
        {"text": "y", "entities": []}
    ]
    r = evaluate(samples(spark, tmp_path, rows), "ner").first()
    assert (r.tp, r.fp, r.fn) == (1, 0, 1)


def test_sentiment(spark, tmp_path):
    rows = [{"text": "Profit rose", "sentiment": "bullish"}, {"text": "Sales fell", "label": 0, "prediction": "neg"}]
    assert evaluate(samples(spark, tmp_path, rows), "sentiment").first().accuracy == 0.5
    assert evaluate(samples(spark, tmp_path, rows), "sentiment", predict=True).first().accuracy == 1.0


def test_kpi(spark, tmp_path):
    rows = [
        {"text": "revenue of 119.6 and EPS of 2", "reference_kpis": {"revenue": 120.0, "eps": 2}, "predictions": {"revenue": 100}}
    ]
    assert evaluate(samples(spark, tmp_path, rows), "kpi").first().numeric_accuracy == 0.0
    r = evaluate(samples(spark, tmp_path, rows), "kpi", predict=True).first()
    assert (r.numeric_accuracy, r.extraction_recall) == (1.0, 1.0)


def test_rag(spark, tmp_path):
    rows = [
        {
            "question": "q",
            "answer": "a b",
            "generated_answer": "a b",
            "gold": ["x  Y"],
            "retrieved_chunks": [{"chunk_id": "1", "text": "z"}, {"text": "x y"}]
        }
    ]
    r = evaluate(samples(spark, tmp_path, rows), "rag").first()
    assert (r.hit_rate_top1, r.mrr, r.exact_match, r.bleu) == (0.0, 0.5, 1.0, 1.0)


def test_finer(spark, tmp_path):
    rows = [{"tokens": ["a", "b"], "tags": ["B-X", "I-X"], "predicted_tags": ["B-X", "I-X"]}, {"tokens": ["c"], "tags": ["B-Y"]}]
    r = evaluate(samples(spark, tmp_path, rows), "finer").first()
    assert (r.tp, r.fp, r.fn) == (1, 0, 1)


def test_unknown_kind(spark, tmp_path):
    with pytest.raises(ValueError):
        evaluate(samples(spark, tmp_path, [{"a": 1}]), "other")


def test_analyze_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "ABC_10-K_FY2020.html").write_text("<p>Item 1A risks.</p><p>Item 7 Revenue of $5 million rose.</p>")
    (tmp_path / "in" / "x.pdf").write_bytes(b"%PDF")
    rejects = analyze(spark, str(tmp_path / "in"), "What was revenue?", str(tmp_path / "out"))
    assert rejects.count() == 1
    report = spark.read.json(str(tmp_path / "out")).first()
    assert report.metadata.ticker == "ABC" and report.financial_metrics.kpi_count == 1
    write_metrics(spark.createDataFrame([(0.123456, 3)], "a double, b int"), str(tmp_path / "m"))
    assert tuple(spark.read.json(str(tmp_path / "m")).first()) == (0.1235, 3)
    write_samples(spark.range(2), str(tmp_path / "s"), "made for a test")
    assert read_eval_set(spark, str(tmp_path / "s" / "part*")).count() == 2


def test_small_preparations(spark):
    corpus = spark.createDataFrame([(1, None, "t "), (2, "T", "u")], "i int, title string, text string")
    assert [r.passage for r in pr.titled_passages(corpus, "i", "title", "text").orderBy("doc_id").collect()] == ["t", "T u"]
    log = spark.createDataFrame([("sequential (median): 50.0s\nparallel (median): 40.0s",), ("",)], "t string")
    assert [r.speedup for r in pr.benchmark_log(log, "t").collect()] == [1.25, None]
    q = spark.createDataFrame([(1, "a", 1), (1, "b", 0)], "query_id int, doc_id string, score int")
    assert pr.relevant_sets(q).first().doc_ids == ["a"]
    s = spark.createDataFrame([("x", 2), ("y", 9)], "sentence string, label int")
    assert [r.sentiment for r in pr.sentiment_samples(s).collect()] == ["positive", None]
