from pyspark.sql import functions as F

from ledgerloom.operators import kpi, sentiment
from ledgerloom.operators.entities import extract_entities
from ledgerloom.sources.documents import html_document, html_tables, json_document, read_documents, read_eval_set


def test_kpis_of_a_sentence(spark):
    text = "revenue of $119.60B for Q1 2024. gross margin was 38.2%. Net income reached $24.20B, sales, 5 million. Total net sales of 383285 and x"
    got = kpi.extract_kpis(spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, t string"), "k", "t")
    rows = {(r.kpi_type, r.value, r.unit) for r in got.collect()}
    assert rows == {("revenue", 119.6, "B"), ("gross_margin", 38.2, "%"), ("net_income", 24.2, "B"), ("revenue", 383285.0, "and")}
    assert kpi.derived_margin(got, "k").count() == 0  # a percentage isn't divided


def test_override_takes_the_best_score(spark):
    kpis = spark.createDataFrame(
        [(1, "revenue", 0, "sales", 5.0, "M", "sales 5 M", "regex"), (1, "eps", 0, "EPS", 1.0, "", "EPS 1", "regex")],
        "k int, kpi_type string, ord int, name string, value double, unit string, raw_text string, source string"
    )
    tagged = spark.createDataFrame(
        [(1, 0, "Revenues", 7.0, 0.5, "7"), (1, 1, "Revenues", 9.0, 0.9, "9"), (1, 2, "Debt", 1.0, 1.0, "1")],
        "k int, ord int, tag string, value double, score double, text string"
    )
    got = {(r.kpi_type, r.value) for r in kpi.override_revenue(kpis, tagged, "k").collect()}
    assert got == {("revenue", 9.0), ("eps", 1.0)}


def test_sentiment_of_nothing_is_neutral(spark):
    df = spark.createDataFrame([(1, None), (2, "  "), (3, "Profit rose. Sales grew"), (4, "Sales fell. Losses")], "k int, t string")
    got = {r.k: (r.label, r.score) for r in sentiment.document_sentiment(df, "k", "t").collect()}
    assert got == {1: ("neutral", 0.0), 2: ("neutral", 0.0), 3: ("positive", 1.0), 4: ("negative", -1.0)}


def test_entities(spark):
    df = spark.createDataFrame([(1, "Then Velholm Energy met Jane Roe."), (2, None)], "k int, t string")
    assert {(r.word, r.entity_group) for r in extract_entities(df, "k", "t").collect()} >= {("Jane Roe", "MISC")}


def test_html():
    assert html_document("<p>a &amp; b<script>x</script></p>\n<div> c </div>") == "a & b\nc"


def test_nested_tables(spark):
    page = "<table><tr><td>a<table><tr><td>b</td></tr></table></td></tr></table>"
    rows = html_tables(spark.createDataFrame([(1, page), (2, None)], "k int, h string"), "k", "h").collect()
    assert {(r.table_ord, tuple(r.cells)) for r in rows} >= {(1, ("b",))}
    assert any(r.table_ord == 0 and r.cells[0].startswith("a") for r in rows)


def test_json():
    assert json_document('{"text": 1, "body": "x"}') == "x"
    assert json_document('"y"') == "y"
    assert json_document('{"text": "", "n": 1}') == '{\n  "text": "",\n  "n": 1\n}'


def test_folder(spark, tmp_path):
    (tmp_path / "ABC_10-K_FY2020.txt").write_text("plain text")
    (tmp_path / "x.JSON").write_text('{"content": "from json"}')
    (tmp_path / "y.html").write_text("<p>from html</p>")
    (tmp_path / "z.pdf").write_bytes(b"%PDF")
    (tmp_path / "q.doc").write_text("?")
    (tmp_path / "bad.json").write_text("{")
    docs, rejects = read_documents(spark, str(tmp_path))
    assert {r.raw_text: r.ticker for r in docs.collect()} == {"plain text": "ABC", "from json": None, "from html": None}
    assert sorted(r.reason for r in rejects.collect()) == ["no PDF reader", "not readable", "unsupported format"]


def test_eval_sets(spark, tmp_path):
    for i, body in enumerate(['[{"a": 1}, {"a": 2}]', '{"data": [{"a": 1}]}', '{"a": 1}']):
        (tmp_path / f"{i}.json").write_text(body)
    assert [read_eval_set(spark, str(tmp_path / f"{i}.json")).count() for i in range(3)] == [2, 1, 1]
    assert read_eval_set(spark, str(tmp_path / "0.json"), limit=1).select(
        F.get_json_object("sample", "$.a").alias("a")
    ).first().a == "1"
