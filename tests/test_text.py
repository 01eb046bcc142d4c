import html

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import text as tx
from ledgerloom.operators import chunking as ch
from ledgerloom.plans import text_queries


def one(spark, f, *values):
    rows = spark.createDataFrame(
        [(i, v) for i, v in enumerate(values)], "i int, t string"
    ).select("i", f(F.col("t")).alias("x")).orderBy("i").collect()
    return [r.x for r in rows]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("revenue of $119.6 billion for Q1 2024", "revenue of $119.60B for Q1 2024"),
        ("Net income reached $24.2 billion, up 10%.", "Net income reached $24.20B, up 10%."),
        ("12 percentage points, 5 percent", "12%age points, 5%"),
        ("$, B ", "$, B "),
        ("$2.675 million.", "$2.67M."),
        ("$1,000 thousandth", "$1,000 thousandth"),
    ],
)
def test_amounts(raw, clean):
    assert tx.normalize_amounts_py(raw) == clean


def test_cleaning_order(spark):
    got = one(spark, tx.clean_text, "He said “hello” and it’s &lt;b&gt;fine&lt;/b&gt; x<br>y  z", None, "", " \n")
    assert got == ["He said \"hello\" and it's fine xy z", None, "", ""]


def test_unescape_is_exact(spark):
    texts = ["a &amp;lt; b", "&nbsp;&eacute;&#x41;", "&bogus;"]
    assert one(spark, tx.html_unescape, *texts) == [html.unescape(t) for t in texts]


def test_filename_metadata(spark):
    got = one(
        spark,
        tx.filename_metadata,
        "x/AAPL_10K_FY2023.txt",
        "MSFT_10-Q_Q2_2024.htm",
        "GOOG_10-K_FY2024.pdf",
        "small_filing.txt",
        "medium_filing.txt",
        "uploaded_document.pdf",
        None
    )
    want = [
        ("AAPL", "FY2023", "unknown"),
        ("MSFT", "Q22024", "10-Q"),
        ("GOOG", "FY2024", "10-K"),
        ("SMALL", None, "unknown"),
        (None, None, "unknown"),
        (None, None, "unknown"),
        (None, None, "unknown")
    ]
    assert [tuple(x) for x in got] == want
    assert one(spark, lambda c: tx.filename_metadata(c, fixed=True), "AAPL_10K_FY2023.txt")[0].doc_type == "10-K"


def test_call_detection_needs_the_fix(spark):
    text = "Operator: welcome to the earnings call"
    assert one(spark, tx.earnings_call_flag, text) == [False]
    assert one(spark, lambda c: tx.earnings_call_flag(c, fixed=True), text) == [True]


@pytest.mark.parametrize(("tokens", "windows"), [(1, 1), (512, 1), (513, 2), (960, 2), (961, 3), (1408, 3), (1409, 4)])
def test_window_counts(spark, tokens, windows):
    df = spark.createDataFrame([("d", " ".join(f"w{i}" for i in range(tokens)))], "doc_id string, t string")
    rows = ch.token_windows(df, ["doc_id"], "t").orderBy("ord").collect()
    assert len(rows) == windows
    assert rows[-1].text.split()[-1] == f"w{tokens - 1}"
    assert all(r.token_count <= 512 for r in rows)
    assert all(r.text.split()[0] == f"w{448 * r.ord}" for r in rows)


def test_windows_of_nothing_and_sections(spark):
    df = spark.createDataFrame([("a", None), ("b", " "), ("c", "x")], "doc_id string, t string")
    assert [r.doc_id for r in ch.token_windows(df, ["doc_id"], "t").collect()] == ["c"]
    text = "Item 7. outlook item 1a risks ITEM 8 numbers"
    got = ch.sec_sections(
        spark.createDataFrame([("d", text), ("n", None)], "doc_id string, raw_text string")
    ).orderBy("ord").collect()
    assert [(r.section, text[r.start : r.end]) for r in got] == [
        ("risk_factors", "item 1a risks "), ("mda", "Item 7. outlook "), ("financial_statements", "ITEM 8 numbers")
    ]


def test_sections_of_whole_filings(spark, tmp_path):
    rows = [("d", "ab " * 1000), ("late", "x" * 900 + " item 1b " + "y" * 91), ("tiny", "z"), ("n", None)]
    spark.createDataFrame(rows, "doc_id string, cleaned_text string").write.parquet(f"{tmp_path}/parsed_document.parquet")
    got = {(r.doc_id, r.section): (r.start, r.end) for r in text_queries.sec_sections(spark, str(tmp_path)).collect()}
    assert {k: v for k, v in got.items() if k[0] == "d"} == {
        ("d", "mda"): (9, 1018), ("d", "risk_factors"): (1018, 2028), ("d", "financial_statements"): (2028, 3035)
    }
    assert got["late", "financial_statements"] == (694, 936) and got["late", "unresolved_staff_comments"] == (936, 1035)
    assert got["tiny", "financial_statements"] == (28, 36)


def test_chunk_ids_repeat(spark):
    docs = spark.createDataFrame([("d", "One two. Three.")], "doc_id string, cleaned_text string")
    a, b = (ch.chunk_documents(docs).collect() for _ in range(2))
    assert a == b and len(a) == 1


def test_speakers(spark):
    text = "Operator: hi;\nJane Roe: yes;\nOperator: bye;"
    got = ch.speaker_sections(spark.createDataFrame([("d", text)], "doc_id string, raw_text string")).orderBy("ord").collect()
    assert [r.section for r in got] == ["operator", "jane roe", "operator_1"]
    assert "".join(text[r.start : r.end] for r in got) == text


@given(st.text(max_size=60))
def test_amounts_never_fail(t):
    tx.normalize_amounts_py(t)
