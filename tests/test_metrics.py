import pytest
from pyspark.sql import functions as F

from ledgerloom.metrics import evaluators as ev
from ledgerloom.operators import preparation as pr
from ledgerloom.plans import metric_queries


def test_entities(spark):
    ref = spark.createDataFrame(
        [(0, "a", "ORG"), (0, "b", "LOC"), (0, "c", "PER"), (1, "d", "LOC"), (1, "e", "LOC"), (1, "e", "LOC")],
        "sample_id int, word string, entity string"
    )
    pred = spark.createDataFrame([(0, "a", "ORG"), (0, "b", "LOC"), (0, "x", "PER")], "sample_id int, word string, entity string")
    r = ev.entity_scores(pred, ref).first()
    assert (r.tp, r.fp, r.fn) == (2, 1, 3)
    assert r.precision == pytest.approx(2 / 3) and r.recall == pytest.approx(0.4)
    by = {x.entity: (x.tp, x.fn, x["count"]) for x in ev.entity_scores_by_type(pred, ref).collect()}
    assert by == {"ORG": (1, 0, 1), "LOC": (1, 2, 4), "PER": (0, 1, 1)}


def test_entities_of_nothing(spark):
    none = spark.createDataFrame([], "sample_id int, word string, entity string")
    r = ev.entity_scores(none, none).first()
    assert (r.tp, r.precision, r.f1_score) == (0, 0.0, 0.0)


def test_published_confusion_matrix(spark):
    cells = {"negative": (298, 1, 4), "neutral": (19, 1345, 27), "positive": (12, 1, 557)}
    rows = [(r, p) for r, ns in cells.items() for p, n in zip(ev.CLASSES, ns) for _ in range(n)]
    s = ev.class_summary(ev.class_scores(spark.createDataFrame(rows, "reference string, predicted string"))).first()
    assert s.accuracy == pytest.approx(0.97173, abs=1e-5) and s.macro_f1 == pytest.approx(0.96250, abs=1e-5)


def test_unknown_label_is_an_error(spark):
    df = spark.createDataFrame([("odd",)], "l string")
    with pytest.raises(Exception, match="unknown label"):
        df.select(ev.canonical_label(F.col("l"))).collect()


def test_steps(spark):
    rows = [
        (1, "+", [1.0, 2.0], 3.0),
        (2, "-", [5.0, 2.0, 1.0], 2.0),
        (3, "/", [1.0, 0.0], 1.0),
        (4, "%", [50.0, 10.0], 5.0),
        (5, "^", [1.0], 1.0),
        (6, "/", [1.0, 4.0], 25.0),
        (7, "*", None, 1.0)
    ]
    df = spark.createDataFrame(
        [(k, [(o, op, e)]) for k, op, o, e in rows],
        "k int, calculation_steps array<struct<operands:array<double>,operator:string,expected_result:double>>"
    )
    r = ev.calculation_accuracy(ev.steps(df, "k")).first()
    assert (r.correct_steps, r.total_steps) == (5, 7)
    b = {x.operator: (x.correct, x.total, x.scaled) for x in ev.calculation_breakdown(ev.steps(df, "k")).collect()}
    assert b["/"] == (1, 2, 1) and b["all"][1] == 5


def test_programs(spark):
    df = spark.createDataFrame(
        [(1, "subtract(206588, 181001)", "$25,587"), (2, "add(1, 2), divide(#0, 3)", "1"), (3, "add(1, 2)", "yes"), (4, None, None)],
        "k int, p string, a string"
    )
    assert [
        (r.operator, r.operands, r.expected) for r in pr.program_samples(df, "k", "p", "a").collect()
    ] == [("-", [206588.0, 181001.0], 25587.0)]


def test_retrieval_and_generation(spark):
    c = "array<struct<chunk_id:string,text:string>>"
    df = spark.createDataFrame(
        [
            (1, [("x", "t"), ("g", "t")], [("g", "u")], "Net sales rose", "net  sales rose "),
            (2, [], [], None, "a b"),
            (3, [(None, "A  b")], [("", "a b")], "", "")
        ],
        f"k int, r {c}, g {c}, gen string, ref string"
    )
    got = {r.k: r for r in ev.retrieval_scores(df, "k", "r", "g").collect()}
    assert (got[1].hit_rate_top1, got[1].hit_rate_top5, got[1].mrr, got[1].ndcg) == (0.0, 1.0, 0.5, 0.5)
    assert (got[2].mrr, got[2].ndcg) == (0.0, 0.0)
    assert (got[3].hit_rate_top1, got[3].ndcg) == (1.0, 1.0)
    gen = {r.k: r for r in ev.generation_scores(df, "k", "gen", "ref").collect()}
    assert (gen[1].exact_match, gen[1].rouge_l, gen[1].bleu) == (0.0, 1.0, 1.0)
    assert (gen[2].rouge_l, gen[2].bleu, gen[3].exact_match) == (0.0, 0.0, 1.0)


def test_tags_round_trip(spark):
    tokens = ["Net", "sales", "were", "416,161", "."]
    df = spark.createDataFrame(
        [(1, tokens, [(15, 22, "Revenues")])], "k int, tokens array<string>, e array<struct<start:int,end:int,tag:string>>"
    )
    tags = ev.spans_to_tags(df, "k", "tokens", "e")
    assert [r.tag for r in tags.orderBy("i").collect()] == ["O", "O", "O", "B-Revenues", "O"]
    spans = ev.tag_spans(tags, "k", "i", "tag").collect()
    assert [(s.entity, s.start, s.end) for s in spans] == [("Revenues", 3, 3)]


def test_subword_labels(spark):
    df = spark.createDataFrame([(1, [None, 0, 0, 1, None], [5, 7])], "k int, w array<int>, t array<int>")
    assert pr.align_labels(df, "k", "w", "t").first().labels == [-100, 5, -100, 7, -100]
    ids = spark.createDataFrame([(1, [-100, 0, 1])], "k int, i array<int>")
    assert pr.decode_labels(ids, "k", "i", ["O", "B-X"]).first().tags == ["O", "B-X"]


def test_evidence_samples(spark):
    df = spark.createDataFrame(
        [(1, "q", "a", ["x", "", None, "y"]), (2, "q", "", ["x"]), (3, "q", "a", [])], "id int, q string, a string, e array<string>"
    )
    rows = pr.evidence_samples(df, "id", "q", "a", "e").collect()
    assert [[tuple(c) for c in r.gold_chunks] for r in rows] == [[("1-0", "x"), ("1-1", "y")]]


def test_subsample_needs_every_query(spark, tmp_path):
    # every third passage is judged 0, the others are needed by one of the 50 queries
    spark.range(70_000).selectExpr(
        "concat('c', id) AS chunk_id", "CAST(id AS INT) AS ord", "'x' AS text"
    ).write.parquet(f"{tmp_path}/document_chunk.parquet")
    rows = metric_queries.ir_subsample(spark, str(tmp_path)).groupBy("needed").count().collect()
    assert {r.needed: r["count"] for r in rows} == {True: 46_666, False: 20_000}


def test_tags_of_a_very_long_document(spark, tmp_path):
    spark.sql(
        "SELECT 1L AS doc_id, repeat('a ', 1000002) AS text UNION ALL SELECT 2L, 'b c' UNION ALL SELECT 3L, NULL"
    ).write.parquet(f"{tmp_path}/documents.parquet")
    rows = metric_queries.span_to_iob2(spark, str(tmp_path)).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in rows} == {1: 1_000_002, 2: 2}
