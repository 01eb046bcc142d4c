"""Queries of the evaluation metrics and of the preparation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.metrics import evaluators as ev
from ledgerloom.operators import preparation as pr
from ledgerloom.operators import vectors as vx
from ledgerloom.plans import sqltools as q
from ledgerloom.session import table

_KINDS = ("revenue", "gross_margin_pct", "eps")


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _entities(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Events as entities of their users: references, and predictions that miss some and name some otherwise."""
    e = table(spark, d, "events")
    kind = lambda n: F.element_at(F.array(*[F.lit(x) for x in ev.ENTITY_TYPES]), (F.pmod(n, F.lit(4)) + 1).cast("int"))
    word = F.concat("event_type", (F.col("event_id") % 40).cast("string"))
    reference = e.select(F.col("user_id").alias("sample_id"), word.alias("word"), kind(F.col("event_id")).alias("entity"))
    guess = F.when(F.col("event_id") % 5 == 0, F.col("event_id") + 1).otherwise(F.col("event_id"))
    predicted = e.where("event_id % 7 <> 0").select(
        F.col("user_id").alias("sample_id"), word.alias("word"), kind(guess).alias("entity")
    )
    return predicted, reference


def eval_ner(spark: SparkSession, d: str) -> DataFrame:
    return _round(ev.entity_scores(*_entities(spark, d)), "precision", "recall", "f1_score")


def eval_ner_by_type(spark: SparkSession, d: str) -> DataFrame:
    return _round(ev.entity_scores_by_type(*_entities(spark, d)), "precision", "recall", "f1_score")


def _labels(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ev.CLASSES])
    pick = lambda n: F.element_at(names, (F.pmod(n, F.lit(3)) + 1).cast("int"))
    guess = F.when(F.col("event_id") % 11 == 0, F.lit(None)).when(
        F.col("user_id") % 4 == 0, pick(F.col("user_id"))
    ).otherwise(pick(F.col("event_id")))
    return table(spark, d, "events").select("event_id", pick(F.col("event_id")).alias("reference"), guess.alias("predicted"))


def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return ev.confusion_matrix(_labels(spark, d))


def eval_sentiment_by_class(spark: SparkSession, d: str) -> DataFrame:
    return _round(ev.class_scores(_labels(spark, d)), "precision", "recall", "f1_score")


def eval_sentiment(spark: SparkSession, d: str) -> DataFrame:
    return _round(ev.class_summary(ev.class_scores(_labels(spark, d))), "accuracy", "macro_f1", "weighted_f1")


_SPELLINGS = (" Positive", "POS", "bullish", "2", "negative ", "neg", "Bearish", "0", "neutral", "NEU", "1", "mixed")


def sentiment_label_normalize(spark: SparkSession, d: str) -> DataFrame:
    spelled = F.element_at(F.array(*[F.lit(x) for x in _SPELLINGS]), (F.col("c_custkey") % len(_SPELLINGS) + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", ev.canonical_label(spelled, strict=False).alias("label"))


def _kpis(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "kpi_example")


def eval_kpi(spark: SparkSession, d: str) -> DataFrame:
    scores = ev.kpi_scores(_kpis(spark, d), "sample_id", "reference_kpis", "extracted_kpis", types=_KINDS)
    return _round(scores, "numeric_accuracy", "extraction_recall", "type_coverage", "mean_absolute_error", "rmse")


def eval_kpi_macro(spark: SparkSession, d: str) -> DataFrame:
    names = ["numeric_accuracy", "extraction_recall", "type_coverage"]
    scores = ev.kpi_scores(_kpis(spark, d), "sample_id", "reference_kpis", "extracted_kpis", types=_KINDS)
    return _round(ev.macro(scores, names), *names)


def eval_kpi_by_type(spark: SparkSession, d: str) -> DataFrame:
    return _round(
        ev.kpi_accuracy_by_type(_kpis(spark, d), "sample_id", "reference_kpis", "extracted_kpis", types=_KINDS), "accuracy"
    )


def calc_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return _round(ev.calculation_accuracy(ev.steps(_kpis(spark, d), "sample_id")), "calculation_accuracy")


def finqa_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return _round(ev.calculation_breakdown(ev.steps(_kpis(spark, d), "sample_id")), "accuracy", "adjusted")


def _programs(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("o_orderkey")
    name = F.element_at(F.array(*[F.lit(x) for x in (*ev.PROGRAM_OPERATORS, "exp")]), (n % 5 + 1).cast("int"))
    right = F.when(n % 7 == 0, F.lit("#0")).otherwise(F.concat((n % 13 + 1).cast("string"), F.lit(",000")))
    return table(spark, d, "orders").select(
        "o_orderkey",
        F.concat(F.lit(" "), name, F.lit("( "), "o_custkey", F.lit(", "), right, F.lit(")")).alias("program"),
        F.when(n % 11 == 0, "yes").otherwise(F.concat(F.lit("$"), F.col("o_custkey").cast("string"), F.lit("%"))).alias("answer")
    )


def finqa_program_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = pr.program_samples(_programs(spark, d), "o_orderkey", "program", "answer")
    return rows.select(
        F.col("id").alias("o_orderkey"),
        "operator",
        F.col("operands")[0].alias("left_operand"),
        F.col("operands")[1].alias("right_operand"),
        "expected"
    )


def eval_rag_retrieval(spark: SparkSession, d: str) -> DataFrame:
    return _round(
        ev.retrieval_scores(table(spark, d, "rag_example"), "sample_id", "retrieved_chunks", "gold_chunks"), "mrr", "ndcg"
    )


def eval_rag_generation(spark: SparkSession, d: str) -> DataFrame:
    return _round(
        ev.generation_scores(table(spark, d, "rag_example"), "sample_id", "generated_answer", "answer"), "rouge_l", "bleu"
    )


def eval_rag(spark: SparkSession, d: str) -> DataFrame:
    rag = table(spark, d, "rag_example").dropDuplicates(["sample_id"])
    both = ev.retrieval_scores(rag, "sample_id", "retrieved_chunks", "gold_chunks").join(
        ev.generation_scores(rag, "sample_id", "generated_answer", "answer"), "sample_id"
    )
    names = ["hit_rate_top1", "hit_rate_top5", "mrr", "ndcg", "exact_match", "rouge_l", "bleu"]
    return _round(ev.macro(both, names), *names)


def ir_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Ranking of each queried vector's nearest ten against the vectors of its label with an id divisible by 5."""
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")
    ranked = vx.search(e, asked, "vec_id", "query_id", k=10, exclude_self=True).select(
        F.col("query").alias("query_id"), "rank", F.col("id").alias("doc_id")
    )
    relevant = asked.select("query_id", "label").join(
        e.where("vec_id % 5 = 0").select(F.col("vec_id").alias("doc_id"), "label"), "label"
    ).where("doc_id <> query_id")
    return _round(ev.ranking_scores(ranked, relevant), "ndcg", "mrr", "recall", "precision_at_1")


_MARKS = ((10, 25, "Revenues"), (20, 40, "DebtInstrument"), (60, 61, "Revenues"))


def span_to_iob2(spark: SparkSession, d: str) -> DataFrame:
    from ledgerloom.functions.text import words

    marks = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(t).alias("tag")) for a, b, t in _MARKS])
    docs = table(spark, d, "documents").select("doc_id", words(F.col("text")).alias("tokens"), marks.alias("entities"))
    return ev.spans_to_tags(docs, "doc_id", "tokens", "entities")


def _tags(spark: SparkSession, d: str) -> DataFrame:
    """Line items of an order as a tagged sentence, with another column as its prediction."""
    tag = lambda c: F.when(F.col(c) % 5 < 2, "O").when(
        F.col(c) % 5 == 2, "B-Revenues"
    ).when(F.col(c) % 5 == 3, "I-Revenues").otherwise("B-Debt")
    place = F.col("l_linenumber").cast("long") * 10_000_000 + F.col("l_partkey") * 100 + F.col("l_suppkey") % 100
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", place.alias("place")).agg(
        F.max("l_partkey").alias("l_partkey"), F.max("l_suppkey").alias("l_suppkey")
    )
    return rows.select(
        "l_orderkey",
        "place",
        tag("l_partkey").alias("reference"),
        F.when(F.col("l_suppkey") % 3 == 0, tag("l_suppkey")).otherwise(tag("l_partkey")).alias("predicted")
    )


def iob2_spans(spark: SparkSession, d: str) -> DataFrame:
    return ev.tag_spans(_tags(spark, d), "l_orderkey", "place", "reference")


def eval_finer(spark: SparkSession, d: str) -> DataFrame:
    rows = _tags(spark, d)
    scores = ev.tagging_scores(
        ev.tag_spans(rows, "l_orderkey", "place", "predicted"),
        ev.tag_spans(rows, "l_orderkey", "place", "reference"),
        "l_orderkey",
        by_type=True
    )
    return _round(scores, "precision", "recall", "f1_score")


def corpus_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return pr.corpus_passages(table(spark, d, "rag_example"), "sample_id", "gold_chunks")


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "document_chunk").groupBy(F.col("chunk_id").alias("doc_id")).agg(F.max("text").alias("passage"))


def _qrels(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "document_chunk")
    return c.select(
        (F.col("ord") % 50).cast("long").alias("query_id"), F.col("chunk_id").alias("doc_id"), (F.col("ord") % 3).alias("score")
    ).distinct()


def training_pairs(spark: SparkSession, d: str) -> DataFrame:
    queries = table(spark, d, "eval_item").select(F.col("item_id").alias("query_id"), F.col("question").alias("query"))
    return pr.training_pairs(_qrels(spark, d), queries, _corpus(spark, d))


def ir_subsample(spark: SparkSession, d: str) -> DataFrame:
    needed = _qrels(spark, d).where("score > 0")
    return pr.sample_corpus(_corpus(spark, d).select("doc_id"), needed, 20_000)


def timing_median(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    overall = ev.exact_median(events, "value")
    per = events.groupBy("event_type").agg(F.median("value").alias("m"))
    return per.select(
        "event_type", F.round("m", 6).alias("median_value"), F.round(F.try_divide(F.lit(overall), "m"), 6).alias("speedup")
    )


def published_results(spark: SparkSession, d: str) -> DataFrame:
    return ev.published(spark)


def _prf(where: str, by: str = "") -> str:
    """Scores from rows (by, in_p, in_r)."""
    head, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return (
        f"SELECT {head}tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END, 6) AS f1_score FROM (SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall"
        f" FROM (SELECT {head}CAST(coalesce(sum(in_p * in_r), 0) AS BIGINT) AS tp, CAST(coalesce(sum(in_p * (1 - in_r)), 0) AS BIGINT) AS fp, CAST(coalesce(sum((1 - in_p) * in_r), 0) AS BIGINT) AS fn FROM ({where}){group}))"
    )


def _kind(n: str) -> str:
    return f"['PER', 'ORG', 'LOC', 'MISC'][({n}) % 4 + 1]"


_ENT_R = f"SELECT user_id AS sample_id, event_type || CAST(event_id % 40 AS VARCHAR) AS word, {_kind('event_id')} AS entity FROM events"
_ENT_P = f"SELECT user_id AS sample_id, event_type || CAST(event_id % 40 AS VARCHAR) AS word, {_kind('CASE WHEN event_id % 5 = 0 THEN event_id + 1 ELSE event_id END')} AS entity FROM events WHERE event_id % 7 <> 0"
_ENT = f"SELECT sample_id, word, entity, max(p) AS in_p, max(r) AS in_r FROM (SELECT *, 1 AS p, 0 AS r FROM ({_ENT_P}) UNION ALL SELECT *, 0, 1 FROM ({_ENT_R})) GROUP BY ALL"
_PICK = lambda n: f"['negative', 'neutral', 'positive'][({n}) % 3 + 1]"
_LABELS = f"(SELECT event_id, {_PICK('event_id')} AS reference, coalesce(CASE WHEN event_id % 11 = 0 THEN NULL WHEN user_id % 4 = 0 THEN {_PICK('user_id')} ELSE {_PICK('event_id')} END, 'neutral') AS predicted FROM events)"
_CLASS = f"WITH c AS (SELECT label, CAST(sum(CASE WHEN reference = label AND predicted = label THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN reference <> label AND predicted = label THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN reference = label AND predicted <> label THEN 1 ELSE 0 END) AS BIGINT) AS fn FROM {_LABELS}, (VALUES ('negative'), ('neutral'), ('positive')) t(label) GROUP BY 1), s AS (SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall, tp + fn AS support FROM c), f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1_score FROM s)"
_NUMBERS = lambda c: f"list_filter(map_entries({c}), lambda e: e.value IS NOT NULL AND NOT isnan(e.value))"
_KPI = f"WITH k AS (SELECT sample_id, row_number() OVER () AS id, coalesce(len({_NUMBERS('reference_kpis')}), 0) AS refs, coalesce(len({_NUMBERS('extracted_kpis')}), 0) AS exts, reference_kpis AS r, extracted_kpis AS e FROM kpi_example), p AS (SELECT id, t AS kpi_type, r[t] AS rv, e[t] AS ev FROM k, (VALUES ('revenue'), ('gross_margin_pct'), ('eps')) v(t)), q AS (SELECT id, kpi_type, CASE WHEN rv = 0 THEN abs(ev) ELSE abs(ev - rv) / abs(rv) END AS error FROM p WHERE rv IS NOT NULL AND ev IS NOT NULL AND NOT isnan(rv) AND NOT isnan(ev)), s AS (SELECT k.sample_id, coalesce(sum(CASE WHEN error <= 0.01 THEN 1 ELSE 0 END) / nullif(any_value(refs), 0)::DOUBLE, 0) AS numeric_accuracy, coalesce(any_value(exts) / nullif(any_value(refs), 0)::DOUBLE, 0) AS extraction_recall, count(error) / 3.0::DOUBLE AS type_coverage, coalesce(avg(error), 0) AS mean_absolute_error, coalesce(sqrt(avg(error * error)), 0) AS rmse, CAST(any_value(refs) AS INTEGER) AS total_kpis FROM k LEFT JOIN q ON k.id = q.id GROUP BY k.id, k.sample_id)"
_STEPS = "WITH t AS (SELECT s.operands AS o, coalesce(s.operator, '+') AS operator, s.expected_result AS expected FROM (SELECT unnest(calculation_steps) AS s FROM kpi_example)), c AS (SELECT operator, expected, CASE operator WHEN '+' THEN list_sum(o) WHEN '-' THEN o[1] - coalesce(list_sum(o[2:]), 0) WHEN '*' THEN list_product(o) WHEN '/' THEN o[1] / CASE WHEN o[2] = 0 THEN 1 ELSE o[2] END WHEN '%' THEN o[1] * o[2] / 100 END AS result FROM t), w AS (SELECT operator, coalesce(abs(result - expected) <= 0.01 * greatest(1, abs(expected)), false) AS ok, coalesce(abs(result * 100 - expected) <= 0.01 * greatest(1, abs(expected)), false) AS sc FROM c)"
_PROGRAM = "SELECT o_orderkey, ' ' || ['add', 'subtract', 'multiply', 'divide', 'exp'][o_orderkey % 5 + 1] || '( ' || o_custkey || ', ' || CASE WHEN o_orderkey % 7 = 0 THEN '#0' ELSE CAST(o_orderkey % 13 + 1 AS VARCHAR) || ',000' END || ')' AS p, CASE WHEN o_orderkey % 11 = 0 THEN 'yes' ELSE '$' || o_custkey || '%' END AS a FROM orders"
_AMOUNT = lambda x: f"try_cast(replace(replace(replace(trim({x}), ',', ''), '$', ''), '%', '') AS DOUBLE)"
_IDS = lambda c: f"list_transform(coalesce({c}, []), lambda x: coalesce(nullif(x.chunk_id, ''), lower({q.collapse('x.text')})))"
_RETRIEVAL = "SELECT sample_id, CAST(coalesce(h[1], 0) AS DOUBLE) AS hit_rate_top1, CASE WHEN coalesce(list_position(h[:5], 1), 0) > 0 THEN 1.0::DOUBLE ELSE 0 END AS hit_rate_top5, CASE WHEN coalesce(list_position(h[:5], 1), 0) > 0 THEN 1.0::DOUBLE / list_position(h[:5], 1) ELSE 0 END AS mrr, CASE WHEN len(g) = 0 THEN 0 ELSE coalesce(list_sum(list_transform(range(1, len(h) + 1), lambda i: h[i]::DOUBLE / i)), 0) / list_sum(list_transform(range(1, len(g) + 1), lambda i: 1.0::DOUBLE / i)) END AS ndcg FROM (SELECT sample_id, g, list_transform(r, lambda x: CAST(list_contains(g, x) AS INTEGER)) AS h FROM (SELECT sample_id, {r} AS r, {g} AS g FROM {src}))"
_PAIRS = lambda w: f"list_distinct(list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))"
_STRIP = lambda c: f"regexp_replace(lower({c}), '^{q.SPACE}+|{q.SPACE}+$', '', 'g')"
_GENERATION = "SELECT sample_id, CASE WHEN " + _STRIP(
    "g"
) + " = " + _STRIP("r") + " THEN 1.0::DOUBLE ELSE 0 END AS exact_match, CASE WHEN p + c = 0 THEN 0 ELSE 2 * p * c / (p + c) END AS rouge_l, CASE WHEN len(rp) = 0 THEN 0 ELSE len(list_intersect(gp, rp)) / len(rp)::DOUBLE END AS bleu FROM (SELECT *, CASE WHEN len(gw) = 0 THEN 0 ELSE same / len(gw)::DOUBLE END AS p, CASE WHEN len(rw) = 0 THEN 0 ELSE same / len(rw)::DOUBLE END AS c, " + _PAIRS(
    "gw"
) + " AS gp, " + _PAIRS("rw") + " AS rp FROM (SELECT *, len(list_filter(range(1, least(len(gw), len(rw)) + 1), lambda i: gw[i] = rw[i])) AS same FROM (SELECT sample_id, g, r, " + q.words("g") + " AS gw, " + q.words("r") + " AS rw FROM (SELECT sample_id, coalesce(generated_answer, '') AS g, coalesce(answer, '') AS r FROM {src}))))"
_ONE = "(SELECT * FROM rag_example QUALIFY row_number() OVER (PARTITION BY sample_id) = 1)"
_RET = lambda src: _RETRIEVAL.replace("{r}", _IDS("retrieved_chunks")).replace("{g}", _IDS("gold_chunks")).replace("{src}", src)
_SIM = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_TAG = lambda c: f"CASE WHEN {c} % 5 < 2 THEN 'O' WHEN {c} % 5 = 2 THEN 'B-Revenues' WHEN {c} % 5 = 3 THEN 'I-Revenues' ELSE 'B-Debt' END"
_TAGS = f"tags AS (SELECT l_orderkey, place, {_TAG('pk')} AS reference, CASE WHEN sk % 3 = 0 THEN {_TAG('sk')} ELSE {_TAG('pk')} END AS predicted FROM (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) * 10000000 + l_partkey * 100 + l_suppkey % 100 AS place, max(l_partkey) AS pk, max(l_suppkey) AS sk FROM lineitem GROUP BY 1, 2))"
_SPANS = lambda c: f"(SELECT l_orderkey, any_value(k) AS entity, min(place) AS start, max(place) AS \"end\" FROM (SELECT *, sum(f) OVER (PARTITION BY l_orderkey ORDER BY place) AS i FROM (SELECT l_orderkey, place, k, CASE WHEN k IS NOT NULL AND (starts_with({c}, 'B-') OR b IS NULL OR b <> k) THEN 1 ELSE 0 END AS f FROM (SELECT *, lag(k) OVER (PARTITION BY l_orderkey ORDER BY place) AS b FROM (SELECT *, CASE WHEN {c} <> 'O' THEN {c}[3:] END AS k FROM tags)))) WHERE k IS NOT NULL GROUP BY l_orderkey, i)"
_QRELS = "(SELECT DISTINCT CAST(ord % 50 AS BIGINT) AS query_id, chunk_id AS doc_id, ord % 3 AS score FROM document_chunk)"

SQL = {
    "eval_ner": _prf(_ENT),
    "eval_ner_by_type": f"SELECT s.*, count FROM ({_prf(_ENT, 'entity')}) s JOIN (SELECT entity, count(*) AS count FROM ({_ENT_R}) GROUP BY 1) r ON s.entity = r.entity",
    "confusion_matrix": "SELECT reference, " + ", ".join(
        f"CAST(sum(CASE WHEN predicted = '{x}' THEN 1 ELSE 0 END) AS BIGINT) AS {x}" for x in ev.CLASSES
    ) + f" FROM {_LABELS} GROUP BY 1",
    "eval_sentiment_by_class": _CLASS + " SELECT label, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score, support FROM f",
    "eval_sentiment": _CLASS + " SELECT round(sum(tp) / sum(support)::DOUBLE, 6) AS accuracy, round(avg(f1_score), 6) AS macro_f1, round(sum(f1_score * support) / sum(support), 6) AS weighted_f1, CAST(sum(support) AS BIGINT) AS total FROM f",
    "sentiment_label_normalize": f"SELECT c_custkey, CASE WHEN s IN ('positive', 'pos', 'bullish', '2') THEN 'positive' WHEN s IN ('negative', 'neg', 'bearish', '0') THEN 'negative' WHEN s IN ('neutral', 'neu', '1') THEN 'neutral' END AS label FROM (SELECT c_custkey, lower(trim([{', '.join(q.quote(x) for x in _SPELLINGS)}][c_custkey % {len(_SPELLINGS)} + 1])) AS s FROM customer)",
    "eval_kpi": _KPI + " SELECT sample_id, round(numeric_accuracy, 6) AS numeric_accuracy, round(extraction_recall, 6) AS extraction_recall, round(type_coverage, 6) AS type_coverage, round(mean_absolute_error, 6) AS mean_absolute_error, round(rmse, 6) AS rmse, total_kpis FROM s",
    "eval_kpi_macro": _KPI + " SELECT round(avg(numeric_accuracy), 6) AS numeric_accuracy, round(avg(extraction_recall), 6) AS extraction_recall, round(avg(type_coverage), 6) AS type_coverage, count(*) AS samples FROM s",
    "eval_kpi_by_type": _KPI + " SELECT kpi_type, round(avg(CASE WHEN error <= 0.01 THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy, count(*) AS n FROM q GROUP BY 1",
    "calc_accuracy": _STEPS + " SELECT CAST(sum(CAST(ok AS INTEGER)) AS BIGINT) AS correct_steps, count(*) AS total_steps, round(sum(CAST(ok AS INTEGER)) / count(*)::DOUBLE, 6) AS calculation_accuracy FROM w",
    "finqa_breakdown": _STEPS + " SELECT coalesce(operator, 'all') AS operator, CAST(sum(CAST(ok AS INTEGER)) AS BIGINT) AS correct, count(*) AS total, CAST(sum(CAST(NOT ok AND sc AS INTEGER)) AS BIGINT) AS scaled, round(sum(CAST(ok AS INTEGER)) / count(*)::DOUBLE, 6) AS accuracy, round(sum(CAST(ok OR sc AS INTEGER)) / count(*)::DOUBLE, 6) AS adjusted FROM w WHERE operator IN ('+', '-', '*', '/') GROUP BY ROLLUP (operator)",
    "finqa_program_parse": f"SELECT o_orderkey, CASE n WHEN 'add' THEN '+' WHEN 'subtract' THEN '-' WHEN 'multiply' THEN '*' ELSE '/' END AS operator, l AS left_operand, r AS right_operand, e AS expected FROM (SELECT o_orderkey, regexp_extract(trim(p), {q.quote(ev.PROGRAM)}, 1) AS n, {_AMOUNT(f'regexp_extract(trim(p), {q.quote(ev.PROGRAM)}, 2)')} AS l, {_AMOUNT(f'regexp_extract(trim(p), {q.quote(ev.PROGRAM)}, 3)')} AS r, {_AMOUNT('a')} AS e FROM ({_PROGRAM})) WHERE n <> '' AND l IS NOT NULL AND r IS NOT NULL AND e IS NOT NULL",
    "eval_rag_retrieval": f"SELECT sample_id, hit_rate_top1, hit_rate_top5, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg FROM ({_RET('rag_example')})",
    "eval_rag_generation": f"SELECT sample_id, exact_match, round(rouge_l, 6) AS rouge_l, round(bleu, 6) AS bleu FROM ({_GENERATION.replace('{src}', 'rag_example')})",
    "eval_rag": "SELECT " + ", ".join(
        f"round(avg({c}), 6) AS {c}" for c in ("hit_rate_top1", "hit_rate_top5", "mrr", "ndcg", "exact_match", "rouge_l", "bleu")
    ) + f", count(*) AS samples FROM ({_RET(_ONE)}) a JOIN ({_GENERATION.replace('{src}', _ONE)}) b USING (sample_id)",
    "ir_metrics": f"WITH r AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_SIM} DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id QUALIFY rank <= 10), l AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 100 = 0 AND b.vec_id % 5 = 0 AND a.vec_id <> b.vec_id), n AS (SELECT query_id, count(*) AS n FROM l GROUP BY 1), h AS (SELECT r.query_id, sum(1 / log2(rank + 1)) AS dcg, min(rank) AS best, count(*) AS found FROM r JOIN l ON r.query_id = l.query_id AND r.doc_id = l.doc_id GROUP BY 1) SELECT n.query_id, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg, round(coalesce(1.0::DOUBLE / best, 0), 6) AS mrr, round(coalesce(found, 0) / n::DOUBLE, 6) AS recall, CASE WHEN best = 1 THEN 1.0::DOUBLE ELSE 0 END AS precision_at_1 FROM n LEFT JOIN h ON n.query_id = h.query_id",
    "span_to_iob2": f"WITH t AS (SELECT doc_id, {q.words('text')} AS w FROM documents WHERE text IS NOT NULL), x AS (SELECT doc_id, unnest(range(0, len(w))) AS i, unnest(w) AS token FROM t), o AS (SELECT doc_id, i, token, sum(length(token) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(token) - 1 AS s FROM x), e AS (SELECT * FROM (VALUES {', '.join(f'({n}, {a}, {b}, {q.quote(t)})' for n, (a, b, t) in enumerate(_MARKS))}) v(n, a, b, tag)), m AS (SELECT doc_id, i, n, tag, row_number() OVER (PARTITION BY doc_id, n ORDER BY i) AS k FROM o JOIN e ON s < b AND s + length(token) > a) SELECT o.doc_id, CAST(o.i AS INTEGER) AS i, token, coalesce(arg_max(CASE WHEN k = 1 THEN 'B-' ELSE 'I-' END || tag, n), 'O') AS tag FROM o LEFT JOIN m ON o.doc_id = m.doc_id AND o.i = m.i GROUP BY o.doc_id, o.i, token",
    "iob2_spans": f"WITH {_TAGS} SELECT * FROM {_SPANS('reference')}",
    "eval_finer": f"WITH {_TAGS} " + _prf(
        f"SELECT l_orderkey, entity, start, \"end\", max(p) AS in_p, max(r) AS in_r FROM (SELECT *, 1 AS p, 0 AS r FROM {_SPANS('predicted')} UNION ALL SELECT *, 0, 1 FROM {_SPANS('reference')}) GROUP BY ALL",
        "entity"
    ),
    "corpus_dedupe": "SELECT chunk_id, arg_min(text, struct_pack(sample_id, i)) AS text FROM (SELECT sample_id, i, coalesce(nullif(c.chunk_id, ''), 'chunk-' || md5(c.text)) AS chunk_id, c.text AS text FROM (SELECT sample_id, unnest(range(0, len(gold_chunks))) AS i, unnest(gold_chunks) AS c FROM rag_example) WHERE c.text IS NOT NULL) GROUP BY 1",
    "training_pairs": f"SELECT r.query_id, r.doc_id, e.question AS query, c.passage FROM {_QRELS} r JOIN eval_item e ON r.query_id = e.item_id JOIN (SELECT chunk_id, max(text) AS passage FROM document_chunk GROUP BY 1) c ON c.chunk_id = r.doc_id WHERE score > 0",
    "ir_subsample": f"WITH c AS (SELECT DISTINCT chunk_id AS doc_id FROM document_chunk WHERE chunk_id IS NOT NULL), n AS (SELECT DISTINCT doc_id FROM {_QRELS} WHERE score > 0) SELECT doc_id, true AS needed FROM c WHERE doc_id IN (SELECT doc_id FROM n) UNION ALL (SELECT doc_id, false FROM c WHERE doc_id NOT IN (SELECT doc_id FROM n) ORDER BY md5('42:' || doc_id), doc_id LIMIT 20000)",
    "timing_median": "SELECT event_type, round(median(value), 6) AS median_value, round((SELECT median(value) FROM events) / nullif(median(value), 0), 6) AS speedup FROM events GROUP BY 1",
    "published_results": "SELECT * FROM (VALUES " + ", ".join(
        f"({q.quote(a)}, {q.quote(b)}, {v}::DOUBLE)" for a, b, v in ev.PUBLISHED
    ) + ") t(benchmark, metric, value)",
}

QUERIES = {name: globals()[name] for name in SQL}
