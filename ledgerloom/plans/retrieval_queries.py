"""Queries of the vector, retrieval and report operators."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import report as rp
from ledgerloom.operators import retrieval as rt
from ledgerloom.operators import vectors as vx
from ledgerloom.pipeline import AnalysisPipeline
from ledgerloom.plans import sqltools as q
from ledgerloom.plans.extract_queries import SQL as _EXTRACT
from ledgerloom.plans.extract_queries import _judged_sql, _kpi_sql, entity_type_counts, top_entity_type
from ledgerloom.session import checkpointed, table
from ledgerloom.settings import DEFAULT

#: Thresholds for the vectors of the test data, whose nearest neighbours are far apart.
LOOSE = replace(DEFAULT, similarity_floor=0.28, routing_similarity=0.33)
#: Thresholds for vectors of letters, which are all alike.
STRICT = replace(DEFAULT, similarity_floor=0.9, routing_similarity=0.93)


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 100."""
    return table(spark, d, "embeddings").where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")


def _hits(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), F.round("similarity", 5).alias("similarity")
    )


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return _hits(vx.search(table(spark, d, "embeddings"), _asked(spark, d), "vec_id", "query_id", exclude_self=True))


def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Search within the query's own label, for half of the queries."""
    asked = _asked(spark, d).withColumn("label", F.when(F.col("query_id") % 200 == 0, F.col("label")))
    return _hits(vx.search(table(spark, d, "embeddings"), asked, "vec_id", "query_id", group="label", exclude_self=True))


def vector_threshold(spark: SparkSession, d: str) -> DataFrame:
    return _hits(
        vx.search(
            table(spark, d, "embeddings"), _asked(spark, d), "vec_id", "query_id", floor=LOOSE.similarity_floor, exclude_self=True
        )
    )


def avg_similarity(spark: SparkSession, d: str) -> DataFrame:
    hits = vx.search(
        table(spark, d, "embeddings"), _asked(spark, d), "vec_id", "query_id", floor=LOOSE.similarity_floor, exclude_self=True
    )
    per = hits.groupBy(F.col("query").alias("query_id")).agg(F.count(F.lit(1)).alias("hits"), F.avg("similarity").alias("a"))
    return _asked(spark, d).select("query_id").join(per, "query_id", "left").select(
        "query_id", F.coalesce("hits", F.lit(0)).alias("hits"), F.round(F.coalesce("a", F.lit(0.0)), 5).alias("average")
    )


def requery_loop(spark: SparkSession, d: str) -> DataFrame:
    """The loop over vectors: attempt n asks with the vector n ids further on."""
    vectors = table(spark, d, "embeddings")

    def attempt(left: DataFrame, n: int) -> DataFrame:
        asked = left.join(vectors.select((F.col("vec_id") - n).alias("query_id"), "embedding"), "query_id")
        return vx.search(vectors, asked, "vec_id", "query_id", floor=LOOSE.similarity_floor).withColumnRenamed("query", "query_id")

    found = rt.requery(_asked(spark, d).select("query_id"), attempt, key="query_id", s=LOOSE)
    return found.select("query_id", "attempt", "rank", F.col("id").alias("vec_id"), F.round("similarity", 5).alias("similarity"))


def vector_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Chunks indexed before 2022 are the old collection, later ones are put into it."""
    rows = vx.collection_rows(table(spark, d, "document_chunk")).select(
        "chunk_id", "doc_id", "ticker", "chunk_type", "page_number", F.size("embedding").alias("dim"), "indexed_at"
    )
    old, new = rows.where("indexed_at < timestamp'2022-01-01'"), rows.where("indexed_at >= timestamp'2022-01-01'")
    return vx.upsert(vx.upsert(old.limit(0), old, version="indexed_at"), new, version="indexed_at").drop("indexed_at")


def vector_metadata_defaults(spark: SparkSession, d: str) -> DataFrame:
    odd = F.when(F.col("ord") % 7 == 0, F.lit("other")).otherwise(F.col("chunk_type"))
    rows = table(spark, d, "document_chunk").withColumn("chunk_type", odd).withColumn(
        "ticker", F.nullif("ticker", F.lit("unknown"))
    )
    return vx.collection_rows(rows).select("chunk_id", "ticker", "chunk_type", "page_number")


def _rag(spark: SparkSession, d: str) -> DataFrame:
    """One row a sample: a re-delivered row repeats its content."""
    cols = ("question", "answer", "generated_answer", "gold_chunks", "retrieved_chunks")
    return table(spark, d, "rag_example").groupBy("sample_id").agg(*[F.max(c).alias(c) for c in cols])


def query_reformulate(spark: SparkSession, d: str) -> DataFrame:
    rows = _rag(spark, d).select("sample_id", "question", F.explode(F.array(F.lit(1), F.lit(2))).alias("attempt"))
    return rows.select("sample_id", "attempt", rt.reformulate(F.col("question"), F.col("attempt")).alias("query"))


def _with_hits(spark: SparkSession, d: str) -> DataFrame:
    hit = lambda c, i: F.struct(
        c["text"].alias("text"), F.when(i == 0, F.lit("mda")).alias("section"), (F.lit(0.875) - i * 0.125).alias("similarity")
    )
    return _rag(spark, d).select("sample_id", F.col("question").alias("query"), F.transform("retrieved_chunks", hit).alias("hits"))


def rag_context(spark: SparkSession, d: str) -> DataFrame:
    return _with_hits(spark, d).select("sample_id", rt.build_context(F.col("hits")).alias("context"))


def extractive_answer(spark: SparkSession, d: str) -> DataFrame:
    return rt.generate(_with_hits(spark, d)).select("sample_id", "reasoning", "answer")


def llm_response_parse(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(
        F.col("sample_id") % 3 == 0,
        F.concat(F.lit("REASONING: "), "question", F.lit("\nANSWER: "), F.coalesce("answer", F.lit("")), F.lit(" "))
    ).otherwise(F.coalesce("answer", F.lit("")))
    return _rag(spark, d).select("sample_id", rt.parse_response(said).alias("p")).select("sample_id", "p.*")


def report_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings of users as documents: sentiment from their values, entities from their events."""
    base = table(spark, d, "events").groupBy("user_id").agg(
        F.avg("value").alias("v"), F.count_distinct("event_type").alias("kinds")
    )
    joined = base.join(top_entity_type(spark, d), "user_id", "left")
    label = F.when(F.col("v") > 50, "positive").when(F.col("v") < 48, "negative").otherwise("other")
    lines = rp.findings(label, F.col("entity_group"), F.col("n"), F.col("kinds"), F.signum(F.col("v") - 49))
    return joined.select("user_id", F.array_join(lines, "|").alias("findings"))


def report_summary(spark: SparkSession, d: str) -> DataFrame:
    counts = entity_type_counts(spark, d).groupBy("user_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types"))
    label = F.when(F.col("user_id") % 2 == 0, "positive")
    return counts.select(
        "user_id",
        rp.summary(
            F.col("n"),
            F.col("types"),
            label,
            (F.col("user_id") % 8) / F.lit(8.0),
            F.col("types"),
            F.col("types") - 1,
            F.lit(1),
            F.repeat(F.lit("ab "), (F.col("user_id") % 50).cast("int"))
        ).alias("summary")
    )


def analysis_report(spark: SparkSession, d: str) -> DataFrame:
    """The whole pipeline over the filings, with one question for each document that has a ticker."""
    docs = _filings(spark, d)
    questions = docs.where("ticker is not null").select(
        "doc_id", F.col("doc_id").alias("query_id"), F.lit(_QUESTION).alias("query"), "ticker"
    )
    return AnalysisPipeline(settings=LOOSE).analyze(docs, questions)


_QUESTION = "What is the total revenue and net income?"
_LETTERS = "etaoinshrdlucmfwypvbgkjqxz"


class LetterEmbedder:
    """How often each letter stands in a text: vectors that other engines can repeat."""

    dim = len(_LETTERS)

    def embed(self, text: Column) -> Column:
        low = F.lower(F.coalesce(text, F.lit("")))
        return F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(x), F.lit("")))).cast("float") for x in _LETTERS])


def _filings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parsed_document").where("cleaned_text is not null").groupBy("doc_id").agg(
        *[F.max(c).alias(c) for c in ("ticker", "doc_type", "fiscal_period", "cleaned_text")]
    )


def report_hits(spark: SparkSession, d: str) -> DataFrame:
    """The retrieval of the report: chunks of all filings, and the loop's hits for a question about each filing with a ticker."""
    line = AnalysisPipeline(embedder=LetterEmbedder(), settings=STRICT)
    docs = _filings(spark, d)
    asked = docs.where("ticker is not null").select(F.col("doc_id").alias("query_id"), F.lit(_QUESTION).alias("query"), "ticker")
    hits = line.retrieve(checkpointed(line.chunks(docs)), asked)
    return hits.select(
        F.col("query_id").alias("doc_id"),
        "attempt",
        "rank",
        F.col("id").alias("chunk_id"),
        F.round("similarity", 4).alias("similarity")
    )


def report_figures(spark: SparkSession, d: str) -> DataFrame:
    """What the report says of each filing's figures and sentiment."""
    r = analysis_report(spark, d)
    return r.select(
        "doc_id",
        "metadata.ticker",
        "metadata.doc_type",
        "metadata.fiscal_period",
        "financial_metrics.kpi_count",
        "financial_metrics.total_kpis",
        F.col("sentiment_analysis.overall_sentiment").alias("sentiment"),
        F.round("sentiment_analysis.confidence_score", 6).alias("score"),
        "sentiment_analysis.is_positive"
    )


_SIM = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


def _topk(where: str = "true", floor: float | None = None, raw: bool = False) -> str:
    keep = f" AND s >= {floor}" if floor is not None else ""
    sim = "s" if raw else "round(s, 5)"
    return (
        f"SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS INTEGER) AS rank, vec_id, {sim} AS similarity FROM (SELECT a.vec_id AS query_id, b.vec_id, {_SIM} AS s FROM embeddings a, embeddings b"
        f" WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND {where}) WHERE true{keep} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) <= 5"
    )


_DOCS = "(SELECT doc_id, max(ticker) AS ticker, max(doc_type) AS doc_type, max(fiscal_period) AS fiscal_period, max(cleaned_text) AS text FROM parsed_document WHERE cleaned_text IS NOT NULL GROUP BY 1)"
_PIECE = "regexp_extract(piece, '(?s)^(.*[.!?])(?:\\s|$)', 1)"
_LETTER_SQL = "[" + ", ".join(f"(length({{0}}) - length(replace({{0}}, '{x}', '')))::DOUBLE" for x in _LETTERS) + "]"
_ASKED = ", ".join(
    f"({i}, {q.quote(x.lower())})"
    for i, x in enumerate((_QUESTION, f"Provide detailed information about: {_QUESTION}", "total revenue net income"))
)
_HITS = f"""
WITH w AS (SELECT doc_id, ticker, text, string_split(text, ' ') AS w FROM {_DOCS} WHERE trim(text, ' ') <> ''),
k AS (SELECT doc_id, ticker, text, w, len(w) AS n, unnest(range(0, CASE WHEN len(w) <= 512 THEN 1 ELSE CAST(ceil((len(w) - 512) / 448.0) AS BIGINT) + 1 END)) AS ord FROM w),
p AS (SELECT doc_id, ticker, text, n, ord, array_to_string(list_slice(w, ord * 448 + 1, least(ord * 448 + 512, n)), ' ') AS piece FROM k),
c AS (SELECT ticker, sha256(doc_id || chr(1) || chr(1) || ord) AS chunk_id, lower(CASE WHEN n > 512 THEN trim(CASE WHEN {_PIECE} <> '' THEN {_PIECE} ELSE piece END, ' ') ELSE text END) AS t FROM p),
v AS (SELECT ticker, chunk_id, {_LETTER_SQL.format('t')} AS e FROM c WHERE t <> ''),
a AS (SELECT n, {_LETTER_SQL.format('t')} AS e FROM (VALUES {_ASKED}) x(n, t)),
h AS (SELECT ticker, n, chunk_id, list_cosine_similarity(a.e, v.e) AS s, row_number() OVER (PARTITION BY ticker, n ORDER BY list_cosine_similarity(a.e, v.e) DESC, chunk_id) AS rank FROM v, a WHERE list_sum(v.e) > 0 AND list_cosine_similarity(a.e, v.e) >= {STRICT.similarity_floor} QUALIFY rank <= 5),
g AS (SELECT ticker, n, count(*) AS c, avg(s) AS m FROM h GROUP BY 1, 2),
f AS (SELECT doc_id, ticker, coalesce((SELECT min(n) FROM g WHERE g.ticker = d.ticker AND n < 2 AND c >= 3 AND m >= {STRICT.routing_similarity}), 2) AS n FROM {_DOCS} d WHERE ticker IS NOT NULL)
SELECT f.doc_id, CAST(h.n AS INTEGER) AS attempt, CAST(rank AS INTEGER) AS rank, chunk_id, round(s, 4) AS similarity FROM h JOIN f ON h.ticker = f.ticker AND h.n = f.n
"""
_FIGURES = f"WITH d AS (SELECT * FROM {_DOCS}), k AS ({_kpi_sql('SELECT doc_id, text FROM d', 'doc_id')}), m AS (SELECT doc_id FROM (SELECT doc_id, arg_min(value, ord) AS gv, arg_min(unit, ord) AS gu FROM k WHERE kpi_type = 'gross_margin' GROUP BY 1) JOIN (SELECT doc_id, arg_min(value, ord) AS rv FROM k WHERE kpi_type = 'revenue' GROUP BY 1) USING (doc_id) WHERE trim(gu) <> '%' AND rv <> 0), n AS (SELECT doc_id, count(DISTINCT kpi_type) AS kinds FROM k GROUP BY 1), s AS (SELECT doc_id, substr(s, 1, 512) AS s FROM (SELECT doc_id, unnest(list_slice(string_split(text, '.'), 1, 50)) AS s FROM d) WHERE length(trim(s, ' ')) >= 5), j AS ({_judged_sql('SELECT * FROM s', 'doc_id', 's')}), a AS (SELECT doc_id, avg(score) AS score FROM j GROUP BY 1), x AS (SELECT d.doc_id, ticker, doc_type, fiscal_period, coalesce(kinds, 0) AS kpi_count, coalesce(kinds, 0) + CASE WHEN d.doc_id IN (SELECT doc_id FROM m) THEN 1 ELSE 0 END AS total_kpis, coalesce(score, 0) AS score FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN a ON a.doc_id = d.doc_id WHERE ticker IS NOT NULL) SELECT doc_id, ticker, doc_type, fiscal_period, kpi_count, total_kpis, CASE WHEN score > 0.2 THEN 'positive' WHEN score < -0.2 THEN 'negative' ELSE 'neutral' END AS sentiment, round(score, 6) AS score, score > 0.5 AS is_positive FROM x"

_FLOOR = LOOSE.similarity_floor
_ATTEMPTS = f"WITH h AS (SELECT query_id, n, vec_id, s, row_number() OVER (PARTITION BY query_id, n ORDER BY s DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, n, b.vec_id, {_SIM} AS s FROM embeddings q, (VALUES (0), (1), (2)) t(n), embeddings a, embeddings b WHERE q.vec_id % 100 = 0 AND a.vec_id = q.vec_id + n) WHERE s >= {_FLOOR} QUALIFY rank <= 5), g AS (SELECT query_id, n, count(*) AS c, avg(s) AS m FROM h GROUP BY 1, 2), f AS (SELECT vec_id AS query_id, coalesce((SELECT min(n) FROM g WHERE g.query_id = e.vec_id AND n < 2 AND c >= 3 AND m >= {LOOSE.routing_similarity}), 2) AS n FROM embeddings e WHERE vec_id % 100 = 0)"
_RAG = "(SELECT sample_id, max(question) AS question, max(answer) AS answer, max(generated_answer) AS generated_answer, max(gold_chunks) AS gold_chunks, max(retrieved_chunks) AS retrieved_chunks FROM rag_example GROUP BY 1)"
_ROWS = "SELECT chunk_id, doc_id, coalesce(ticker, 'unknown') AS ticker, CASE WHEN chunk_type IN ('mda', 'risk_factors', 'financial_statements', 'general') THEN chunk_type ELSE 'general' END AS chunk_type, coalesce(page_number, -1) AS page_number, CAST(len(embedding) AS INTEGER) AS dim, indexed_at FROM document_chunk WHERE chunk_id IS NOT NULL AND embedding IS NOT NULL"
_STOP = ", ".join(q.quote(w) for w in rt.QUESTION_WORDS)

SQL = {
    "vector_topk": _topk(),
    "vector_topk_filtered": _topk("(a.vec_id % 200 <> 0 OR a.label = b.label)"),
    "vector_threshold": _topk(floor=_FLOOR),
    "avg_similarity": f"SELECT e.vec_id AS query_id, count(t.vec_id) AS hits, round(coalesce(avg(similarity), 0), 5) AS average FROM embeddings e LEFT JOIN ({_topk(floor=_FLOOR, raw=True)}) t ON t.query_id = e.vec_id WHERE e.vec_id % 100 = 0 GROUP BY 1",
    "requery_loop": _ATTEMPTS + " SELECT h.query_id, CAST(h.n AS INTEGER) AS attempt, CAST(rank AS INTEGER) AS rank, vec_id, round(s, 5) AS similarity FROM h JOIN f ON h.query_id = f.query_id AND h.n = f.n",
    "vector_upsert": f"WITH r AS ({_ROWS}) SELECT * EXCLUDE (indexed_at) FROM r QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC) = 1",
    "vector_metadata_defaults": "SELECT chunk_id, coalesce(nullif(ticker, 'unknown'), 'unknown') AS ticker, CASE WHEN ord % 7 = 0 OR chunk_type NOT IN ('mda', 'risk_factors', 'financial_statements', 'general') OR chunk_type IS NULL THEN 'general' ELSE chunk_type END AS chunk_type, coalesce(page_number, -1) AS page_number FROM document_chunk WHERE chunk_id IS NOT NULL AND embedding IS NOT NULL",
    "query_reformulate": f"SELECT sample_id, n AS attempt, CASE WHEN n = 1 THEN 'Provide detailed information about: ' || question ELSE coalesce(nullif(array_to_string(list_filter(string_split(trim(regexp_replace(replace(question, '?', ''), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')), ' '), lambda w: lower(w) NOT IN ({_STOP})), ' '), ''), question) END AS query FROM {_RAG}, (VALUES (1), (2)) t(n)",
    "rag_context": f"SELECT sample_id, array_to_string(list_transform(range(1, len(retrieved_chunks) + 1), lambda i: '[Chunk ' || i || '] (' || CASE WHEN i = 1 THEN 'mda' ELSE 'general' END || ', similarity: ' || printf('%.3f', 0.875 - (i - 1) * 0.125::DOUBLE) || ')' || chr(10) || substr(retrieved_chunks[i].text, 1, 500) || '...' || chr(10)), chr(10)) AS context FROM {_RAG}",
    "extractive_answer": f"SELECT sample_id, CASE WHEN len(retrieved_chunks) > 0 THEN 'Question: ' || question || chr(10) || chr(10) || 'Analyzing ' || len(retrieved_chunks) || ' relevant document sections:' || chr(10) || array_to_string(list_transform(range(1, len(retrieved_chunks) + 1), lambda i: i || '. Section discusses: ' || substr(retrieved_chunks[i].text, 1, 100) || '... (relevance: ' || printf('%.2f', 100 * (0.875 - (i - 1) * 0.125::DOUBLE)) || '%)' || chr(10)), '') ELSE '{rt.NO_CHUNKS_REASONING}' END AS reasoning, CASE WHEN len(retrieved_chunks) = 0 THEN '{rt.NO_CHUNKS_ANSWER}' WHEN length(t) > 500 THEN substr(t, 1, 500) || '...' ELSE t END AS answer FROM (SELECT *, array_to_string(list_transform(retrieved_chunks, lambda c: substr(c.text, 1, 200)), ' ') AS t FROM {_RAG})",
    "llm_response_parse": f"SELECT sample_id, CASE WHEN headed THEN regexp_replace(replace(string_split(r, 'ANSWER:')[1], 'REASONING:', ''), '^\\s+|\\s+$', '', 'g') ELSE '' END AS reasoning, CASE WHEN headed THEN regexp_replace(string_split(r, 'ANSWER:')[2], '^\\s+|\\s+$', '', 'g') ELSE r END AS answer FROM (SELECT sample_id, r, contains(r, 'REASONING:') AND contains(r, 'ANSWER:') AS headed FROM (SELECT sample_id, CASE WHEN sample_id % 3 = 0 THEN 'REASONING: ' || question || chr(10) || 'ANSWER: ' || coalesce(answer, '') || ' ' ELSE coalesce(answer, '') END AS r FROM {_RAG}))",
    "report_hits": _HITS,
    "report_figures": _FIGURES,
    "report_findings": f"WITH b AS (SELECT user_id, avg(value) AS v, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1), t AS ({_EXTRACT['top_entity_type']}) SELECT b.user_id, concat_ws('|', 'Document exhibits a ' || CASE WHEN v > 50 THEN 'positive' WHEN v < 48 THEN 'negative' ELSE 'neutral' END || ' sentiment overall', 'Most common entity type: ' || entity_group || ' (' || n || ' occurrences)', CASE WHEN kinds > 0 THEN 'Identified ' || kinds || ' types of KPIs in document' END, CASE WHEN v > 49 THEN 'Management tone becomes more positive from opening to closing' WHEN v < 49 THEN 'Management tone becomes more negative from opening to closing' END) AS findings FROM b LEFT JOIN t ON b.user_id = t.user_id",
    "report_summary": f"SELECT user_id, concat_ws(' ', 'Identified ' || n || ' entities across ' || types || ' categories.', CASE WHEN user_id % 2 = 0 THEN 'Document has positive sentiment (score: ' || printf('%.3f', (user_id % 8) / 8.0::DOUBLE) || ').' END, CASE WHEN types > 0 THEN 'Extracted ' || (types - 1) || ' KPIs with 1 derived calculations.' END, CASE WHEN a <> '' THEN 'Answer: ' || CASE WHEN length(a) > 100 THEN substr(a, 1, 100) || '...' ELSE a END END) AS summary FROM (SELECT user_id, CAST(sum(n) AS BIGINT) AS n, count(*) AS types, repeat('ab ', CAST(user_id % 50 AS INTEGER)) AS a FROM ({_EXTRACT['entity_type_counts']}) GROUP BY 1)",
}

QUERIES = {name: globals()[name] for name in [*SQL, "analysis_report"]}
