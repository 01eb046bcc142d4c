"""Queries of the preparation operators, of tagged figures and of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.metrics import evaluators as ev
from ledgerloom.operators import chunking as ch
from ledgerloom.operators import entities as en
from ledgerloom.operators import preparation as pr
from ledgerloom.operators import report as rp
from ledgerloom.operators import vectors as vx
from ledgerloom.plans import sqltools as q
from ledgerloom.plans.metric_queries import _qrels, _QRELS
from ledgerloom.session import checkpointed, table
from ledgerloom.sources import documents as src


def figure_spans(spark: SparkSession, d: str) -> DataFrame:
    """Entries as spans of a tagger; every fifth has no type and no score."""
    odd = F.col("entry_id") % 5 == 0
    span = F.struct(
        F.col("raw_text").alias("word"),
        F.when(~odd, F.col("name")).alias("entity_group"),
        F.when(~odd, F.col("ord") / 8).alias("score"),
        F.lit(0).alias("start"),
        F.length("raw_text").alias("end")
    )
    rows = table(spark, d, "kpi_agent").select("entry_id", en.reshape_spans(F.array(span))[0].alias("f"))
    return rows.select("entry_id", "f.text", "f.tag", "f.value", F.round("f.score", 6).alias("score"), "f.start", "f.end")


class _Amounts:
    """A tagger for which every dollar amount is a revenue."""

    def tag(self, text: Column) -> Column:
        from ledgerloom.functions.text import regex_spans

        return F.transform(
            regex_spans(text, r"\$[\d,]*\d"),
            lambda m: F.struct(
                F.substr(text, m["start"] + 1, m["end"] - m["start"]).alias("word"),
                F.lit("Revenues").alias("entity_group"),
                F.lit(0.5).alias("score"),
                m["start"].alias("start"),
                m["end"].alias("end")
            )
        )


def tagged_figures(spark: SparkSession, d: str) -> DataFrame:
    """Amounts of all chunks of a filing, numbered in order of the chunks."""
    chunks = table(spark, d, "document_chunk").groupBy("doc_id", "chunk_id").agg(
        F.max("ord").alias("ord"), F.max("text").alias("text")
    )
    return en.tag_figures(
        chunks, "doc_id", ["ord", "chunk_id"], "text", _Amounts()
    ).drop("start", "end").withColumn("ord", F.col("ord").cast("int"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as the pages of their filings."""
    return table(spark, d, "document_chunk").groupBy("doc_id", "ord").agg(F.max("text").alias("text"))


def page_offsets(spark: SparkSession, d: str) -> DataFrame:
    return src.page_offsets(_pages(spark, d), "doc_id", "ord", "text")


def page_map(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages(spark, d).groupBy("doc_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda p: p["text"]).alias("pages")
    )
    return pages.select("doc_id", F.explode(src.page_map(F.col("pages"))).alias("page", "end"))


def chunk_types(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "document_chunk").select("chunk_id", ch.chunk_type(F.col("metadata")["section"]).alias("chunk_type"))


def report_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as a report shows them, a third of them without section, page and similarity."""
    odd = F.col("ord") % 3 == 0
    blank = lambda c: F.when(~odd, c)
    hit = F.struct(
        "chunk_id",
        "text",
        blank(F.col("metadata")["section"]).alias("section"),
        "chunk_type",
        blank(F.col("page_number")).alias("page_number"),
        blank(F.col("ord") / 16).alias("similarity")
    )
    return table(spark, d, "document_chunk").where("chunk_id is not null").select(
        F.explode(rp.format_chunks(F.array(hit))).alias("h")
    ).select("h.*")


def document_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the filings by the sections that their own section maps name."""
    docs = table(spark, d, "parsed_document").where("cleaned_text is not null").groupBy("doc_id").agg(
        F.max(F.struct("cleaned_text", F.map_entries("section_map").alias("m"))).alias("r")
    ).select("doc_id", "r.cleaned_text", "r.m")
    sections = docs.select("doc_id", F.posexplode(F.array_sort("m")).alias("ord", "e")).select(
        "doc_id",
        "ord",
        F.lower("e.key").alias("section"),
        F.col("e.value.start_char").alias("start"),
        F.col("e.value.end_char").alias("end")
    )
    chunks = ch.chunk_documents(docs.select("doc_id", "cleaned_text"), sections, snap=False)
    return chunks.select("doc_id", "section", "chunk_type", "ord", "text", "token_count", "local_start", "start_offset")


def entity_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Entities whose word and type have one of several names."""
    from ledgerloom.__main__ import _entities

    n = F.col("event_id")
    word, kind = F.element_at(F.array(F.lit("word"), F.lit("text")), (n % 2 + 1).cast("int")), F.element_at(
        F.array(*[F.lit(x) for x in ("entity", "entity_group", "label", "kind")]), (n % 4 + 1).cast("int")
    )
    body = F.concat(
        F.lit('[{"'),
        word,
        F.lit('": "w'),
        (n % 9).cast("string"),
        F.lit('", "'),
        kind,
        F.lit('": "'),
        F.col("event_type"),
        F.lit('"}]')
    )
    return table(spark, d, "events").select("event_id", F.explode(_entities(body)).alias("e")).select("event_id", "e.*")


def sentiment_set(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(
        F.concat("event_type", F.col("event_id").cast("string")).alias("sentence"),
        (F.col("event_id") % 4).cast("int").alias("label")
    )
    return pr.sentiment_samples(rows)


def evidence_set(spark: SparkSession, d: str) -> DataFrame:
    rag = table(spark, d, "rag_example").groupBy("sample_id").agg(
        *[F.max(c).alias(c) for c in ("question", "answer", "gold_chunks")]
    )
    rows = pr.evidence_samples(
        rag.withColumn("texts", F.transform("gold_chunks", lambda c: c["text"])), "sample_id", "question", "answer", "texts"
    )
    return rows.select("id", "question", "answer", F.explode("gold_chunks").alias("g")).select(
        "id", "question", "answer", F.col("g.chunk_id").alias("chunk_id"), F.col("g.text").alias("text")
    )


def program_set(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("sample_id")
    rag = table(spark, d, "rag_example").groupBy("sample_id").agg(
        *[F.max(c).alias(c) for c in ("question", "answer", "generated_answer")]
    )
    program = F.when(n % 3 == 0, "divide(12, 4)").when(n % 3 == 1, "subtract(1,250.5, 50.5)").otherwise("add(1, 2), divide(#0, 3)")
    rows = rag.select(
        F.array("question", F.repeat(F.lit("long "), (n % 900).cast("int"))).alias("pre_text"),
        F.when(n % 2 == 0, F.array(F.coalesce("generated_answer", F.lit("")))).alias("post_text"),
        "question",
        program.alias("program"),
        F.lit("$3").alias("answer")
    )
    out = pr.finqa_samples(rows).withColumn("s", F.col("calculation_steps")[0])
    return out.select(
        "text",
        "question",
        F.size("reference_kpis").alias("kpis"),
        F.col("s.operator").alias("operator"),
        F.col("s.operands")[0].alias("first"),
        F.col("s.expected_result").alias("expected")
    )


def label_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Orders as sentences of words of two parts between special tokens, and their numbered tags."""
    words = (F.col("o_orderkey") % 5 + 1).cast("int")
    ids = F.concat(
        F.array(F.lit(None).cast("int")),
        F.transform(F.sequence(F.lit(0), 2 * words - 1), lambda i: F.floor(i / 2).cast("int")),
        F.array(F.lit(None).cast("int"))
    )
    tags = F.transform(F.sequence(F.lit(0), words - 1), lambda i: F.pmod(F.col("o_custkey") + i, F.lit(3)).cast("int"))
    rows = table(spark, d, "orders").select("o_orderkey", ids.alias("word_ids"), tags.alias("tags"))
    return pr.align_labels(rows, "o_orderkey", "word_ids", "tags").select(
        "o_orderkey", F.array_join(F.transform("labels", lambda x: x.cast("string")), ",").alias("labels")
    )


_NAMES = ("O", "B-Revenues", "I-Revenues")


def label_decoding(spark: SparkSession, d: str) -> DataFrame:
    ids = F.array(F.lit(-100), (F.col("o_orderkey") % 3).cast("int"), (F.col("o_custkey") % 3).cast("int"), F.lit(-100))
    rows = pr.decode_labels(table(spark, d, "orders").select("o_orderkey", ids.alias("ids")), "o_orderkey", "ids", list(_NAMES))
    return rows.select("o_orderkey", F.array_join("tags", ",").alias("tags"))


def titled_passages(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(
        "p_partkey", F.when(F.col("p_partkey") % 4 > 0, F.col("p_name")).otherwise("").alias("title"), "p_type"
    )
    return pr.titled_passages(rows, "p_partkey", "title", "p_type")


def relevant_sets(spark: SparkSession, d: str) -> DataFrame:
    return pr.relevant_sets(_qrels(spark, d)).select("query_id", F.array_join(F.sort_array("doc_ids"), ",").alias("doc_ids"))


def benchmark_log(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("o_orderkey")
    line = F.concat(
        F.lit("Sequential (median): "),
        (n % 90 + 1).cast("string"),
        F.lit(".5s\n"),
        F.when(n % 7 > 0, F.concat(F.lit("parallel (median): "), (n % 40 + 1).cast("string"), F.lit(".25 s"))).otherwise("")
    )
    rows = table(spark, d, "orders").select("o_orderkey", line.alias("log"))
    return pr.benchmark_log(rows, "log").groupBy("sequential", "parallel").agg(
        F.count(F.lit(1)).alias("runs"), F.round(F.max("speedup"), 6).alias("speedup")
    )


def metric_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Mean values by event type of two groups of users, as the metrics of two runs."""
    side = lambda rest: table(spark, d, "events").where(F.col("user_id") % 2 == rest).groupBy(
        F.col("event_type").alias("metric")
    ).agg(
        F.round(F.avg("value"), 6).alias("value")
    )
    return ev.compare_runs(side(0), side(1)).withColumn("delta", F.round("delta", 6))


def rag_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Chunks and extractive answers for every question, from the gold passages of all samples."""
    rag = table(spark, d, "rag_example").groupBy("sample_id").agg(*[F.max(c).alias(c) for c in ("question", "gold_chunks")])
    corpus = checkpointed(vx.embed(pr.corpus_passages(rag, "sample_id", "gold_chunks")))
    return pr.predict_answers(rag, corpus)


_CHUNK_PAGES = "SELECT doc_id, ord, max(text) AS text FROM document_chunk GROUP BY 1, 2"
_GROUPED_RAG = "SELECT sample_id, max(question) AS question, max(answer) AS answer, max(generated_answer) AS generated_answer, max(gold_chunks) AS gold_chunks FROM rag_example GROUP BY 1"
_SECTIONED = (
    "WITH r AS (SELECT doc_id, max(struct_pack(t := cleaned_text, m := list_sort(list_transform(map_entries(section_map), lambda e: struct_pack(key := e.key, s := e.value.start_char, e := e.value.end_char))))) AS r FROM parsed_document WHERE cleaned_text IS NOT NULL GROUP BY 1),"
    " s AS (SELECT doc_id, r.t AS t, unnest(r.m) AS e FROM r WHERE len(r.m) > 0),"
    " u AS (SELECT doc_id, lower(e.key) AS section, e.s AS sec_start, substr(t, e.s + 1, greatest(e.e - e.s, 0)) AS body FROM s UNION ALL SELECT doc_id, NULL, 0, r.t FROM r WHERE coalesce(len(r.m), 0) = 0),"
    " w AS (SELECT *, string_split(body, ' ') AS w FROM u WHERE trim(body, ' ') <> ''),"
    " k AS (SELECT *, len(w) AS n, unnest(range(0, CASE WHEN len(w) <= 512 THEN 1 ELSE CAST(ceil((len(w) - 512) / 448.0) AS BIGINT) + 1 END)) AS ord FROM w),"
    " p AS (SELECT doc_id, section, CAST(ord AS INTEGER) AS ord, CASE WHEN n > 512 THEN trim(array_to_string(list_slice(w, ord * 448 + 1, least(ord * 448 + 512, n)), ' '), ' ') ELSE body END AS text, CASE WHEN ord = 0 THEN 0 ELSE length(array_to_string(list_slice(w, 1, ord * 448), ' ')) + 1 END AS local_start, sec_start FROM k)"
    " SELECT doc_id, section, CASE WHEN section IN ('mda', 'risk_factors', 'financial_statements') THEN section ELSE 'general' END AS chunk_type, ord, text, CAST(len(string_split(text, ' ')) AS INTEGER) AS token_count, CAST(local_start AS INTEGER) AS local_start, CAST(sec_start + local_start AS INTEGER) AS start_offset FROM p WHERE text <> ''"
)
_STEP = "CASE WHEN n % 3 = 0 THEN {a} ELSE {b} END"

SQL = {
    "figure_spans": "SELECT entry_id, coalesce(raw_text, '') AS text, CASE WHEN entry_id % 5 = 0 THEN 'unknown' ELSE coalesce(name, 'unknown') END AS tag, try_cast(regexp_replace(raw_text, '[^0-9.\\-]', '', 'g') AS DOUBLE) AS value, CASE WHEN entry_id % 5 = 0 THEN 0.0::DOUBLE ELSE coalesce(round(ord / 8.0::DOUBLE, 6), 0.0) END AS score, 0 AS start, CAST(length(raw_text) AS INTEGER) AS \"end\" FROM kpi_agent",
    "tagged_figures": "WITH c AS (SELECT doc_id, chunk_id, max(ord) AS ord, max(text) AS text FROM document_chunk GROUP BY 1, 2), m AS (SELECT doc_id, chunk_id, ord, regexp_extract_all(text, '\\$[\\d,]*\\d') AS a FROM c), x AS (SELECT doc_id, chunk_id, ord, unnest(range(0, len(a))) AS i, unnest(a) AS text FROM m) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord NULLS FIRST, chunk_id NULLS FIRST, i) - 1 AS INTEGER) AS ord, text, 'Revenues' AS tag, try_cast(regexp_replace(text, '[^0-9.\\-]', '', 'g') AS DOUBLE) AS value, 0.5::DOUBLE AS score FROM x",
    "page_offsets": f"SELECT doc_id, ord, e - n AS start, e AS \"end\" FROM (SELECT doc_id, ord, coalesce(length(text), 0) AS n, CAST(sum(coalesce(length(text), 0)) OVER w + row_number() OVER w - 1 AS BIGINT) AS e FROM ({_CHUNK_PAGES}) WINDOW w AS (PARTITION BY doc_id ORDER BY ord NULLS FIRST ROWS UNBOUNDED PRECEDING))",
    "page_map": f"SELECT doc_id, 'page_' || row_number() OVER w AS page, CAST(sum(coalesce(length(text), 0)) OVER w AS INTEGER) AS \"end\" FROM ({_CHUNK_PAGES}) WINDOW w AS (PARTITION BY doc_id ORDER BY ord NULLS FIRST ROWS UNBOUNDED PRECEDING)",
    "chunk_types": "SELECT chunk_id, CASE WHEN metadata['section'] IN ('mda', 'risk_factors', 'financial_statements') THEN metadata['section'] ELSE 'general' END AS chunk_type FROM document_chunk",
    "report_chunks": "SELECT chunk_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS text, coalesce(CASE WHEN ord % 3 <> 0 THEN metadata['section'] END, 'general') AS section, coalesce(chunk_type, 'general') AS chunk_type, coalesce(CASE WHEN ord % 3 <> 0 THEN page_number END, -1) AS page_number, coalesce(CASE WHEN ord % 3 <> 0 THEN ord / 16.0::DOUBLE END, 0.0) AS similarity FROM document_chunk WHERE chunk_id IS NOT NULL",
    "document_chunks": _SECTIONED,
    "entity_aliases": "SELECT event_id, 'w' || (event_id % 9) AS word, CASE WHEN event_id % 4 = 3 THEN 'unknown' ELSE event_type END AS entity FROM events",
    "sentiment_set": "SELECT event_type || event_id AS text, CASE event_id % 4 WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' WHEN 2 THEN 'positive' END AS sentiment FROM events",
    "evidence_set": f"WITH r AS (SELECT *, list_filter(list_transform(gold_chunks, lambda c: c.text), lambda t: coalesce(t, '') <> '') AS g FROM ({_GROUPED_RAG}) WHERE coalesce(question, '') <> '' AND coalesce(answer, '') <> '') SELECT sample_id AS id, question, answer, sample_id || '-' || unnest(range(0, len(g))) AS chunk_id, unnest(g) AS text FROM r",
    "program_set": f"SELECT substr(concat_ws(' ', nullif(array_to_string(list_filter([question, repeat('long ', CAST(n % 900 AS INTEGER))], lambda x: x IS NOT NULL), ' '), ''), CASE WHEN n % 2 = 0 THEN nullif(coalesce(generated_answer, ''), '') END), 1, 4000) AS text, coalesce(question, '') AS question, 0 AS kpis, {_STEP.format(a=repr('/'), b=repr('-'))} AS operator, {_STEP.format(a='12.0::DOUBLE', b='1250.5::DOUBLE')} AS first, 3.0::DOUBLE AS expected FROM (SELECT *, sample_id AS n FROM ({_GROUPED_RAG})) WHERE n % 3 < 2",
    "label_alignment": "SELECT o_orderkey, '-100,' || array_to_string(list_transform(range(0, 2 * (o_orderkey % 5 + 1)), lambda i: CASE WHEN i % 2 = 1 THEN '-100' ELSE CAST((o_custkey + i // 2) % 3 AS VARCHAR) END), ',') || ',-100' AS labels FROM orders",
    "label_decoding": f"SELECT o_orderkey, [{', '.join(q.quote(n) for n in _NAMES)}][o_orderkey % 3 + 1] || ',' || [{', '.join(q.quote(n) for n in _NAMES)}][o_custkey % 3 + 1] AS tags FROM orders",
    "titled_passages": "SELECT p_partkey AS doc_id, trim(CASE WHEN p_partkey % 4 > 0 THEN p_name ELSE '' END || ' ' || p_type, ' ') AS passage FROM part",
    "relevant_sets": f"SELECT query_id, array_to_string(list_sort(list(DISTINCT doc_id)), ',') AS doc_ids FROM {_QRELS} WHERE score > 0 GROUP BY 1",
    "benchmark_log": "SELECT sequential, parallel, count(*) AS runs, round(max(sequential / parallel), 6) AS speedup FROM (SELECT (o_orderkey % 90 + 1.5)::DOUBLE AS sequential, CASE WHEN o_orderkey % 7 > 0 THEN (o_orderkey % 40 + 1.25)::DOUBLE END AS parallel FROM orders) GROUP BY 1, 2",
    "metric_deltas": "SELECT a.metric, a.value AS before, b.value AS after, round(b.value - a.value, 6) AS delta FROM (SELECT event_type AS metric, round(avg(value), 6) AS value FROM events WHERE user_id % 2 = 0 GROUP BY 1) a JOIN (SELECT event_type AS metric, round(avg(value), 6) AS value FROM events WHERE user_id % 2 = 1 GROUP BY 1) b ON a.metric = b.metric",
}

QUERIES = {name: globals()[name] for name in [*SQL, "rag_predictions"]}
