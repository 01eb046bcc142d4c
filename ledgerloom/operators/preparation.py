"""Preparation of evaluation and training sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.metrics.evaluators import parse_program
from ledgerloom.operators.vectors import VectorIndex
from ledgerloom.pipeline import AnalysisPipeline

SENTIMENT_IDS = {0: "negative", 1: "neutral", 2: "positive"}


def sentiment_samples(rows: DataFrame, text: str = "sentence", label: str = "label") -> DataFrame:
    """(text, sentiment) from numbered labels; other numbers give null."""
    names = F.coalesce(*[F.when(F.col(label) == k, F.lit(v)) for k, v in SENTIMENT_IDS.items()])
    return rows.select(F.col(text).alias("text"), names.alias("sentiment"))


def evidence_samples(rows: DataFrame, ident: str, question: str, answer: str, evidence: str) -> DataFrame:
    """(id, question, answer, gold_chunks) of rows that have all three; chunk ids are the row's id and the place."""
    texts = F.filter(evidence, lambda t: F.coalesce(t, F.lit("")) != "")
    gold = F.transform(
        texts,
        lambda t, i: F.struct(F.concat_ws("-", F.col(ident).cast("string"), i.cast("string")).alias("chunk_id"), t.alias("text"))
    )
    ok = (F.coalesce(question, F.lit("")) != "") & (F.coalesce(answer, F.lit("")) != "") & (F.size(texts) > 0)
    return rows.where(ok).select(
        F.col(ident).alias("id"), F.col(question).alias("question"), F.col(answer).alias("answer"), gold.alias("gold_chunks")
    )


def program_samples(rows: DataFrame, ident: str, program: str, answer: str) -> DataFrame:
    """(id, operator, operands, expected) of the programs of one operation; others are dropped."""
    return rows.select(
        F.col(ident).alias("id"), parse_program(F.col(program), F.col(answer)).alias("p")
    ).where("p is not null").select("id", "p.*")


def finqa_samples(rows: DataFrame, keep: int = 4000) -> DataFrame:
    """(text, question, reference_kpis, calculation_steps) of rows (pre_text, post_text, question, program, answer).

    Only programs of one operation count. The text is what stands before and after the table, its first ``keep``
    characters; there are no reference figures.
    """
    side = lambda c: F.nullif(F.array_join(c, " "), F.lit(""))
    text = F.substring(F.concat_ws(" ", side(F.col("pre_text")), side(F.col("post_text"))), 1, keep)
    step = parse_program(F.col("program"), F.col("answer"))
    found = rows.select(
        text.alias("text"), F.coalesce("question", F.lit("")).alias("question"), step.alias("_p")
    ).where("_p is not null")
    steps = F.array(
        F.struct(
            F.col("_p.operands").alias("operands"),
            F.col("_p.operator").alias("operator"),
            F.col("_p.expected").alias("expected_result")
        )
    )
    return found.select(
        "text", "question", F.create_map().cast("map<string,double>").alias("reference_kpis"), steps.alias("calculation_steps")
    )


def _rows(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files, or JSON lines and JSON arrays by their suffix."""
    if path.endswith((".json", ".jsonl")):
        return spark.read.option("multiLine", path.endswith(".json")).json(path)
    return spark.read.parquet(path)


def _has(rows: DataFrame, *names: str) -> str | None:
    return next((n for n in names if n in rows.columns), None)


def _either(rows: DataFrame, *names: str):
    """The first of the columns that is there and isn't empty."""
    found = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in rows.columns]
    return F.coalesce(*found, F.lit(None).cast("string"))


def read_sentiment_set(spark: SparkSession, path: str) -> DataFrame:
    """(text, sentiment) of a file with sentence and label."""
    return sentiment_samples(_rows(spark, path))


def read_evidence_set(spark: SparkSession, path: str) -> DataFrame:
    """(id, question, answer, gold_chunks) of a file with question, answer and evidence (texts, or objects with evidence_text)."""
    rows = _rows(spark, path)
    kind = rows.schema["evidence"].dataType.simpleString()
    texts = F.transform("evidence", lambda e: e["evidence_text"]) if "struct" in kind else F.col("evidence").cast("array<string>")
    ident = _has(rows, "financebench_id", "id")
    named = rows.withColumn("_id", F.col(ident) if ident else F.md5(F.concat_ws("|", "question", "answer"))).withColumn("_e", texts)
    return evidence_samples(named, "_id", "question", "answer", "_e")


def read_program_set(spark: SparkSession, path: str) -> DataFrame:
    """Samples of a file with pre_text, post_text, question, program_re or program, and answer or final_result."""
    rows = _rows(spark, path)
    part = lambda n: F.col(n).cast("array<string>") if n in rows.columns else F.array().cast("array<string>")
    return finqa_samples(
        rows.select(
            part("pre_text").alias("pre_text"),
            part("post_text").alias("post_text"),
            _either(rows, "question").alias("question"),
            _either(rows, "program_re", "program").alias("program"),
            _either(rows, "answer", "final_result").alias("answer")
        )
    )


def read_retrieval_set(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """corpus (doc_id, passage), queries (query_id, query) and qrels (query_id, doc_id, score) of a folder with three tables."""
    corpus, queries, qrels = (_rows(spark, f"{folder}/{n}.parquet") for n in ("corpus", "queries", "qrels"))
    ident = lambda df: _has(df, "_id", "id")
    return (
        titled_passages(corpus, ident(corpus), "title", "text"),
        queries.select(F.col(ident(queries)).cast("string").alias("query_id"), F.col("text").alias("query")),
        qrels.select(
            F.col("query-id").cast("string").alias("query_id"),
            F.col("corpus-id").cast("string").alias("doc_id"),
            F.col("score").cast("double").alias("score")
        ),
    )


def read_tagging_set(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """(tokens, tags) of a file with tokens and numbered tags."""
    rows = _rows(spark, path).withColumn("_key", F.monotonically_increasing_id())
    tags = decode_labels(rows, "_key", "ner_tags", names)
    return rows.select("_key", "tokens").join(tags, "_key").drop("_key")


def index_corpus(
    index: VectorIndex, samples: DataFrame, key: str = "sample_id", chunks: str = "gold_chunks", ticker: str = "eval"
) -> None:
    """Puts the distinct gold passages of an evaluation set into a collection of their own."""
    rows = corpus_passages(samples, key, chunks)
    index.upsert(
        rows.select(
            "chunk_id",
            "text",
            F.lit(ticker).alias("ticker"),
            F.lit("general").alias("chunk_type"),
            F.lit(None).cast("int").alias("page_number")
        )
    )


def predict_answers(
    samples: DataFrame,
    corpus: DataFrame,
    pipeline: AnalysisPipeline | None = None,
    key: str = "sample_id",
    question: str = "question",
    loop: bool = False
) -> DataFrame:
    """(key, retrieved_chunks, generated_answer) of every sample, from a corpus (chunk_id, text, embedding).

    A sample without a question gets no chunks and an empty answer.
    """
    line = pipeline or AnalysisPipeline()
    chunks = corpus.select(
        "chunk_id",
        "text",
        F.lit(None).cast("string").alias("ticker"),
        F.lit(None).cast("string").alias("section"),
        F.lit("general").alias("chunk_type"),
        F.lit(-1).alias("page_number"),
        "embedding"
    )
    asked = samples.select(
        F.col(key).alias("query_id"), F.coalesce(question, F.lit("")).alias("query"), F.lit(None).cast("string").alias("ticker")
    )
    said = line.answer(chunks, asked.where("query <> ''"), loop=loop)
    got = said.select(
        "query_id",
        F.transform("hits", lambda h: F.struct(h["chunk_id"].alias("chunk_id"), h["text"].alias("text"))).alias("retrieved_chunks"),
        F.col("answer").alias("generated_answer")
    )
    empty = F.array().cast(got.schema["retrieved_chunks"].dataType)
    rows = asked.select("query_id").join(got, "query_id", "left")
    return rows.select(
        F.col("query_id").alias(key),
        F.coalesce("retrieved_chunks", empty).alias("retrieved_chunks"),
        F.coalesce("generated_answer", F.lit("")).alias("generated_answer")
    )


def corpus_passages(samples: DataFrame, key: str, chunks: str) -> DataFrame:
    """(chunk_id, text): the first passage of each chunk id in order of sample and place.

    A passage without id gets one from its text, so that it doesn't depend on how many came before.
    """
    rows = samples.select(key, F.posexplode(chunks).alias("i", "c")).where("c.text is not null")
    ident = F.coalesce(F.nullif("c.chunk_id", F.lit("")), F.concat(F.lit("chunk-"), F.md5("c.text")))
    return rows.groupBy(ident.alias("chunk_id")).agg(F.min_by("c.text", F.struct(key, "i")).alias("text"))


def training_pairs(qrels: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, doc_id, query, passage) of the positive judgements whose query and passage exist."""
    return qrels.where("score > 0").select("query_id", "doc_id").join(queries, "query_id").join(corpus, "doc_id")


def seeded_order(ident: str, seed: int = 42):
    """A fixed pseudo-random order that other engines can repeat."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(ident).cast("string")))


def sample_corpus(corpus: DataFrame, needed: DataFrame, distractors: int, ident: str = "doc_id", seed: int = 42) -> DataFrame:
    """All needed passages and a seeded sample of others."""
    keep = corpus.join(needed.select(ident).distinct(), ident, "left_semi").withColumn("needed", F.lit(True))
    rest = corpus.join(needed.select(ident), ident, "left_anti").orderBy(seeded_order(ident, seed), ident).limit(distractors)
    return keep.unionByName(rest.withColumn("needed", F.lit(False)))


def align_labels(rows: DataFrame, key: str, word_ids: str, tags: str) -> DataFrame:
    """(key, labels): the tag of a word at its first sub-word, -100 at the others and at special tokens."""
    return rows.select(
        key,
        F.transform(
            word_ids,
            lambda w, i: F.when(
                w.isNull() | (F.coalesce(F.try_element_at(F.col(word_ids), i), F.lit(-1)) == w) & (i > 0), -100
            ).otherwise(F.try_element_at(F.col(tags), w + 1))
        ).alias("labels")
    )


def decode_labels(rows: DataFrame, key: str, ids: str, names: list[str]) -> DataFrame:
    """(key, tags): label names of the ids, ignored places left out."""
    table = F.array(*[F.lit(n) for n in names])
    return rows.select(key, F.transform(F.filter(ids, lambda i: i != -100), lambda i: F.try_element_at(table, i + 1)).alias("tags"))


def titled_passages(corpus: DataFrame, ident: str, title: str, text: str) -> DataFrame:
    """(doc_id, passage): title and text with a space between, trimmed."""
    return corpus.select(F.col(ident).alias("doc_id"), F.trim(F.concat_ws(" ", title, text)).alias("passage"))


def relevant_sets(qrels: DataFrame) -> DataFrame:
    """(query_id, doc_ids) of the positive judgements."""
    return qrels.where("score > 0").groupBy("query_id").agg(F.collect_set("doc_id").alias("doc_ids"))


def benchmark_log(logs: DataFrame, text: str) -> DataFrame:
    """(sequential, parallel, speedup) from a benchmark's log lines; null where a line is missing."""
    seconds = lambda name: F.regexp_extract(text, rf"(?i){name}\s*\(median\):\s*([0-9.]+)\s*s", 1).try_cast("double")
    return logs.select(seconds("sequential").alias("sequential"), seconds("parallel").alias("parallel")).withColumn(
        "speedup", F.try_divide("sequential", "parallel")
    )
