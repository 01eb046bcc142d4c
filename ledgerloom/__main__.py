"""Command line: ``python -m ledgerloom analyze`` and ``python -m ledgerloom evaluate``, also as a spark-submit main."""

from __future__ import annotations

import argparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import clean_text
from ledgerloom.metrics import evaluators as ev
from ledgerloom.operators import entities, kpi, preparation, vectors
from ledgerloom.operators.chunking import sec_sections
from ledgerloom.pipeline import AnalysisPipeline
from ledgerloom.ports import FigureTagger, LexiconSentiment, RuleTagger
from ledgerloom.session import checkpointed, open_session
from ledgerloom.sources.documents import alias, read_documents, read_eval_set
from ledgerloom.sources.sinks import write_metrics, write_reports

_CHUNKS = "array<struct<chunk_id:string,text:string>>"
_ENTITIES = "array<struct<word:string,text:string,entity:string,entity_group:string,label:string>>"


def analyze(spark: SparkSession, path: str, query: str, output: str) -> DataFrame:
    """Reads, cleans, sections and analyses every document under ``path`` for one question; returns the rejects."""
    raw, rejects = read_documents(spark, path)
    docs = raw.withColumn("cleaned_text", clean_text(F.col("raw_text")))
    asked = docs.select("doc_id", F.col("doc_id").alias("query_id"), F.lit(query).alias("query"), "ticker")
    sections = sec_sections(docs.where("format = 'html'"))
    write_reports(AnalysisPipeline().analyze(docs, asked, sections), output)
    return rejects


def _entities(column: Column) -> Column:
    """Entities with their several spellings of word and type."""
    live = F.coalesce(F.from_json(column, _ENTITIES), F.from_json(F.lit("[]"), _ENTITIES))
    return F.transform(
        live,
        lambda e: F.struct(
            F.coalesce(e["word"], e["text"]).alias("word"),
            F.coalesce(e["entity"], e["entity_group"], e["label"], F.lit("unknown")).alias("entity")
        )
    )


def evaluate(samples: DataFrame, kind: str, predict: bool = False, figures: FigureTagger | None = None) -> DataFrame:
    """Metrics of an evaluation set (sample_id, sample); ``predict`` fills the predictions with the default operators.

    For answers these search the set's own gold passages; tags of figures come from ``figures``, and are all O without.
    """
    s = F.col("sample")
    text = alias(s, "text")
    if kind == "ner":
        guess = RuleTagger().tag(text) if predict else None
        predicted = F.transform(
            guess, lambda e: F.struct(e["word"].alias("word"), e["entity_group"].alias("entity"))
        ) if predict else _entities(alias(s, "predictions"))
        rows = lambda c: samples.select("sample_id", F.explode(c).alias("e")).select("sample_id", "e.*")
        return ev.entity_scores(rows(predicted), rows(_entities(alias(s, "references", "entities"))))
    if kind == "sentiment":
        guess = LexiconSentiment().classify(text)["label"] if predict else alias(
            s, "prediction", "predicted_sentiment", "predicted"
        )
        rows = samples.select(
            ev.canonical_label(alias(s, "sentiment", "label")).alias("reference"), ev.canonical_label(guess).alias("predicted")
        )
        return ev.class_summary(ev.class_scores(rows))
    if kind == "kpi":
        numbers = lambda *names: F.from_json(alias(s, *names), "map<string,double>")
        rows = samples.select(
            "sample_id",
            numbers("reference_kpis", "gold_kpis").alias("r"),
            numbers("extracted_kpis", "predicted_kpis", "predictions").alias("e")
        )
        if predict:
            found = kpi.extract_kpis(samples.select("sample_id", text.alias("text")), "sample_id", "text")
            first = found.groupBy("sample_id", "kpi_type").agg(F.min_by("value", "ord").alias("value"))
            maps = first.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("kpi_type", "value"))).alias("e"))
            rows = rows.drop("e").join(maps, "sample_id", "left")
        return ev.macro(
            ev.kpi_scores(rows, "sample_id", "r", "e"),
            ["numeric_accuracy", "extraction_recall", "type_coverage", "mean_absolute_error", "rmse"]
        )
    if kind == "rag":
        chunks = lambda *names: F.coalesce(
            F.from_json(alias(s, *names), _CHUNKS),
            F.transform(
                F.from_json(alias(s, *names), "array<string>"),
                lambda t: F.struct(F.lit(None).cast("string").alias("chunk_id"), t.alias("text"))
            )
        )
        rows = samples.select(
            "sample_id",
            chunks("retrieved_chunks", "retrieved").alias("r"),
            chunks("gold_chunks", "gold", "evidence").alias("g"),
            alias(s, "generated_answer").alias("a"),
            alias(s, "answer", "reference_answer").alias("w"),
            alias(s, "question", "query").alias("question")
        )
        if predict:
            corpus = checkpointed(vectors.embed(preparation.corpus_passages(rows, "sample_id", "g")))
            said = preparation.predict_answers(rows, corpus)
            rows = rows.drop("r", "a").join(
                said.select("sample_id", F.col("retrieved_chunks").alias("r"), F.col("generated_answer").alias("a")), "sample_id"
            )
        both = ev.retrieval_scores(rows, "sample_id", "r", "g").join(ev.generation_scores(rows, "sample_id", "a", "w"), "sample_id")
        return ev.macro(both, ["hit_rate_top1", "hit_rate_top5", "mrr", "ndcg", "exact_match", "rouge_l", "bleu"])
    if kind == "finer":
        tags = lambda name: F.from_json(alias(s, name), "array<string>")
        spans = lambda c: ev.tag_spans(samples.select("sample_id", F.posexplode(c).alias("i", "tag")), "sample_id", "i", "tag")
        none = F.transform(tags("tags"), lambda t: F.lit("O"))
        if not predict:
            return ev.tagging_scores(spans(F.coalesce(tags("predicted_tags"), none)), spans(tags("tags")), "sample_id")
        if figures is None:
            return ev.tagging_scores(spans(none), spans(tags("tags")), "sample_id")
        found = samples.select("sample_id", tags("tokens").alias("tokens")).withColumn(
            "found", entities.reshape_spans(figures.tag(F.array_join("tokens", " ")))
        )
        told = ev.spans_to_tags(found, "sample_id", "tokens", "found")
        return ev.tagging_scores(ev.tag_spans(told, "sample_id", "i", "tag"), spans(tags("tags")), "sample_id")
    raise ValueError(f"unknown kind of evaluation: {kind}")


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="ledgerloom")
    commands = p.add_subparsers(dest="command", required=True)
    a = commands.add_parser("analyze")
    a.add_argument("--documents", required=True)
    a.add_argument("--query", required=True)
    a.add_argument("--output", required=True)
    e = commands.add_parser("evaluate")
    e.add_argument("--kind", required=True, choices=("ner", "sentiment", "kpi", "rag", "finer"))
    e.add_argument("--test-set", required=True)
    e.add_argument("--limit", type=int)
    e.add_argument("--predict", action="store_true")
    e.add_argument("--benchmark", action="store_true", help="show published results as well")
    e.add_argument("--output")
    o = p.parse_args(args)
    spark = open_session()
    if o.command == "analyze":
        analyze(spark, o.documents, o.query, o.output).show(truncate=False)
        return
    scores = evaluate(read_eval_set(spark, o.test_set, o.limit), o.kind, o.predict)
    scores.show(truncate=False)
    if o.benchmark:
        ev.published(spark).show(truncate=False)
    if o.output:
        write_metrics(scores, o.output)


if __name__ == "__main__":
    main()
