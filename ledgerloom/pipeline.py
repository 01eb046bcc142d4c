"""The whole analysis: documents and questions in, one nested report for each pair out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import chunking, entities, kpi, report, retrieval, sentiment, vectors
from ledgerloom.ports import Embedder, EntityTagger, FigureTagger, HashEmbedder, LanguageModel, SentimentModel
from ledgerloom.session import checkpointed
from ledgerloom.settings import DEFAULT, Settings


class AnalysisPipeline:
    """Every model is a port; without any, deterministic defaults are used.

    Figures (doc_id, ord, tag, value, score, text) that are given as ``tagged``, or that ``figures`` finds in the chunks,
    replace revenue found by patterns.
    """

    def __init__(
        self,
        embedder: Embedder | None = None,
        tagger: EntityTagger | None = None,
        sentiment_model: SentimentModel | None = None,
        llm: LanguageModel | None = None,
        settings: Settings = DEFAULT,
        figures: FigureTagger | None = None
    ):
        self.figures = figures
        self.embedder, self.tagger, self.model, self.llm, self.s = embedder or HashEmbedder(), tagger, sentiment_model, llm, settings

    def chunks(self, docs: DataFrame, sections: DataFrame | None = None) -> DataFrame:
        parts = chunking.chunk_documents(docs, sections).drop("sec_ord")
        return vectors.embed(parts.join(docs.select("doc_id", "ticker"), "doc_id"), embedder=self.embedder)

    def _search(self, index: DataFrame, asked: DataFrame, n: int) -> DataFrame:
        vectors_ = asked.withColumn("embedding", self.embedder.embed(retrieval.reformulate(F.col("query"), F.lit(n))))
        return vectors.search(
            index, vectors_, "chunk_id", "query_id", k=self.s.top_k, floor=self.s.similarity_floor, group="ticker"
        ).withColumnRenamed("query", "query_id")

    def _once(self, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The questions with ``_same``, and each different one (query_id, query, ticker) once, with ``_same`` as its id."""
        text = F.struct("query", "ticker")
        # every attempt starts from the questions again
        named = checkpointed(questions.withColumn("_same", F.sha2(F.to_json(text), 256)))
        once = named.groupBy(F.col("_same").alias("query_id")).agg(F.first("query").alias("query"), F.first("ticker").alias("ticker"))
        return named, once

    def _hits(self, index: DataFrame, asked: DataFrame, supplied: DataFrame | None, loop: bool) -> DataFrame:
        def attempt(left: DataFrame, n: int) -> DataFrame:
            if n or supplied is None:
                return self._search(index, left, n)
            given = supplied.select("query_id", "rank", "id", "similarity").join(left.select("query_id"), "query_id", "left_semi")
            return given.unionByName(
                self._search(index, left.join(supplied.select("query_id"), "query_id", "left_anti"), 0).select(given.columns)
            )

        return retrieval.requery(asked.select("query_id", "query", "ticker"), attempt, key="query_id", s=self.s, loop=loop)

    def retrieve(self, index: DataFrame, questions: DataFrame, supplied: DataFrame | None = None, loop: bool = True) -> DataFrame:
        """Hits (query_id, attempt, rank, id, similarity) of (query_id, query, ticker); by the re-query loop, or of one
        attempt without it.

        Questions that say the same of the same ticker are asked once. The first attempt takes the ``supplied`` hits
        (query_id, rank, id, similarity) of those questions that have any; later ones always search.
        """
        fields = ["query_id", "attempt", "rank", "id", "similarity"]
        if supplied is not None:
            return self._hits(index, checkpointed(questions.select("query_id", "query", "ticker")), supplied, loop).select(fields)
        named, once = self._once(questions.select("query_id", "query", "ticker"))
        hits = self._hits(index, once, None, loop).withColumnRenamed("query_id", "_same")
        return named.select("query_id", "_same").join(hits, "_same").select(fields)

    def _full(self, chunks: DataFrame, hits: DataFrame) -> DataFrame:
        """(query_id, hits, attempt, average): the hits of each question with their texts, in order."""
        full = hits.join(chunks.select(F.col("chunk_id").alias("id"), "text", "section", "chunk_type", "page_number"), "id")
        fields = F.struct("rank", F.col("id").alias("chunk_id"), "text", "section", "chunk_type", "page_number", "similarity")
        return full.groupBy("query_id").agg(
            F.array_sort(F.collect_list(fields)).alias("hits"),
            F.max("attempt").alias("attempt"),
            F.avg("similarity").alias("average")
        )

    def _said(self, chunks: DataFrame, asked: DataFrame, supplied: DataFrame | None, loop: bool) -> DataFrame:
        """(query_id, hits, attempt, average, reasoning, answer) of each question."""
        found = self._full(chunks, self._hits(chunks, asked, supplied, loop))
        empty = F.array().cast(found.schema["hits"].dataType)
        joined = asked.select("query_id", "query").join(found, "query_id", "left").withColumn("hits", F.coalesce("hits", empty))
        return retrieval.generate(joined, self.llm).drop("query")

    def answer(self, chunks: DataFrame, questions: DataFrame, supplied: DataFrame | None = None, loop: bool = False) -> DataFrame:
        """questions with hits, attempt, average, reasoning and answer: one search (``loop`` for the re-query loop) and the
        answer from what it finds. Equal questions about a ticker are asked and answered once, but for supplied hits."""
        if supplied is not None:
            asked = checkpointed(questions)
            return asked.join(self._said(chunks, asked, supplied, loop), "query_id")
        named, once = self._once(questions)
        said = self._said(chunks, once, None, loop).withColumnRenamed("query_id", "_same")
        return named.join(said, "_same").drop("_same")

    def analyze(
        self, docs: DataFrame, questions: DataFrame, sections: DataFrame | None = None, tagged: DataFrame | None = None
    ) -> DataFrame:
        """docs (doc_id, ticker, doc_type, fiscal_period, cleaned_text), questions (doc_id, query_id, query, ticker)."""
        s = self.s
        chunks = checkpointed(self.chunks(docs, sections))  # read by every attempt of the search and by the sentiment
        named, once = self._once(questions)
        # what the report shows of the hits, before it is joined to every filing
        said = self._said(chunks, once, None, True).select(
            F.col("query_id").alias("_same"),
            F.struct(
                F.size("hits").alias("chunks_retrieved"),
                F.coalesce("average", F.lit(0.0)).alias("average_similarity"),
                F.coalesce("attempt", F.lit(s.max_retries)).alias("retries_performed"),
                report.format_chunks(F.col("hits")).alias("chunks"),
            ).alias("retrieval"),
            "reasoning",
            "answer",
        )
        asked = named.join(said, "_same").drop("_same")

        ents = entities.extract_entities(docs, "doc_id", "cleaned_text", self.tagger)
        per_doc = entities.entity_summary(entities.entity_type_counts(ents, "doc_id"), "doc_id")
        if tagged is None and self.figures is not None:
            tagged = entities.tag_figures(chunks, "doc_id", ["section", "ord"], "text", self.figures)
        figures = kpi.extract_kpis(docs, "doc_id", "cleaned_text")
        if tagged is not None:
            figures = kpi.override_revenue(figures, tagged, "doc_id")
        totals = kpi.kpi_summary(figures, "doc_id")
        feeling = sentiment.document_sentiment(
            docs, "doc_id", "cleaned_text", self.model, s
        ).withColumnRenamed("score", "sentiment_score")
        shares = sentiment.sentiment_distribution(
            sentiment.chunk_sentiment(chunks, ["doc_id", "chunk_id"], "text", self.model, s), "doc_id"
        )
        calls = sentiment.tone(docs.where("doc_type = 'earnings_call'"), "doc_id", "cleaned_text", self.model, s)
        joined = asked.join(docs.select("doc_id", "doc_type", "fiscal_period"), "doc_id")
        for part in (per_doc, totals, feeling, shares, calls):
            joined = joined.join(part, "doc_id", "left")
        zero = lambda c: F.coalesce(c, F.lit(0))
        return joined.select(
            "doc_id", "query_id",
            F.struct(
                F.coalesce("ticker", F.lit("unknown")).alias("ticker"), "doc_type", "fiscal_period", "query"
            ).alias("metadata"),
            "retrieval",
            F.struct(
                zero(F.col("entities")).alias("total_entities"), F.col("type_counts").alias("entity_types")
            ).alias("named_entities"),
            F.struct(
                F.col("label").alias("overall_sentiment"),
                F.col("sentiment_score").alias("confidence_score"),
                F.struct("positive", "neutral", "negative").alias("sentiment_distribution"),
                "is_positive",
                "tone_progression"
            ).alias("sentiment_analysis"),
            F.struct(
                zero(F.col("total_kpis")).alias("total_kpis"),
                zero(F.col("kpi_count")).alias("kpi_count"),
                zero(F.col("calculated")).alias("calculated_kpis")
            ).alias("financial_metrics"),
            F.struct(F.col("reasoning").alias("chain_of_thought"), F.col("answer").alias("final_answer")).alias("reasoning"),
            report.findings(
                F.col("label"), F.col("top_type"), F.col("top_count"), F.col("kpi_count"), F.col("tone_progression")
            ).alias("key_findings"),
            report.summary(
                F.col("entities"),
                F.col("entity_types"),
                F.col("label"),
                F.col("sentiment_score"),
                F.col("total_kpis"),
                F.col("kpi_count"),
                F.col("calculated"),
                F.col("answer")
            ).alias("summary"),
        )
