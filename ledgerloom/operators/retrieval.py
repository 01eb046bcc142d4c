"""Question answering over retrieved chunks: reformulation, the bounded re-query loop, context and answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.ports import LanguageModel
from ledgerloom.session import checkpointed
from ledgerloom.settings import DEFAULT, Settings

# Words that frame a question, and texts for missing evidence.
QUESTION_WORDS = "what which who whom whose when where why how is are was were be been being do does did the a an of for in on to and or".split()
NO_CHUNKS_REASONING = "No relevant chunks found in document."
NO_CHUNKS_ANSWER = "Unable to answer based on available documents."


def reformulate(query: Column, attempt: Column) -> Column:
    """The query itself, then a request for detail, then its content words (the query where none are left)."""
    plain = F.split(F.trim(F.regexp_replace(F.replace(query, F.lit("?"), F.lit("")), r"\s+", " ")), " ")
    kept = F.array_join(F.filter(plain, lambda w: ~F.lower(w).isin(*QUESTION_WORDS)), " ")
    return F.when(attempt <= 0, query).when(attempt == 1, F.concat(F.lit("Provide detailed information about: "), query)).otherwise(
        F.coalesce(F.nullif(kept, F.lit("")), query)
    )


def routing(n: Column, average: Column, retries: Column, s: Settings = DEFAULT) -> Column:
    """Whether to search again."""
    return ((n < s.min_chunks) | (average < s.routing_similarity)) & (retries < s.max_retries)


def requery(
    queries: DataFrame, search: Callable[[DataFrame, int], DataFrame], key: str = "query", s: Settings = DEFAULT, loop: bool = True
) -> DataFrame:
    """(key, attempt, rank, id, similarity): the hits of the last attempt made for each query; of the first without ``loop``.

    ``search(queries, attempt)`` gives the hits of an attempt. Only queries whose hits are too few or too weak are
    searched again, at most ``max_retries`` times; the last attempt's hits count even where they are worse. Each
    attempt's hits are checkpointed, as they decide about the next.
    """
    left, out = queries, None
    for attempt in range(s.max_retries + 1 if loop else 1):
        hits = checkpointed(search(left, attempt))
        if not loop:
            return hits.withColumn("attempt", F.lit(0))
        stats = left.select(key).distinct().join(
            hits.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg("similarity").alias("a")), key, "left"
        )
        again = stats.where(routing(F.coalesce("n", F.lit(0)), F.coalesce("a", F.lit(0.0)), F.lit(attempt), s)).select(key)
        kept = hits.join(again, key, "left_anti").withColumn("attempt", F.lit(attempt))
        out = kept if out is None else out.unionByName(kept)
        left = left.join(again, key, "left_semi")
    return out


def build_context(hits: Column) -> Column:
    """Hits (text, section, similarity) as a prompt's context."""
    part = lambda h, i: F.concat(
        F.lit("[Chunk "),
        (i + 1).cast("string"),
        F.lit("] ("),
        F.coalesce(h["section"], F.lit("general")),
        F.lit(", similarity: "),
        F.format_string("%.3f", F.coalesce(h["similarity"], F.lit(0.0))),
        F.lit(")\n"),
        F.substring(h["text"], 1, 500),
        F.lit("...\n")
    )
    return F.array_join(F.transform(hits, part), "\n")


def build_reasoning(query: Column, hits: Column) -> Column:
    line = lambda h, i: F.concat(
        (i + 1).cast("string"),
        F.lit(". Section discusses: "),
        F.substring(h["text"], 1, 100),
        F.lit("... (relevance: "),
        F.format_string("%.2f", F.coalesce(h["similarity"], F.lit(0.0)) * 100),
        F.lit("%)\n")
    )
    head = F.concat(
        F.lit("Question: "), query, F.lit("\n\nAnalyzing "), F.size(hits).cast("string"), F.lit(" relevant document sections:\n")
    )
    return F.when(F.size(hits) > 0, F.concat(head, F.array_join(F.transform(hits, line), ""))).otherwise(NO_CHUNKS_REASONING)


def extractive_answer(hits: Column) -> Column:
    """The first 200 characters of every hit, cut at 500."""
    text = F.array_join(F.transform(hits, lambda h: F.substring(h["text"], 1, 200)), " ")
    return F.when(
        F.size(hits) > 0, F.when(F.length(text) > 500, F.concat(F.substring(text, 1, 500), F.lit("..."))).otherwise(text)
    ).otherwise(NO_CHUNKS_ANSWER)


def parse_response(response: Column) -> Column:
    """(reasoning, answer) of a model's response; without both headings all of it is the answer."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    parts = F.split(response, "ANSWER:")
    both = response.contains("REASONING:") & response.contains("ANSWER:")
    return F.struct(
        F.when(both, strip(F.replace(parts[0], F.lit("REASONING:"), F.lit("")))).otherwise("").alias("reasoning"),
        F.when(both, strip(F.try_element_at(parts, F.lit(2)))).otherwise(response).alias("answer"),
    )


def generate(questions: DataFrame, llm: LanguageModel | None = None) -> DataFrame:
    """Adds reasoning and answer to (query, hits); a model that fails (null) leaves the extractive answer."""
    out = questions.withColumn("reasoning", build_reasoning(F.col("query"), F.col("hits"))).withColumn(
        "answer", extractive_answer(F.col("hits"))
    )
    if llm is None:
        return out
    prompt = F.concat(F.lit("Context:\n"), build_context(F.col("hits")), F.lit("\n\nQuestion: "), F.col("query"))
    said = out.withColumn("_m", parse_response(llm.complete(prompt)))
    has = F.col("_m.answer").isNotNull() & (F.size("hits") > 0)
    return said.withColumn("reasoning", F.when(has, F.col("_m.reasoning")).otherwise(F.col("reasoning"))).withColumn(
        "answer", F.when(has, F.col("_m.answer")).otherwise(F.col("answer"))
    ).drop("_m")
