"""Sentiment of documents and chunks, distribution over chunks, tone of transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.ports import LexiconSentiment, SentimentModel
from ledgerloom.settings import DEFAULT, Settings


def _sign(label: Column) -> Column:
    return F.when(label == "positive", 1.0).when(label == "negative", -1.0).otherwise(0.0)


def document_sentiment(
    docs: DataFrame, key: str, text: str, model: SentimentModel | None = None, s: Settings = DEFAULT
) -> DataFrame:
    """(key, label, score, is_positive): mean signed confidence of the first sentences; blank and null texts are neutral.

    A sentence is what stands between points, so decimals are cut too.
    """
    model = model or LexiconSentiment()
    sentences = F.filter(
        F.slice(F.split(F.coalesce(text, F.lit("")), r"\."), 1, s.sentence_limit),
        lambda x: F.length(F.trim(x)) >= s.min_sentence_chars
    )
    rows = docs.select(key, F.explode_outer(F.transform(sentences, lambda x: F.substring(x, 1, s.sentence_chars))).alias("_s"))
    judged = rows.select(key, F.when(F.col("_s").isNotNull(), model.classify(F.col("_s"))).alias("_m"))
    score = F.coalesce(F.avg(F.when(F.col("_m").isNotNull(), _sign(F.col("_m.label")) * F.col("_m.confidence"))), F.lit(0.0))
    out = judged.groupBy(key).agg(score.alias("score"))
    label = F.when(F.col("score") > s.label_threshold, "positive").when(
        F.col("score") < -s.label_threshold, "negative"
    ).otherwise("neutral")
    return out.select(key, label.alias("label"), "score", (F.col("score") > s.positive_threshold).alias("is_positive"))


def chunk_sentiment(
    chunks: DataFrame, keys: list[str], text: str, model: SentimentModel | None = None, s: Settings = DEFAULT
) -> DataFrame:
    """(keys, label, score, confidence) of every chunk of at least five characters."""
    model = model or LexiconSentiment()
    rows = chunks.where(F.length(F.trim(text)) >= s.min_sentence_chars).select(
        *keys, model.classify(F.substring(text, 1, s.sentence_chars)).alias("_m")
    )
    return rows.select(*keys, "_m.label", (_sign(F.col("_m.label")) * F.col("_m.confidence")).alias("score"), "_m.confidence")


def sentiment_distribution(judged: DataFrame, key: str) -> DataFrame:
    """(key, positive, neutral, negative): shares of the labels."""
    return judged.groupBy(key).agg(
        *[F.avg(F.when(F.col("label") == x, 1.0).otherwise(0.0)).alias(x) for x in ("positive", "neutral", "negative")]
    )


def tone(
    docs: DataFrame, key: str, text: str, model: SentimentModel | None = None, s: Settings = DEFAULT, n: int = 10
) -> DataFrame:
    """Opening and closing tone (the first and last ten sentences); scores are 1, 0 or -1, confidence doesn't count."""
    model = model or LexiconSentiment()
    parts = F.split(F.col(text), r"\.")
    tail = F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), F.lit(n))
    cut = lambda a: F.substring(F.array_join(a, " "), 1, s.sentence_chars)
    rows = docs.where(F.trim(text) != "").select(
        key, model.classify(cut(F.slice(parts, 1, n))).alias("_o"), model.classify(cut(tail)).alias("_c")
    )
    return rows.select(
        key, F.initcap("_o.label").alias("opening_tone"), _sign(
            F.col("_o.label")
        ).alias("opening_score"), F.initcap("_c.label").alias("closing_tone"),
        _sign(F.col("_c.label")).alias("closing_score"), (
            _sign(F.col("_c.label")) - _sign(F.col("_o.label"))
        ).alias("tone_progression"),
    )
