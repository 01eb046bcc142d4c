"""Named entities and tagged figures: tagging by slices, counts by type and tag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.chunking import char_slices
from ledgerloom.functions.text import parse_number
from ledgerloom.ports import EntityTagger, FigureTagger, RuleTagger


def extract_entities(docs: DataFrame, key: str, text: str, tagger: EntityTagger | None = None) -> DataFrame:
    """(key, ord, word, entity_group, start, end, score); places count within the slice that the tagger saw."""
    tagger = tagger or RuleTagger()
    rows = char_slices(docs, [key], text).select(key, "slice", F.posexplode(tagger.tag(F.col("text"))).alias("_i", "_e"))
    return rows.select(key, (F.col("slice").cast("long") * 1_000_000 + F.col("_i")).alias("ord"), "_e.*")


def entity_type_counts(entities: DataFrame, key: str) -> DataFrame:
    """(key, entity_group, n, first_ord)."""
    return entities.groupBy(key, F.coalesce("entity_group", F.lit("unknown")).alias("entity_group")).agg(
        F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord")
    )


def top_entity_type(counts: DataFrame, key: str) -> DataFrame:
    """(key, entity_group, n): the most frequent type, of equals the one seen first."""
    best = F.max_by(F.struct("entity_group", "n"), F.struct(F.col("n"), -F.col("first_ord")))
    return counts.groupBy(key).agg(best.alias("_b")).select(key, "_b.*")


def entity_summary(counts: DataFrame, key: str) -> DataFrame:
    """(key, entities, entity_types, type_counts, top_type, top_count): what a report says of the counts by type."""
    best = F.max_by(F.struct("entity_group", "n"), F.struct(F.col("n"), -F.col("first_ord")))
    found = counts.groupBy(key).agg(
        F.sum("n").alias("entities"),
        F.count(F.lit(1)).alias("entity_types"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity_group", "n")))).alias("type_counts"),
        best.alias("_b"),
    )
    return found.select(
        key, "entities", "entity_types", "type_counts", F.col("_b.entity_group").alias("top_type"), F.col("_b.n").alias("top_count")
    )


def tag_counts(figures: DataFrame, key: str, sample: int = 15) -> DataFrame:
    """(key, total_tagged, tag_counts, sample): counts by tag and the first figures in order."""
    by_tag = figures.groupBy(key, F.coalesce("tag", F.lit("unknown")).alias("tag")).agg(F.count(F.lit(1)).alias("n"))
    tags = by_tag.groupBy(key).agg(
        F.sum("n").alias("total_tagged"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", "n")))).alias("tag_counts")
    )
    first = figures.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy("ord"))).where(F.col("_i") <= sample)
    lists = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "text", "tag", "value"))).alias("sample"))
    return tags.join(lists, key)


def reshape_spans(spans: Column) -> Column:
    """Spans of a tagger as figures (text, tag, value, score, start, end); a span without type is unknown, without score 0."""
    return F.transform(
        spans,
        lambda s: F.struct(
            F.coalesce(s["word"], F.lit("")).alias("text"), F.coalesce(
                s["entity_group"], F.lit("unknown")
            ).alias("tag"), parse_number(s["word"]).alias("value"),
            F.coalesce(s["score"].cast("double"), F.lit(0.0)).alias("score"), s["start"].alias("start"), s["end"].alias("end"),
        ),
    )


FIGURES = "ord bigint, text string, tag string, value double, score double, start int, end int"


def tag_figures(chunks: DataFrame, key: str, order: list[str], text: str, tagger: FigureTagger | None = None) -> DataFrame:
    """(key, ord, text, tag, value, score, start, end): the tagged figures of the chunks that aren't blank, in order.

    Without a tagger, and where it fails, there are none.
    """
    if tagger is None:
        kind = chunks.select(key).schema[0].dataType.simpleString()
        return chunks.sparkSession.createDataFrame([], f"{key} {kind}, {FIGURES}")
    live = chunks.where(F.trim(text) != "").select(
        key, *order, F.posexplode(reshape_spans(tagger.tag(F.col(text)))).alias("_i", "_f")
    )
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order, "_i")) - 1
    f = F.col("_f")
    return live.select(
        key,
        place.cast("long").alias("ord"),
        f["text"].alias("text"),
        f["tag"].alias("tag"),
        f["value"].cast("double").alias("value"),
        f["score"].alias("score"),
        f["start"].cast("int").alias("start"),
        f["end"].cast("int").alias("end")
    )
