"""Findings, summary and the nested report of one document and question."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def findings(sentiment: Column, top_type: Column, top_count: Column, kpi_types: Column, tone_progression: Column) -> Column:
    """Sentences for a reader, in a fixed order; what is missing is left out."""
    return F.array_compact(
        F.array(
            F.concat(
                F.lit("Document exhibits a "),
                F.when(sentiment.isin("positive", "negative"), sentiment).otherwise("neutral"),
                F.lit(" sentiment overall")
            ),
            F.when(
                top_type.isNotNull(),
                F.concat(
                    F.lit("Most common entity type: "), top_type, F.lit(" ("), top_count.cast("string"), F.lit(" occurrences)")
                )
            ),
            F.when(kpi_types > 0, F.concat(F.lit("Identified "), kpi_types.cast("string"), F.lit(" types of KPIs in document"))),
            F.when(tone_progression > 0, F.lit("Management tone becomes more positive from opening to closing")).when(
                tone_progression < 0, F.lit("Management tone becomes more negative from opening to closing")
            ),
        )
    )


def summary(
    entities: Column,
    entity_types: Column,
    sentiment: Column,
    score: Column,
    total_kpis: Column,
    kpi_types: Column,
    derived: Column,
    answer: Column
) -> Column:
    preview = F.when(F.length(answer) > 100, F.concat(F.substring(answer, 1, 100), F.lit("..."))).otherwise(answer)
    text = F.concat_ws(
        " ",
        F.when(
            entities > 0,
            F.concat(
                F.lit("Identified "),
                entities.cast("string"),
                F.lit(" entities across "),
                entity_types.cast("string"),
                F.lit(" categories.")
            )
        ),
        F.when(
            sentiment.isNotNull(),
            F.concat(F.lit("Document has "), sentiment, F.lit(" sentiment (score: "), F.format_string("%.3f", score), F.lit(")."))
        ),
        F.when(
            total_kpis > 0,
            F.concat(
                F.lit("Extracted "),
                kpi_types.cast("string"),
                F.lit(" KPIs with "),
                derived.cast("string"),
                F.lit(" derived calculations.")
            )
        ),
        F.when(answer != "", F.concat(F.lit("Answer: "), preview)),
    )
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("Analysis incomplete."))


def format_chunks(hits: Column) -> Column:
    """Hits as the report shows them: 200 characters, section and page with defaults."""
    return F.transform(
        hits,
        lambda h: F.struct(
            F.when(
                F.length(h["text"]) > 200, F.concat(F.substring(h["text"], 1, 200), F.lit("..."))
            ).otherwise(h["text"]).alias("text"),
            h["chunk_id"].alias("chunk_id"), F.coalesce(h["section"], F.lit("general")).alias("section"), F.coalesce(
                h["chunk_type"], F.lit("general")
            ).alias("chunk_type"),
            F.coalesce(
                h["page_number"], F.lit(-1)
            ).alias("page_number"), F.coalesce(h["similarity"], F.lit(0.0)).alias("similarity"),
        ),
    )
