"""Queries of the core's own problem: quantities in different units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import units
from ledgerloom.operators import reconcile_units as ru
from ledgerloom.plans import sqltools as q
from ledgerloom.session import table


def _revenues(spark: SparkSession, d: str) -> DataFrame:
    records = ru.revenue_records(table(spark, d, "kpi_example"), table(spark, d, "kpi_agent"))
    return ru.to_dollars(records, table(spark, d, "currency_rate"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return ru.unit_changes(_revenues(spark, d)).select("sample_id", "kpi_side", "entry_id").distinct()


def p3_dollars(spark: SparkSession, d: str) -> DataFrame:
    """Every recorded revenue in US dollars, with the segment of its history that it belongs to."""
    return ru.segment_histories(_revenues(spark, d), ["doc_id", "kind", "source"], "at", "id", "value").select(
        "doc_id", "kind", "id", "value", "currency", "scale", "usd", "segment", "level"
    )


def p3_named(spark: SparkSession, d: str) -> DataFrame:
    """US dollars of the agent's revenues whose unit column names currency and scale by itself."""
    agent = table(spark, d, "kpi_agent")
    alone = agent.withColumn("raw_text", F.lit(None).cast("string"))
    none = table(spark, d, "kpi_example").limit(0)
    full = ru.revenue_records(none, alone).where(
        "unit.currency is not null and unit.scale is not null"
    ).select(F.col("id").alias("entry_id"))
    usd = ru.to_dollars(ru.revenue_records(none, agent), table(spark, d, "currency_rate"))
    return usd.select(F.col("id").alias("entry_id"), "value", "currency", "usd").join(
        full.distinct(), "entry_id", "left_semi"
    ).withColumn("usd", F.round("usd", 2))


def p3_shifts(spark: SparkSession, d: str) -> DataFrame:
    """Unit changes by their factor: how many pairs of records each explains."""
    found = ru.unit_changes(_revenues(spark, d))
    return found.groupBy(F.round(F.log10("unit_ratio"), 3).alias("log10_factor")).agg(
        F.count(F.lit(1)).alias("pairs"), F.count_distinct("entry_id").alias("entries")
    )


def _spelled(table_: dict) -> str:
    return ", ".join(
        f"({q.quote(str(k)) if isinstance(k, str) else f'{k}::DOUBLE'}, {q.quote(n)})" for k, names in table_.items() for n in names
    )


SQL = {
    "p3_named": f"WITH c AS (SELECT * FROM (VALUES {_spelled(units.CURRENCIES)}) t(currency, a)), s AS (SELECT * FROM (VALUES {_spelled(units.SCALES)}) t(scale, b)), u AS (SELECT DISTINCT currency, scale, x FROM (SELECT currency, scale, unnest([a || g || b, b || g || a]) AS x FROM c, s, (VALUES (''), (' '), (' of ')) t(g)))"
    " SELECT DISTINCT entry_id, value, u.currency, round(value * scale * usd_rate, 2) AS usd FROM kpi_agent k JOIN u ON trim(k.unit) = u.x JOIN currency_rate r ON r.currency = u.currency WHERE kpi_type = 'revenue' AND value IS NOT NULL"
}

QUERIES = {"p3_found": p3_found, "p3_dollars": p3_dollars, "p3_named": p3_named, "p3_shifts": p3_shifts}
