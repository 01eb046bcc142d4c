"""Key figures from text: pattern extraction, override by tagged figures, derived margin, totals."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Phrases that name each figure, and the tags that stand for revenue.
PHRASES = {
    "revenue": r"(revenue|sales|net sales|total revenue)",
    "gross_margin": r"(gross\s+margin|gross profit|gross\s+profit\s+margin)",
    "operating_income": r"(operating\s+income|operating\s+profit)",
    "net_income": r"(net\s+income|net profit|bottom\s+line)",
    "eps": r"(earnings?\s+per\s+share|EPS)",
    "ebitda": r"(ebitda|operating\s+cash\s+flow)",
    "roa": r"(return\s+on\s+assets|ROA)",
    "roe": r"(return\s+on\s+equity|ROE)",
}
TAIL = r"\s*(?:of|to|was|is|reached|totaled|stood at)?\s*(?:[:$]\s*){0,2}([\d,\.]+)\s*([A-Z\%]*)"
REVENUE_TAGS = (
    "Revenues",
    "RevenueFromContractWithCustomerExcludingAssessedTax",
    "RevenueFromContractWithCustomerIncludingAssessedTax",
    "RevenueFromRelatedParties",
    "RevenueRemainingPerformanceObligation"
)


_PATTERNS = [(kind, re.compile(phrase + TAIL, re.IGNORECASE | re.ASCII)) for kind, phrase in PHRASES.items()]
_MATCHES = T.ArrayType(
    T.StructType(
        [
            T.StructField("kpi_type", T.StringType()),
            T.StructField("ord", T.IntegerType()),
            *[T.StructField(n, T.StringType()) for n in ("name", "number", "unit", "raw_text")]
        ]
    )
)


@F.pandas_udf(_MATCHES)
def _kpi_matches(texts: pd.Series) -> pd.Series:
    def one(text: str | None) -> list[tuple] | None:
        if text is None:
            return None
        return [(kind, i, m[1], m[2], m[3], m[0]) for kind, pattern in _PATTERNS for i, m in enumerate(pattern.finditer(text))]

    return texts.map(one)


def extract_kpis(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kpi_type, ord, name, value, unit, raw_text, source): all matches whose number is one.

    ``ord`` counts the matches of a type in order; a match without a number keeps its place but gives no row. The unit
    is whatever letters follow, so it may be the next word. Texts without a digit never reach Python.
    """
    rows = texts.where(F.col(text).rlike("[0-9]")).select(key, F.explode(_kpi_matches(F.col(text))).alias("_k"))
    value = F.replace("_k.number", F.lit(","), F.lit("")).try_cast("double")
    return rows.select(
        key, "_k.kpi_type", "_k.ord", "_k.name", value.alias("value"), "_k.unit", "_k.raw_text", F.lit("regex").alias("source")
    ).where("value is not null")


def override_revenue(kpis: DataFrame, tagged: DataFrame, key: str) -> DataFrame:
    """Revenue entries are replaced by the best tagged figure (highest score, first of equals) where there is one."""
    live = tagged.where(F.col("tag").isin(*REVENUE_TAGS) & F.col("value").isNotNull())
    best = live.groupBy(key).agg(
        F.max_by(F.struct("tag", "value", "text"), F.struct(F.coalesce("score", F.lit(0.0)), -F.col("ord"))).alias("_b")
    )
    new = best.select(
        key,
        F.lit("revenue").alias("kpi_type"),
        F.lit(0).alias("ord"),
        F.col("_b.tag").alias("name"),
        F.col("_b.value").alias("value"),
        F.lit("").alias("unit"),
        F.coalesce("_b.text", F.lit("")).alias("raw_text"),
        F.lit("financial_ner_model").alias("source")
    )
    old = kpis.join(new.select(key, "kpi_type"), [key, "kpi_type"], "left_anti")
    return old.select(new.columns).unionByName(new)


def derived_margin(kpis: DataFrame, key: str) -> DataFrame:
    """(key, calculated_gross_margin_percent) from the first gross figure that is no percentage and the first revenue."""
    first = lambda kind: F.min_by(
        F.when(F.col("kpi_type") == kind, F.struct("value", "unit")), F.when(F.col("kpi_type") == kind, F.col("ord"))
    )
    both = kpis.groupBy(key).agg(first("gross_margin").alias("_g"), first("revenue").alias("_r"))
    ok = F.col("_g").isNotNull() & F.col("_r").isNotNull() & (F.trim("_g.unit") != "%") & (F.col("_r.value") != 0)
    return both.where(ok).select(key, (F.col("_g.value") / F.col("_r.value") * 100).alias("calculated_gross_margin_percent"))


def kpi_totals(kpis: DataFrame, margins: DataFrame, key: str) -> DataFrame:
    """(key, kpi_count, calculated, total_kpis)."""
    counts = kpis.groupBy(key).agg(F.count_distinct("kpi_type").alias("kpi_count"))
    joined = counts.join(margins.select(key, F.lit(1).alias("_c")), key, "left")
    return joined.select(
        key,
        "kpi_count",
        F.coalesce("_c", F.lit(0)).alias("calculated"),
        (F.col("kpi_count") + F.coalesce("_c", F.lit(0))).alias("total_kpis")
    )


def kpi_summary(kpis: DataFrame, key: str) -> DataFrame:
    """As ``kpi_totals`` with the derived margins, in one pass over the figures."""
    first = lambda kind: F.min_by(
        F.when(F.col("kpi_type") == kind, F.struct("value", "unit")), F.when(F.col("kpi_type") == kind, F.col("ord"))
    )
    kinds = F.size(F.collect_set("kpi_type")).cast("long")  # at most as many as there are phrases
    found = kpis.groupBy(key).agg(kinds.alias("kpi_count"), first("gross_margin").alias("_g"), first("revenue").alias("_r"))
    ok = F.col("_g").isNotNull() & F.col("_r").isNotNull() & (F.trim("_g.unit") != "%") & (F.col("_r.value") != 0)
    counted = found.withColumn("calculated", F.coalesce(ok, F.lit(False)).cast("int"))
    return counted.select(key, "kpi_count", "calculated", (F.col("kpi_count") + F.col("calculated")).alias("total_kpis"))
