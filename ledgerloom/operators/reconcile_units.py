"""Problem 3: quantities recorded in different units.

The history of a source (its recorded values of one entity in order of time) is segmented by exact penalised
changepoint search (PELT: optimal partitioning with pruning) on log values. Two segments of an entity whose levels are
apart by a known factor, the ratio of two units, mark a unit change; reversing it, that is adding the unit's log factor,
brings both to one level. ``unit_changes`` pairs the records of such segments and then checks each pair exactly.

Words and levels work together. A segment whose words name a unit offers the factors of those units alone. Where words
name none, ``silent`` decides: "default" takes US dollars and whole units (as the results of the queries are defined),
"infer" takes the known unit that reverses the segment to the level of a named one of the same entity, if there is one.

PELT runs between cuts that every optimum has (jump squared / 2 above three penalties), so it stays exact and short. An
optimal segment has no value further than sqrt(2 * penalty) from its level: to split such a value off would pay. Hence
``MATCH`` loses no pair of amounts that are equal within the tolerance. A history is a block a calendar month (of the
id's hash where the time is null): blocks are the unit of work, so an entity with a third of all rows is spread over
many tasks, and the result depends on no partitioning. A segment that goes on in the next month is two of equal level,
between which there is no unit change.

Defined results: null, zero and non-finite values have no log and no segment (they keep amounts as they are, and pair
with nothing); values of different sign are never in one segment; an unknown currency gives null dollars; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import units
from ledgerloom.session import checkpointed, shuffle_width

#: Spread of one level's log values (rounding of recorded figures), and the penalty of a changepoint.
SIGMA = 0.002
PENALTY = 5 * SIGMA**2
#: How far a level shift may be from a known factor: the tolerance of amounts, and what two values differ from their levels.
MATCH = 0.0051 + 2 * (2 * PENALTY) ** 0.5


def pelt(values: np.ndarray, weights: np.ndarray | None = None, penalty: float = PENALTY) -> list[int]:
    """Starts of the segments that minimise the squared error plus ``penalty`` a segment, exactly."""
    n = len(values)
    if n == 0:
        return []
    w = np.ones(n) if weights is None else weights.astype(np.float64)
    v = values - values.mean()
    s0, s1, s2 = (np.concatenate([[0.0], np.cumsum(x)]) for x in (w, w * v, w * v * v))
    best = np.full(n + 1, np.inf)
    best[0] = -penalty
    last = np.zeros(n + 1, dtype=np.int64)
    live = np.array([0])
    for t in range(1, n + 1):
        cost = best[live] + np.maximum(s2[t] - s2[live] - (s1[t] - s1[live]) ** 2 / (s0[t] - s0[live]), 0)
        i = int(cost.argmin())
        best[t], last[t] = cost[i] + penalty, live[i]
        live = np.append(live[cost <= best[t]], t)
    starts, t = [], n
    while t > 0:
        t = int(last[t])
        starts.append(t)
    return starts[::-1]


def level_segments(values: np.ndarray, fresh: np.ndarray | None = None, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """(segment number, level) of every value of one history, or of several where ``fresh`` marks their first values.

    Runs of equal values are one weighted point, which no optimum cuts; most pieces between sure cuts are one point.
    """
    n = len(values)
    first = np.zeros(n, dtype=bool) if fresh is None else fresh.copy()
    first[:1] = True
    edge = first | np.concatenate([[True], values[1:] != values[:-1]])
    run = np.cumsum(edge) - 1
    points, weights, opens = values[edge], np.bincount(run), first[edge]
    starts = opens | np.concatenate([[True], np.diff(points) ** 2 / 2 > 3 * penalty])
    bounds = np.append(np.flatnonzero(starts), len(points))
    for i in np.flatnonzero(np.diff(bounds) > 1):
        a, b = bounds[i], bounds[i + 1]
        starts[a + np.array(pelt(points[a:b], weights[a:b], penalty))] = True
    number = np.cumsum(starts) - 1
    level = np.bincount(number, weights=points * weights) / np.bincount(number, weights=weights)
    return number[run], level[number[run]]


def segment_histories(
    rows: DataFrame, history: list[str], time: str, tie: str, value: str, penalty: float = PENALTY, block: str = "month"
) -> DataFrame:
    """The rows with a usable value, with ``segment`` (differs between all segments) and ``level`` (mean log of its values)."""
    usable = F.col(value).isNotNull() & (F.abs(F.col(value)) > 0) & (F.abs(F.col(value)) < float("inf")) & ~F.isnan(value)
    known = F.lit(True)
    for c in history:
        known &= F.col(c).isNotNull()
    when = F.coalesce(F.unix_micros(F.date_trunc(block, time)), F.pmod(F.xxhash64(tie), F.lit(64)))
    live = rows.where(usable & known).withColumn("_history", F.xxhash64(*history, F.signum(value), when))
    parts = live.repartition(
        shuffle_width(rows.sparkSession), "_history"
    ).sortWithinPartitions("_history", *history, time, tie, value)
    schema = rows.select("*", F.lit(0).cast("long").alias("segment"), F.lit(0.0).alias("level")).schema

    def close(df: pd.DataFrame) -> pd.DataFrame:
        x = df[value].to_numpy(dtype=np.float64)
        fresh = np.ones(len(df), dtype=bool)
        fresh[1:] = np.sign(x[1:]) != np.sign(x[:-1])
        for c in ["_history", *history]:
            v = df[c].to_numpy()
            fresh[1:] |= v[1:] != v[:-1]
        number, level = level_segments(np.log(np.abs(x)), fresh, penalty)
        lead = np.flatnonzero(np.concatenate([[True], np.diff(number) > 0]))
        # named after its history and its first value's place there
        starts = np.maximum.accumulate(np.where(fresh, np.arange(len(df)), 0))
        with np.errstate(over="ignore"):
            name = df["_history"].to_numpy().view(np.uint64)[lead] + (
                lead - starts[lead] + 1
            ).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return df.drop(columns="_history").assign(segment=name.view(np.int64)[number], level=level)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # rows of the history that the last batch may have left unfinished
        for df in batches:
            if not len(df):
                continue
            who = df["_history"].to_numpy()
            cut = len(df) - int(np.argmin((who == who[-1])[::-1])) if (who != who[-1]).any() else 0
            if held and held[0]["_history"].iat[0] != who[0]:
                yield close(pd.concat(held, ignore_index=True))
                held = []
            if cut:
                yield close(pd.concat([*held, df.iloc[:cut]], ignore_index=True))
                held = []
            held.append(df.iloc[cut:])
        if held:
            yield close(pd.concat(held, ignore_index=True))

    return parts.mapInPandas(run, schema)


_UNIT = T.StructType([T.StructField("currency", T.StringType()), T.StructField("scale", T.DoubleType())])


@F.pandas_udf(_UNIT)
def _amount_unit(value: pd.Series, text: pd.Series, named: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([units.unit_of(*x) for x in zip(value, text, named)], columns=["currency", "scale"])


@F.pandas_udf(_UNIT)
def _reference_unit(value: pd.Series, text: pd.Series, named: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([units.reference_unit_of(*x) for x in zip(value, text, named)], columns=["currency", "scale"])


def revenue_records(examples: DataFrame, agent: DataFrame) -> DataFrame:
    """(doc_id, kind, source, id, at, value, unit): the recorded revenues of both tables; kind is reference, extracted or agent.

    A re-delivered row repeats its key and content, so it stays one record.
    """
    e = examples.select(
        "doc_id",
        F.col("sample_id").alias("id"),
        F.col("created_at").alias("at"),
        "text",
        "reference_unit",
        F.try_element_at("reference_kpis", F.lit("revenue")).alias("ref"),
        F.try_element_at("extracted_kpis", F.lit("revenue")).alias("ext")
    )
    nothing = F.lit(None).cast("string")
    reference = e.select(
        "doc_id",
        F.lit("reference").alias("kind"),
        F.lit("").alias("source"),
        "id",
        "at",
        F.col("ref").alias("value"),
        _reference_unit("ref", "text", "reference_unit").alias("unit")
    )
    extracted = e.select(
        "doc_id",
        F.lit("extracted").alias("kind"),
        F.lit("").alias("source"),
        "id",
        "at",
        F.col("ext").alias("value"),
        _amount_unit("ext", "text", nothing).alias("unit")
    )
    a = agent.where("kpi_type = 'revenue'").select(
        "doc_id",
        F.lit("agent").alias("kind"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.col("entry_id").alias("id"),
        F.col("extracted_at").alias("at"),
        "value",
        _amount_unit("value", "raw_text", "unit").alias("unit")
    )
    every = reference.unionByName(extracted).unionByName(a).where("value is not null")
    return every.groupBy("doc_id", "kind", "source", "id", "value", "unit").agg(F.min("at").alias("at"))


def to_dollars(records: DataFrame, rates: DataFrame) -> DataFrame:
    """Adds ``named`` (words name a currency or a scale), ``factor`` (US dollars for one recorded unit) and ``usd``.

    No currency is US dollars, no scale is whole units.
    """
    table = F.broadcast(_rates(rates))  # one row per currency of the world
    named = records.withColumn("named", F.col("unit.currency").isNotNull() | F.col("unit.scale").isNotNull())
    named = named.withColumn("currency", F.coalesce("unit.currency", F.lit("USD"))).withColumn(
        "scale", F.coalesce("unit.scale", F.lit(1.0))
    )
    out = named.join(table, "currency", "left").withColumn(
        "factor",
        F.col("scale") * F.when(F.col("currency") == "USD", F.coalesce("usd_rate", F.lit(1.0))).otherwise(F.col("usd_rate"))
    )
    return out.withColumn("usd", F.col("value") * F.col("factor")).drop("unit", "usd_rate")


def _rates(rates: DataFrame) -> DataFrame:
    return rates.where("currency is not null").groupBy("currency").agg(F.min("usd_rate").alias("usd_rate"))


def _differ(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b))


def _bands(level: Column) -> Column:
    return F.floor(level / F.lit(MATCH)).cast("long")


def _near(level: Column) -> Column:
    return F.explode(F.array(*[_bands(level) + i for i in (-1, 0, 1)]))


def reverse_silent(segments: DataFrame, rates: DataFrame) -> DataFrame:
    """Segments whose words name no unit take the unit that their level shift shows.

    Of the known units (currencies times scales, a few dozen) that bring the segment to the level of a named segment of
    its entity the closest one counts, of equally close ones the least; without such a unit the default stays.
    """
    rows = _rates(rates).where("usd_rate > 0").orderBy("currency").collect()  # the currencies of the world
    if not rows:
        return segments
    known = F.array(
        *[
            F.struct(F.lit(r.currency).alias("c"), F.lit(s).alias("s"), F.lit(r.usd_rate * s).alias("f"))
            for r in rows
            for s in units.SCALES
        ]
    )
    spoken = F.max("named").over(Window.partitionBy("segment"))
    told = checkpointed(segments.withColumn("_spoken", spoken))
    anchors = told.where("named").select(
        "doc_id", (F.col("level") + F.log("factor")).alias("to"), F.signum("value").alias("_sign")
    ).distinct().withColumn("band", _bands(F.col("to")))
    open_ones = told.where(~F.col("_spoken")).select("doc_id", "segment", "level", F.signum("value").alias("_sign")).distinct()
    tried = open_ones.withColumn("_u", F.explode(known)).withColumn(
        "now", F.col("level") + F.log("_u.f")
    ).withColumn("band", _near(F.col("now")))
    off = F.abs(F.col("now") - F.col("to"))
    best = tried.join(anchors, ["doc_id", "_sign", "band"]).where(off <= MATCH).groupBy("segment").agg(
        F.min(F.struct(F.round(off, 6).alias("off"), "_u.f", "_u.c", "_u.s")).alias("_b")
    )
    out = told.join(best, "segment", "left")
    for name, got in (("currency", "_b.c"), ("scale", "_b.s"), ("factor", "_b.f")):
        out = out.withColumn(name, F.coalesce(got, name))
    return out.withColumn("usd", F.col("value") * F.col("factor")).drop("_b", "_spoken").select(segments.columns)


def unit_changes(
    records: DataFrame, rates: DataFrame | None = None, tolerance: float = 0.005, penalty: float = PENALTY, silent: str = "default"
) -> DataFrame:
    """Pairs (one of kpi_example, one of kpi_agent) of an entity that are one amount recorded in different units.

    The pairs come from segments of the two sides whose level shift matches the ratio of their units, another than 1;
    they are then checked: equal in dollars within ``tolerance`` of the larger, and the recorded numbers further apart.
    Levels are joined by entity and band, equal ones of an entity once, so a hot entity isn't joined all to all.
    """
    found = segment_histories(records, ["doc_id", "kind", "source"], "at", "id", "value", penalty)
    if silent == "infer":
        found = reverse_silent(found, rates)
    sign = F.signum("value").alias("sign")
    some = checkpointed(
        found.where("factor > 0").select(
            "doc_id", "kind", "id", "value", "factor", "usd", sign, "level", (F.col("level") + F.log("factor")).alias("reversed")
        )
    )
    levels = some.select("doc_id", "sign", "level", "factor", "reversed", (F.col("kind") == "agent").alias("_agent")).distinct()
    mine, theirs = (levels.where(c).drop("_agent") for c in ("not _agent", "_agent"))
    left = mine.select(
        "doc_id", "sign", _near(F.col("reversed")).alias("band"), *[F.col(c).alias(f"l_{c}") for c in ("level", "factor")]
    )
    right = theirs.select(
        "doc_id", "sign", _bands(F.col("reversed")).alias("band"), *[F.col(c).alias(f"r_{c}") for c in ("level", "factor")]
    )
    known = F.log("l_factor") - F.log("r_factor")
    shifts = left.join(right, ["doc_id", "sign", "band"]).where(
        (F.col("l_factor") != F.col("r_factor")) & (F.abs(F.col("r_level") - F.col("l_level") - known) <= MATCH)
    )
    l = some.where("kind <> 'agent'").select(
        "doc_id",
        "sign",
        F.col("kind").alias("kpi_side"),
        F.col("id").alias("sample_id"),
        *[F.col(c).alias(f"l_{c}") for c in ("value", "usd", "factor", "level")]
    )
    r = some.where("kind = 'agent'").select(
        "doc_id", "sign", F.col("id").alias("entry_id"), *[F.col(c).alias(f"r_{c}") for c in ("value", "usd", "factor", "level")]
    )
    both = l.join(shifts.drop("band"), ["doc_id", "sign", "l_level", "l_factor"]).join(r, ["doc_id", "sign", "r_level", "r_factor"])
    both = both.where(
        (_differ(F.col("l_usd"), F.col("r_usd")) <= tolerance) & (_differ(F.col("l_value"), F.col("r_value")) > tolerance)
    )
    return both.select("sample_id", "kpi_side", "entry_id", (F.col("r_factor") / F.col("l_factor")).alias("unit_ratio")).distinct()
