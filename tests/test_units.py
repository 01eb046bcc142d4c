import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.functions import units
from ledgerloom.operators import reconcile_units as ru


@pytest.mark.parametrize(
    ("value", "text", "named", "unit"),
    [
        (26990.0, "total revenue of EUR 26,990 m for fiscal 2020.", None, ("EUR", 1e6)),
        (134.4, "in USD millions Total sales reached 134.4 in fiscal 2020.", None, ("USD", 1e6)),
        (27203.0, "Thalrix plc: sales 27,203 for fiscal 2022. [thousands of EUR]", None, ("EUR", 1e3)),
        (108.6, "Unless noted, amounts in billions of US dollars. Revenue came to $108.6mn in fiscal 2018.", None, ("USD", 1e6)),
        (391.3, "in INR crore Total net sales totaled 391.3 in fiscal 2022.", None, ("INR", 1e7)),
        (12199.0, "in USD thousands sales of 12,199 compared", "compared", ("USD", 1e3)),
        (
            37943.0,
            "Unless noted, amounts in millions of dollars. Sales came to EUR 37,943 '000 in fiscal 2020.",
            None,
            ("EUR", 1e3)
        ),
        (442.4, "revenue to 442.4", "m", (None, 1e6)),
        (5.0, None, None, (None, None)),
        (85794.0, "net sales of US$85,794", "M", ("USD", 1e6)),
        (1332957864.0, "Stated in USD, not rounded. total revenue of 1,332,957,864 and", "and", ("USD", 1.0)),
    ],
)
def test_unit_of_an_amount(value, text, named, unit):
    assert units.unit_of(value, text, named) == unit


def test_reference_unit():
    text = "total revenue of EUR 26,990 m. Reference values are stated in crores of INR."
    assert units.reference_unit_of(128741.0, text, None) == ("INR", 1e7)
    assert units.reference_unit_of(1.0, text, "billion USD") == ("USD", 1e9)
    assert units.unit_of(26990.0, text) == ("EUR", 1e6)


def brute(values, penalty):
    n, best = len(values), None
    for k in range(n):
        for cuts in itertools.combinations(range(1, n), k):
            b = [0, *cuts, n]
            cost = sum(((values[i:j] - values[i:j].mean()) ** 2).sum() for i, j in zip(b, b[1:])) + penalty * k
            if best is None or cost < best - 1e-15:
                best = cost
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([0.0, 0.001, 0.004, 0.03, 0.5, 6.9]), min_size=1, max_size=9))
def test_segments_are_optimal(xs):
    x = np.array(xs)
    number, level = ru.level_segments(x)
    cost = ((x - level) ** 2).sum() + ru.PENALTY * (len(set(number)) - 1)
    assert cost == pytest.approx(brute(x, ru.PENALTY), abs=1e-12)


def test_pairs_in_other_units(spark):
    examples = spark.createDataFrame(
        [
            (1, "d", "sales of $5,000 million for x", {"revenue": 5.0}, "billion USD"),
            (2, "d", "sales 7", {"revenue": None}, None),
            (3, None, "x", None, None),
            (4, "d", None, {"revenue": float("nan")}, "USD")
        ],
        "sample_id long, doc_id string, text string, reference_kpis map<string,double>, reference_unit string",
    ).selectExpr("*", "map('revenue', 5000D) AS extracted_kpis", "timestamp'2020-01-01' AS created_at", "1 AS value", "2 AS usd")
    agent = spark.createDataFrame(
        [
            (10, "d", "revenue", 5e9, None, "sales of 5,000,000,000"),
            (11, "d", "revenue", 5000.0, "M", "sales of $5,000"),
            (12, "d", "eps", 5.0, "", ""),
            (13, "d", "revenue", 0.0, "", None)
        ],
        "entry_id long, doc_id string, kpi_type string, value double, unit string, raw_text string"
    ).selectExpr(
        "*", "'regex' AS source", "timestamp'2021-01-01' AS extracted_at", "9 AS level"
    )
    rates = spark.createDataFrame([("USD", 1.0), ("EUR", 1.08)], "currency string, usd_rate double")
    got = {
        (r.sample_id, r.kpi_side, r.entry_id)
        for r in ru.unit_changes(ru.to_dollars(ru.revenue_records(examples, agent), rates)).collect()
    }
    assert got == {(1, "reference", 10), (1, "reference", 11), (1, "extracted", 10)}


def test_pairs_in_currencies_of_close_rates(spark):
    rows = [
        ("d", "reference", 1, 1000.0, "EUR"),
        ("d", "agent", 10, 1005.6, "USD"),
        ("d", "agent", 11, 1000.0, "EUR"),
        ("d", "agent", 12, 1020.0, None),
        ("d", "agent", 13, 1.0056, None),
        (None, "agent", 14, 1005.6, "USD")
    ]
    records = spark.createDataFrame(
        [(*r[:4], (r[4], None)) for r in rows],
        "doc_id string, kind string, id long, value double, unit struct<currency:string,scale:double>"
    ).selectExpr(
        "*", "'' AS source", "timestamp'2020-01-01' AS at"
    )
    rates = spark.createDataFrame([("USD", 1.0), ("EUR", 1.0056)], "currency string, usd_rate double")
    got = {(r.sample_id, r.kpi_side, r.entry_id) for r in ru.unit_changes(ru.to_dollars(records, rates)).collect()}
    assert got == {(1, "reference", 10)}


def test_empty_tables(spark):
    e = spark.createDataFrame(
        [],
        "sample_id long, doc_id string, text string, reference_kpis map<string,double>, extracted_kpis map<string,double>, reference_unit string, created_at timestamp"
    )
    a = spark.createDataFrame(
        [],
        "entry_id long, doc_id string, kpi_type string, value double, unit string, raw_text string, source string, extracted_at timestamp"
    )
    r = spark.createDataFrame([], "currency string, usd_rate double")
    assert ru.unit_changes(ru.to_dollars(ru.revenue_records(e, a), r)).count() == 0


RATES = [("USD", 1.0), ("EUR", 1.08), ("JPY", 0.0067)]


def recorded(spark, rows):
    """(kind, id, value, currency, scale) of one document, a day apart."""
    schema = "doc_id string, kind string, source string, id long, value double, unit struct<currency:string,scale:double>, day int"
    made = spark.createDataFrame([("d", k, "", i, v, (c, s), n) for n, (k, i, v, c, s) in enumerate(rows)], schema)
    return made.selectExpr("* EXCEPT (day)", "CAST(date_add(DATE'2020-01-01', day) AS TIMESTAMP) AS at")


SILENT = [
    ("reference", 1, 5.0, "USD", 1e9),
    ("reference", 2, 7.0, None, None),
    ("agent", 10, 5000.0, None, None),
    ("agent", 11, 5000.0, None, None),
    ("agent", 12, 123.0, None, None),
    ("agent", 13, 4629.6, None, None),
    ("agent", 14, -5000.0, None, None)
]


def test_a_level_shift_gives_the_unit_that_words_leave_out(spark):
    rates = spark.createDataFrame(RATES, "currency string, usd_rate double")
    records = ru.to_dollars(recorded(spark, SILENT), rates)
    assert ru.unit_changes(records, rates).count() == 0
    got = {
        (r.sample_id, r.kpi_side, r.entry_id, round(r.unit_ratio, 9))
        for r in ru.unit_changes(records, rates, silent="infer").collect()
    }
    assert got == {(1, "reference", 10, 1e-3), (1, "reference", 11, 1e-3), (1, "reference", 13, 1.08e-3)}


def test_without_segmentation_pairs_are_lost(spark):
    rates = spark.createDataFrame(RATES, "currency string, usd_rate double")
    rows = [
        ("reference", 1, 5.0, "USD", 1e9),
        ("agent", 10, 5000.0, "USD", 1e6),
        ("agent", 11, 9.0, "USD", 1e9),
        ("agent", 12, 5e6, "USD", 1e3)
    ]
    records = ru.to_dollars(recorded(spark, rows), rates)
    assert {r.entry_id for r in ru.unit_changes(records).collect()} == {10, 12}
    assert ru.unit_changes(records, penalty=1e9).count() == 0  # one segment a history


def test_segments_depend_on_no_partitioning(spark):
    rows = spark.range(3000).selectExpr(
        "'h' AS h", "id", "exp(sin(id / 50) / 2) * IF(id % 700 < 350, 1, 1000) AS v", "timestamp_seconds(id * 20000) AS at"
    )
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append({(r.id, r.segment, r.level) for r in ru.segment_histories(rows, ["h"], "at", "id", "v").collect()})
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen[0]) == 3000 and seen[0] == seen[1]


def test_values_without_segment(spark):
    rows = spark.createDataFrame(
        [("h", 1, None), ("h", 2, 0.0), ("h", 3, float("inf")), (None, 4, 1.0), ("h", 5, -2.0), ("h", 6, 2.0)],
        "h string, id long, v double"
    ).selectExpr("*", "CAST(NULL AS TIMESTAMP) AS at")
    got = ru.segment_histories(rows, ["h"], "at", "id", "v").collect()
    assert {r.id for r in got} == {5, 6} and len({r.segment for r in got}) == 2
