"""Queries of the figure, entity and sentiment operators, and of the sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text as tx
from ledgerloom.operators import entities as en
from ledgerloom.operators import kpi as kp
from ledgerloom.operators import sentiment as se
from ledgerloom.ports import NEGATIVE, POSITIVE, RuleTagger
from ledgerloom.plans import sqltools as q
from ledgerloom.session import table
from ledgerloom.sources import documents as src


def _orders_text() -> Column:
    money = lambda c: F.format_string("%.1f", F.floor(F.col(c) / 1000).cast("double"))
    return F.concat(
        F.lit("Total revenue of $"), money("o_totalprice"), F.lit(" M and "),
        F.when(F.col("o_orderkey") % 4 == 0, F.lit("gross margin was 38.2%")).when(
            F.col("o_orderkey") % 4 == 1, F.concat(F.lit("gross profit reached "), (F.col("o_orderkey") % 97).cast("string"))
        ).otherwise("costs fell"),
        F.lit(". Net income: $"), (F.col("o_custkey") % 1000).cast("string"), F.lit(",250.5 and EPS of "), F.when(
            F.col("o_orderkey") % 5 == 0, F.lit(",")
        ).otherwise(F.lit("1.25")), F.lit(" steps"),
    )


_ORDERS_TEXT_SQL = (
    "'Total revenue of $' || printf('%.1f', floor(o_totalprice / 1000)) || ' M and ' || CASE WHEN o_orderkey % 4 = 0 THEN 'gross margin was 38.2%' WHEN o_orderkey % 4 = 1 THEN 'gross profit reached ' || CAST(o_orderkey % 97 AS VARCHAR) ELSE 'costs fell' END"
    " || '. Net income: $' || CAST(o_custkey % 1000 AS VARCHAR) || ',250.5 and EPS of ' || CASE WHEN o_orderkey % 5 = 0 THEN ',' ELSE '1.25' END || ' steps'"
)


def _order_kpis(spark: SparkSession, d: str) -> DataFrame:
    return kp.extract_kpis(table(spark, d, "orders").select("o_orderkey", _orders_text().alias("text")), "o_orderkey", "text")


def kpi_extract(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "kpi_example").groupBy("sample_id").agg(F.max("text").alias("text"))
    return kp.extract_kpis(texts, "sample_id", "text")


def kpi_margin(spark: SparkSession, d: str) -> DataFrame:
    return kp.derived_margin(_order_kpis(spark, d), "o_orderkey").withColumn(
        "calculated_gross_margin_percent", F.round("calculated_gross_margin_percent", 6)
    )


def kpi_totals(spark: SparkSession, d: str) -> DataFrame:
    kpis = _order_kpis(spark, d)
    return kp.kpi_totals(kpis, kp.derived_margin(kpis, "o_orderkey"), "o_orderkey")


def kpi_summary(spark: SparkSession, d: str) -> DataFrame:
    return kp.kpi_summary(_order_kpis(spark, d), "o_orderkey")


def entity_summary(spark: SparkSession, d: str) -> DataFrame:
    """How many entities and types each user has, and the most frequent type."""
    return en.entity_summary(entity_type_counts(spark, d), "user_id").drop("type_counts")


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    """Line items as tagged figures of their orders; every third order has none of revenue."""
    tag = F.when(F.col("l_linenumber") % 3 == 0, "Revenues").when(
        F.col("l_orderkey") % 3 == 0, "DebtInstrumentFaceAmount"
    ).otherwise("RevenueFromRelatedParties")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.col("l_linenumber").alias("ord"),
        tag.alias("tag"),
        F.col("l_quantity").alias("value"),
        (F.col("l_discount") * 100).cast("int").cast("double").alias("score"),
        F.concat(F.lit("$ "), F.col("l_quantity").cast("int").cast("string")).alias("text"),
        "l_partkey",
        "l_suppkey"
    )


def kpi_override(spark: SparkSession, d: str) -> DataFrame:
    best = _tagged(spark, d).groupBy("o_orderkey", "ord").agg(
        F.max_by(F.struct("tag", "value", "score", "text"), F.struct("score", "l_partkey", "l_suppkey", "value")).alias("b")
    ).select("o_orderkey", "ord", "b.*")
    kept = table(spark, d, "orders").select("o_orderkey")
    return kp.override_revenue(_order_kpis(spark, d), best.join(kept, "o_orderkey", "left_semi"), "o_orderkey")


def xbrl_numeric_parse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "kpi_agent").select(
        "entry_id",
        tx.parse_number(F.col("raw_text")).alias("value"),
        tx.parse_number(F.concat_ws("", F.lit("$"), "unit")).alias("from_unit"),
        tx.parse_amount(F.regexp_extract("raw_text", r"[$]?[\d,.]+%?$", 0)).alias("amount")
    )


def xbrl_tag_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = en.tag_counts(
        _tagged(spark, d).withColumn("ord", F.col("ord").cast("long") * 1_000_000 + F.col("l_partkey")), "o_orderkey"
    )
    tags = counts.select("o_orderkey", "total_tagged", F.explode("tag_counts").alias("tag", "n"), F.size("sample").alias("sampled"))
    return tags


def ner_entities(spark: SparkSession, d: str) -> DataFrame:
    return en.extract_entities(table(spark, d, "documents"), "doc_id", "text")


def ner_words(spark: SparkSession, d: str) -> DataFrame:
    """How often each document names each entity."""
    return ner_entities(spark, d).groupBy("doc_id", "word", "entity_group").agg(F.count(F.lit(1)).alias("n"))


def entity_type_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts by type over entities given as rows: the event types of each user."""
    rows = table(spark, d, "events").select("user_id", F.col("event_type").alias("entity_group"), F.col("event_id").alias("ord"))
    return en.entity_type_counts(rows, "user_id")


def top_entity_type(spark: SparkSession, d: str) -> DataFrame:
    return en.top_entity_type(entity_type_counts(spark, d), "user_id")


def sentiment_document(spark: SparkSession, d: str) -> DataFrame:
    return se.document_sentiment(table(spark, d, "documents"), "doc_id", "text").withColumn("score", F.round("score", 6))


def sentiment_chunks(spark: SparkSession, d: str) -> DataFrame:
    return se.chunk_sentiment(table(spark, d, "document_chunk"), ["chunk_id"], "text").select(
        "chunk_id", "label", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence")
    )


def sentiment_distribution(spark: SparkSession, d: str) -> DataFrame:
    shares = se.sentiment_distribution(
        se.chunk_sentiment(table(spark, d, "document_chunk"), ["doc_id", "chunk_id"], "text"), "doc_id"
    )
    return shares.select("doc_id", *[F.round(c, 6).alias(c) for c in ("positive", "neutral", "negative")])


def tone(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "parsed_document").where("doc_type = 'earnings_call'").groupBy("doc_id").agg(
        F.max("cleaned_text").alias("cleaned_text")
    )
    return se.tone(calls, "doc_id", "cleaned_text")


def _json_rows(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit('{"note": 1, "text": "'), F.col("event_type"), F.lit('"}'))
    content = F.concat(F.lit('{"text": 5, "body": "'), F.col("event_type"), F.lit('", "document": "x"}'))
    return table(spark, d, "events").select(
        "event_id",
        F.when(F.col("event_id") % 3 == 0, body).when(F.col("event_id") % 3 == 1, content).otherwise(
            F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))
        ).alias("json")
    )


def json_source(spark: SparkSession, d: str) -> DataFrame:
    return _json_rows(spark, d).select("event_id", src.json_text(F.col("json")).alias("text"))


def html_source(spark: SparkSession, d: str) -> DataFrame:
    page = F.concat(
        F.lit("<html><head><style>p {}</style><script>var a = '<b>';</script></head><body><p>"),
        F.col("p_name"),
        F.lit(" &amp; "),
        F.col("p_brand"),
        F.lit("</p><div>  "),
        F.col("p_type"),
        F.lit(" </div></body></html>")
    )
    return table(spark, d, "part").select("p_partkey", src.html_text(page).alias("text"))


def html_tables(spark: SparkSession, d: str) -> DataFrame:
    page = F.concat(
        F.lit("<table><tr><th>name</th><th>size</th></tr><tr><td> "),
        F.col("p_name"),
        F.lit(" </td><td>"),
        F.col("p_size").cast("string"),
        F.lit("</td></tr></table><table><tr></tr></table>")
    )
    return src.html_tables(table(spark, d, "part").select("p_partkey", page.alias("html")), "p_partkey", "html").select(
        "p_partkey", "table_ord", "row_ord", F.array_join("cells", "|").alias("cells")
    )


def _kpi_sql(source: str, key: str) -> str:
    out = []
    for kind, phrase in kp.PHRASES.items():
        rx = q.quote("(?i)" + phrase + kp.TAIL)
        out.append(
            f"SELECT {key}, '{kind}' AS kpi_type, unnest(range(0, len(r))) AS i, unnest(r) AS raw_text, unnest(a) AS name, unnest(b) AS number, unnest(u) AS unit FROM (SELECT {key}, regexp_extract_all(text, {rx}, 0) AS r, regexp_extract_all(text, {rx}, 1) AS a, regexp_extract_all(text, {rx}, 2) AS b, regexp_extract_all(text, {rx}, 3) AS u FROM ({source}))"
        )
    return f"SELECT {key}, kpi_type, CAST(i AS INTEGER) AS ord, name, try_cast(replace(number, ',', '') AS DOUBLE) AS value, unit, raw_text, 'regex' AS source FROM ({' UNION ALL '.join(out)}) WHERE try_cast(replace(number, ',', '') AS DOUBLE) IS NOT NULL"


_NAMES = RuleTagger.pattern.replace("\\s", q.SPACE)
_ORDER_KPIS = _kpi_sql(f"SELECT o_orderkey, {_ORDERS_TEXT_SQL} AS text FROM orders", "o_orderkey")
_MARGINS = f"WITH k AS ({_ORDER_KPIS}), g AS (SELECT o_orderkey, arg_min(value, ord) AS gv, arg_min(unit, ord) AS gu FROM k WHERE kpi_type = 'gross_margin' GROUP BY 1), r AS (SELECT o_orderkey, arg_min(value, ord) AS rv FROM k WHERE kpi_type = 'revenue' GROUP BY 1), m AS (SELECT o_orderkey, round(gv / rv * 100, 6) AS calculated_gross_margin_percent FROM g JOIN r USING (o_orderkey) WHERE trim(gu) <> '%' AND rv <> 0)"
_TAGGED_SQL = "SELECT l_orderkey AS o_orderkey, l_linenumber AS ord, CASE WHEN l_linenumber % 3 = 0 THEN 'Revenues' WHEN l_orderkey % 3 = 0 THEN 'DebtInstrumentFaceAmount' ELSE 'RevenueFromRelatedParties' END AS tag, l_quantity AS value, CAST(CAST(trunc(l_discount * 100) AS INTEGER) AS DOUBLE) AS score, '$ ' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS text, l_partkey, l_suppkey FROM lineitem"


def _count_sql(x: str, lexicon: list[str]) -> str:
    return f"len(list_filter(string_split_regex(lower({x}), '[^a-z]+'), lambda w: w IN ({', '.join(q.quote(w) for w in lexicon)})))"


def _judged_sql(source: str, keys: str, x: str) -> str:
    """(keys, label, score, confidence) for rows of source with text x."""
    return (
        f"SELECT {keys}, CASE WHEN p > n THEN 'positive' WHEN p < n THEN 'negative' ELSE 'neutral' END AS label, CASE WHEN p = n THEN 1.0::DOUBLE ELSE abs(p - n) / CAST(p + n AS DOUBLE) END AS confidence,"
        f" CASE WHEN p = n THEN 0.0::DOUBLE ELSE (p - n) / CAST(p + n AS DOUBLE) END AS score FROM (SELECT {keys}, {_count_sql(x, POSITIVE)} AS p, {_count_sql(x, NEGATIVE)} AS n FROM ({source}))"
    )


_SENTENCES = "SELECT doc_id, substr(s, 1, 512) AS s FROM (SELECT doc_id, unnest(list_slice(string_split(text, '.'), 1, 50)) AS s FROM documents WHERE text IS NOT NULL) WHERE length(trim(s)) >= 5"
_CHUNKS = "SELECT doc_id, chunk_id, substr(text, 1, 512) AS s FROM document_chunk WHERE length(trim(text)) >= 5"
_CALLS = "SELECT doc_id, {part} AS s FROM (SELECT doc_id, string_split(max(cleaned_text), '.') AS parts FROM parsed_document WHERE doc_type = 'earnings_call' GROUP BY doc_id HAVING trim(max(cleaned_text)) <> '')"
_OPENING = _judged_sql(_CALLS.format(part="substr(array_to_string(list_slice(parts, 1, 10), ' '), 1, 512)"), "doc_id", "s")
_CLOSING = _judged_sql(
    _CALLS.format(part="substr(array_to_string(list_slice(parts, greatest(len(parts) - 9, 1), len(parts)), ' '), 1, 512)"),
    "doc_id",
    "s"
)

SQL = {
    "kpi_extract": _kpi_sql("SELECT sample_id, max(text) AS text FROM kpi_example GROUP BY 1", "sample_id"),
    "kpi_margin": _MARGINS + " SELECT * FROM m",
    "kpi_totals": _MARGINS + " SELECT k.o_orderkey, count(DISTINCT kpi_type) AS kpi_count, CAST(count(DISTINCT m.o_orderkey) AS INTEGER) AS calculated, count(DISTINCT kpi_type) + count(DISTINCT m.o_orderkey) AS total_kpis FROM k LEFT JOIN m ON k.o_orderkey = m.o_orderkey GROUP BY 1",
    "kpi_override": f"WITH k AS ({_ORDER_KPIS}), l AS (SELECT o_orderkey, ord, arg_max(struct_pack(tag, value, score, text), struct_pack(score, l_partkey, l_suppkey, value)) AS b FROM ({_TAGGED_SQL}) GROUP BY 1, 2), c AS (SELECT o_orderkey, ord, b.tag AS tag, b.value AS value, b.score AS score, b.text AS text FROM l WHERE b.tag IN ({', '.join(q.quote(x) for x in kp.REVENUE_TAGS)}) AND b.value IS NOT NULL AND o_orderkey IN (SELECT o_orderkey FROM orders)), n AS (SELECT o_orderkey, 'revenue' AS kpi_type, 0 AS ord, tag AS name, value, '' AS unit, text AS raw_text, 'financial_ner_model' AS source FROM c QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY score DESC, ord) = 1) SELECT o_orderkey, kpi_type, ord, name, value, unit, raw_text, source FROM k WHERE NOT (kpi_type = 'revenue' AND o_orderkey IN (SELECT o_orderkey FROM n)) UNION ALL SELECT * FROM n",
    "xbrl_numeric_parse": "SELECT entry_id, try_cast(regexp_replace(raw_text, '[^0-9.\\-]', '', 'g') AS DOUBLE) AS value, try_cast(regexp_replace(concat_ws('', '$', unit), '[^0-9.\\-]', '', 'g') AS DOUBLE) AS from_unit, try_cast(replace(replace(replace(trim(regexp_extract(raw_text, '[$]?[\\d,.]+%?$')), ',', ''), '$', ''), '%', '') AS DOUBLE) AS amount FROM kpi_agent",
    "xbrl_tag_counts": f"WITH t AS ({_TAGGED_SQL}), n AS (SELECT o_orderkey, count(*) AS total_tagged FROM t GROUP BY 1) SELECT t.o_orderkey, any_value(total_tagged) AS total_tagged, tag, count(*) AS n, CAST(least(any_value(total_tagged), 15) AS INTEGER) AS sampled FROM t JOIN n USING (o_orderkey) GROUP BY t.o_orderkey, tag",
    "ner_words": f"WITH t AS (SELECT doc_id, unnest(list_transform(range(0, CAST(ceil(length(text) / 2048.0) AS BIGINT)), lambda s: text[s * 2048 + 1 : s * 2048 + 2048])) AS t FROM documents WHERE length(text) > 0), m AS (SELECT doc_id, unnest(regexp_extract_all(t, {q.quote(_NAMES)}, 0)) AS word, unnest(regexp_extract_all(t, {q.quote(_NAMES)}, 1)) AS org FROM t) SELECT doc_id, word, CASE WHEN coalesce(org, '') <> '' THEN 'ORG' ELSE 'MISC' END AS entity_group, count(*) AS n FROM m GROUP BY ALL",
    "entity_type_counts": "SELECT user_id, coalesce(event_type, 'unknown') AS entity_group, count(*) AS n, min(event_id) AS first_ord FROM events GROUP BY 1, 2",
    "top_entity_type": "SELECT user_id, entity_group, n FROM (SELECT user_id, coalesce(event_type, 'unknown') AS entity_group, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1",
    "sentiment_document": f"WITH j AS ({_judged_sql(_SENTENCES, 'doc_id', 's')}), a AS (SELECT d.doc_id, coalesce(avg(score), 0.0::DOUBLE) AS score FROM documents d LEFT JOIN j ON d.doc_id = j.doc_id GROUP BY 1) SELECT doc_id, CASE WHEN score > 0.2 THEN 'positive' WHEN score < -0.2 THEN 'negative' ELSE 'neutral' END AS label, round(score, 6) AS score, score > 0.5 AS is_positive FROM a",
    "sentiment_chunks": f"SELECT chunk_id, label, round(score, 6) AS score, round(confidence, 6) AS confidence FROM ({_judged_sql(_CHUNKS, 'doc_id, chunk_id', 's')})",
    "sentiment_distribution": "SELECT doc_id, " + ", ".join(
        f"round(avg(CASE WHEN label = '{x}' THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS {x}" for x in ("positive", "neutral", "negative")
    ) + f" FROM ({_judged_sql(_CHUNKS, 'doc_id, chunk_id', 's')}) GROUP BY 1",
    "tone": f"SELECT o.doc_id, upper(o.label[1]) || o.label[2:] AS opening_tone, sign(o.score)::DOUBLE AS opening_score, upper(c.label[1]) || c.label[2:] AS closing_tone, sign(c.score)::DOUBLE AS closing_score, sign(c.score)::DOUBLE - sign(o.score)::DOUBLE AS tone_progression FROM ({_OPENING}) o JOIN ({_CLOSING}) c ON o.doc_id = c.doc_id",
    "json_source": "SELECT event_id, event_type AS text FROM events",
    "html_source": "SELECT p_partkey, p_name || ' & ' || p_brand || chr(10) || p_type AS text FROM part",
    "html_tables": "SELECT p_partkey, 0 AS table_ord, r AS row_ord, CASE WHEN r = 0 THEN 'name|size' ELSE p_name || '|' || p_size END AS cells FROM part, (VALUES (0), (1)) t(r)",
}

SQL["kpi_summary"] = SQL["kpi_totals"]
SQL["entity_summary"] = (
    f"SELECT t.user_id, c.entities, c.entity_types, entity_group AS top_type, n AS top_count FROM ({SQL['top_entity_type']}) t JOIN"
    f" (SELECT user_id, CAST(sum(n) AS BIGINT) AS entities, count(*) AS entity_types FROM ({SQL['entity_type_counts']}) GROUP BY 1) c"
    " ON t.user_id = c.user_id"
)

QUERIES = {name: globals()[name] for name in [*SQL, "ner_entities"]}
