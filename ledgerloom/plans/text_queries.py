"""Queries of the cleaning, metadata, section and chunking operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text as tx
from ledgerloom.operators import chunking as ch
from ledgerloom.plans import sqltools as q
from ledgerloom.session import table


def clean_whitespace(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.collapse_whitespace(F.col("text")).alias("text"))


def clean_unicode(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.fold_punctuation(F.col("text")).alias("text"))


def clean_strip_tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parsed_document").select("doc_id", tx.strip_tags(F.col("raw_text")).alias("text"))


def clean_entities_named(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.decode_named_entities(F.col("text")).alias("text"))


def clean_entities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.html_unescape(F.col("text")).alias("text"))


def clean_money(spark: SparkSession, d: str) -> DataFrame:
    """Amounts and percentages of the raw filings."""
    return table(spark, d, "parsed_document").select("doc_id", tx.normalize_amounts(F.col("raw_text")).alias("text"))


def clean_percent(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        "doc_id", tx.normalize_amounts(F.regexp_replace("text", r"\$", "USD ")).alias("text")
    )


def boilerplate_flags(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat_ws(
        " ",
        "text",
        F.when(F.col("doc_id") % 3 == 0, "Forward-looking statements apply.").when(F.col("doc_id") % 5 == 0, "Copyright 2024")
    )
    return table(spark, d, "documents").select("doc_id", tx.boilerplate_flags(text).alias("f")).select("doc_id", "f.*")


def clean_document(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parsed_document").select("doc_id", tx.clean_text(F.col("raw_text")).alias("text"))


def filename_metadata(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "parsed_document").select("doc_id", tx.filename_metadata(F.col("source_path")).alias("m"))
    return docs.select("doc_id", "m.*")


def earnings_call_flag(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("Operator: Welcome to the earnings call. "), F.col("raw_text"))
    return table(spark, d, "parsed_document").select(
        "doc_id", tx.earnings_call_flag(text).alias("as_written"), tx.earnings_call_flag(text, fixed=True).alias("ignoring_case")
    )


def _transcripts(spark: SparkSession, d: str) -> DataFrame:
    line = lambda who, c: F.concat(F.lit(f"{who}: "), F.coalesce(tx.collapse_whitespace(F.col(c)), F.lit("")), F.lit(";\n"))
    rag = table(spark, d, "rag_example").groupBy("sample_id").agg(
        *[F.max(c).alias(c) for c in ("question", "answer", "generated_answer")]
    )
    return rag.select(
        F.col("sample_id").alias("doc_id"),
        F.concat(line("Operator", "question"), line("Jane Roe", "answer"), line("Operator", "generated_answer")).alias("raw_text")
    )


def speaker_sections(spark: SparkSession, d: str) -> DataFrame:
    return ch.speaker_sections(_transcripts(spark, d))


def _filings(spark: SparkSession, d: str) -> DataFrame:
    """Whole filing texts with an item heading before each third of their length."""
    x, third = F.col("cleaned_text"), F.floor(F.length("cleaned_text") / 3).cast("int")
    parts = [
        F.lit("Contents\n"),
        F.lit("Item 7. "),
        F.substr(x, F.lit(1), third),
        F.lit("\nItem 1A. "),
        F.substr(x, third + 1, third),
        F.lit("\nITEM 8 "),
        F.substr(x, 2 * third + 1)
    ]
    docs = table(spark, d, "parsed_document").where("cleaned_text is not null").groupBy("doc_id").agg(
        F.max("cleaned_text").alias("cleaned_text")
    )
    return docs.select("doc_id", F.concat(*parts).alias("raw_text"))


def sec_sections(spark: SparkSession, d: str) -> DataFrame:
    return ch.sec_sections(_filings(spark, d))


def _flat(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.collapse_whitespace(F.col("text")).alias("text"))


def token_chunks(spark: SparkSession, d: str) -> DataFrame:
    return ch.token_windows(_flat(spark, d), ["doc_id"], "text")


def chunk_sentence_snap(spark: SparkSession, d: str) -> DataFrame:
    return ch.token_windows(_flat(spark, d), ["doc_id"], "text", snap=True)


def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    per = ch.token_windows(_flat(spark, d), ["doc_id"], "text").groupBy("doc_id")
    return per.agg(F.count(F.lit(1)).alias("chunks"), F.sum("token_count").alias("tokens"), F.max("token_count").alias("largest"))


def char_slices(spark: SparkSession, d: str) -> DataFrame:
    return ch.char_slices(table(spark, d, "documents"), ["doc_id"], "text")


def section_texts(spark: SparkSession, d: str) -> DataFrame:
    """Length and text of the sections that the filings' own section maps name."""
    docs = table(spark, d, "parsed_document").where("cleaned_text is not null").dropDuplicates(["doc_id"])
    rows = docs.select("doc_id", "cleaned_text", F.explode("section_map").alias("section", "s"))
    return rows.select(
        "doc_id",
        F.lower("section").alias("section"),
        ch.section_text(F.col("cleaned_text"), F.col("s.start_char"), F.col("s.end_char")).alias("text")
    )


def document_summary(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "parsed_document").groupBy("doc_id").agg(
        F.max(F.length("raw_text")).alias("raw_chars"),
        F.max(F.length("cleaned_text")).alias("clean_chars"),
        F.max(F.size(F.map_keys("section_map"))).alias("sections")
    )
    chunks = table(spark, d, "document_chunk").groupBy("doc_id").agg(F.count_distinct("chunk_id").alias("chunks"))
    return docs.join(chunks, "doc_id", "left").select(
        "doc_id", "raw_chars", "clean_chars", "sections", F.coalesce("chunks", F.lit(0)).alias("chunks")
    )


_MONEY_SQL = "raw_text"
for _unit, _names in tx.MONEY.items():
    _MONEY_SQL = q.substitute(
        _MONEY_SQL,
        rf"(?i)\$({q.SPACE}*[\d,]*\d[\d,]*(?:\.\d+)?){q.SPACE}*(?:{_names})({q.SPACE[:-1]}.,;)]|$)",
        f"'$' || format('{{:.2f}}', regexp_replace({{g1}}, '[^0-9.]', '', 'g')::DOUBLE) || '{_unit}' || {{g2}}"
    )
_PERCENT_SQL = q.substitute("{x}", rf"(?i)([\d,]+(?:\.\d+)?){q.SPACE}*(percent|percentage|%)", "replace({g1}, ',', '') || '%'")
_FLAT_SQL = f"SELECT doc_id, {q.collapse('text')} AS text FROM documents WHERE text IS NOT NULL"
_WINDOWS_SQL = f"""
WITH flat AS ({_FLAT_SQL}), words AS (SELECT doc_id, text, string_split(text, ' ') AS w FROM flat WHERE text <> ''),
k AS (SELECT doc_id, text, w, len(w) AS n, unnest(range(0, CASE WHEN len(w) <= 512 THEN 1 ELSE CAST(ceil((len(w) - 512) / 448.0) AS BIGINT) + 1 END)) AS ord FROM words),
p AS (SELECT doc_id, text, n, CAST(ord AS INTEGER) AS ord, array_to_string(list_slice(w, ord * 448 + 1, least(ord * 448 + 512, n)), ' ') AS piece,
  CASE WHEN ord = 0 THEN 0 ELSE length(array_to_string(list_slice(w, 1, ord * 448), ' ')) + 1 END AS local_start FROM k)
"""


def _windows_sql(piece: str) -> str:
    return _WINDOWS_SQL + f"SELECT doc_id, ord, text, CAST(len(string_split(text, ' ')) AS INTEGER) AS token_count, CAST(local_start AS INTEGER) AS local_start FROM (SELECT doc_id, ord, local_start, CASE WHEN n > 512 THEN trim({piece}) ELSE text END AS text FROM p)"


def _sections_sql() -> str:
    items = list(enumerate(ch.SEC_ITEMS.items()))
    # place of an item behind a start: the length of the lazily matched text before it
    at = lambda t, item: f"CASE WHEN regexp_matches({t}, '\\b{item}\\b') THEN length(regexp_extract({t}, '(?s)^(.*?)\\b{item}\\b', 1)) END"
    out = []
    for i, (item, section) in items:
        rest = f"substr(low, start + 1 + {len(item)})"
        others = ", ".join(at(rest, o) for _, (o, _s) in items if o != item)
        out.append(
            f"SELECT doc_id, {i} AS ord, '{section}' AS section, CAST(start AS INTEGER) AS start, CAST(coalesce(start + {len(item)} + least({others}), n) AS INTEGER) AS \"end\" FROM (SELECT doc_id, low, length(low) AS n, {at('low', item)} AS start FROM t) WHERE start IS NOT NULL"
        )
    base = "WITH t AS (SELECT doc_id, lower('Contents' || chr(10) || 'Item 7. ' || substr(x, 1, k) || chr(10) || 'Item 1A. ' || substr(x, k + 1, k) || chr(10) || 'ITEM 8 ' || substr(x, 2 * k + 1)) AS low FROM (SELECT doc_id, max(cleaned_text) AS x, CAST(floor(length(max(cleaned_text)) / 3) AS INTEGER) AS k FROM parsed_document WHERE cleaned_text IS NOT NULL GROUP BY doc_id))"
    return base + " UNION ALL ".join(out)


_STEM = "regexp_replace(regexp_extract(source_path, '([^/\\\\]*)$', 1), '(.)\\.[^.]*$', '\\1')"
_TURNS = f"SELECT sample_id AS doc_id, coalesce({q.collapse('max(question)')}, '') AS a, coalesce({q.collapse('max(answer)')}, '') AS b, coalesce({q.collapse('max(generated_answer)')}, '') AS c FROM rag_example GROUP BY sample_id"

SQL = {
    "clean_whitespace": f"SELECT doc_id, {q.collapse('text')} AS text FROM documents",
    "clean_unicode": f"SELECT doc_id, {q.fold('text')} AS text FROM documents",
    "clean_strip_tags": "SELECT doc_id, regexp_replace(raw_text, '<[^>]+>', '', 'g') AS text FROM parsed_document",
    "clean_entities_named": f"SELECT doc_id, {q.entities('text')} AS text FROM documents",
    "clean_entities": f"SELECT doc_id, {q.entities('text')} AS text FROM documents",
    "clean_money": f"SELECT doc_id, CASE WHEN raw_text IS NOT NULL THEN {_PERCENT_SQL.replace('{x}', _MONEY_SQL)} END AS text FROM parsed_document",
    "clean_percent": "SELECT doc_id, CASE WHEN text IS NOT NULL THEN " + _PERCENT_SQL.replace(
        "{x}", "replace(text, '$', 'USD ')"
    ) + " END AS text FROM documents",
    "boilerplate_flags": f"SELECT doc_id, regexp_matches(t, {q.quote(tx.SAFE_HARBOUR)}) AS safe_harbour, regexp_matches(t, {q.quote(tx.COPYRIGHT)}) AS copyright FROM (SELECT doc_id, concat_ws(' ', text, CASE WHEN doc_id % 3 = 0 THEN 'Forward-looking statements apply.' WHEN doc_id % 5 = 0 THEN 'Copyright 2024' END) AS t FROM documents)",
    "clean_document": "SELECT doc_id, CASE WHEN raw_text IS NOT NULL THEN " + q.collapse(
        _PERCENT_SQL.replace(
            "{x}", _MONEY_SQL.replace("raw_text", q.fold("regexp_replace(" + q.entities("raw_text") + ", '<[^>]+>', '', 'g')"))
        )
    ) + " END AS text FROM parsed_document",
    "filename_metadata": f"SELECT doc_id, nullif(upper(regexp_extract(s, {q.quote(tx.TICKER_IN_NAME)}, 1)), '') AS ticker, nullif(upper(regexp_extract(s, {q.quote(tx.PERIOD_IN_NAME)}, 1)) || regexp_extract(s, {q.quote(tx.PERIOD_IN_NAME)}, 2), '') AS fiscal_period, CASE WHEN upper(regexp_extract(s, {q.quote(tx.TYPE_IN_NAME)}, 1)) IN ('10-K', '10-Q') THEN upper(regexp_extract(s, {q.quote(tx.TYPE_IN_NAME)}, 1)) ELSE 'unknown' END AS doc_type FROM (SELECT doc_id, {_STEM} AS s FROM parsed_document)",
    "earnings_call_flag": "SELECT doc_id, " + ", ".join(
        "(" + " + ".join(
            f"coalesce(CAST(regexp_matches(s, {q.quote(i + p)}) AS INTEGER), 0)" for p in tx.CALL_SIGNS
        ) + f") >= 2 AS {name}"
        for i, name in (("", "as_written"), ("(?i)", "ignoring_case"))
    ) + " FROM (SELECT doc_id, lower(substr('Operator: Welcome to the earnings call. ' || raw_text, 1, 5000)) AS s FROM parsed_document)",
    "speaker_sections": f"WITH t AS ({_TURNS}), e AS (SELECT doc_id, length(a) + 12 AS e1, length(a) + 12 + length(b) + 12 AS e2, length(a) + 12 + length(b) + 12 + length(c) + 12 AS e3 FROM t) SELECT doc_id, CAST(o AS INTEGER) AS ord, s AS section, CAST(x AS INTEGER) AS start, CAST(y AS INTEGER) AS \"end\" FROM (SELECT doc_id, 0 AS o, 'operator' AS s, 0 AS x, e1 AS y FROM e UNION ALL SELECT doc_id, 1, 'jane roe', e1, e2 FROM e UNION ALL SELECT doc_id, 2, 'operator_1', e2, e3 FROM e)",
    "sec_sections": _sections_sql(),
    "token_chunks": _windows_sql("piece"),
    "chunk_sentence_snap": _windows_sql(
        "CASE WHEN regexp_extract(piece, '(?s)^(.*[.!?])(?:\\s|$)', 1) <> '' THEN regexp_extract(piece, '(?s)^(.*[.!?])(?:\\s|$)', 1) ELSE piece END"
    ),
    "chunk_stats": f"SELECT doc_id, count(*) AS chunks, CAST(sum(token_count) AS BIGINT) AS tokens, max(token_count) AS largest FROM ({_windows_sql('piece')}) GROUP BY doc_id",
    "char_slices": "SELECT doc_id, CAST(s AS INTEGER) AS slice, substr(text, s * 2048 + 1, 2048) AS text FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 2048.0) AS BIGINT))) AS s FROM documents WHERE length(text) > 0)",
    "section_texts": "SELECT doc_id, lower(e.key) AS section, substr(t, e.value.start_char + 1, greatest(e.value.end_char - e.value.start_char, 0)) AS text FROM (SELECT doc_id, t, unnest(map_entries(m)) AS e FROM (SELECT doc_id, any_value(cleaned_text) AS t, any_value(section_map) AS m FROM parsed_document WHERE cleaned_text IS NOT NULL GROUP BY doc_id))",
    "document_summary": "SELECT p.doc_id, raw_chars, clean_chars, sections, coalesce(chunks, 0) AS chunks FROM (SELECT doc_id, CAST(max(length(raw_text)) AS INTEGER) AS raw_chars, CAST(max(length(cleaned_text)) AS INTEGER) AS clean_chars, CAST(max(len(map_keys(section_map))) AS INTEGER) AS sections FROM parsed_document GROUP BY doc_id) p LEFT JOIN (SELECT doc_id, count(DISTINCT chunk_id) AS chunks FROM document_chunk GROUP BY doc_id) c ON p.doc_id = c.doc_id",
}

QUERIES = {name: globals()[name] for name in SQL}
