"""Readers of filings and evaluation sets.

A folder of files is read through Spark's binary source, so each file is one row and parsing is a column expression;
what can't be read ends in a table of rejects with the reason, and never fails the job.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.text import earnings_call_flag, filename_metadata
from ledgerloom.ports import PdfReader

# Fields that may hold a JSON document's text, in order of preference; formats.
JSON_FIELDS = ("text", "content", "body", "document", "data")
FORMATS = {".pdf": "pdf", ".htm": "html", ".html": "html", ".txt": "txt", ".json": "json"}
_SKIPPED = frozenset({"script", "style"})


def json_document(raw: str) -> str:
    """Text of a JSON document: the first string among the known fields, a string itself, else the document as text."""
    value = json.loads(raw)
    if isinstance(value, str):
        return value
    if isinstance(value, dict):
        found = next((value[f] for f in JSON_FIELDS if isinstance(value.get(f), str)), "")
        return found or json.dumps(value, indent=2)
    return str(value)


@F.pandas_udf(T.StringType())
def _json_document(raw: pd.Series) -> pd.Series:
    def one(x: str | None) -> str | None:
        try:
            return None if x is None else json_document(x)
        except ValueError:
            return None

    return raw.map(one)


def json_text(c: Column) -> Column:
    """As ``json_document``; null where the text is no JSON. The usual case, a string field, stays in the JVM."""
    v = F.try_parse_json(c)
    fields = [F.try_variant_get(v, f"$.{f}", "string") for f in JSON_FIELDS]
    kinds = [F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant")) for f in JSON_FIELDS]
    picked = F.coalesce(*[F.when(k == "STRING", x) for x, k in zip(fields, kinds)])
    return F.when(F.nullif(picked, F.lit("")).isNotNull(), picked).otherwise(_json_document(c))


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.skip = 0
        self.buffer = ""

    def flush(self) -> None:
        if text := self.buffer.strip():
            self.parts.append(text)
        self.buffer = ""

    def handle_starttag(self, tag, attrs):
        self.flush()
        self.skip += tag in _SKIPPED

    def handle_endtag(self, tag):
        self.flush()
        self.skip -= tag in _SKIPPED and self.skip > 0

    def handle_data(self, data):
        if not self.skip:
            self.buffer += data


def html_document(raw: str) -> str:
    """Stripped texts between the tags, one a line, without scripts and styles."""
    p = _Text()
    p.feed(raw)
    p.close()
    p.flush()
    return "\n".join(p.parts)


@F.pandas_udf(T.StringType())
def _html_document(raw: pd.Series) -> pd.Series:
    return raw.map(html_document, na_action="ignore")


def html_text(c: Column) -> Column:
    return _html_document(c)


class _Tables(HTMLParser):
    """Cells by table and row; a row of a nested table belongs to the outer one as well."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[str]]] = []
        self.open: list[int] = []
        self.rows: list[list[list[str]]] = []
        self.cells: list[list[str]] = []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
            self.open.append(len(self.tables) - 1)
        elif tag == "tr" and self.open:
            row: list[str] = []
            for t in self.open:
                self.tables[t].append(row)
            self.rows.append([row])
        elif tag in ("td", "th") and self.rows:
            self.cells.append([])

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cells:
            text = "".join(self.cells.pop())
            for row in self.rows[-1] if self.rows else []:
                row.append(text)
        elif tag == "tr" and self.rows:
            self.rows.pop()
        elif tag == "table" and self.open:
            self.open.pop()

    def handle_data(self, data):
        for cell in self.cells:
            cell.append(data.strip())


def html_tables(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, table_ord, row_ord, cells): rows of all tables; empty rows and empty tables are left out."""
    kind = pages.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, raw in zip(b["k"], b["h"]):
                p = _Tables()
                p.feed(raw)
                p.close()
                kept = [[r for r in t if r] for t in p.tables]
                for i, t in enumerate([t for t in kept if t]):
                    rows += [(k, i, j, r) for j, r in enumerate(t)]
            yield pd.DataFrame(rows, columns=[key, "table_ord", "row_ord", "cells"])

    live = pages.where(F.col(html).isNotNull()).select(F.col(key).alias("k"), F.col(html).alias("h"))
    return live.mapInPandas(run, f"{key} {kind}, table_ord int, row_ord int, cells array<string>")


def read_documents(
    spark: SparkSession, path: str, pdf: PdfReader | None = None, fixed: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects) of a file, folder or glob; the format is the lower-cased suffix.

    Without a PDF reader, PDF files are rejects. ``fixed`` mends file types without hyphen and the detection of calls.
    """
    return parse_files(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), pdf, fixed)


def parse_files(found: DataFrame, pdf: PdfReader | None = None, fixed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects) of files (path, content), as ``read_documents`` makes them."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./\\]*)$", 1))
    files = found.withColumn("format", F.coalesce(*[F.when(suffix == s, F.lit(f)) for s, f in FORMATS.items()]))
    raw = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "\ufffd", "")
    text = F.when(F.col("format") == "html", html_text(raw)).when(
        F.col("format") == "json", json_text(raw)
    ).when(F.col("format") == "txt", raw)
    readable = F.col("format").isin("html", "json", "txt")
    if pdf is not None:
        text = text.when(
            F.col("format") == "pdf",
            F.array_join(F.transform(pdf_pages(F.col("content"), pdf), lambda p: F.coalesce(p, F.lit(""))), "\n")
        )
        readable = F.col("format").isNotNull()
    named = files.where(readable).select("path", "content", "format").withColumn("raw_text", text)
    call = earnings_call_flag(F.col("raw_text"), fixed) & (F.col("format") == "txt")
    meta = filename_metadata(F.col("path"), F.when(call, "earnings_call").otherwise("unknown"), fixed)
    docs = named.where("raw_text is not null").select(
        F.sha2("path", 256).alias("doc_id"), F.col("path").alias("source_path"), meta.alias("m"), "raw_text", "format"
    )
    # contents are read again only for the formats whose parsing can fail
    reason = F.when(F.col("format").isNull(), "unsupported format").otherwise("no PDF reader")
    refused = files.where(~F.coalesce(readable, F.lit(False))).select("path", reason.alias("reason"))
    failed = named.where(F.col("format").isin("json", "pdf") & F.col("raw_text").isNull()).select(
        "path", F.lit("not readable").alias("reason")
    )
    return docs.select(
        "doc_id", "source_path", "m.doc_type", "m.ticker", "m.fiscal_period", "raw_text", "format"
    ), refused.unionByName(failed)


def pdf_pages(content: Column, pdf: PdfReader) -> Column:
    """Texts of a file's pages in order; null for a file that can't be read."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def read(files: pd.Series) -> pd.Series:
        def one(x: bytes | None) -> list[str] | None:
            try:
                return None if x is None else list(pdf.pages(x))
            except Exception:  # a port may fail in any way; the file becomes a reject
                return None

        return files.map(one)

    return read(content)


def page_map(pages: Column) -> Column:
    """page_1, page_2, ... -> characters on the pages up to it; the separators between pages don't count."""
    lengths = F.transform(pages, lambda p: F.length(F.coalesce(p, F.lit(""))))
    return F.map_from_entries(
        F.transform(
            pages,
            lambda p, i: F.struct(
                F.concat(F.lit("page_"), (i + 1).cast("string")),
                F.aggregate(F.slice(lengths, F.lit(1), i + 1), F.lit(0), lambda t, n: t + n)
            )
        )
    )


def page_offsets(pages: DataFrame, key: str, number: str, text: str) -> DataFrame:
    """(key, number, start, end): places of the pages in the text that joins them by a line break."""
    w = Window.partitionBy(key).orderBy(number).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = pages.select(key, number, F.length(F.coalesce(text, F.lit(""))).alias("_n"))
    end = F.sum("_n").over(w) + F.row_number().over(Window.partitionBy(key).orderBy(number)) - 1
    return rows.withColumn("end", end.cast("long")).select(key, number, (F.col("end") - F.col("_n")).alias("start"), "end")


def pdf_tables(files: DataFrame, key: str, content: str, pdf: PdfReader) -> DataFrame:
    """(key, page, table_ord, row_ord, cells, source): rows of the tables of PDF files; unreadable files give none."""
    kind = files.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, x in zip(b["k"], b["c"]):
                try:
                    tables = list(pdf.tables(x))
                except Exception:  # as above
                    continue
                for i, (page, table) in enumerate(tables):
                    rows += [(k, page, i, j, [None if c is None else str(c) for c in r], "pdf") for j, r in enumerate(table)]
            yield pd.DataFrame(rows, columns=[key, "page", "table_ord", "row_ord", "cells", "source"])

    live = files.where(F.col(content).isNotNull()).select(F.col(key).alias("k"), F.col(content).alias("c"))
    return live.mapInPandas(run, f"{key} {kind}, page int, table_ord int, row_ord int, cells array<string>, source string")


# Keys under which an evaluation file may hold its samples.
CONTAINERS = ("samples", "data", "examples")


def read_eval_set(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(sample_id, sample): the samples of a bare list, of the first list among the containers, or a single object.

    ``sample`` is JSON text: evaluators take from it the fields they know. A file without samples or with other entries
    raises an error.
    """
    whole = spark.read.text(path, wholetext=True)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def samples(raw: pd.Series) -> pd.Series:
        def one(x: str) -> list[str]:
            value = json.loads(x)
            if isinstance(value, dict):
                value = next((value[c] for c in CONTAINERS if isinstance(value.get(c), list)), [value])
            if not all(isinstance(v, dict) for v in value):
                raise ValueError("an evaluation set must hold objects")
            return [json.dumps(v) for v in value]

        return raw.map(one)

    files = whole.select(F.input_file_name().alias("_f"), samples(F.col("value")).alias("_s"))
    # files in the order of their names; one small row a file decides where its numbers start
    names = files.select("_f", F.size("_s").alias("_n"))
    start = names.select("_f", (F.sum("_n").over(Window.orderBy("_f")) - F.col("_n")).alias("_b"))
    rows = files.join(F.broadcast(start), "_f").select("_b", F.posexplode("_s").alias("_i", "sample")).select(
        (F.col("_b") + F.col("_i")).cast("int").alias("sample_id"), "sample"
    )
    return rows if limit is None else rows.where(F.col("sample_id") < limit)


def alias(sample: Column, *names: str) -> Column:
    """The first present of several keys of a JSON sample, as text."""
    return F.coalesce(*[F.get_json_object(sample, f"$.{n}") for n in names])


