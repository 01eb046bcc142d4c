"""Cleaning of filing text as column expressions; Python only where Spark has no equivalent."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space as Python sees it, dash and quote folding, patterns of amounts and boilerplate.
SPACE = r"[\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
DASHES_AND_QUOTES = ("\u2010\u2011\u2012\u2013\u2014\u2015\u201c\u201d\u2018\u2019", "------\"\"''")
NAMED_ENTITIES = (
    ("&nbsp;", "\u00a0"), ("&quot;", '"'), ("&mdash;", "\u2014"), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")
)
MONEY = {"B": "billion|B", "M": "million|M", "K": "thousand|K"}
PERCENT = r"([\d,]+(?:\.\d+)?)\s*(?:percent|percentage|%)"
SAFE_HARBOUR = r"(?i)(safe\s+harbour|forward[-\s]?looking\s+statements?|forward[-\s]?looking\s+information)"
COPYRIGHT = r"(?i)(©|\(c\)\s*\d{4}|copyright\s*(?:©)?\s*\d{4})"

_AMOUNTS = [(re.compile(rf"\$\s*([\d,]+(?:\.\d+)?)\s*(?:{names})(?=[\s.,;)]|$)", re.I), unit) for unit, names in MONEY.items()]
_PERCENT = re.compile(PERCENT, re.I)


def collapse_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def fold_punctuation(c: Column) -> Column:
    return F.translate(c, *DASHES_AND_QUOTES)


def strip_tags(c: Column) -> Column:
    """Tags are replaced by nothing, so that words on both sides can fuse."""
    return F.regexp_replace(c, "<[^>]+>", "")


def decode_named_entities(c: Column) -> Column:
    """The frequent entities without leaving the JVM; the ampersand comes last."""
    for name, char in NAMED_ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def boilerplate_flags(c: Column) -> Column:
    return F.struct(c.rlike(SAFE_HARBOUR).alias("safe_harbour"), c.rlike(COPYRIGHT).alias("copyright"))


def _amount(unit: str):
    def put(m: re.Match) -> str:
        digits = m[1].replace(",", "")
        return f"${float(digits):.2f}{unit}" if digits else m[0]

    return put


def normalize_amounts_py(text: str) -> str:
    for pattern, unit in _AMOUNTS:
        text = pattern.sub(_amount(unit), text)
    return _PERCENT.sub(lambda m: m[1].replace(",", "") + "%", text)


@F.pandas_udf(T.StringType())
def html_unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


@F.pandas_udf(T.StringType())
def normalize_amounts(texts: pd.Series) -> pd.Series:
    """ "$ 1,234.5 billion" becomes "$1234.50B", "12.5 percent" becomes "12.5%"; rounding is that of binary numbers."""
    return texts.map(normalize_amounts_py, na_action="ignore")


_TAGS = re.compile("<[^>]+>")
_FOLD = str.maketrans(*DASHES_AND_QUOTES)


def clean_text_py(text: str) -> str:
    text = _TAGS.sub("", html.unescape(text) if "&" in text else text).translate(_FOLD)
    # as Python sees white space, which str.split shares
    return " ".join((normalize_amounts_py(text) if "$" in text or "%" in text or "ercent" in text.lower() else text).split())


@F.pandas_udf(T.StringType())
def _clean_text(texts: pd.Series) -> pd.Series:
    return texts.map(clean_text_py, na_action="ignore")


def clean_text(c: Column) -> Column:
    """Entities, tags, dashes and quotes, amounts, white space, in this order; null stays null.

    Entities and amounts need Python, so all steps are taken in one trip there.
    """
    return _clean_text(c)


_SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("groups", T.ArrayType(T.StringType()))
        ]
    )
)


def regex_spans(c: Column, pattern: str, flags: int = 0) -> Column:
    """All matches with their offsets and groups, which Spark's expressions can't give."""
    compiled = re.compile(pattern, flags)

    @F.pandas_udf(_SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [(m.start(), m.end(), list(m.groups())) for m in compiled.finditer(t)])

    return spans(c)


def words(c: Column) -> Column:
    """Space-separated words, lower-cased; empty for a blank text."""
    flat = F.lower(collapse_whitespace(c))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


# Spellings in file names.
TICKER_IN_NAME = r"(?i)^([A-Z]{1,5})[\s_-]"
PERIOD_IN_NAME = r"(?i)(FY|Q1|Q2|Q3|Q4)[\s_-]?(\d{4})"
TYPE_IN_NAME = r"(?i)(10-K|10-Q|10K|10Q)"


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(.)\.[^.]*$", "$1")


def filename_metadata(path: Column, prior_type: Column | None = None, fixed: bool = False) -> Column:
    """(ticker, fiscal_period, doc_type) from a file name. Unhyphenated types don't count unless ``fixed``."""
    stem = file_stem(path)
    kind = F.upper(F.regexp_extract(stem, TYPE_IN_NAME, 1))
    if fixed:
        kind = F.regexp_replace(kind, "^10([KQ])$", "10-$1")
    period = F.concat(F.upper(F.regexp_extract(stem, PERIOD_IN_NAME, 1)), F.regexp_extract(stem, PERIOD_IN_NAME, 2))
    return F.struct(
        F.nullif(F.upper(F.regexp_extract(stem, TICKER_IN_NAME, 1)), F.lit("")).alias("ticker"),
        F.nullif(period, F.lit("")).alias("fiscal_period"),
        F.when(kind.isin("10-K", "10-Q"), kind).otherwise(
            prior_type if prior_type is not None else F.lit("unknown")
        ).alias("doc_type"),
    )


# Signs of an earnings call.
CALL_SIGNS = (
    r"\b(Operator|Moderator):",
    r"\b(Analysts?|Participants?|Speakers?):",
    r"(Q&A|Question and Answer)",
    r"\b(earnings call|earnings? (conference )?call)\b"
)


def earnings_call_flag(c: Column, fixed: bool = False) -> Column:
    """At least two signs in the first 5,000 lower-cased characters; as the capitals of three signs never match there,
    the flag is never set unless ``fixed`` ignores case."""
    sample = F.lower(F.substring(c, 1, 5000))
    hits = [F.coalesce(sample.rlike(("(?i)" if fixed else "") + p), F.lit(False)).cast("int") for p in CALL_SIGNS]
    return sum(hits[1:], hits[0]) >= 2


def parse_number(c: Column) -> Column:
    """Digits, points and signs of a tagged span as a number; null where they make none."""
    return F.regexp_replace(c, r"[^0-9.\-]", "").try_cast("double")


def parse_amount(c: Column) -> Column:
    return F.translate(F.trim(c), ",$%", "").try_cast("double")
