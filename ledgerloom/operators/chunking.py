"""Sections, token windows, sentence boundaries and slices of filing texts; all narrow, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import regex_spans
from ledgerloom.settings import DEFAULT

# Fixed values.
SEC_ITEMS = {"item 1a": "risk_factors", "item 1b": "unresolved_staff_comments", "item 7": "mda", "item 8": "financial_statements"}
CHUNK_TYPES = {"mda": "mda", "risk_factors": "risk_factors", "financial_statements": "financial_statements"}


def chunk_type(section: Column) -> Column:
    return F.coalesce(F.when(section.isin(*CHUNK_TYPES), section), F.lit("general"))


def _first(text: Column, item: str) -> Column:
    """Zero-based place of the first whole occurrence of an item, -1 where there is none."""
    return F.regexp_instr(text, F.lit(rf"\b{item}\b")).cast("int") - 1


def sec_sections(docs: DataFrame, text: str = "raw_text") -> DataFrame:
    """(doc_id, ord, section, start, end): each item's first occurrence up to the nearest other item behind it."""
    low = F.lower(F.col(text))
    found = []
    for ord_, (item, section) in enumerate(SEC_ITEMS.items()):
        start = _first(low, item)
        rest = F.substr(low, start + 1 + len(item))
        others = [F.when(_first(rest, o) >= 0, _first(rest, o)) for o in SEC_ITEMS if o != item]
        end = F.coalesce(start + len(item) + F.least(*others), F.length(text))
        found.append(F.struct(F.lit(ord_).alias("ord"), F.lit(section).alias("section"), start.alias("start"), end.alias("end")))
    rows = docs.where(F.col(text).isNotNull()).select("doc_id", F.explode(F.array(*found)).alias("_s"))
    return rows.where("_s.start >= 0").select("doc_id", "_s.*")


def section_text(text: Column, start: Column, end: Column) -> Column:
    """The slice [start, end) of a text, in zero-based characters."""
    return F.substr(text, start + 1, F.greatest(end - start, F.lit(0)))


def speaker_sections(docs: DataFrame, text: str = "raw_text") -> DataFrame:
    """(doc_id, ord, section, start, end): turns of a transcript; a repeated speaker gets the suffix _1, _2, ..."""
    turns = docs.select(
        "doc_id", F.length(text).alias("n"), F.posexplode(regex_spans(F.col(text), r"(?m)^([A-Za-z\s\-.]+?):\s*")).alias("ord", "m")
    )
    order = Window.partitionBy("doc_id").orderBy("ord")
    name = F.lower(F.trim(F.regexp_replace(F.col("m.groups")[0], r"^\s+|\s+$", "")))
    turns = turns.select(
        "doc_id",
        "ord",
        name.alias("speaker"),
        F.col("m.start").alias("start"),
        F.coalesce(F.lead("m.start").over(order), F.col("n")).alias("end")
    )
    again = F.row_number().over(Window.partitionBy("doc_id", "speaker").orderBy("ord")) - 1
    return turns.withColumn("again", again).select(
        "doc_id",
        "ord",
        F.when(F.col("again") == 0, F.col("speaker")).otherwise(F.concat_ws("_", "speaker", "again")).alias("section"),
        "start",
        "end"
    )


def last_sentence(piece: Column) -> Column:
    """Length of a piece up to its last sentence end (. ! or ? before a space or the piece's end), 0 where there is none."""
    return F.length(F.regexp_extract(piece, r"(?s)^(.*[.!?])(?=\s|$)", 1))


def token_windows(
    texts: DataFrame,
    keys: list[str],
    text: str,
    limit: int = DEFAULT.max_tokens,
    overlap: int = DEFAULT.overlap_tokens,
    snap: bool = False
) -> DataFrame:
    """(keys, ord, text, token_count, local_start): windows of ``limit`` tokens that repeat ``overlap`` of them.

    The start of window k is k * (limit - overlap), so the windows of a text are one explode. Tokens are separated by
    single spaces. ``snap`` ends a window at the last sentence end within it. A text within the limit stays whole;
    blank and null texts give no rows.
    """
    step = limit - overlap
    base = texts.where(F.col(text).isNotNull() & (F.trim(text) != "")).select(*keys, F.col(text).alias("_t"))
    base = base.withColumn("_w", F.split("_t", " ")).withColumn("_n", F.size("_w"))
    last = F.when(F.col("_n") <= limit, F.lit(0)).otherwise(F.ceil((F.col("_n") - limit) / step).cast("int"))
    # length of each stride of tokens with its trailing space: prefix sums over them give the windows' places
    strides = F.transform(
        F.sequence(F.lit(0), last), lambda k: F.length(F.array_join(F.slice("_w", k * step + 1, F.lit(step)), " ")) + 1
    )
    rows = base.withColumn("_l", strides).withColumn("ord", F.explode(F.sequence(F.lit(0), last)))
    start, end = F.col("ord") * step, F.least(F.col("ord") * step + limit, F.col("_n"))
    place = F.aggregate(F.slice("_l", F.lit(1), F.col("ord")), F.lit(0), lambda t, x: t + x)
    rows = rows.withColumn("_s", place).withColumn("_p", F.array_join(F.slice("_w", start + 1, end - start), " "))
    piece = F.col("_p")
    if snap:
        piece = F.when(last_sentence(piece) > 0, F.substr(piece, F.lit(1), last_sentence(piece))).otherwise(piece)
    piece = F.when(F.col("_n") > limit, F.trim(piece)).otherwise(F.col("_t"))
    out = rows.withColumn("text", piece).where(F.col("text") != "")
    return out.select(*keys, "ord", "text", F.size(F.split("text", " ")).alias("token_count"), F.col("_s").alias("local_start"))


def chunk_documents(docs: DataFrame, sections: DataFrame | None = None, text: str = "cleaned_text", snap: bool = True) -> DataFrame:
    """Chunks of documents: by section where a document has sections (text outside is left out), else of the whole.

    Ids are hashes of document, section and place, so that a repeated run replaces its own chunks.
    """
    plain = docs.select("doc_id", F.col(text).alias("body"))
    if sections is None:
        units = plain.select(
            "doc_id", F.lit(-1).alias("sec_ord"), F.lit(None).cast("string").alias("section"), F.lit(0).alias("sec_start"), "body"
        )
    else:
        inside = plain.join(sections.select("doc_id", F.col("ord").alias("sec_ord"), "section", "start", "end"), "doc_id", "left")
        body = F.when(F.col("section").isNull(), F.col("body")).otherwise(section_text(F.col("body"), F.col("start"), F.col("end")))
        units = inside.select(
            "doc_id",
            F.coalesce("sec_ord", F.lit(-1)).alias("sec_ord"),
            "section",
            F.coalesce("start", F.lit(0)).alias("sec_start"),
            body.alias("body")
        )
    w = token_windows(units, ["doc_id", "sec_ord", "section", "sec_start"], "body", snap=snap)
    ident = F.sha2(
        F.concat_ws("\u0001", F.col("doc_id").cast("string"), F.coalesce("section", F.lit("")), F.col("ord").cast("string")), 256
    )
    return w.select(
        "doc_id",
        ident.alias("chunk_id"),
        "sec_ord",
        "ord",
        "section",
        chunk_type(F.col("section")).alias("chunk_type"),
        "text",
        "token_count",
        "local_start",
        (F.col("sec_start") + F.col("local_start")).alias("start_offset"),
        F.lit(None).cast("int").alias("page_number")
    )


def char_slices(texts: DataFrame, keys: list[str], text: str, size: int = DEFAULT.slice_chars) -> DataFrame:
    """(keys, slice, text): consecutive slices of ``size`` characters; empty and null texts give no rows."""
    rows = texts.where(F.length(text) > 0).withColumn(
        "slice", F.explode(F.sequence(F.lit(0), F.ceil(F.length(text) / size).cast("int") - 1))
    )
    return rows.select(*keys, "slice", F.substr(F.col(text), F.col("slice") * size + 1, F.lit(size)).alias("text"))
