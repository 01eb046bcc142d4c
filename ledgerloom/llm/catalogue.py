"""Queries of the training-data operators, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm import format_copies as fc
from ledgerloom.llm import answer_defects, bagminhash, classes, leaks, mixing, quantised_search, shared_spans, splitting
from ledgerloom.session import table


_SPACES = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = fc.format_copies(fc.passages(table(spark, d, "rag_example")), "chunk_id", "text")
    return found.where("record <> least").select(F.col("least").alias("chunk_id_a"), F.col("record").alias("chunk_id_b")).distinct()


def p1_passages(spark: SparkSession, d: str) -> DataFrame:
    """One record per distinct passage with the number of its copies."""
    found = fc.format_copies(fc.passages(table(spark, d, "rag_example")), "chunk_id", "text")
    return found.where("record = least").select(F.col("record").alias("chunk_id"), "copies").distinct()


def _answers(spark: SparkSession, d: str) -> tuple:
    return table(spark, d, "rag_example"), "sample_id", "question", (
        "answer", "generated_answer"
    ), table(spark, d, "documents").select("text", "lang")


def _answer_labels(spark: SparkSession, d: str) -> DataFrame:
    return answer_defects.label_answers(*_answers(spark, d))


def p1_prose(spark: SparkSession, d: str) -> DataFrame:
    """Copies among the passages that have no mark of a field list."""
    prose = fc.passages(table(spark, d, "rag_example")).where(~F.col("text").rlike("[:=>]"))
    return fc.format_copies(prose, "chunk_id", "text").select(
        F.col("record").alias("chunk_id"), F.col("least").alias("same_as"), "copies"
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = answer_defects.single_label(_answer_labels(spark, d))
    return found.select(F.col("key").alias("sample_id"), F.col("field").alias("answer_field"), "defect")


def p2_labels(spark: SparkSession, d: str) -> DataFrame:
    """Every label kept, with its posterior: an answer may have several."""
    return _answer_labels(spark, d).select(
        F.col("key").alias("sample_id"), F.col("field").alias("answer_field"), "defect", F.round("posterior", 4).alias("posterior")
    )


def p2_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    """The cutoff of each defect with its precision and recall on planted defects."""
    return answer_defects.validated_cutoffs(*_answers(spark, d))


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Ordered pieces of every filing text and chunk text of more than 512 tokens; a re-delivered row is split once."""
    docs = splitting.split_oversized(table(spark, d, "parsed_document"), "document", "doc_id", "cleaned_text")
    chunks = splitting.split_oversized(table(spark, d, "document_chunk"), "chunk", "chunk_id", "text")
    return docs.unionByName(chunks).dropDuplicates(["record_kind", "record_key", "ord", "start_char", "token_count"])


def p4_checks(spark: SparkSession, d: str) -> DataFrame:
    """Whether the pieces of each long text are within the limits, in order, and give back the text."""
    texts = table(spark, d, "document_chunk").where(
        "chunk_id is not null and text is not null"
    ).groupBy("chunk_id").agg(F.max("text").alias("text"))
    pieces = splitting.split_oversized(texts, "chunk", "chunk_id", "text").withColumn("chars", F.length("text"))
    per = pieces.groupBy(F.col("record_key").alias("chunk_id")).agg(
        F.array_sort(F.collect_list(F.struct("ord", "start_char", "text", "token_count", "chars"))).alias("p"),
        F.max("pieces").alias("pieces")
    )
    end = lambda x: x["start_char"] + x["chars"]
    given_back = F.aggregate("p", F.lit(""), lambda t, x: F.concat(F.substr(t, F.lit(1), x["start_char"]), x["text"]))
    overlaps = F.transform(F.filter("p", lambda x: x["ord"] > 0), lambda x: end(F.element_at("p", x["ord"])) - x["start_char"])
    repeated = F.forall(
        F.arrays_zip(F.filter("p", lambda x: x["ord"] > 0).alias("x"), overlaps.alias("n")),
        lambda z: (z["n"] >= 0) & (
            F.size(F.filter(F.split(F.substr(z["x"]["text"], F.lit(1), z["n"]), _SPACES), lambda w: w != "")) <= 64
        )
    )
    return per.join(texts, "chunk_id").select(
        "chunk_id", F.forall(
            "p", lambda x: x["token_count"] <= 512
        ).alias("within_limit"), (F.size("p") == F.col(
            "pieces"
        )).alias("all_there"), (given_back == F.col("text")).alias("gives_text_back"), repeated.alias("within_overlap")
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    docs = splitting.split_oversized(table(spark, d, "parsed_document"), "document", "doc_id", "cleaned_text")
    chunks = splitting.split_oversized(table(spark, d, "document_chunk"), "chunk", "chunk_id", "text")
    return docs.unionByName(chunks).select("record_kind", "record_key").distinct()


#: More byte-equal copies of one text than these are written as a star instead of all pairs.
COPIES = 64


def _near_chunks(spark: SparkSession, d: str, weighting: str = "set") -> tuple[DataFrame, DataFrame]:
    return bagminhash.near_duplicates(
        table(spark, d, "document_chunk"), "chunk_id", "text", threshold=0.5, width=3, weighting=weighting
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    members, links = _near_chunks(spark, d)
    return classes.linked_records(members, links, COPIES, text="text_id").select(
        F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b")
    )


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per chunk: its class of equal shingle sets, the class's size and its links to other classes."""
    members, links = _near_chunks(spark, d)
    return classes.class_report(members, links).withColumnsRenamed({"record": "chunk_id", "first": "class_chunk_id"})


def p5_multisets(spark: SparkSession, d: str) -> DataFrame:
    """The same for multisets of shingles: a repeated passage counts as often as it stands in the text."""
    members, links = _near_chunks(spark, d, "count")
    return classes.class_report(members, links).withColumnsRenamed({"record": "chunk_id", "first": "class_chunk_id"})


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    near = quantised_search.all_neighbours(table(spark, d, "document_chunk"), "chunk_id", "embedding", k=10, floor=0.9)
    return near.select(
        F.least("record", "neighbour").alias("chunk_id_a"), F.greatest("record", "neighbour").alias("chunk_id_b")
    ).distinct()


def p6_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 10 nearest of all chunks for every chunk whose hashed id is divisible by 100."""
    chunks = table(spark, d, "document_chunk")
    number = F.conv(F.substring(F.md5(F.col("chunk_id").cast("binary")), 1, 8), 16, 10).cast("long")
    near = quantised_search.search(chunks, chunks.where(F.pmod(number, F.lit(100)) == 0), "chunk_id", "embedding")
    return near.select(F.col("record").alias("chunk_id"), "rank", F.round("similarity", 4).alias("similarity"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    hits = leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_item"))
    return hits.select("doc_id", "item_id").distinct()


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every document with the leaked spans cut out."""
    docs = table(spark, d, "documents")
    return leaks.remove_leaks(docs, leaks.find_leaks(docs, table(spark, d, "eval_item")))


def p8_selected(spark: SparkSession, d: str) -> DataFrame:
    """The chosen documents, the source each is used for and how many times."""
    return mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_target"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_target"))[1]


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """Documents from which something was cut, whether anything of the items is left, and whether the cut was needed."""
    docs, items = table(spark, d, "documents"), table(spark, d, "eval_item")
    hits = leaks.find_leaks(docs, items)
    clean = leaks.remove_leaks(docs, hits).where("items_removed > 0")
    left = leaks.find_leaks(clean, items).select("doc_id").distinct().withColumn("leaks", F.lit(True))
    return clean.join(left, "doc_id", "left").select(
        "doc_id",
        F.col("items_removed").alias("items"),
        (F.length("text") < F.col("chars_before")).alias("shorter"),
        F.coalesce("leaks", F.lit(False)).alias("still_leaks")
    )


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """Whether each source keeps its cap and, of what all sources with documents may have, comes to its share."""
    chosen, report = mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_target"))
    used = chosen.groupBy("source").agg(
        F.max("repeats").alias("most"), F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("documents")
    )
    live = F.sum(F.when(F.col("available_tokens") > 0, F.col("target_share")).otherwise(0.0)).over(Window.partitionBy())
    wanted = F.when(F.col("available_tokens") > 0, F.col("target_share") / live).otherwise(0.0)
    rows = report.withColumn("wanted", wanted).join(
        used.drop("documents").join(used.select("source", F.col("documents").alias("n")), "source"), "source", "left"
    )
    return rows.select(
        "source", (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within_cap"), (
            F.col("times_over") <= F.col("max_repeats") + 1e-9
        ).alias("within_size"),
        (F.abs(F.col("actual_share") - F.col("wanted")) < 0.02).alias("has_share"), (
            F.coalesce("rows", F.lit(0)) == F.coalesce("n", F.lit(0))
        ).alias("rows_distinct"),
    )


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    texts = shared_spans.text_classes(table(spark, d, "documents"), "doc_id", "text", 300)
    links = shared_spans.shared_spans(texts).select("a", "b").distinct()
    members = texts.select("record", "class_id").distinct()
    return classes.linked_records(members, links, COPIES).select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    """The stretches themselves, between the least documents of each class of equal texts."""
    texts = shared_spans.text_classes(table(spark, d, "documents"), "doc_id", "text", 300)
    least = texts.groupBy("class_id").agg(F.min("record").alias("doc_id"))
    spans = shared_spans.shared_spans(texts)
    out = spans.join(least.select(F.col("class_id").alias("a"), F.col("doc_id").alias("doc_id_a")), "a").join(
        least.select(F.col("class_id").alias("b"), F.col("doc_id").alias("doc_id_b")), "b"
    )
    return out.select("doc_id_a", "doc_id_b", "chain", "start_a", "start_b", "length", F.round("identity", 4).alias("identity"))


def p9_shared(spark: SparkSession, d: str) -> DataFrame:
    """How much of each document of at least 300 characters stands in another one too."""
    texts = shared_spans.text_classes(table(spark, d, "documents"), "doc_id", "text", 300)
    return shared_spans.shared_report(texts, shared_spans.shared_spans(texts), 300).withColumnRenamed("record", "doc_id")


def p9_cover(spark: SparkSession, d: str) -> DataFrame:
    """The characters of each document that stand in stretches shared with others."""
    return p9_shared(spark, d).select("doc_id", "chars", "shared_chars", "copies")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


# DuckDB's \s is ASCII: white space is spelled out.
_SPACE = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
_GRAMS = "list_transform(range(1, len(w) - {0} + 2), lambda i: array_to_string(w[i : i + {0} - 1], ' '))"



def _near_report(name: str) -> str:
    """Classes and links of the chunks by brute force; ``name`` names the x-th occurrence of a shingle s in its chunk, so
    that a multiset is a set of names."""
    return (
        f"WITH w AS (SELECT DISTINCT chunk_id, {_WORDS.format('text')} AS w FROM document_chunk WHERE text IS NOT NULL AND chunk_id IS NOT NULL),"
        f" u AS (SELECT chunk_id, unnest({_GRAMS.format(3)}) AS s FROM w WHERE len(w) >= 3),"
        f" g AS (SELECT chunk_id, list(DISTINCT {name}) AS g FROM (SELECT chunk_id, s, row_number() OVER (PARTITION BY chunk_id, s) AS x FROM u) GROUP BY 1),"
        " k AS (SELECT chunk_id, g, md5(array_to_string(list_sort(g), '|')) AS k FROM g), c AS (SELECT k, min(chunk_id) AS first, count(*) AS class_size, any_value(g) AS g FROM k GROUP BY 1),"
        " s AS (SELECT k, unnest(g) AS s FROM c), n AS (SELECT k, count(*) AS n FROM s GROUP BY 1),"
        " p AS (SELECT a.k AS a, b.k AS b, count(*) AS m FROM s a JOIN s b ON a.s = b.s AND a.k < b.k GROUP BY 1, 2),"
        " l AS (SELECT a, b FROM p JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE m / (x.n + y.n - m)::DOUBLE >= 0.5),"
        " e AS (SELECT k, count(*) AS links FROM (SELECT a AS k FROM l UNION ALL SELECT b FROM l) GROUP BY 1)"
        " SELECT chunk_id, first AS class_chunk_id, class_size, coalesce(links, 0) AS links FROM k JOIN c USING (k) LEFT JOIN e USING (k)"
    )


# Letters and digits in order, case folded, with the points between digits (\x01 for the time being).
_CONTENT = "replace(regexp_replace(regexp_replace(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '(\\p{{Nd}})\\.(\\p{{Nd}})', '\\1' || chr(1) || '\\2', 'g'), '(\\p{{Nd}})\\.(\\p{{Nd}})', '\\1' || chr(1) || '\\2', 'g'), '[^\\p{{L}}\\p{{N}}\\x01]+', '', 'g'), chr(1), '.')".replace("{{", "{").replace("}}", "}")
_LEAKS = f"WITH d AS (SELECT DISTINCT doc_id, unnest({_GRAMS.format(12)}) AS g FROM (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL) WHERE len(w) >= 12), i AS (SELECT DISTINCT item_id, unnest({_GRAMS.format(12)}) AS g FROM (SELECT item_id, {_WORDS.format('t')} AS w FROM (SELECT item_id, unnest([question, passage]) AS t FROM eval_item) WHERE t IS NOT NULL) WHERE len(w) >= 12) SELECT DISTINCT doc_id, item_id FROM d JOIN i ON d.g = i.g"

_VECTORS = "SELECT chunk_id, any_value(embedding)::DOUBLE[] AS e FROM document_chunk WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AND chunk_id IS NOT NULL GROUP BY 1"

SQL = {
    "p4_found": f"SELECT DISTINCT record_kind, record_key FROM (SELECT 'document' AS record_kind, doc_id AS record_key, cleaned_text AS t FROM parsed_document UNION ALL SELECT 'chunk', chunk_id, text FROM document_chunk) WHERE len(regexp_extract_all(t, '[^{_SPACE}]+')) > 512",
    "p5_found": f"WITH s AS (SELECT DISTINCT chunk_id, unnest({_GRAMS.format(3)}) AS g FROM (SELECT chunk_id, {_WORDS.format('text')} AS w FROM document_chunk WHERE text IS NOT NULL AND chunk_id IS NOT NULL) WHERE len(w) >= 3), n AS (SELECT chunk_id, count(*) AS n FROM s GROUP BY 1), c AS (SELECT a.chunk_id AS a, b.chunk_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.chunk_id < b.chunk_id GROUP BY 1, 2) SELECT a AS chunk_id_a, b AS chunk_id_b FROM c JOIN n x ON x.chunk_id = a JOIN n y ON y.chunk_id = b WHERE k / (x.n + y.n - k)::DOUBLE >= 0.5",
    "p1_prose": f"WITH r AS (SELECT unnest(list_concat(coalesce(gold_chunks, []), coalesce(retrieved_chunks, []))) AS c FROM rag_example), p AS (SELECT DISTINCT c.chunk_id AS chunk_id, c.text AS text FROM r WHERE c.chunk_id IS NOT NULL AND c.text IS NOT NULL AND NOT regexp_matches(c.text, '[:=>]')), k AS (SELECT DISTINCT chunk_id, {_CONTENT} AS k FROM p), g AS (SELECT k, min(chunk_id) AS same_as, count(*) AS copies FROM k GROUP BY 1) SELECT chunk_id, same_as, copies FROM k JOIN g USING (k)",
    "p4_checks": f"SELECT chunk_id, true AS within_limit, true AS all_there, true AS gives_text_back, true AS within_overlap FROM (SELECT chunk_id, max(text) AS t FROM document_chunk WHERE chunk_id IS NOT NULL AND text IS NOT NULL GROUP BY 1) WHERE len(regexp_extract_all(t, '[^{_SPACE}]+')) > 512",
    "p7_checks": f"SELECT doc_id, count(DISTINCT item_id) AS items, true AS shorter, false AS still_leaks FROM ({_LEAKS}) GROUP BY 1",
    "p8_checks": "SELECT source, true AS within_cap, true AS within_size, true AS has_share, true AS rows_distinct FROM mix_target WHERE source IS NOT NULL",
    "p9_cover": "WITH t AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 300), w AS (SELECT doc_id, unnest(range(1, length(text) - 298)) AS i, unnest(list_transform(range(1, length(text) - 298), lambda i: hash(text[i : i + 299]))) AS s FROM t), h AS (SELECT s FROM w GROUP BY 1 HAVING count(DISTINCT doc_id) > 1), x AS (SELECT doc_id, i, max(i + 300) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM w WHERE s IN (SELECT s FROM h)), c AS (SELECT doc_id, sum(i + 300 - greatest(i, coalesce(e, 0))) AS n FROM x GROUP BY 1), k AS (SELECT text, count(*) AS copies FROM t GROUP BY 1) SELECT doc_id, CAST(length(text) AS INTEGER) AS chars, CAST(coalesce(n, 0) AS INTEGER) AS shared_chars, copies FROM t JOIN k USING (text) LEFT JOIN c USING (doc_id)",
    "p5_classes": _near_report("s"),
    "p5_multisets": _near_report("s || ' ' || x"),
    "p6_found": f"WITH v AS ({_VECTORS}), r AS (SELECT a.chunk_id AS a, b.chunk_id AS b, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.chunk_id <> b.chunk_id QUALIFY row_number() OVER (PARTITION BY a.chunk_id ORDER BY s DESC, b.chunk_id) <= 10) SELECT DISTINCT least(a, b) AS chunk_id_a, greatest(a, b) AS chunk_id_b FROM r WHERE s >= 0.9",
    "p6_topk": f"WITH v AS ({_VECTORS}), r AS (SELECT a.chunk_id AS a, b.chunk_id AS b, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.chunk_id <> b.chunk_id WHERE ('0x' || substr(md5(a.chunk_id), 1, 8))::BIGINT % 100 = 0) SELECT a AS chunk_id, CAST(row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS INTEGER) AS rank, round(s, 4) AS similarity FROM r QUALIFY rank <= 10",
    "p7_found": _LEAKS,
    "p9_found": "WITH w AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, length(text) - 298), lambda i: text[i : i + 299])) AS s FROM documents WHERE length(text) >= 300) SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM w a JOIN w b ON a.s = b.s AND a.doc_id < b.doc_id",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


QUERIES = queries()
