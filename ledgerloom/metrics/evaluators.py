"""Evaluation metrics as DataFrame transforms: entities, classes, figures, retrieval, generation, tags, rankings."""

from __future__ import annotations

import bisect
import itertools

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.text import collapse_whitespace, words
from ledgerloom.settings import DEFAULT


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or missing."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def prf(df: DataFrame) -> DataFrame:
    """Adds precision, recall and f1_score to (tp, fp, fn)."""
    df = df.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn(
        "recall", ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    )
    return df.withColumn("f1_score", f1(F.col("precision"), F.col("recall")))


# --- entities -----------------------------------------------------------------------------------------------------

ENTITY_TYPES = ("PER", "ORG", "LOC", "MISC", "STOCK_EXCHANGE")


def compare_sets(predicted: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, in_p, in_r) over the distinct rows of both sides; keys may hold nulls."""
    side = lambda df, p: df.select(*keys).withColumn("p", F.lit(p)).withColumn("r", F.lit(1 - p))
    return side(predicted, 1).unionByName(side(reference, 0)).groupBy(*keys).agg(F.max("p").alias("in_p"), F.max("r").alias("in_r"))


def _sums(groups: DataFrame, by: list[str]) -> DataFrame:
    p, r = F.col("in_p"), F.col("in_r")
    return groups.groupBy(*by).agg(
        F.coalesce(F.sum(p * r), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(p * (1 - r)), F.lit(0)).alias("fp"),
        F.coalesce(F.sum((1 - p) * r), F.lit(0)).alias("fn")
    )


def entity_scores(predicted: DataFrame, reference: DataFrame) -> DataFrame:
    """Micro precision, recall and F1 over distinct (sample, word, entity)."""
    return prf(_sums(compare_sets(predicted, reference, ["sample_id", "word", "entity"]), []))


def entity_scores_by_type(predicted: DataFrame, reference: DataFrame, types: tuple[str, ...] = ENTITY_TYPES) -> DataFrame:
    """The same for each known type that has references; ``count`` counts all references, repeated ones too."""
    scores = prf(_sums(compare_sets(predicted, reference, ["sample_id", "word", "entity"]), ["entity"]))
    counts = reference.groupBy("entity").agg(F.count(F.lit(1)).alias("count"))
    return scores.join(counts, "entity").where(F.col("entity").isin(*types))


# --- classes ------------------------------------------------------------------------------------------------------

CLASSES = ("negative", "neutral", "positive")
# Spellings of the labels.
LABELS = {
    "positive": ["positive", "pos", "bullish", "2"],
    "negative": ["negative", "neg", "bearish", "0"],
    "neutral": ["neutral", "neu", "1"]
}


def canonical_label(c: Column, strict: bool = True) -> Column:
    """A label by its spelling; an unknown one is an error, or null where not ``strict``."""
    low = F.lower(F.trim(c.cast("string")))
    found = F.coalesce(*[F.when(low.isin(*names), F.lit(label)) for label, names in LABELS.items()])
    return F.coalesce(
        found, F.when(c.isNotNull(), F.raise_error(F.concat(F.lit("unknown label: "), low)).cast("string"))
    ) if strict else found


def confusion_matrix(df: DataFrame, reference: str = "reference", predicted: str = "predicted") -> DataFrame:
    """(reference, negative, neutral, positive) for each of the three classes, with zeros; a missing prediction is neutral."""
    rows = df.select(F.col(reference).alias("reference"), F.coalesce(F.col(predicted), F.lit("neutral")).alias("predicted"))
    cells = [
        F.count(F.when((F.col("reference") == r) & (F.col("predicted") == p), 1)).alias(f"{r}_{p}")
        for r in CLASSES
        for p in CLASSES
    ]
    lines = F.array(*[F.struct(F.lit(r).alias("reference"), *[F.col(f"{r}_{p}").alias(p) for p in CLASSES]) for r in CLASSES])
    return rows.agg(*cells).select(F.explode(lines).alias("l")).select("l.*")


def class_scores(df: DataFrame, reference: str = "reference", predicted: str = "predicted") -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1_score, support) for the three classes."""
    rows = df.select(
        F.col(reference).alias("r"), F.coalesce(F.col(predicted), F.lit("neutral")).alias("p")
    ).groupBy("r", "p").count()
    one = lambda x: F.struct(F.lit(x).alias("label"), (F.col("r") == x).alias("is_r"), (F.col("p") == x).alias("is_p"))
    long = rows.select("count", F.explode(F.array(*[one(x) for x in CLASSES])).alias("k")).select("count", "k.*")
    n = lambda cond: F.sum(F.when(cond, F.col("count")).otherwise(0))
    sums = long.groupBy("label").agg(
        n(F.col("is_r") & F.col("is_p")).alias("tp"),
        n(~F.col("is_r") & F.col("is_p")).alias("fp"),
        n(F.col("is_r") & ~F.col("is_p")).alias("fn")
    )
    return prf(sums).withColumn("support", F.col("tp") + F.col("fn"))


def class_summary(scores: DataFrame) -> DataFrame:
    """(accuracy, macro_f1, weighted_f1, total)."""
    total = F.sum("support")
    return scores.agg(
        ratio(F.sum("tp"), total).alias("accuracy"),
        F.avg("f1_score").alias("macro_f1"),
        ratio(F.sum(F.col("f1_score") * F.col("support")), total).alias("weighted_f1"),
        total.alias("total")
    )


# --- figures ------------------------------------------------------------------------------------------------------

KPI_TYPES = ("revenue", "gross_margin", "operating_income", "net_income", "eps", "ebitda", "roa", "roe")


def _numbers(c: Column) -> Column:
    """The entries of a map that are numbers, or texts of numbers."""
    values = F.coalesce(F.transform_values(c, lambda k, v: v.try_cast("double")), F.create_map().cast("map<string,double>"))
    return F.map_filter(values, lambda k, v: v.isNotNull() & ~F.isnan(v))


def kpi_errors(df: DataFrame, key: str, reference: str, extracted: str, types: tuple[str, ...] = KPI_TYPES) -> DataFrame:
    """(key, refs, exts, errors): relative errors (absolute for a reference of 0) of the known types on both sides."""
    both = df.select(key, _numbers(F.col(reference)).alias("r"), _numbers(F.col(extracted)).alias("e"))
    one = lambda k: F.struct(k.alias("kpi_type"), F.try_element_at("r", k).alias("rv"), F.try_element_at("e", k).alias("ev"))
    pairs = F.filter(F.transform(F.array(*[F.lit(t) for t in types]), one), lambda p: p["rv"].isNotNull() & p["ev"].isNotNull())
    error = lambda p: F.when(p["rv"] == 0, F.abs(p["ev"])).otherwise(F.abs(p["ev"] - p["rv"]) / F.abs(p["rv"]))
    return both.select(
        key,
        F.size("r").alias("refs"),
        F.size("e").alias("exts"),
        F.transform(pairs, lambda p: F.struct(p["kpi_type"].alias("kpi_type"), error(p).alias("error"))).alias("errors")
    )


def kpi_scores(
    df: DataFrame,
    key: str,
    reference: str,
    extracted: str,
    types: tuple[str, ...] = KPI_TYPES,
    tolerance: float = DEFAULT.tolerance
) -> DataFrame:
    """Per sample: accuracy and recall over all references (recall counts every extracted figure), coverage, MAE, RMSE."""
    e = kpi_errors(df, key, reference, extracted, types)
    total = lambda f: F.aggregate("errors", F.lit(0.0), lambda t, x: t + f(x["error"]))
    n = F.size("errors")
    return e.select(
        key, ratio(
            F.size(F.filter("errors", lambda x: x["error"] <= tolerance)), F.col("refs")
        ).alias("numeric_accuracy"), ratio(F.col("exts"), F.col("refs")).alias("extraction_recall"),
        (n / len(types)).alias("type_coverage"), ratio(total(lambda x: x), n).alias("mean_absolute_error"), F.sqrt(
            ratio(total(lambda x: x * x), n)
        ).alias("rmse"), F.col("refs").alias("total_kpis"),
    )


def kpi_accuracy_by_type(
    df: DataFrame,
    key: str,
    reference: str,
    extracted: str,
    types: tuple[str, ...] = KPI_TYPES,
    tolerance: float = DEFAULT.tolerance
) -> DataFrame:
    rows = kpi_errors(df, key, reference, extracted, types).select(F.explode("errors").alias("e"))
    return rows.groupBy("e.kpi_type").agg(
        F.avg((F.col("e.error") <= tolerance).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n")
    )


def apply_operator(operands: Column, operator: Column) -> Column:
    """Result of a calculation step; a division by 0 divides by 1; null for unknown operators and missing operands."""
    first, rest = F.try_element_at(operands, F.lit(1)), F.slice(operands, F.lit(2), F.greatest(F.size(operands) - 1, F.lit(0)))
    fold = lambda start, f: F.aggregate(rest, start, f)
    total = F.aggregate(operands, F.lit(0.0), lambda t, x: t + x)
    return (
        F.when(operator == "+", total)
        .when(operator == "-", F.when(F.size(operands) == 0, F.lit(0.0)).otherwise(fold(first, lambda t, x: t - x)))
        .when(operator == "*", F.aggregate(operands, F.lit(1.0), lambda t, x: t * x))
        .when(operator == "/", fold(first, lambda t, x: t / F.when(x == 0, 1.0).otherwise(x)))
        .when(operator == "%", F.when(F.size(operands) > 1, first * F.try_element_at(operands, F.lit(2)) / 100).otherwise(first))
    )


def steps(df: DataFrame, key: str, column: str = "calculation_steps") -> DataFrame:
    """(key, operator, expected, result) of every calculation step; a missing operator is an addition."""
    rows = df.select(key, F.explode(column).alias("s"))
    operator = F.coalesce("s.operator", F.lit("+"))
    operands = F.coalesce("s.operands", F.array().cast("array<double>"))
    return rows.select(
        key,
        operator.alias("operator"),
        F.col("s.expected_result").alias("expected"),
        apply_operator(operands, operator).alias("result")
    )


def within(result: Column, expected: Column, tolerance: float = DEFAULT.tolerance) -> Column:
    return F.coalesce(F.abs(result - expected) <= tolerance * F.greatest(F.lit(1.0), F.abs(expected)), F.lit(False))


def calculation_accuracy(rows: DataFrame) -> DataFrame:
    correct = F.coalesce(F.sum(within(F.col("result"), F.col("expected")).cast("long")), F.lit(0))
    return rows.agg(correct.alias("correct_steps"), F.count(F.lit(1)).alias("total_steps")).withColumn(
        "calculation_accuracy", ratio(F.col("correct_steps"), F.col("total_steps"))
    )


def calculation_breakdown(rows: DataFrame) -> DataFrame:
    """By operator and in total: correct, total, explained by a factor of 100, accuracy and adjusted accuracy."""
    ok, scaled = within(F.col("result"), F.col("expected")), within(F.col("result") * 100, F.col("expected"))
    live = rows.where(F.col("operator").isin("+", "-", "*", "/") & F.col("result").isNotNull())
    out = live.rollup("operator").agg(
        F.sum(ok.cast("long")).alias("correct"),
        F.count(F.lit(1)).alias("total"),
        F.sum((~ok & scaled).cast("long")).alias("scaled")
    )
    return out.select(
        F.coalesce("operator", F.lit("all")).alias("operator"),
        "correct",
        "total",
        "scaled",
        ratio(F.col("correct"), F.col("total")).alias("accuracy"),
        ratio(F.col("correct") + F.col("scaled"), F.col("total")).alias("adjusted")
    )


# Operators of the programs.
PROGRAM_OPERATORS = {"add": "+", "subtract": "-", "multiply": "*", "divide": "/"}
PROGRAM = r"^(add|subtract|multiply|divide)\(\s*(-?[0-9.,]+)\s*,\s*(-?[0-9.,]+)\s*\)$"


def parse_program(program: Column, answer: Column) -> Column:
    """(operator, operands, expected) of a program of one operation, null for others; expected is the given answer."""
    from ledgerloom.functions.text import parse_amount

    text = F.trim(F.coalesce(program, F.lit("")))
    part = lambda i: F.regexp_extract(text, PROGRAM, i)
    operator = F.coalesce(*[F.when(part(1) == k, F.lit(v)) for k, v in PROGRAM_OPERATORS.items()])
    a, b, e = parse_amount(part(2)), parse_amount(part(3)), parse_amount(answer)
    return F.when(
        operator.isNotNull() & a.isNotNull() & b.isNotNull() & e.isNotNull(),
        F.struct(operator.alias("operator"), F.array(a, b).alias("operands"), e.alias("expected"))
    )


# --- retrieval and generation -------------------------------------------------------------------------------------


def chunk_identity(c: Column) -> Column:
    """The chunk's id, or its text with white space collapsed and case folded where the id is missing."""
    return F.transform(
        F.coalesce(c, F.array().cast("array<struct<chunk_id:string,text:string>>")),
        lambda x: F.coalesce(F.nullif(x["chunk_id"], F.lit("")), F.lower(collapse_whitespace(x["text"])))
    )


def retrieval_scores(df: DataFrame, key: str, retrieved: str, gold: str) -> DataFrame:
    """Hit rates at 1 and 5, reciprocal rank within 5, and gain with the discount 1 / rank over all ranks."""
    rows = df.select(key, chunk_identity(F.col(retrieved)).alias("r"), chunk_identity(F.col(gold)).alias("g"))
    rows = rows.withColumn("h", F.transform("r", lambda x: F.array_contains("g", x)))
    place = F.array_position(F.slice("h", 1, 5), True)
    gain = F.aggregate(
        F.zip_with("h", F.sequence(F.lit(1), F.greatest(F.size("h"), F.lit(1))), lambda h, i: F.when(h, 1 / i).otherwise(0.0)),
        F.lit(0.0),
        lambda t, x: t + F.coalesce(x, F.lit(0.0))
    )
    ideal = F.when(
        F.size("g") > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(F.size("g"), F.lit(1))), F.lit(0.0), lambda t, i: t + 1 / i)
    ).otherwise(0.0)
    hit = lambda n: (F.coalesce(F.array_position(F.slice("h", 1, n), True), F.lit(0)) > 0).cast("double")
    return rows.select(
        key,
        hit(1).alias("hit_rate_top1"),
        hit(5).alias("hit_rate_top5"),
        F.when(place > 0, 1 / place).otherwise(0.0).alias("mrr"),
        ratio(gain, ideal).alias("ndcg")
    )


def generation_scores(df: DataFrame, key: str, generated: str, reference: str) -> DataFrame:
    """Exact match, F1 of words equal in place, and recall of distinct word pairs."""
    rows = df.select(key, F.coalesce(generated, F.lit("")).alias("g"), F.coalesce(reference, F.lit("")).alias("r"))
    rows = rows.withColumn("gw", words(F.col("g"))).withColumn("rw", words(F.col("r")))
    pairs = lambda w: F.array_distinct(
        F.transform(
            F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat(x, F.lit(" "), F.element_at(w, i + 2))
        )
    )
    rows = rows.withColumn("gp", pairs(F.col("gw"))).withColumn("rp", pairs(F.col("rw")))
    same = F.size(F.filter(F.zip_with("gw", "rw", lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x))
    rows = rows.withColumn("p", ratio(same, F.size("gw"))).withColumn("c", ratio(same, F.size("rw")))
    strip = lambda c: F.regexp_replace(F.lower(c), r"(?U)^\s+|\s+$", "")
    return rows.select(
        key,
        (strip(F.col("g")) == strip(F.col("r"))).cast("double").alias("exact_match"),
        f1(F.col("p"), F.col("c")).alias("rouge_l"),
        ratio(F.size(F.array_intersect("gp", "rp")), F.size("rp")).alias("bleu")
    )


def macro(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean of each metric over the samples, 0 where there are none."""
    return df.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in columns], F.count(F.lit(1)).alias("samples"))


def ranking_scores(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ndcg, mrr, recall, precision_at_1) from (query_id, rank, doc_id) and the relevant (query_id, doc_id)."""
    rel = relevant.select("query_id", "doc_id").distinct()
    totals = rel.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    hits = ranked.where(F.col("rank") <= k).join(rel, ["query_id", "doc_id"]).groupBy("query_id").agg(
        F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"), F.min("rank").alias("best"), F.count(F.lit(1)).alias("found")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda t, i: t + 1 / F.log2(i + 1))
    rows = totals.join(hits, "query_id", "left")
    return rows.select(
        "query_id",
        ratio(F.coalesce("dcg", F.lit(0.0)), ideal).alias("ndcg"),
        F.coalesce(1 / F.col("best"), F.lit(0.0)).alias("mrr"),
        ratio(F.coalesce("found", F.lit(0)), F.col("n")).alias("recall"),
        F.coalesce((F.col("best") == 1).cast("double"), F.lit(0.0)).alias("precision_at_1")
    )


# --- tags ---------------------------------------------------------------------------------------------------------


_TAGGED = T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("tag", T.StringType())]))


@F.pandas_udf(_TAGGED)
def _tagged(tokens: pd.Series, entities: pd.Series) -> pd.Series:
    def one(words: list[str] | None, spans: list[dict] | None) -> list[tuple[str, str]] | None:
        if words is None:
            return None
        ends = list(itertools.accumulate(len(w) + 1 for w in words))
        tags = ["O"] * len(words)
        for e in spans if spans is not None else ():
            if e is None or e["start"] is None or e["end"] is None or e["end"] <= e["start"]:
                continue
            # the tokens that the entity touches: the first that ends behind its start, up to the last that begins before its end
            first = bisect.bisect_right(ends, e["start"] + 1)
            for i in range(first, len(words)):
                if (ends[i - 1] if i else 0) >= e["end"]:
                    break
                tags[i] = f"{'B' if i == first else 'I'}-{e['tag']}"
        return list(zip(words, tags))

    return pd.Series([one(w, e) for w, e in zip(tokens, entities)])


def spans_to_tags(df: DataFrame, key: str, tokens: str, entities: str) -> DataFrame:
    """(key, i, token, tag): IOB2 tags of tokens joined by single spaces; of overlapping entities the later one holds.

    ``entities`` is an array of (start, end, tag) over that text; those without characters tag nothing. The first token
    that an entity touches begins it. A document is tagged in one step, so nothing is shuffled.
    """
    return df.select(
        key, F.posexplode(_tagged(F.col(tokens), F.col(entities))).alias("i", "_t")
    ).select(key, "i", "_t.token", "_t.tag")


def exact_median(df: DataFrame, value: str) -> float | None:
    """Median of a column; only the values between two approximate percentiles close to it are ranked in one task."""
    live = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    near = live.agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx("v", [0.4998, 0.5002], 10_000).alias("p"),
        F.min("v").alias("lo"),
        F.max("v").alias("hi")
    ).first()
    if not near.n:
        return None
    few = near.n < 20_000
    low, high = (near.lo, near.hi) if few else near.p
    inside = F.col("v").between(low, high)
    below, m = live.agg(F.sum((F.col("v") < low).cast("long")), F.sum(inside.cast("long"))).first()
    rank = (near.n - 1) / 2 - below
    return live.where(inside).agg(F.percentile("v", rank / (m - 1) if m > 1 else 0.5)).first()[0]


def tag_spans(rows: DataFrame, key: str, place: str, tag: str) -> DataFrame:
    """(key, entity, start, end): entities of a tag sequence; an I behind O or another type begins one too."""
    w = Window.partitionBy(key).orderBy(place)
    kind = F.when(F.col(tag) != "O", F.regexp_replace(tag, "^[BI]-", ""))
    marked = rows.withColumn("_k", kind).withColumn("_b", F.lag("_k").over(w))
    fresh = F.col("_k").isNotNull() & (F.col(tag).startswith("B-") | F.col("_b").isNull() | (F.col("_b") != F.col("_k")))
    island = F.sum(fresh.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    live = marked.withColumn("_i", island).where("_k is not null")
    return live.groupBy(key, "_i").agg(
        F.first("_k").alias("entity"), F.min(place).alias("start"), F.max(place).alias("end")
    ).drop("_i")


def tagging_scores(predicted: DataFrame, reference: DataFrame, key: str, by_type: bool = False) -> DataFrame:
    """Entity-level precision, recall and F1 of spans (key, entity, start, end)."""
    return prf(_sums(compare_sets(predicted, reference, [key, "entity", "start", "end"]), ["entity"] if by_type else []))


# Results published elsewhere, for comparison.
PUBLISHED = [
    (
        "finer139", "f1_overall", 0.892
    ), ("finer139", "f1_org", 0.901), ("finer139", "f1_per", 0.873), ("finer139", "f1_loc", 0.812), (
        "finer139", "f1_contract_items", 0.885
    ),
    ("phrasebank", "accuracy", 0.97), (
        "phrasebank", "f1_positive", 0.96
    ), ("phrasebank", "f1_negative", 0.95), ("phrasebank", "f1_neutral", 0.91),
    ("finqa", "accuracy_low", 0.73), (
        "finqa", "accuracy_expected", 0.80
    ), ("finqa", "accuracy_top", 0.88), ("finqa", "multi_step_share", 0.30),
    (
        "financebench", "exact_match", 0.75
    ), ("financebench", "rouge_l", 0.82), ("financebench", "hit_at_1", 0.62), ("financebench", "hit_at_5", 0.85), ("financebench", "mrr", 0.71),
]


def published(spark) -> DataFrame:
    return spark.createDataFrame(PUBLISHED, "benchmark string, metric string, value double")


def compare_runs(before: DataFrame, after: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    """(metric, before, after, delta) of the metrics that both runs have."""
    old, new = before.select(metric, F.col(value).alias("before")), after.select(metric, F.col(value).alias("after"))
    return old.join(new, metric).withColumn("delta", F.col("after") - F.col("before"))
