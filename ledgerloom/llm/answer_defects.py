"""Problem 2: broken prompt and response pairs.

Several noisy labelling functions vote on each defect; a label model (expectation-maximisation over the vote patterns)
turns them into posteriors, and every label whose posterior exceeds its cutoff is kept. Some functions are patterns,
others are learned: languages from labelled texts (``languages``), refusals from the answers that the patterns agree on,
and whether an open-ended answer breaks off from the answers that end properly: how often a context of one to three
tokens ends a sentence or goes on.

Cutoffs are validated in every run: defects are planted into a sample of the answers (cut, copied, emptied, swapped for
one in another language, or replaced by refusals that no pattern was written for), the planted answers pass the same
functions and the fitted model, and of a grid of cutoffs that of the greatest F1 is taken. ``validated_cutoffs`` reports
them with precision and recall.

The statistics cover all rows: context counts stay distributed and are joined to the open answers. What is fitted on the
driver (languages, refusal words, planted answers) sees a sample of at most 2 * SAMPLE answers.

Defined results: a null answer is empty; a null question makes nothing but the question's own comparisons abstain;
repeated rows count as often as they stand in the statistics and give one row each key; rows with a null key take part
in the statistics alone.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.label_model import best_cutoff, fit_posteriors
from ledgerloom.llm.languages import Languages, learn_languages
from ledgerloom.llm.words import split_words
from ledgerloom.session import checkpointed

#: Order of precedence for the single label of an answer.
DEFECTS = ("empty", "question_copy", "refusal", "other_language", "truncated")
#: Answers sampled to learn from, and defects of each kind planted among them.
SAMPLE, PLANTED = 5000, 300

# Words that say nothing, words that can't end a sentence, ways to refuse, and refusals to validate with.
PLACEHOLDERS = frozenset("n a|na|null|none|nan|nil|tbd|tba|tbc|todo|blank|empty|no answer|no response|not available|not applicable|missing|pending|undefined|unknown|placeholder|keine angabe|k a|sans objet|sin datos|nessuna risposta|keine antwort|sin respuesta|pas de réponse|no data|void|xxx|lorem ipsum".split("|"))
_DANGLING = frozenset(
    "the of and to in a an is was were that for on with as by from at its which or than their into about but because while between per der die das und im von für den dem des ein eine einer einem einen zu mit auf bei um dass oder als le les et des du un une en dans pour que qui sur par avec au aux el los las y de del por con al il lo gli e di della dei delle che si tra da dal dalla nel nella".split()
)
_ABBREVIATION = regex.compile(
    r"(?i)(?:\b(?:inc|corp|co|ltd|mio|mrd|no|vs|approx|dr|mr|mrs|st|e\.g|i\.e|etc|thsd|ca|nr|jan|feb|aug|sept|oct|nov|dec))\.$"
)
_END = regex.compile(r"[.!?。！？][\"'”’»)\]]*$")
_OPEN = regex.compile(r"(?:[(\[{,;:/&$€£¥–—-]|[(\[]?(?:\.{2,}|…)[)\]]?)[\"'”’»]*$")
_CUT = regex.compile(r"(?:\.{2,}|…|[(\[])[)\]]?$")

_REFUSALS = [
    re.compile(
        r"\b(?:i|we)(?:['’]m| am| are)?\b[^.?!]{0,40}\b(?:can(?:no|['’])t|cannot|unable|not able|won['’]?t|will not|must decline|decline|don['’]?t have|do not have|am afraid|refuse)\b|\b(?:decline|unable) to (?:answer|respond|comment|say|determine|help|provide)\b|\bnot possible for me\b|\bas an? (?:ai|language model|assistant)\b"
    ),
    re.compile(
        r"\b(?:sorry|apolog(?:y|ies|ise|ize)|unfortunately|regret)\b|\b(?:tut mir leid|leider)\b|\b(?:désolée?|malheureusement|regrette)\b|\b(?:lo siento|lamentablemente|disculp)|\b(?:mi dispiace|purtroppo|spiacente)\b"
    ),
    re.compile(
        r"\b(?:insufficient|not enough|no(?:t| ) (?:enough|sufficient)|nothing)\b[^.?!]{0,40}\b(?:context|information|excerpts?|passages?|documents?|answer)\b|\bdo(?:es)? not (?:contain|include|provide)\b[^.?!]{0,30}\b(?:information|answer|enough)\b|\bno answer can be given\b|\boutside (?:of )?what i can\b|\bcannot be (?:answered|determined)\b"
    ),
    re.compile(
        r"\bkann (?:ich|dazu|diese|leider)\b[^.?!]*\bnicht\b|\bkeine (?:auskunft|angaben|antwort)\b|\bnicht beantworten\b|\bnicht genügend informationen\b|\bne (?:me|peux|puis|permet|contient)\b[^.?!]*\bpas\b|\bpas suffisamment\b|\bno (?:puedo|contiene|dispongo|es posible|me es posible)\b|\binformación suficiente\b|\bnon (?:posso|mi consente|contiene|sono in grado|è possibile)\b|\binformazioni sufficienti\b"
    ),
]
UNSEEN_REFUSALS = [
    "That is something I would rather not discuss.", "I have no way of telling you this.", "Please consult a qualified expert; I cannot advise on it.", "My instructions keep me from replying here.",
    "I do not know the answer to this question.", "It is beyond my abilities to give you these figures.", "I'd prefer not to comment on that.", "We regret that no information can be shared.",
]
_META = re.compile(
    r"\b(?:context|question|passages?|excerpts?|documents?|provided|request|access|information|speculate|professional advi[sc]er|frage|unterlagen|auskunft|kontext|contexte|question|documents|contexto|pregunta|información|contesto|domanda|rispondere|répondre|responder|beantworten)\b"
)
_REPORTED = re.compile(
    r"^(?:the (?:company|filing|board|management|group|firm)|management|analysts?|the (?:chief|audit|treasurer)|in |about |no change|for )|\b(?:said|told|indicated|stressed|warned|reported) (?:that )?it\b|\bwas unable to quantify\b"
)


def is_open(text: str) -> bool:
    """No sign that the last sentence is over; an abbreviation's point is no such sign."""
    t = text.rstrip()
    return not _END.search(t) or bool(_OPEN.search(t)) or bool(_ABBREVIATION.search(t))


_TOKEN = regex.compile(r"\p{N}[\p{N}.,]*\p{N}|\p{N}|\p{L}+|[^\s\p{L}\p{N}]")


def tokens(text: str) -> list[str]:
    """Lower-cased words, numbers as one token, other characters; closing points left out."""
    return ["#" if t[0].isnumeric() else t for t in _TOKEN.findall(text.lower().rstrip().rstrip(".!?\"'”’»)"))]


def contexts(t: list[str], i: int) -> list[str]:
    """The contexts of one to three tokens that end with token i; the start of the text is a token too."""
    padded = ["^", "^", *t[: i + 1]]
    return [" ".join(padded[-k:]) for k in (1, 2, 3)]


SHORT = 5  # words of a reply that may be complete without a sentence


def whole(t: list[str]) -> str:
    """Key of a text's tokens from its start; distinct from every context."""
    return "$ " + " ".join(t)


def _context_counts(pairs: DataFrame) -> DataFrame:
    """(context, ends, goes_on) over the answers that end properly, and how often an open answer is just its first
    tokens or an answer goes on after them; combined within each batch before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ends, on = Counter(), Counter()
            for a in b["answer"]:
                if a is None:
                    continue
                t = tokens(a)
                on.update(whole(t[:i]) for i in range(1, min(len(t), 2 * SHORT + 1)))
                if is_open(a):
                    if len(t) <= 2 * SHORT:
                        ends[whole(t)] += 1
                    continue
                for i in range(len(t)):
                    (ends if i == len(t) - 1 else on).update(contexts(t, i))
            keys = ends.keys() | on.keys()
            yield pd.DataFrame([(k, ends[k], on[k]) for k in keys], columns=["context", "ends", "goes_on"])

    return pairs.mapInPandas(run, "context string, ends bigint, goes_on bigint").groupBy("context").agg(
        F.sum("ends").alias("ends"), F.sum("goes_on").alias("goes_on")
    )


class RefusalWords:
    """Words and pairs of words that tell refusals from other answers, learned from the sampled answers: those that the
    patterns call refusals, without a figure or a report of what others said, against all others."""

    def __init__(self, answers: list[str]):
        counts, sizes = (Counter(), Counter()), [0, 0]
        for a in set(answers):
            said = set(self._parts(a))
            kind = int(sum(_refusal_signs(a)[0]) > 0 and not _refusal_signs(a)[1])
            counts[kind].update(said)
            sizes[kind] += 1
        self.odds = {}
        if min(sizes) >= 5:
            for w in counts[0].keys() | counts[1].keys():
                if counts[0][w] + counts[1][w] >= 3:
                    self.odds[w] = math.log((counts[1][w] + 0.5) / (sizes[1] + 1)) - math.log((counts[0][w] + 0.5) / (sizes[0] + 1))

    @staticmethod
    def _parts(a: str) -> list[str]:
        w = [x for x in split_words(a) if x.isalpha()]
        return w + [f"{x} {y}" for x, y in zip(w, w[1:])]

    def score(self, a: str) -> float | None:
        """Mean log odds of the known parts; None where fewer than three are known."""
        known = [self.odds[x] for x in self._parts(a) if x in self.odds]
        return sum(known) / len(known) if len(known) >= 3 else None


def _refusal_signs(text: str) -> tuple[list[bool], bool]:
    """Which patterns of refusals match, and whether the text reports what others said or names a figure."""
    low = text.lower()
    hits = [bool(p.search(low)) for p in _REFUSALS]
    if not any(hits):
        return hits, False
    figures = bool(
        re.search(r"\d", re.sub(r"(?i)\b(?:fy|q[1-4]|fiscal|quarter of|exercice|ejercicio|esercizio|geschäftsjahr)\s*\d*", "", low))
    )
    return hits, figures or (bool(_REPORTED.search(low)) and not hits[0])


def _vote(yes: bool, no: bool = False) -> str:
    return "1" if yes else "0" if no else "-"


def votes(
    question: str | None,
    answer: str | None,
    seen: list[tuple[int, int]] | None,
    languages: Languages,
    refusals: RefusalWords,
    asked_in: tuple | None = None
) -> dict[str, str]:
    """Vote patterns of all defects; ``seen`` has (ends, goes on) of the answer's closing contexts of 1, 2, 3 tokens,
    of the whole answer and of the token before the last, ``asked_in`` the question's language if it is known already."""
    text = (answer or "").strip()
    words, asked = split_words(text), split_words(question)
    bare = " ".join(words)
    out = {}

    nothing = not words
    placeholder = bare in PLACEHOLDERS
    out["empty"] = _vote(nothing, len(words) > 3) + _vote(placeholder or nothing, not placeholder and len(words) > 1) + _vote(
        (len(bare) < 2 and not bare.isdigit()) or placeholder, len(words) > 3
    )
    if nothing or placeholder:  # nothing for the others to judge
        return out | {"question_copy": "---", "refusal": "-------", "other_language": "---", "truncated": "--------"}

    within = bool(asked) and f" {bare} " in f" {' '.join(asked)} "
    cover = len(words) / len(asked) if asked else 0.0
    known = set(asked)
    own = sum(w not in known for w in words) / len(words)  # a question said twice has no words of its own either
    out["question_copy"] = _vote(
        within and cover >= 0.5, own > 0.3 or cover < 0.3
    ) + _vote(own == 0 and cover >= 0.5, own > 0.1) + _vote(
        own < 0.1 and "?" in text[-3:], own > 0.2 or cover < 0.3
    )

    hits, other = _refusal_signs(text)
    meta = any(hits) and bool(_META.search(text.lower()))
    learned = refusals.score(text)
    out["refusal"] = "".join(_vote(h) for h in hits) + _vote(any(hits) and not other, other) + _vote(meta and not other, other)
    out["refusal"] += _vote(learned is not None and learned >= REFUSED and not other, learned is not None and learned < 0)

    open_end = is_open(text) or (text[-1] in '"“„«' and not _END.search(text))
    # the last word of an open answer may be a part of one, which says nothing of the language
    said = text.rsplit(maxsplit=1)[0] if open_end and len(words) > 3 else text
    pairs = zip(languages.of(said), asked_in or languages.of(question))
    out["other_language"] = "".join(_vote(bool(a and q and a != q), bool(a and q and a == q)) for a, q in pairs)

    t = tokens(text)
    last = t[-1] if t else ""
    dangling = bool(_OPEN.search(text)) or text.count("(") > text.count(")") or (
        text[-1] in "\"“„«" and text.count('"') % 2 == 1
    ) or text[-1] in "“„«"
    short = len(words) <= SHORT and not dangling
    seen = seen or [(0, 0)] * 5
    alone, beyond = seen[3]
    usual = short and alone >= 3 and alone >= 0.03 * beyond  # a reply that others give too
    cut = bool(_CUT.search(text))
    # a small word that never follows the one before it, however often that stands: part of a word
    broken = open_end and not cut and not usual and len(t) > 1 and last.isalpha() and text.endswith(last) and sum(
        seen[1]
    ) == 0 and seen[4][1] >= 50
    v = [
        _vote(dangling, not open_end),
        _vote(cut, not open_end),
        _vote(open_end and last in _DANGLING and not usual, not open_end),
        _vote(broken, not open_end)
    ]
    for k in range(3):
        ends, on = seen[k]
        if not open_end or usual:
            v.append("0")
        elif cut:  # the mark tells that more was to come, whatever stands before it
            v.append("-")
        elif k == 0:
            v.append(_vote(ends + on == 0 and last not in ("#", "") and len(words) > 1, ends > 0 and short))
        elif ends + on < 8 or short:
            v.append("-")
        else:
            v.append(_vote(ends <= 0.02 * (ends + on), ends >= 0.2 * (ends + on)))
    v.append(_vote(short and beyond >= 8 and alone < 0.01 * beyond, usual))
    out["truncated"] = "".join(v)
    return out


#: Mean log odds from which the learned words call an answer a refusal.
REFUSED = 1.5


def plant(
    sample: list[tuple[str | None, str | None]], languages: Languages, per_defect: int = PLANTED, seed: int = 11
) -> list[tuple[str, str | None, str | None]]:
    """(defect or "none", question, answer): defects made of sampled answers that end properly."""
    rng = random.Random(seed)
    good = [
        (q, a)
        for q, a in sample
        if q and a and not is_open(a) and len(split_words(a)) >= 8 and not any(
            _refusal_signs(a)[0]
        ) and split_words(a) != split_words(q)
    ]
    if not good:
        return []
    rng.shuffle(good)
    good = good[:per_defect]
    out: list[tuple[str, str | None, str | None]] = [("none", q, a) for q, a in good]
    for q, a in good:
        cut = a[: rng.randrange(len(a) * 3 // 10, len(a) * 9 // 10)].rstrip()
        out.append(("truncated", q, cut + rng.choice(["", "", "", "...", " [...]", " ("])))
        out.append(
            ("question_copy", q, rng.choice([q, q.lower(), q.upper(), q.rstrip("?. ") + ".", q.split(" ", 1)[-1], f"{q} {q}"]))
        )
        out.append(("empty", q, rng.choice([None, "", " ", "...", "-", "N/A", "none"])))
        said = rng.choice(UNSEEN_REFUSALS)
        if languages.of(said)[2] in (None, languages.of(q)[2]):
            out.append(("refusal", q, said))
    told = [(q, a, languages.of(q)[2], languages.of(a)[2]) for q, a in good]
    for q, _, asked, _ in told:
        others = [a for _, a, _, said in told if said and asked and said != asked]
        if others:
            out.append(("other_language", q, rng.choice(others)))
    return out


def _ballots(rows: DataFrame, key: str, question: str, answers: tuple[str, ...], samples: DataFrame | None) -> DataFrame:
    """(key, field, defect, pattern) of every answer; those planted have a null key and their defect, after a #, as field."""
    spark = rows.sparkSession
    fields = F.explode(F.array(*[F.struct(F.lit(a).alias("field"), F.col(a).alias("answer")) for a in answers]))
    pairs = rows.select(F.col(key).alias("key"), F.col(question).alias("question"), fields.alias("p")).select(
        "key", "question", "p.field", "p.answer"
    )
    n = rows.count() * len(answers)
    some = pairs.where(
        F.pmod(F.xxhash64("question", "answer"), F.lit(max(1, n // SAMPLE))) == 0
    ).select("question", "answer").limit(2 * SAMPLE).collect()
    sample = sorted(((r.question, r.answer) for r in some), key=str)
    languages = learn_languages(samples, sorted({t for pair in sample for t in pair if t}))
    model = spark.sparkContext.broadcast((languages, RefusalWords([a for _, a in sample if a])))
    made = [(None, q, f"#{d}", a) for d, q, a in plant(sample, languages)]
    planted = spark.createDataFrame(made, pairs.schema)

    def closing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for a in b["answer"].dropna().unique():
                if is_open(a) and (t := tokens(a)):
                    before = contexts(t, len(t) - 2)[0] if len(t) > 1 else whole(t)
                    rows += [(a, k, c) for k, c in enumerate([*contexts(t, len(t) - 1), whole(t), before])]
            yield pd.DataFrame(rows, columns=["answer", "k", "context"])

    # answers that may be open: no point after a word of more than six letters
    maybe = ~F.col("answer").rlike(r"\w{7}[.!?][\"'”’»)\]]*\s*$")
    every = pairs.where("key is not null").unionByName(planted)
    wanted = every.select("answer").where(maybe).distinct().mapInPandas(closing, "answer string, k int, context string")
    stats = wanted.join(_context_counts(pairs), "context", "left").groupBy("answer").agg(
        F.sort_array(F.collect_list(F.struct("k", "ends", "goes_on"))).alias("seen")
    )
    # answers that have no context get a key of their own, so that frequent ones (null, blank) don't meet in one task
    spread = F.when(maybe & (F.trim("answer") != ""), F.col("answer")).otherwise(
        F.concat(F.lit("\u0000"), F.monotonically_increasing_id().cast("string"))
    )
    joined = every.withColumn("_a", spread).join(stats.withColumnRenamed("answer", "_a"), "_a", "left")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        languages, refusals = model.value
        asked: dict[str, tuple] = {}
        for b in batches:
            out = []
            for k, f, q, a, s in zip(b["key"], b["field"], b["question"], b["answer"], b["seen"]):
                seen = [(int(x["ends"] or 0), int(x["goes_on"] or 0)) for x in s] if s is not None else None
                if q not in asked:
                    if len(asked) > 20_000:
                        asked.clear()
                    asked[q] = languages.of(q)
                out += [(k, f, d, p) for d, p in votes(q, a, seen, languages, refusals, asked[q]).items()]
            yield pd.DataFrame(out, columns=["key", "field", "defect", "pattern"]).astype({"key": b["key"].dtype})

    schema = pairs.select("key", "field", F.lit("").alias("defect"), F.lit("").alias("pattern")).schema
    return checkpointed(joined.select("key", "field", "question", "answer", "seen").mapInPandas(judge, schema))


def _posteriors(ballots: DataFrame) -> tuple[dict[tuple[str, str], float], dict[str, tuple[float, float, float]], dict[str, int]]:
    """Posterior of each (defect, pattern), (cutoff, precision, recall) and number of planted answers of each defect."""
    true = F.when(F.col("key").isNull(), F.expr("substring(field, 2)"))
    counted = ballots.groupBy("defect", "pattern", true.alias("truth")).count().collect()  # at most 3 ** functions patterns a defect
    table, cutoffs, planted = {}, {}, {}
    for d in DEFECTS:
        mine = Counter()
        for r in counted:
            if r.defect == d and r.truth is None:
                mine[r.pattern] += r["count"]
        seen = sorted({r.pattern for r in counted if r.defect == d})
        fitted = fit_posteriors(seen, [mine[p] for p in seen]) if mine else {}
        # a pattern without a vote for the defect is no evidence for it
        fitted = {p: x if "1" in p else 0.0 for p, x in fitted.items()}
        table |= {(d, p): x for p, x in fitted.items()}
        tried = [
            (fitted.get(r.pattern, 0.0), r.truth == d)
            for r in counted
            if r.defect == d and r.truth is not None
            for _ in range(r["count"])
        ]
        planted[d] = sum(t for _, t in tried)
        cutoffs[d] = best_cutoff(tried) if planted[d] else (0.5, None, None)
    return table, cutoffs, planted


def label_answers(
    rows: DataFrame,
    key: str,
    question: str,
    answers: tuple[str, ...],
    samples: DataFrame | None = None,
    cutoffs: dict[str, float] | None = None
) -> DataFrame:
    """(key, field, defect, posterior): every label whose posterior exceeds its cutoff, for every answer column.

    ``samples`` (text, lang) are texts to learn languages from; without it no answer is called one in another language.
    ``cutoffs`` replace those validated.
    """
    ballots = _ballots(rows, key, question, answers, samples)
    table, chosen, _ = _posteriors(ballots)
    at = {d: c[0] for d, c in chosen.items()} | (cutoffs or {})
    kept = [(d, p, float(x)) for (d, p), x in table.items() if x > at[d]]
    known = rows.sparkSession.createDataFrame(kept, "defect string, pattern string, posterior double")
    return ballots.where("key is not null").join(
        F.broadcast(known), ["defect", "pattern"]
    ).select("key", "field", "defect", "posterior").distinct()


def validated_cutoffs(
    rows: DataFrame, key: str, question: str, answers: tuple[str, ...], samples: DataFrame | None = None
) -> DataFrame:
    """(defect, planted, cutoff, precision, recall) on the planted answers; null figures where none could be planted."""
    _, chosen, planted = _posteriors(_ballots(rows, key, question, answers, samples))
    return rows.sparkSession.createDataFrame(
        [(d, planted[d], *chosen[d]) for d in DEFECTS],
        "defect string, planted long, cutoff double, precision double, recall double"
    )


def single_label(labels: DataFrame) -> DataFrame:
    """The label of the greatest posterior of each answer, of equal ones (to three places) the first in the order of precedence."""
    order = F.array_position(F.array(*[F.lit(d) for d in DEFECTS]), F.col("defect"))
    return labels.groupBy("key", "field").agg(F.max_by("defect", F.struct(F.round("posterior", 3), -order)).alias("defect"))
