"""The operators as Spark jobs: brute force on small tables, nulls, ties, repeats, hot groups, empty tables, clashing names."""

import itertools
import random

import numpy as np
import pytest

from ledgerloom.llm import answer_defects, bagminhash, catalogue, classes, format_copies, leaks, mixing, quantised_search, shared_spans, splitting
from ledgerloom.llm.words import split_words
from test_llm_units import labelled

CLASH = [f"{i} AS {n}" for i, n in enumerate(("record", "class_id", "h", "a", "b", "q", "n", "v", "canon", "bucket"))]


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts(spark):
    """Random texts, some edited, a third of all rows one text, nulls, blanks, repeats."""
    rng = random.Random(5)
    rows = [(i, words(rng, 120)) for i in range(60)]
    for i in range(25):
        w = rows[i][1].split()
        for _ in range(i):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((100 + i, " ".join(w)))
    hot = words(rng, 80)
    rows += [(1000 + i, hot) for i in range(50)] + [
        (2000, None), (2001, ""), (2002, " "), (2003, "one two"), (0, rows[0][1]), (None, hot)
    ]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, text string").selectExpr(
        "cast(id AS string) AS sid", "id", "text", *CLASH
    ).repartition(5)


def test_format_copies_with_hot_and_salted_groups(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(f"k{i:04d}", f"Common start {i % 40} {rng.choice(['', '!', ' - '])}", i) for i in range(400)] + [
        (f"z{i:04d}", rng.choice(["Hot, TEXT 1.5", "hot text: 1.5", "HOT-text 1.5;"]), i) for i in range(200)
    ]
    rows += [("n", None, 0), (None, "x", 0), ("e1", "...", 0), ("e2", "", 0), ("k0000", rows[0][1], 9)]
    df = spark.createDataFrame(rows, "id string, t string, record int").selectExpr("*", "1 AS text", "2 AS canon", "3 AS salt")
    want = {}
    for k, t, _ in rows:
        if k is not None and t is not None:
            want.setdefault(format_copies.canonical(t), set()).add(k)
    want = {k: (min(g), len(g)) for g in want.values() for k in g}
    for limit, size in ((30, 16_000_000), (30, 0), (50_000, 0)):  # with and without splits and salts, broadcast or not
        monkeypatch.setattr(format_copies, "BROADCAST_BYTES", size)
        got = {r.record: (r.least, r.copies) for r in format_copies.format_copies(df, "id", "t", bucket_rows=limit).collect()}
        assert got == want


def test_pieces(spark, texts):
    df = frame(spark, [*texts, (3000, "word " * 1000), (3001, "a" * 5000)])
    rows = splitting.split_oversized(df, "chunk", "sid", "text", 50, 8).collect()
    by = {}
    for r in rows:
        by.setdefault(r.record_key, {})[r.ord] = r
    assert set(by) == {str(i) for i, t in texts + [(3000, "word " * 1000)] if i is not None and t and len(t.split()) > 50}
    for p in by.values():
        assert sorted(p) == list(range(p[0].pieces)) and all(r.token_count <= 50 for r in p.values())


@pytest.mark.parametrize("weighting", ["set", "count"])
def test_near_duplicates_match_brute_force(spark, texts, weighting):
    members, links = bagminhash.near_duplicates(frame(spark, texts), "sid", "text", threshold=0.5, width=3, weighting=weighting)
    got = {(r.a, r.b) for r in classes.linked_records(members, links, 64).collect()}
    bags = {}
    for i, t in texts:
        w = split_words(t)
        if i is not None and len(w) >= 3:
            bags[str(i)] = sorted(zip(w, w[1:], w[2:]))
    from collections import Counter

    as_bag = (lambda x: Counter(set(x))) if weighting == "set" else Counter
    bags = {k: as_bag(v) for k, v in bags.items()}
    want = {(a, b) for a in bags for b in bags if a < b and (bags[a] & bags[b]).total() >= 0.5 * (bags[a] | bags[b]).total()}
    assert got == want
    report = {r.record: r for r in classes.class_report(members, links).collect()}
    assert report["1000"].class_size == 50 and set(report) == set(bags)


def test_large_classes_become_stars(spark):
    members = spark.createDataFrame([(i, 1) for i in range(10)] + [(20, 2), (21, 2)], "record long, class_id long")
    links = spark.createDataFrame([(1, 2)], "a long, b long")
    got = {(r.a, r.b) for r in classes.linked_records(members, links, expand=5).collect()}
    assert got == {(0, i) for i in range(1, 10)} | {(20, 21), (0, 20), (0, 21)}


def test_only_equal_texts_become_stars(spark, tmp_path):
    base = "the same passage of standard words in every filing"
    forms = [" ".join(w.upper() if i >> j & 1 else w for j, w in enumerate(base.split())) for i in range(70)]
    rows = [(i, t) for i, t in enumerate(forms)] + [(i, forms[0]) for i in range(100, 170)] + [
        (200, base + " too"), (201, "quite other words than those")
    ]
    spark.createDataFrame(
        [(str(i), t) for i, t in rows], "chunk_id string, text string"
    ).write.parquet(f"{tmp_path}/document_chunk.parquet")
    got = [tuple(r) for r in catalogue.p5_found(spark, str(tmp_path)).collect()]
    ends = sorted(str(i) for i in range(70)) + ["200"]  # record 0 stands for its copies 100 to 169
    want = {tuple(sorted(p)) for p in itertools.combinations(ends, 2)} | {("0", str(i)) for i in range(100, 170)}
    assert set(got) == want and len(got) == len(want)


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 64))
    x[200:300] = x[:100] + 0.3 * rng.normal(size=(100, 64))
    x[300:] = x[299]  # a quarter of all rows is one vector
    rows = [(f"v{i:03d}", r.tolist()) for i, r in enumerate(x.astype("float32"))]
    bad = [
        ("b0", None),
        ("b1", [0.0] * 64),
        ("b2", [1.0] * 63),
        ("b3", [float("nan")] * 64),
        ("b4", [float("inf")] * 64),
        ("b5", [None] * 64),
        (None, rows[0][1]),
        rows[3],
        ("big", [1e30] * 64)
    ]
    df = spark.createDataFrame(rows + bad, "id string, e array<float>").selectExpr("*", *CLASH)
    for limit in (20_000, 60):  # whole and split lists
        got = quantised_search.all_neighbours(df, "id", "e", k=5, floor=0.9, list_rows=40, list_limit=limit).collect()
        u = x.astype("float32").astype(float)
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        s = u @ u.T
        np.fill_diagonal(s, -2)
        near = {}
        for r in got:
            near.setdefault(r.record, set()).add(r.neighbour)
        for i in range(299):
            want = {f"v{j:03d}" for j in np.argsort(-s[i], kind="stable")[:5] if s[i, j] >= 0.9}
            assert len(near.get(f"v{i:03d}", set()) & want) >= 0.9 * len(want) and (i > 98 or len(want) > 0)
        assert all(len(near[f"v{i}"]) == 5 for i in range(300, 400))
        assert not {r.record for r in got} & {f"b{i}" for i in range(6)}
    top = quantised_search.search(df, df.where("id < 'v020'"), "id", "e", k=3).collect()
    hits = sum(r.neighbour in {f"v{j:03d}" for j in np.argsort(-s[int(r.record[1:])])[:3]} for r in top if r.record[0] == "v")
    assert hits >= 0.9 * 60


def cloud(n, seed=0):
    """Vectors around few centres of very uneven weight, every second one with a near copy."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, 64))
    x = centres[np.minimum(rng.geometric(0.15, n) - 1, 39)] * 0.5 + rng.normal(size=(n, 64))
    x[1::2] = x[::2] + 0.25 * rng.normal(size=(n // 2, 64))
    return x.astype("float32")


def test_lists_of_large_lists(spark):
    """With centroids from a small sample, lists get lists of their own: the codes scanned a vector stay about as many."""
    scanned = {}
    for n in (3000, 24_000):
        x = cloud(n)
        df = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "role int, vid bigint, v array<float>")
        q = quantised_search.fit_quantiser(
            quantised_search._matrix(df.limit(400).select("v").toArrow().column("v").combine_chunks(), 64), 50
        )
        sizes = {}
        for limit in (200, 10**9):
            placed = quantised_search.list_rows_of(df, 64, q, 3, 3, 50, limit)
            per = placed.groupBy("list", "block").agg({"role": "sum", "vid": "count"}).collect()
            sizes[limit] = sum((r["count(vid)"] - r["sum(role)"]) * r["count(vid)"] for r in per) / n
            assert {r.vid for r in placed.where("role = 0").select("vid").distinct().collect()} == set(range(n))
        scanned[n] = sizes
    assert scanned[24_000][10**9] > 5 * scanned[3000][10**9]
    assert scanned[24_000][200] < 2 * scanned[3000][200] + 200
    names = spark.createDataFrame([(f"v{i:05d}", v.tolist()) for i, v in enumerate(x)], "id string, e array<float>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = quantised_search.all_neighbours(names, "id", "e", k=5, sample_rows=400, list_rows=50, list_limit=200).collect()
    got = {(int(r.record[1:]), int(r.neighbour[1:])) for r in near}
    asked = range(0, 24_000, 100)
    want = {i: np.argsort(-np.where(np.arange(len(u)) == i, -2, u @ u[i]))[:5] for i in asked}
    pairs = {(i, j) for i, js in want.items() for j in js.tolist() if u[i] @ u[j] >= 0.9}
    assert len(pairs & got) >= 0.97 * len(pairs) > 100
    top = quantised_search.search(
        names, names.where("id like '%00'"), "id", "e", k=5, probe=24, sample_rows=400, list_rows=50, list_limit=200
    ).collect()
    hits = sum(int(r.neighbour[1:]) in want[int(r.record[1:])] for r in top)
    assert len(top) == 5 * len(asked) and hits >= 0.9 * 5 * len(asked)


@pytest.mark.parametrize("dim", [1, 3, 50])
def test_vectors_of_any_length(spark, dim):
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(200, dim)).astype("float32")
    df = spark.createDataFrame([(f"v{i}", r.tolist()) for i, r in enumerate(x)], "id string, e array<float>")
    u = x.astype(float) / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    got = {}
    for r in quantised_search.search(df, df.where("id < 'v2'"), "id", "e", dim=dim, k=3).collect():
        got.setdefault(int(r.record[1:]), []).append(s[int(r.record[1:]), int(r.neighbour[1:])])
    assert len(got) == df.where("id < 'v2'").count()
    assert all(np.allclose(sorted(v), np.sort(s[i])[-3:], atol=1e-5) for i, v in got.items())


def test_leaks_by_both_ways_and_removal(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = [
        (1, f"Before. {item.upper().replace(' ', ', ')} after"),
        (2, "nothing here"),
        (3, None),
        (4, ""),
        (5, item[4:]),
        (6, " ".join(item.split()[:11])),
        (None, item)
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS question", "3 AS spans")
    items = spark.createDataFrame(
        [(7, item, None), (8, None, "too short"), (9, item, item)], "item_id long, question string, passage string"
    )
    for limit in (2_000_000, 1):
        hits = leaks.find_leaks(df, items, broadcast_grams=limit)
        rows = {(r.doc_id, r.item_id): (r.first_word, r.last_word) for r in hits.collect()}
        assert rows == {(1, 7): (1, 14), (1, 9): (1, 14), (5, 7): (0, 12), (5, 9): (0, 12)}
    clean = {r.doc_id: (r.text, r.items_removed) for r in leaks.remove_leaks(df, hits).collect() if r.doc_id}
    assert clean[1] == ("Before.  after", 2) and clean[5] == ("", 2) and clean[2] == ("nothing here", 0) and clean[3] == (None, 0)


def test_mix_keeps_shares_and_caps(spark):
    rng = random.Random(2)
    rows = [(i, words(rng, rng.randrange(5, 60)), "ab"[i % 4 == 0]) for i in range(300)] + [
        (1000 + i, f"small {i} text of few words", "c") for i in range(10)
    ]
    rows += [(2000 + i, rows[i][1], "c") for i in range(3)] + [
        (3000, None, "a"), (3001, " ", "a"), (3002, "x", None), (3003, "x", "other"), (3004, rows[1][1], "a")
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr(
        "*", "1 AS tokens", "2 AS pattern", "3 AS place"
    )
    goal = spark.createDataFrame(
        [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int"
    )
    chosen, report = mixing.mix_sources(df, goal)
    r = {x.source: x for x in report.collect()}
    for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.1)):
        assert r[s].actual_share == pytest.approx(w / 0.9, abs=0.03)
        assert r[s].most_repeats <= r[s].max_repeats and r[s].times_over <= r[s].max_repeats
    assert r["none"].used_tokens == 0
    rows = chosen.collect()
    assert len({(x.doc_id, x.source) for x in rows}) == len(rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix_sources(df, goal)[0].collect()))
    short = {x.source: x for x in mixing.mix_sources(df, goal, total_tokens=10**7)[1].collect()}
    assert all(short[s].times_over <= short[s].max_repeats + 1e-9 for s in "abc")


def test_shared_spans_match_brute_force(spark):
    rng = random.Random(8)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    base = [make(500) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(20 + i, make(200) + base[i][i * 20 : i * 20 + n] + make(100)) for i, n in enumerate((299, 300, 301, 350, 299, 400))]
    rows += [(40, base[7]), (41, base[7]), (42, "z" * 400), (43, "z" * 350), (44, "z" * 299), (50, None), (51, ""), (0, base[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *CLASH)
    found = shared_spans.text_classes(df, "doc_id", "text", 300)
    spans = shared_spans.shared_spans(found)
    got = {
        (r.a, r.b)
        for r in classes.linked_records(
            found.select("record", "class_id").distinct(), spans.select("a", "b").distinct(), 64
        ).collect()
    }
    live = {i: t for i, t in rows if t and len(t) >= 300}
    windows = {i: {t[k : k + 300] for k in range(len(t) - 299)} for i, t in live.items()}
    assert got == {(a, b) for a in live for b in live if a < b and windows[a] & windows[b]}
    report = {r.record: r for r in shared_spans.shared_report(found, spans, 300).collect()}
    assert report[40].shared_chars == 500 and report[40].copies == 3
    assert report[21].shared_chars == 300 and report[20].shared_chars == 0 and report[8].shared_chars == 0


def test_shared_spans_of_rules_and_disclaimers(spark):
    """Dashes, and text in all documents, which hot seeds of 120 characters would all make meet."""
    rng = random.Random(9)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    small, large, tail = make(130), make(400), make(280)
    rows = [(i, make(150) + small + make(150)) for i in range(60)] + [(100 + i, make(80) + large + make(80)) for i in range(40)]
    rows += [(200 + i, make(90) + tail + "-" * n + make(90)) for i, n in enumerate((10_000, 10_000, 40, 250, 5, 0))] + [
        (300 + i, "-" * (280 + 5 * i) + make(40)) for i in range(8)
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    windows = {i: {t[k : k + 300] for k in range(len(t) - 299)} for i, t in rows}
    want = {(a, b) for a, b in itertools.combinations(sorted(windows), 2) if windows[a] & windows[b]}
    found = shared_spans.text_classes(df, "doc_id", "text", 300)
    for hot in (64, 2):
        spans = shared_spans.shared_spans(found, hot=hot)
        got = {
            (r.a, r.b)
            for r in classes.linked_records(
                found.select("record", "class_id").distinct(), spans.select("a", "b").distinct(), 64
            ).collect()
        }
        assert got == want


def test_defects(spark):
    ask = "What was the revenue of Velholm Energy in fiscal 2020?"
    good = [
        "Revenue of Velholm Energy rose {}% in fiscal 2020, mainly because of lower costs.",
        "The filing names lower costs as the main reason, followed by price {}.",
        "Revenue was ${} million in fiscal 2020."
    ]
    rows = [(i, ask, good[i % 3].format(i), good[(i + 1) % 3].format(i)) for i in range(300)]
    bad = {
        1000: (None, "empty"), 1001: (" \n", "empty"), 1002: ("N/A", "empty"), 1003: (
            "I cannot answer this question from the context provided.", "refusal"
        ), 1004: (
            "Lo siento, no puedo responder a esta pregunta.", "refusal"
        ),
        1005: ("WHAT WAS THE REVENUE OF VELHOLM ENERGY IN FISCAL 2020", "question_copy"), 1006: (
            "Die Gesellschaft rechnet wegen höherer Kosten mit einem Rückgang um 5 %.", "other_language"
        ),
        1007: ("The filing names lower costs as the", "truncated"), 1008: (
            "Revenue of Velholm Energy rose 4% in fis", "truncated"
        ), 1009: (
            "The filing names lower costs...", "truncated"
        ),
    }
    rows += [(k, ask, a, good[0].format(k)) for k, (a, _) in bad.items()] + [
        (2000, ask, "Revenue was $5 million in fiscal 2020", "4.2%"),
        (None, ask, "x", "y"),
        (2001, None, good[0].format(1), good[1].format(2)),
        rows[0]
    ]
    bad[1012] = (f"{ask} {ask}", "question_copy")
    bad[1010] = ("De onderneming verwacht dit jaar een daling vanwege hogere kosten.", "other_language")
    bad[1011] = ("My instructions do not let me answer this question for you.", "refusal")  # no pattern has it
    rows += [(k, ask, bad[k][0], good[0].format(k)) for k in (1010, 1011, 1012)]
    rows += [
        (3000 + i, ask, f"I cannot answer {w} from the context provided.", good[1].format(i))
        for i, w in enumerate(("this question", "that for you", "this for me", "you", "my question", "this") * 2)
    ]
    df = spark.createDataFrame(
        [(str(k) if k else k, *r) for k, *r in rows], "sample_id string, question string, answer string, generated_answer string"
    ).selectExpr(
        "*", "1 AS key", "2 AS field", "3 AS seen", "4 AS defect"
    )
    samples = spark.createDataFrame(labelled(), "text string, lang string")
    labels = answer_defects.label_answers(df, "sample_id", "question", ("answer", "generated_answer"), samples)
    got = {(r.key, r.field): r.defect for r in answer_defects.single_label(labels).collect()}
    want = {(str(k), "answer"): d for k, (_, d) in bad.items()} | {(str(3000 + i), "answer"): "refusal" for i in range(12)}
    assert got == want
    report = {
        r.defect: r
        for r in answer_defects.validated_cutoffs(df, "sample_id", "question", ("answer", "generated_answer"), samples).collect()
    }
    assert all(
        0 < report[d].cutoff < 1 for d in answer_defects.DEFECTS
    ) and report["empty"].recall == report["empty"].precision == 1.0


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "id string, text string, source string, doc_id long")
    assert format_copies.format_copies(docs, "id", "text").count() == 0
    assert splitting.split_oversized(docs, "x", "id", "text").count() == 0
    members, links = bagminhash.near_duplicates(docs, "id", "text")
    assert classes.linked_records(members, links, 64).count() == 0
    vectors = spark.createDataFrame([], "id string, e array<float>")
    assert quantised_search.all_neighbours(vectors, "id", "e").count() == 0
    assert quantised_search.search(vectors, vectors, "id", "e").count() == 0
    items = spark.createDataFrame([], "item_id long, question string, passage string")
    assert leaks.find_leaks(docs, items).count() == 0
    found = shared_spans.text_classes(docs, "doc_id", "text", 300)
    assert shared_spans.shared_spans(found).count() == 0
    goal = spark.createDataFrame([], "source string, target_share double, max_repeats int")
    assert [x.count() for x in mixing.mix_sources(docs, goal)] == [0, 0]
    pairs = spark.createDataFrame([], "key long, question string, answer string")
    assert answer_defects.label_answers(pairs, "key", "question", ("answer",)).count() == 0


@pytest.mark.parametrize(
    "name", ["p1_found", "p2_found", "p4_found", "p5_found", "p6_found", "p7_found", "p8_selected", "p9_found"]
)
def test_catalogue_runs(spark, small, name):
    df = catalogue.queries()[name](spark, small)
    want = {
        "p1_found": "chunk_id_a chunk_id_b",
        "p2_found": "sample_id answer_field defect",
        "p4_found": "record_kind record_key",
        "p5_found": "chunk_id_a chunk_id_b",
        "p6_found": "chunk_id_a chunk_id_b",
        "p7_found": "doc_id item_id",
        "p8_selected": "doc_id source tokens repeats",
        "p9_found": "doc_id_a doc_id_b"
    }
    assert df.columns == want[name].split()
    assert df.count() == df.distinct().count()
