"""Operators' inner parts against brute force; no Spark."""

import random

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import answer_defects as ad
from ledgerloom.llm import bagminhash as bm
from ledgerloom.llm import format_copies as fc
from ledgerloom.llm import label_model, languages, leaks, mixing, shared_spans, splitting
from ledgerloom.llm import quantised_search as qs
from ledgerloom.llm.words import split_words, window_hashes, word_hashes


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Net sales of $1,000.5 (up)", "net SALES of 1000.5 -- up;", True),
        ("1.5 m", "15 m", False),
        ("a. 5", "a 5", True),
        (
            '{"Ticker": "AB", "Unit": "USD million", "Opening": "1,000.5"}',
            "unit = usd million ; opening = 1000.5 ; ticker = ab;",
            True
        ),
        ("Ticker: AB\nUnit: USD", "UNIT=USD|TICKER=AB", True),
        ("Ticker: AB; Unit: USD.", "Ticker: USD; Unit: AB", False),
        ("Straße", "STRASSE", True),
        ("<a>1</a><b>x y</b>", "b: x y; a: 1", True),
    ],
)
def test_canonical(a, b, same):
    assert (fc.canonical(a) == fc.canonical(b)) is same


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("a=1,b=2", "b=2,a=1"),
        ("a:1,000,b:x,y,c:3", "C = 3; B = x,y; A = 1000"),
        ("Unit->USD,Opening balance->5", "opening balance -> 5\nunit -> usd"),
        ("net " * 40 + "debt: 5; unit: USD", "Unit: USD; " + "Net " * 40 + "Debt: 5"),
        ("Unit: USD, " + "net " * 20 + "debt: 5", "net " * 20 + "debt=5|unit=USD"),
    ],
)
def test_field_lists_in_any_order(a, b):
    assert len(fc.fields(a)) == len(fc.fields(b)) > 1 and fc.canonical(a) == fc.canonical(b)


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ('[{"a":1,"b":2},{"a":3,"b":4}]', '[{"a":9,"b":7},{"a":3,"b":4}]', False),
        ('[{"a":1,"b":2},{"a":3,"b":4}]', '[{"b":2,"a":1},\n{"b":4,"a":3}]', True),
        ('[{"a":1,"b":2},{"a":3,"b":4}]', '[{"a":3,"b":4},{"a":1,"b":2}]', False),
        ('{"a":1,"a":2,"b":3}', '{"a":2,"b":3}', False),
        ('{"a":1,"a":2,"b":3}', "b: 3; a: 2; a: 1", True),
        ('{"a":12345678901234567.8,"b":1}', '{"a":12345678901234567.9,"b":1}', False),
        ('{"rev":1.50,"b":1}', "rev: 1.50; b: 1", True),
        ('{"rev":1.50,"b":1}', "rev: 1.5; b: 1", False),
        ('[{"a": 1}, {"b": "x"}]', "B = x | A = 1", True),
        ('{"a": ["x", "y"], "b": 1}', "b: 1; a: x, y", True),
        ('{"a": {"x": 1, "y": 2}, "b": 1}', '{"b": 1, "a": {"y": 2, "x": 1}}', True),
        ('["x", "y"]', "x y", True),
        ("1\x005", "1.5", False),
        ("1\x005", "15", True),
        ("[" * 100_000, "", True),
    ],
)
def test_canonical_form_drops_no_content(a, b, same):
    assert (fc.canonical(a) == fc.canonical(b)) is same


def test_prose_and_long_texts_are_no_field_lists():
    assert fc.fields("Sales rose 3,500,and costs fell: see below") is None and fc.fields("word " * 20_000) is None
    assert fc.fields("a:" + ",b" * 20_000) is None and fc.fields("a" + "_" * 20_000) is None


@given(st.lists(st.binary(max_size=12), max_size=300))
def test_trie_counts(keys):
    trie = fc.CountingTrie(burst=4, stride=2)
    want = {}
    for i, k in enumerate(keys):
        trie.add(k, str(i))
        want.setdefault(k, []).append(str(i))
    assert {k: sorted(v) for k, v in trie.terminals()} == {k: sorted(v) for k, v in want.items()}


@settings(deadline=None, max_examples=60)
@given(
    st.lists(st.sampled_from(["word", "End.", "semi;", "a\n\nb", "x", "e.g.", "é ü"]), min_size=0, max_size=400), st.integers(8, 60)
)
def test_pieces_give_back_the_text(parts, limit):
    text = " ".join(parts)
    overlap = limit // 4
    pieces = splitting.split_text(text, limit, overlap)
    n = len(text.split())
    assert bool(pieces) == (n > limit)
    if pieces:
        assert "".join(p[3][p[2] - p[1] :] for p in pieces) == text
        assert all(p[4] <= limit and p[4] == len(p[3].split()) for p in pieces)
        assert all(len(text[b[1] : b[2]].split()) <= overlap for b in pieces[1:])


def test_pieces_break_at_sentences():
    text = " ".join(
        f"word{i}" + ("." if i % 20 == 19 else "") + ("" if i % 20 else "") for i in range(1500)
    ).replace(". word", ". Word")
    cuts = [p[5] for p in splitting.split_text(text)[:-1]]
    assert cuts and all(c >= splitting.SENTENCE for c in cuts)


def test_unbreakable_texts():
    assert [p[4] for p in splitting.split_text("x " * 1025, 512, 0)] and splitting.split_text("y" * 100_000) == []


@pytest.mark.parametrize(("n", "shared"), [(100, 67), (60, 20), (9, 6)])
def test_signatures_estimate_similarity(n, shared):
    rng, got = np.random.default_rng(3), []
    for _ in range(40):
        x = rng.integers(0, 2**63, 2 * n - shared).astype(np.uint64)
        s = bm.bagminhash([(x[:n], np.ones(n)), (x[n - shared :], np.ones(n))], 128)
        got.append((s[0] == s[1]).mean())
    assert np.mean(got) == pytest.approx(shared / (2 * n - shared), abs=0.04)


def test_signatures_of_weighted_sets():
    rng, got = np.random.default_rng(4), []
    a, b = rng.integers(1, 9, 50), rng.integers(1, 9, 50)
    for _ in range(40):
        x = rng.integers(0, 2**63, 50).astype(np.uint64)
        s = bm.bagminhash([(x, a.astype(float)), (x, b.astype(float))], 128)
        got.append((s[0] == s[1]).mean())
    assert np.mean(got) == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.04)


def test_signatures_dont_depend_on_the_batch():
    rng = np.random.default_rng(5)
    sets = [(rng.integers(0, 2**63, n).astype(np.uint64), np.ones(n)) for n in (1, 3, 200, 40)]
    together = bm.bagminhash(sets, 64)
    for s, row in zip(sets, together):
        assert (bm.bagminhash([(s[0][::-1], s[1])], 64)[0] == row).all()


@settings(deadline=None, max_examples=50)
@given(
    st.text(alphabet="ab \n", max_size=120),
    st.text(alphabet="ab \n", max_size=120),
    st.text(alphabet="abc", min_size=30, max_size=40)
)
def test_winnowing_misses_no_shared_stretch(x, y, common):
    k, least = 12, 30
    texts = [x + common + x[:5], y + "|" + common]
    owner, _, h = shared_spans.winnow(texts, k, least - k + 1)
    assert set(h[owner == 0].tolist()) & set(h[owner == 1].tolist())


def brute_period(t):
    return next(p for p in range(1, len(t) + 1) if all(t[i] == t[i + p] for i in range(len(t) - p)))


@given(st.text(alphabet="ab", min_size=1, max_size=24))
def test_least_period(t):
    assert shared_spans.least_period(t) == brute_period(t)


def test_a_run_is_one_seed():
    k, least = 120, 300
    seeds = shared_spans.winnow(["x" * 50 + "-" * 10_000 + "end", "ab" * 400], k, least - k + 1)
    owner, place, h, period = shared_spans.collapse_runs(*seeds, k)
    assert len(seeds[0]) > 9000 and len(owner) < 40
    assert 1 in period[owner == 0] and 2 in period[owner == 1]


@settings(deadline=None, max_examples=300)
@given(st.data())
def test_runs_and_hot_seeds_miss_no_shared_stretch(data):
    """Texts of a few repeated parts: a shared stretch is found through each level of seeds alone."""
    k, least = 8, 20
    unit = st.sampled_from(["a", "ab", "abc", "aab", "x", "y", "zw", "abcdefghijk"])
    text = st.lists(st.tuples(unit, st.integers(1, 14)).map(lambda u: u[0] * u[1]), min_size=1, max_size=5).map("".join)
    texts = [data.draw(text), data.draw(text)]
    n = longest_common(*texts)
    owner, place, h, period = shared_spans.collapse_runs(*shared_spans.winnow(texts, k, least - k + 1), k)
    level = [(o, (int(s), int(i), k, int(p), 0, least - k, False)) for o, i, s, p in zip(owner, place, h, period)]
    for parts in (2, 3, 0):
        best = 0
        for _, (s, i, size, p, low, high, run) in (e for e in level if e[0] == 0):
            for _, (t, j, _, q, _, _, _) in (e for e in level if e[0] == 1 and e[1][0] == s):
                shift = 0 if size or high <= least - k else k
                at = [(i - shift, j - shift)] if not p and not q else [
                    x for r in {p, q} - {0} for x in shared_spans.run_anchors(*texts, i, j, k, r, least)
                ]
                best = max([best, *(m for a in at for _, _, m in shared_spans.align(*texts, [a], k)[0])])
        assert best == n or n < least
        level = [
            (o, x)
            for o, s in level
            for x in ([s] if s[6] else shared_spans.longer_seeds(texts[o], s[1], s[2], s[4], s[5], least, parts))
        ]


def longest_common(x, y):
    best, row = 0, [0] * (len(y) + 1)
    for i in range(len(x)):
        new = [0] * (len(y) + 1)
        for j in range(len(y)):
            if x[i] == y[j]:
                new[j + 1] = row[j] + 1
                best = max(best, new[j + 1])
        row = new
    return best


@settings(deadline=None, max_examples=40)
@given(st.text(alphabet="ab", max_size=40), st.text(alphabet="cd", min_size=20, max_size=40), st.text(alphabet="ab", max_size=40))
def test_aligned_stretches_are_maximal(a, common, b):
    x, y, k = a + common + b, b + common + a, 10
    seeds = {}
    for i in range(len(x) - k + 1):
        seeds.setdefault(x[i : i + k], []).append(i)
    anchors = [(i, j) for j in range(len(y) - k + 1) for i in seeds.get(y[j : j + k], [])]
    found = [s for path in shared_spans.chain(anchors, k) for s in shared_spans.align(x, y, path, k)[0]]
    assert max(n for _, _, n in found) == longest_common(x, y)
    assert all(x[i : i + n] == y[j : j + n] for i, j, n in found)


def test_leaks_scan():
    index = leaks.GramIndex([(7, "one two three four five"), (8, "x y"), (9, "Three, four FIVE six")], 3)
    runs = index.scan(["zero one TWO three-four five six", "one two", "", "x y z"])
    assert sorted(runs) == [(0, 7, 1, 6), (0, 9, 3, 7)]


def test_window_hashes_are_of_the_words():
    w = split_words("A b, c. A b")
    h = window_hashes(word_hashes(w), 2)
    assert h[0] == h[3] and len(set(h.tolist())) == 3


def brute_flow(patterns, shares, repeats, total):
    """Largest placement by trying all integer splits of tiny patterns."""
    best, items = 0, [(p, s) for p in patterns for s in p if s in shares]

    def go(i, used, got):
        nonlocal best
        if i == len(items):
            best = max(best, sum(got.values()))
            return
        p, s = items[i]
        cap = patterns[p] * max(repeats[x] for x in p) - used.get(p, 0)
        for n in range(0, min(cap, patterns[p] * repeats[s], int(total * shares[s]) - got.get(s, 0)) + 1):
            go(i + 1, used | {p: used.get(p, 0) + n}, got | {s: got.get(s, 0) + n})

    go(0, {}, {})
    return best


@settings(deadline=None, max_examples=25)
@given(st.integers(0, 4), st.integers(0, 4), st.integers(0, 3), st.integers(1, 3), st.integers(1, 2), st.integers(1, 12))
def test_flow_places_as_much_as_possible(a, b, ab, ra, rb, total):
    patterns = {k: n for k, n in {("a",): a, ("b",): b, ("a", "b"): ab}.items() if n}
    shares, repeats = {"a": 0.5, "b": 0.5}, {"a": ra, "b": rb}
    taken, placed = mixing.route(patterns, shares, repeats, total)
    assert placed == sum(taken.values()) == brute_flow(patterns, shares, repeats, total)
    assert all(n <= patterns[p] * repeats[s] for (p, s), n in taken.items())


def test_flow_spreads_before_repeating():
    taken, _ = mixing.route({("a",): 10, ("a", "b"): 10}, {"a": 0.5, "b": 0.5}, {"a": 4, "b": 4}, 20)
    assert taken == {(("a",), "a"): 10, (("a", "b"), "b"): 10}


def test_label_model_finds_the_defect():
    rng, patterns = np.random.default_rng(0), {}
    truth = rng.random(4000) < 0.15
    for t in truth:
        p = "".join("-" if rng.random() < 0.3 else "1" if rng.random() < (0.9 if t else 0.05) else "0" for _ in range(4))
        patterns.setdefault(p, [0, 0])
        patterns[p][0] += 1
        patterns[p][1] += int(t)
    post = label_model.fit_posteriors(list(patterns), [n for n, _ in patterns.values()])
    right = sum(max(d, 0) if post[p] > 0.5 else n - d for p, (n, d) in patterns.items())
    assert right / 4000 > 0.95
    assert label_model.fit_posteriors([], []) == {}


SENTENCES = {
    "en": "The company names lower costs as the main reason|Revenue of the group rose because of higher prices|Management said that it expects a decline this year|What was the result of the business in the last quarter|The customers have ordered less than before",
    "de": "Die Gesellschaft rechnet wegen höherer Kosten mit einem Rückgang|Der Umsatz des Konzerns ist im letzten Jahr gestiegen|Das ist nicht der wichtigste Grund für die Entwicklung|Wie hoch war das Ergebnis des Unternehmens im Quartal|Die Kunden haben weniger bestellt als im Vorjahr",
    "fr": "La société prévoit une baisse en raison du coût de l'énergie|Le chiffre d'affaires du groupe a augmenté cette année|Les clients ont commandé moins que l'année dernière|Quel était le résultat de la société pour le trimestre|La direction a indiqué que les coûts sont plus élevés",
    "es": "La dirección señaló que se cerrarán centros y se invertirán fondos|La cifra de ventas del grupo creció este año|Los clientes pidieron menos que el año anterior|Cuál fue el resultado de la empresa en el trimestre|La empresa espera una caída por el coste de la energía",
    "it": "La società prevede un calo a causa dei costi dell'energia|Il fatturato del gruppo è cresciuto quest'anno|I clienti hanno ordinato meno rispetto all'anno scorso|Quale era il risultato della società nel trimestre|La direzione ha detto che i costi sono più alti",
    "nl": "De onderneming verwacht een daling vanwege hogere kosten|De omzet van de groep is dit jaar gestegen|De klanten hebben minder besteld dan vorig jaar|Wat was het resultaat van het bedrijf in het kwartaal|Het bestuur zei dat de prijzen zijn verhoogd",
}


def labelled(n=30):
    rng = random.Random(3)
    return [(". ".join(rng.choice(s.split("|")) for _ in range(6)), lang) for lang, s in SENTENCES.items() for _ in range(n)]


@pytest.mark.parametrize(
    ("text", "lang"),
    [
        ("Die Kosten des Unternehmens sind höher als im Jahr", "de"),
        ("Le résultat de la société est plus élevé", "fr"),
        ("La empresa pidieron que el resultado de ventas creció", "es"),
        ("Il risultato della società è più alto", "it"),
        ("The result of the company rose", "en"),
        ("Het resultaat van de onderneming is gestegen", "nl"),
        ("FY2020", None),
        ("4.2 %", None),
        ("", None),
        (None, None)
    ],
)
def test_language(text, lang):
    assert languages.Languages(labelled()).of(text)[2] == lang


def test_languages_without_samples():
    assert languages.Languages([]).of("The result of the company") == (None, None, None)
    assert languages.Languages([("only one language here", "en")] * 30).of("only one language") == (None, None, None)


def test_unseen_refusals_score_above_answers():
    known = [
        "I cannot answer this question.",
        "I am unable to say that from the context.",
        "I'm sorry, but I do not have the information.",
        "Sorry, I can't help you with that.",
        "As a language model I am not able to give you figures."
    ]
    good = [
        f"{a} of the company {b} by {n}% because of {c}."
        for a in ("Revenue", "Net debt")
        for b in ("rose", "fell")
        for n in range(9)
        for c in ("lower costs", "higher prices")
    ]
    r = ad.RefusalWords(known * 9 + [f"{k} Case {i}." for i, k in enumerate(known * 2)] + good)
    assert r.score("I do not know the answer to that question.") > ad.REFUSED > 0 > r.score(good[0])
    assert r.score("Quite other words") is None and ad.RefusalWords([]).score("I cannot answer") is None


def test_single_functions_can_decide():
    """A vote of one function alone is evidence where the others abstain; posteriors are not all 0 or 1."""
    rng, patterns = np.random.default_rng(1), {}
    for _ in range(5000):
        t = rng.random() < 0.1
        p = "".join("-" if rng.random() < 0.6 else "01"[int(t if rng.random() < a else not t)] for a in (0.95, 0.8, 0.7))
        patterns.setdefault(p, [0, 0])
        patterns[p][int(t)] += 1
    post = label_model.fit_posteriors(list(patterns), [sum(c) for c in patterns.values()])
    assert post["1--"] > post["-1-"] > post["--1"] and 0.02 < post["--1"] < 0.9
    found = [(post[p], bool(t)) for p, c in patterns.items() for t in (0, 1) for _ in range(c[t])]
    cutoff, precision, recall = label_model.best_cutoff(found)
    assert 0 < cutoff < 1 and precision > 0.4 and recall > 0.4
    assert label_model.best_cutoff([(0.9, True), (0.2, False)])[1:] == (1.0, 1.0)


@pytest.mark.parametrize(
    ("text", "open_end"),
    [
        ("It ends.", False),
        ("It ends", True),
        ("of Mondova Inc.", True),
        ("it goes on...", True),
        ("because (", True),
        ('He said "yes."', False),
        ("of [...]", True)
    ]
)
def test_open_ends(text, open_end):
    assert ad.is_open(text) is open_end


def test_quantised_scan_finds_neighbours():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 64)).astype(np.float32)
    x[1000:] = x[:1000] + 0.2 * rng.normal(size=(1000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = qs.fit_quantiser(x, 8)
    ids = np.arange(2000)
    a, b, s = qs._rerank(q, x, ids, x, ids, q.encode(x), 1, -2.0, 24)
    exact = x @ x.T
    np.fill_diagonal(exact, -2)
    assert (b == exact.argmax(1)[a]).mean() > 0.97
    assert s == pytest.approx(exact.max(1)[a], abs=1e-5) or (b == exact.argmax(1)[a]).mean() < 1


def test_anisotropic_codes_keep_products():
    """The parallel part of the residual is smaller than with the plain loss."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    parallel = {}
    for t in (0.0, 0.4):
        q = qs.fit_quantiser(x, 4, threshold=t)
        back = q.codebooks[np.arange(16), q.encode(x)].reshape(len(x), -1)
        parallel[t] = np.mean(((x - back) * x).sum(1) ** 2)
    assert parallel[0.4] < parallel[0.0]


def test_words_are_letters_and_digits():
    text = "".join(chr(random.Random(0).randrange(32, 0x3000)) for _ in range(10)) + " Ab_c1 "
    assert split_words(text)[-2:] == ["ab", "c1"]
    assert split_words(None) == [] and regex.__name__ == "regex"
