import math
import random
import re
import unicodedata
from collections import Counter
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from tarn.llm import language_id, toxicity

from .conftest import EDGES, SCHEMA, documents


def test_profiles_against_plain_counting():
    text = "The cat, the CAT; it's état"
    plain = Counter()
    for w in ["the", "cat", "the", "cat", "it", "s", "état"]:
        p = f"\x01{w}\x01"
        for n in (1, 2, 3):
            plain.update(g for i in range(len(p) - n + 1) if (g := p[i : i + n]) != "\x01" and "\x01" not in g[1:-1])
    pack = lambda g: sum(ord(c) << 21 * (2 - i) for i, c in enumerate(g))
    grams, n = language_id.counts(text)
    assert dict(zip(grams.tolist(), n.tolist())) == {pack(g): k for g, k in plain.items()}
    assert language_id.ranked(grams, n).tolist() == sorted((pack(g) for g in plain), key=lambda g: (-dict(zip(grams.tolist(), n.tolist()))[g], g))[:300]


def test_long_texts_in_pieces(monkeypatch, prose):
    text = prose(500)
    whole = language_id.counts(text)
    monkeypatch.setattr(language_id, "PIECE", 100)
    parts = language_id.counts(text)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_language(spark):
    draw = random.Random(3)
    make = lambda sounds: " ".join("".join(draw.choice(sounds) for _ in range(3)) for _ in range(60))
    rows = [(i, make(["th", "e", "ing", "or"]) if i % 2 else make(["sch", "ü", "ei", "ß"]), "en" if i % 2 else "de", "a") for i in range(10, 90)]
    docs = documents(spark, rows + EDGES)
    profiles = language_id.learn(docs, F.coalesce(F.col("doc_id") < 70, F.lit(False)))
    got = language_id.predict(docs, profiles).collect()
    assert len(got) == len(rows) + len(EDGES) and all(0 <= r.score <= 1 for r in got)
    assert all(r.lang_pred == ("en" if r.doc_id % 2 else "de") for r in got if r.doc_id and r.doc_id >= 70)
    assert all(r.lang_pred == "und" for r in got if r.doc_id in (1, 2, 3))
    nothing = language_id.learn(docs, F.lit(False))
    assert nothing == {} and {r.lang_pred for r in language_id.predict(docs, nothing).collect()} == {"und"}
    assert language_id.predict(documents(spark, []), profiles).count() == 0


def test_marginals_against_enumeration():
    draw = np.random.default_rng(2)
    arcs = draw.normal(size=(2, 2))
    sequences = [draw.normal(size=n) * 2 for n in (3, 1, 5, 0, 4)]
    got = toxicity.marginals(sequences, arcs)
    _, expected = toxicity._forward_backward(sequences, arcs, pairs=True)
    pairs = np.zeros((2, 2))
    for u, m in zip(sequences, got):
        weight, total = np.zeros(len(u)), 0.0
        own = np.zeros((2, 2))
        for states in product((0, 1), repeat=len(u)):
            w = math.exp(sum(u[t] for t, s in enumerate(states) if s) + sum(arcs[a, b] for a, b in zip(states, states[1:])))
            total += w
            weight += w * np.array(states, float) if len(u) else 0
            for a, b in zip(states, states[1:]):
                own[a, b] += w
        assert np.allclose(m, weight / total if len(u) else weight)
        pairs += own / total
    assert np.allclose(pairs, expected)


def test_long_sequences_give_the_same(monkeypatch):
    draw = np.random.default_rng(4)
    arcs = np.array([[0.6, -0.6], [-0.5, -0.4]])
    sequences = [draw.normal(size=n) * 3 - 3 for n in (1, 2, 3, 10, 999, 5000)]
    short = toxicity._forward_backward(sequences, arcs)[0]
    monkeypatch.setattr(toxicity, "LONG", 0)
    for a, b in zip(short, toxicity.marginals(sequences, arcs)):
        assert np.allclose(a, b, atol=1e-12)


def test_toxicity(spark, prose):
    draw = random.Random(6)
    rows, labels = [], []
    for i in range(10, 330):
        words = prose(draw.randint(20, 60)).split()
        y = int(i % 4 == 0)
        for _ in range(3 * y):
            words.insert(draw.randrange(len(words)), draw.choice(["vilex", "Zorgon", "zorgish"]))
        rows.append((i, " ".join(words), "en", "a"))
        labels.append((i, 0, y))
    docs = documents(spark, rows + EDGES)
    known = spark.createDataFrame([*labels, (None, 0, 1), (10, 0, None)], "doc_id long, quality int, toxic int")
    field = toxicity.learn(docs, known, F.coalesce(F.col("doc_id") < 250, F.lit(False)))
    got = {r.doc_id: r for r in toxicity.tag(docs, field).collect()}
    assert all((got[i].score >= 0.3) == bool(y) for i, _, y in labels)
    text = dict((r[0], r[1]) for r in rows)
    assert {text[i][b:e].lower() for i, r in got.items() if i and i >= 10 for b, e in zip(r.begins, r.ends)} == {"vilex", "zorgon", "zorgish"}
    assert got[1].score == got[2].score == got[3].score < 0.3
    left = toxicity.keep(docs, field)
    assert left.columns == SCHEMA.names and left.count() == len(rows) + len(EDGES) - sum(y for *_, y in labels)
    empty = toxicity.learn(documents(spark, []), known, F.lit(True))
    assert {r.score for r in toxicity.tag(docs, empty).collect()} == {0.0}


def test_places_in_longer_lower_case():
    assert toxicity._places("İx bad", np.array([2])) == [(3, 6)]  # the first letter makes two characters


def plain_grams(text):
    out = Counter()
    for w in "".join(c if unicodedata.category(c)[0] == "L" else " " for c in text.lower()).split(" "):
        p = f"\x01{w}\x01"
        if w:
            out.update(g for n in (1, 2, 3) for i in range(len(p) - n + 1) if (g := p[i : i + n]) != "\x01")
    return out


def plain_profile(counted, most):
    return [g for g, _ in sorted(counted.items(), key=lambda item: (-item[1], [ord(c) for c in item[0]]))[:most]]


def test_language_query_against_plain_profiles(spark, prose):
    draw = random.Random(12)
    sounds = {"en": "thoraeiouns", "de": "schüeirnßt", "zz": "zażółćgęśl"}
    rows = [(i, " ".join("".join(draw.choice(sounds[lang]) for _ in range(draw.randint(1, 6))) for _ in range(draw.randint(1, 40))) + draw.choice(["", " 12", " É!"]), lang, "a") for i, lang in enumerate(draw.choices(list(sounds), k=150), 10)]
    rows += EDGES + [(500, "1 2 3", "en", "a"), (501, "x" * 5000, None, "a")]
    docs = documents(spark, rows)
    got = language_id.predict(docs, language_id.learn(docs, F.coalesce(F.col("doc_id") < 100, F.lit(False)))).collect()
    taught = {}
    for i, text, lang, _ in rows:
        if i is not None and i < 100 and lang and text:
            taught.setdefault(lang, Counter()).update(plain_grams(text))
    profiles = {lang: plain_profile(c, language_id.PROFILE) for lang, c in sorted(taught.items())}
    want = Counter()
    for i, text, *_ in rows:
        own = plain_profile(plain_grams(text or ""), language_id.PROFILE)
        far = {lang: sum(abs(k - p.index(g)) if g in p else language_id.PROFILE for k, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(far, key=far.get) if own else "und"
        want[i, best, round(1 - far[best] / (language_id.PROFILE * len(own)), 9) if own else 0.0] += 1
    assert Counter((r.doc_id, r.lang_pred, round(r.score, 9)) for r in got) == want


def test_toxic_scores_and_spans_against_enumeration(spark):
    draw = random.Random(13)
    arcs = np.array([[0.4, -0.7], [-0.6, 0.9]])
    weights = {"bad": 2.5, "vile": 1.5, "vile*": 1.0, "good": -1.0, "état": 0.7}
    field = toxicity.Field(weights, -1.2, arcs, (2.0, -3.0))
    rows = [(i, draw.choice(["", "1 "]) + " ".join(draw.choice(["bad", "Bad,", "vile", "vilest", "good", "x", "état", "-"]) for _ in range(draw.randint(0, 9))), "en", "a") for i in range(10, 70)] + EDGES
    got = {(r.doc_id, r.score): list(zip(r.begins, r.ends)) for r in toxicity.tag(documents(spark, rows), field).collect()}
    assert len(got) >= 60
    for i, text, *_ in rows:
        found = list(re.finditer(r"[^\W\d_]+", (text or "").lower()))
        odds = [-1.2 + sum(weights.get(f, 0) for f in [m.group(), *(m.group()[:k] + "*" for k in (4, 5, 6) if len(m.group()) >= k)]) for m in found]
        total, one = 0.0, np.zeros(len(found))
        for states in product((0, 1), repeat=len(found)):
            w = math.exp(sum(u for u, s in zip(odds, states) if s) + sum(arcs[a, b] for a, b in zip(states, states[1:])))
            total += w
            one += w * np.array(states, float)
        marginal = one / total
        score = 1 / (1 + math.exp(-(2 * np.sort(marginal)[-toxicity.TOP :].sum() - 3)))
        near = [spans for (d, s), spans in got.items() if d == i and abs(s - score) < 1e-9]
        assert near and near[0] == [m.span() for m, p in zip(found, marginal) if p >= 0.5], (i, text)
