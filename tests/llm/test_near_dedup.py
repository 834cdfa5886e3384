import random
import re

import numpy as np
import pytest

from tarn.llm import near_dedup
from tarn.llm.shingles import sets, word_hashes

from .conftest import EDGES, SCHEMA, documents


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows, percent=85):
    own = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(own[i] & own[j])
            if own[i] and own[j] and 100 * both >= percent * (len(own[i]) + len(own[j]) - both):
                root[find(i)] = find(j)
    low = {}
    for i, (d, *_) in enumerate(rows):
        low[find(i)] = min((x for x in (low.get(find(i)), d) if x is not None), default=None)
    return sorted(repr((d, len(own[i]), low[find(i)] if own[i] else d)) for i, (d, *_) in enumerate(rows))


@pytest.mark.parametrize("block", [256, 8])
def test_against_brute_force(spark, prose, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    draw = random.Random(5)
    rows = list(EDGES) + [(6, "one TWO", "en", "a"), (7, "One two", "en", "a"), (8, "one two three four five", "en", "a")]
    for g in range(12):
        base = prose(draw.choice([30, 60, 150])).split()
        for _ in range(40 if g == 0 else draw.randint(1, 8)):
            copy = list(base)
            for _ in range(draw.randint(0, 4)):
                copy[draw.randrange(len(copy))] = draw.choice(["Changed", "other", "words"])
            rows.append((len(rows) * 7 % 1009 + 100, " \n".join(copy), "en", "a"))
    got = near_dedup.near_classes(documents(spark, rows).repartition(3)).collect()
    assert sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in got) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_rows_that_stay(spark, prose):
    base = prose(80)
    rows = [(3, base, "en", "a"), (2, base + " tail", "en", "a"), (9, prose(80), "en", "a"), (2, base + " tail", "en", "a"), *EDGES]
    df = near_dedup.deduplicate(documents(spark, rows), percent=80)
    assert df.columns == SCHEMA.names
    kept = sorted((str(r.doc_id), r.text) for r in df.collect() if r.text and r.text.strip())
    assert [(i, t) for i, t in kept if t == base] == [] and [i for i, t in kept if t == base + " tail"] == ["2"]
    assert {i for i, _ in kept} >= {"2", "9", "4", "5"}
    assert near_dedup.near_classes(documents(spark, [])).count() == 0


def test_shingle_sets(prose):
    texts = [None, "", " ", "a", "A", "a b", "a b c d e", "a  b\tc\nd e", "a b c d e f", "é" * 5000, prose(3000)]
    own = list(sets(texts))
    assert [len(s) for s in own] == [len(shingles(t)) for t in texts]
    assert (own[3] == own[4]).all() and (own[6] == own[7]).all() and not (own[3] == own[5]).all()
    assert len(word_hashes(b"x" * (5 << 20) + b" y")[1]) == 2


def test_signature_estimates_similarity():
    signer, draw = near_dedup.Signer(), np.random.default_rng(3)
    base = draw.integers(0, 2**63, 1000, dtype=np.uint64)
    other = np.concatenate([base[:900], draw.integers(0, 2**63, 100, dtype=np.uint64)])
    close = (signer.signature(np.sort(base)) == signer.signature(np.sort(other))).mean()
    assert abs(close - 900 / 1100) < 0.15
    both = near_dedup.overlaps([base, other, base[:10]])
    assert (both[0, 1], both[0, 2], both[1, 2], both[2, 0]) == (900, 10, 10, 10)


def test_a_large_group_of_near_copies_costs_its_size(spark, prose, monkeypatch):
    draw = random.Random(9)
    base = prose(400).split()
    texts = set()
    while len(texts) < 5000:
        copy = list(base)
        for _ in range(draw.randint(1, 3)):
            copy[draw.randrange(len(copy))] = f"w{draw.randrange(10**6)}"
        texts.add(" ".join(copy))
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(sorted(texts))]).repartition(4)
    seen = {}
    for name in ("_led", "_open_tiles"):
        monkeypatch.setattr(near_dedup, name, lambda *a, own=getattr(near_dedup, name), name=name: seen.setdefault(name, own(*a)))
    counted = {}
    monkeypatch.setattr(near_dedup, "discard", lambda *a: counted.update({n: df.count() for n, df in seen.items()}))
    got = near_dedup.near_classes(docs)
    assert got.where("component_id = 0").count() == 5000
    assert counted["_led"] < 5 * 5000 and counted["_open_tiles"] == 0


def test_distances_to_a_leader():
    a, b, c = (np.array(x, np.uint64) for x in ([1, 2, 3, 9], [2, 3, 4], [10, 11]))
    both, union = near_dedup.distances(a, [b, c, a])
    assert both.tolist() == [2, 0, 4] and union.tolist() == [5, 6, 4]


def test_rings_keep_every_link(spark, prose):
    """Chains of edits: neighbours are linked, ends are far from their leader."""
    draw, rows = random.Random(10), []
    for g in range(6):
        words = prose(120).split()
        for _ in range(25):
            for _ in range(2):
                words[draw.randrange(len(words))] = f"v{draw.randrange(10**6)}"
            rows.append((draw.randrange(10**6), " ".join(words), "en", "a"))
    got = near_dedup.near_classes(documents(spark, rows)).collect()
    assert sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in got) == brute(rows)
