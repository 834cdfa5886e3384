import random
from fractions import Fraction

from tarn.llm import mixing

from .conftest import EDGES, SCHEMA, documents


def test_targets():
    sizes = [100, 10, 1000, 0]
    got = mixing.targets(sizes)
    assert sum(got) == Fraction(3, 2) * sum(sizes) and all(t <= 2 * s for t, s in zip(got, sizes))
    assert got[0] == 200 and got[1] == 20 and got[3] == 0  # the excess goes to the third
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0, 0]


def test_sainte_lague_against_quotients():
    draw = random.Random(1)
    for _ in range(300):
        n = draw.randint(1, 8)
        votes = [draw.choice([0, 1, 5, 5, 100, Fraction(7, 3)]) for _ in range(n)]
        most = [draw.randint(0, 30) for _ in range(n)]
        seats = draw.randint(0, 60)
        plain = sorted((-Fraction(v) / (2 * k + 1), i) for i, v in enumerate(votes) if v for k in range(most[i]))[:seats]
        assert mixing.sainte_lague(votes, seats, most) == [sum(i == j for _, j in plain) for i in range(n)]


def test_plan_and_mix(spark, prose):
    draw = random.Random(4)
    rows = [(i, prose(draw.randint(1, 300)), "en", draw.choice(["a"] * 6 + ["b", "c", None])) for i in range(10, 400)] + EDGES
    docs = documents(spark, rows)
    got = mixing.plan(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault((r.source_size, r.target), []).append(r)
    for (size, target), own in by.items():
        assert sum(r.size for r in own) == size and abs(sum(r.taken for r in own) - target) <= max(16, 0.01 * target)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.plan(docs.repartition(7)).collect()))
    mixed = mixing.mix(docs.where("doc_id >= 10"))
    assert mixed.columns == SCHEMA.names
    words = {}
    for r in mixed.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
        assert r.n_chars == len(r.text)
    planned = {r.doc_id: r.taken for r in mixing.plan(docs.where("doc_id >= 10")).collect() if r.taken}
    assert words == planned
    assert mixing.plan(documents(spark, [])).count() == 0 and mixing.plan(documents(spark, EDGES[:3])).count() == 3
