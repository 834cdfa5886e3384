import hashlib
import random

from tarn.llm import exact_dedup

from .conftest import EDGES, SCHEMA, documents


def brute(rows):
    by = {}
    for i, t, *_ in rows:
        by.setdefault(t or "", []).append(i)
    return sorted(repr((i, max((x for x in by[t or ""] if x is not None), default=None), len(by[t or ""]), hashlib.sha256((t or "").encode()).hexdigest())) for i, t, *_ in rows)


def test_against_brute_force(spark, prose):
    draw = random.Random(2)
    texts = [prose(draw.randint(1, 40)) for _ in range(40)]
    texts += [t + " more" for t in texts[:10]] + ["x" * 31, "x" * 32, "x" * 33, "x" * 544, "x" * 545, "y" * 200_000, "y" * 200_000 + "z"]
    rows = [(i, draw.choice(texts), "en", "a") for i in range(300)] + [(1000 + i, "y" * 200_000, "en", "a") for i in range(3)] + EDGES
    got = exact_dedup.exact_classes(documents(spark, rows).repartition(5)).collect()
    assert sorted(repr((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == brute(rows)
    assert all(r.kept <= (r.doc_id == r.keep_id) for r in got)
    groups = {(r.keep_id, r.text_sha256) for r in got}
    assert sum(r.kept for r in got) == len(groups)  # one row of each group, repeated rows too


def test_rows_that_stay(spark):
    rows = EDGES + [(7, "one", "en", "a"), (8, "two", "en", "a"), (8, "three", "en", "a")]
    df = exact_dedup.deduplicate(documents(spark, rows))
    assert df.columns == SCHEMA.names
    assert sorted(r.text or "" for r in df.collect()) == sorted({t or "" for _, t, *_ in rows})
    assert exact_dedup.deduplicate(documents(spark, [])).count() == 0


def test_radix_groups():
    texts = [b"", b"a", b"", b"a" * 32, b"a" * 32, b"a" * 33, b"a" * 600, b"a" * 600, b"a" * 599 + b"b"]
    assert sorted(map(sorted, exact_dedup.radix_groups(texts))) == [[0, 2], [1], [3, 4], [5], [6, 7], [8]]
