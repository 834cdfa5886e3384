import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm import topk

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("row", T.StringType())])


def brute(rows, k=5):
    ints = [(i, [math.floor(Fraction(float(x)) * 256) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(ints):
        if i % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(ints) if a != b and len(v) == len(q))[:k]
            out += [(i, r + 1, j, max(-(2**63), min(2**63 - 1, -s))) for r, (s, j) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("small", [0, 50_000])
def test_against_brute_force(spark, monkeypatch, small):
    for name, value in (("QUERIES", 4), ("CELL", 60), ("STATS", 8), ("SMALL", small)):
        monkeypatch.setattr(topk, name, value)
    draw = np.random.default_rng(1)
    rows = [(i, draw.normal(size=8).astype(np.float32).tolist(), "x") for i in range(400)]
    rows += [(400 + i, rows[7][1], "x") for i in range(60)]  # ties
    rows += [(1000, None, "x"), (1050, [1.0, None], "x"), (1100, [math.nan] * 8, "x"), (1150, [math.inf] * 8, "x"), (None, rows[3][1], "x"), (1200, [1.0, 2.0], "x"), (1201, [1.0, 3.0], "x"), (1250, [], "x"), (1251, [], "x")]
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA), F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False))).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_repeated_and_empty(spark):
    rows = [(50, [1.0, 0.0], "x"), (50, [1.0, 0.0], "x"), (3, [0.5, 0.0], "x")]
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect()
    assert sorted(map(tuple, got)) == [(50, 1, 50, 65536), (50, 1, 50, 65536), (50, 2, 3, 32768), (50, 2, 3, 32768)]
    assert topk.top_k(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0


def test_components_of_every_size(spark):
    draw = np.random.default_rng(2)
    rows = [(i, draw.normal(size=4).tolist(), "x") for i in range(200)]
    rows += [(200 + i, (draw.normal(size=4) * 10.0 ** draw.choice([0, 3, 7, 16, 30, 200])).tolist(), "x") for i in range(300)]
    rows += [(600, [1.7e308, -1.7e308, 0.0, 1.0], "x"), (601, [0.0, 0.0, 0.0, 0.0], "x"), (650, [2.0**53 + 2, 1.0, 0.0, 0.0], "x"), (651, [2.0**53, 1.0, 0.0, 0.0], "x")]
    schema = T.StructType([SCHEMA[0], T.StructField("embedding", T.ArrayType(T.DoubleType())), SCHEMA[2]])
    got = topk.top_k(spark.createDataFrame(rows, schema), F.col("vec_id") % 50 == 0).collect()
    assert sorted(map(tuple, got)) == brute(rows)
    probe = [(0, [1.0, 0.0], "x"), (1, [9e6, 0.0], "x"), (2, [0.5, 0.0], "x"), (3, [0.25, 0.0], "x")]
    assert topk.top_k(spark.createDataFrame(probe, SCHEMA), F.col("vec_id") == 0).orderBy("rank").first().vec_id == 1


def test_rank_keys_order_as_integers():
    values = sorted([0, 1, -1, 255, 256, -255, -256, 2**63, -(2**63), 10**80, -(10**80), 65535, -65536])
    assert sorted(values, key=topk.rank_key) == values


def test_whole_cells_are_ruled_out(spark, monkeypatch):
    monkeypatch.setattr(topk, "CELL", 100)
    draw = np.random.default_rng(3)
    centers = draw.normal(size=(20, 16)) * 4
    rows = [(i, (centers[i % 20] + draw.normal(size=16) * 0.1).tolist(), "x") for i in range(3000)]
    asked = F.col("vec_id") % 50 == 0
    table = spark.createDataFrame(rows, SCHEMA)
    n = topk.search(table, asked).agg(F.sum("evaluated")).first()[0]
    assert n < 0.15 * 60 * 3000
    got = topk.top_k(table, asked).collect()
    assert sorted(map(tuple, got)) == brute([(i, np.float32(v).tolist(), r) for i, v, r in rows])


def test_chunks_are_taken_by_bound(monkeypatch):
    monkeypatch.setattr(topk, "CHUNK", 16)
    draw = np.random.default_rng(4)
    x = draw.integers(-256, 256, (5000, 2)) / 256
    pivots = topk.choose_pivots(np.floor(x[:200] * 256))
    cell = topk.Vectors(np.arange(5000), np.arange(5000), x, topk.pivot_distances(np.floor(x * 256), pivots))
    search = topk.Search(cell.take(np.arange(0, 5000, 50)), 5)
    search.show(cell)
    scores = cell.scaled @ cell.scaled[::50].T
    scores[np.arange(0, 5000, 50), np.arange(100)] = -np.inf
    for i in range(100):
        want = np.lexsort((np.arange(5000), -scores[:, i]))[:5]
        assert [h["vec_id"] for h in search.hits(i)] == want.tolist()
    assert search.evaluated.sum() < 0.2 * 100 * 5000
