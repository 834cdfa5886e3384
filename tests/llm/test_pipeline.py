"""Every stage against a plain version of it, and the whole on the smallest tables."""

import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarn.llm import mixing, toxicity

from .conftest import EDGES, SCHEMA, documents
from .test_near_dedup import brute

STAGES = dict(corpus_pipeline.STAGES)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark, prose):
    draw = random.Random(8)
    rows = []
    for i in range(60):
        words = prose(draw.randint(30, 80)).split()
        rows.append((i, " ".join(words), "en", draw.choice("aab")))
        if i % 10 == 0:
            rows.append((100 + i, rows[-1][1], "en", "b"))
            rows.append((200 + i, rows[-1][1] + " tail", "en", "a"))
    return rows


def test_copies(spark, docs):
    kept = {}
    for i, t, *_ in docs:
        kept[t] = max(i, kept.get(t, -1))
    out = STAGES["exact dedup"](spark, documents(spark, docs), "")
    assert out.columns == SCHEMA.names and {r.doc_id for r in out.collect()} == set(kept.values())


def test_near_copies(spark, docs):
    out = STAGES["near dedup"](spark, documents(spark, docs), "")
    want = {int(x.strip("()").split(",")[2]) for x in brute(docs, 80)}
    assert out.columns == SCHEMA.names and {r.doc_id for r in out.collect()} == want


def test_mixing(spark, docs):
    out = STAGES["mixing"](spark, documents(spark, docs), "").groupBy("doc_id").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()
    assert {r.doc_id: r.n for r in out} == {r.doc_id: r.taken for r in mixing.plan(documents(spark, docs)).collect() if r.taken}


def test_toxic_documents_go_and_clean_ones_stay(spark, prose, tmp_path):
    draw = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        words = prose(draw.randint(20, 60)).split()
        toxic = i % 4 == 0
        for _ in range(3 * toxic):
            words.insert(draw.randrange(len(words)), draw.choice(["vilex", "Zorgon", "zorgish"]))
        rows.append((i, " ".join(words), "en", "a"))
        labels.append((i, 1, int(toxic)))
    labels = [row for row in labels if row[0] % 3]  # a third has no label
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = STAGES["toxicity"](spark, documents(spark, rows), str(tmp_path))
    assert out.columns == SCHEMA.names and {r.doc_id for r in out.collect()} == {i for i in range(600) if i % 4}


def test_stages_on_odd_rows_and_empty_tables(spark, prose, tmp_path):
    spark.createDataFrame([(1, 1, 0), (4, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = EDGES + EDGES + [(60 + i, prose(30), None, None) for i in range(3)] + [(70, "long " + prose(20_000), "en", "a")]
    want = {"toxicity": len(rows), "exact dedup": 8, "near dedup": 10, "mixing": None, "sentencepiece": len(rows)}
    for name, stage in STAGES.items():
        empty = stage(spark, documents(spark, []), str(tmp_path))
        assert empty.count() == 0, name
        got = stage(spark, documents(spark, rows), str(tmp_path)).collect()
        assert want[name] in (None, len(got)), (name, len(got))
    copies = {(r.doc_id, r.text) for r in STAGES["exact dedup"](spark, documents(spark, rows), str(tmp_path)).collect()}
    assert {(i, t) for i, t in copies if i is not None and i < 10} == {(2, ""), (3, " \n\t "), (4, "one"), (5, EDGES[-1][1])}


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_whole(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF).collect()
    assert len(out) > 0 and all(r.n_tokens == len(r.ids) and r.ids[0] == 1 and r.ids[-1] == 2 for r in out)
    left = STAGES["toxicity"](spark, docs, SF)
    field = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"), corpus_pipeline.held_out() == F.lit(False))
    scores = {r.doc_id: r.score for r in toxicity.tag(docs, field).collect()}
    assert {r.doc_id for r in left.collect()} == {i for i, s in scores.items() if s < toxicity.THRESHOLD}
    assert {r.doc_id for r in out} <= {r.doc_id for r in left.collect()}
