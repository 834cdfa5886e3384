import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tarn.llm import mixing

from .conftest import EDGES, documents


def test_rows_without_an_id_or_with_a_repeated_one_take_their_own_quota(spark, prose):
    docs = documents(spark, [(None if i % 2 else 7, prose(20), "en", "abc"[i % 3]) for i in range(120)] + EDGES)
    planned, words = Counter(), Counter()
    for r in mixing.plan(docs).collect():
        planned[r.target] += r.taken
    for r in mixing.mix(docs).collect():
        words[r.source] += len(r.text.split())
    assert len(planned) >= 3 and sorted(n for n in words.values() if n) == sorted(n for n in planned.values() if n)


def test_first_words_of_a_text(spark):
    draw = random.Random(3)
    rows = []
    for _ in range(300):
        text = "".join(draw.choice(["a", "bé", " ", "\t", "\n\x0b", " ", "\U0001f600", "  "]) for _ in range(draw.randint(1, 20)))
        ends = [m.end() for m in re.finditer(mixing.WORD, text)]
        rows += [(text, k + 1, text[:end]) for k, end in enumerate(ends)]
    rows.append(("x " * 50_000, 49_999, ("x " * 49_999)[:-1]))
    df = spark.createDataFrame(rows, "text string, n long, want string")
    assert df.where(mixing._first_words(F.col("text"), F.col("n")) != F.col("want")).count() == 0
