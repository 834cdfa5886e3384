import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *[T.StructField(n, T.StringType()) for n in ("row", "key", "cid", "digest", "n", "_id", "_kept_id", "base", "s", "size")]])


def documents(spark, rows):
    """(doc_id, text, lang, source) rows as documents, with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t), *["x"] * 10) for i, t, lang, source in rows], SCHEMA)


@pytest.fixture(scope="session")
def prose():
    import random

    draw = random.Random(11)
    words = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 7))) for _ in range(400)]

    def make(n):
        return " ".join(draw.choice(words) for _ in range(n))

    return make


#: Null and empty texts, a text without words, repeated rows, null ids, null sources.
EDGES = [(1, None, "en", "a"), (2, "", "en", None), (3, " \n\t ", None, "b"), (4, "one", "en", "a"), (4, "one", "en", "a"), (None, "one", "en", "a"), (None, None, None, None), (5, "é \U0001f600 ▁ x", "de", "b")]
