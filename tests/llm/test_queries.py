import os

import duckdb
import pytest

from tarn.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_oracle(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    result = db.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    columns = sorted(df.columns)
    assert sorted(names) == columns
    expected = sorted(repr([row[names.index(c)] for c in columns]) for row in result.fetchall())
    assert sorted(repr([row[c] for c in columns]) for row in df.collect()) == expected


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLE_SQL])
def test_one_row_for_each_document(spark, name):
    ids = [r.doc_id for r in queries.QUERIES[name](spark, SF).select("doc_id").collect()]
    assert sorted(ids) == sorted(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
