"""Every query with DuckDB SQL gives what DuckDB gives, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLE = entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return db


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(ORACLE) <= set(entry.queries())


@pytest.mark.parametrize("name", [n for n in ORACLE if not n.startswith("op")])
def test_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    result = duck.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = sorted(repr([row[names.index(c)] for c in columns]) for row in result.fetchall())
    assert sorted(repr([row[c] for c in columns]) for row in df.collect()) == expected
