"""The engine's queries over the driver's tables: statements of the dialect, and DuckDB SQL with the same meaning."""

from __future__ import annotations

import base64
import re
import sqlite3
import uuid
from collections.abc import Callable
from contextlib import closing
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import AnalysisError
from .functions.classes import StorageClass, class_of
from .render import row_text
from .session import Engine
from .sources.scratch import new_path
from .sources.sqlite_file import SqliteFileSource

_NULLS = "SELECT n_nationkey, n_name, nullif(n_regionkey, 2) AS r, nullif(n_name, 'CHINA') AS t FROM nation"

#: name -> (statement, DuckDB SQL). ``nation_nulls`` is a view with NULLs made from nation.
STATEMENTS: dict[str, tuple[str, str]] = {
    "flagship": (
        "SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'",
        "SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'",
    ),
    "scan_star": ("SELECT * FROM region", "SELECT * FROM region"),
    "scan_star_documents": ("SELECT * FROM documents", "SELECT * FROM documents"),
    "scan_star_mixed": ("SELECT *, n_nationkey + 1 AS k FROM nation", "SELECT *, CAST(n_nationkey AS BIGINT) + 1 AS k FROM nation"),
    "project_cols": ("SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders", "SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders"),
    "project_dup": ("SELECT o_custkey AS a, o_custkey AS b FROM orders", "SELECT o_custkey AS a, o_custkey AS b FROM orders"),
    "project_case": ("SELECT O_ORDERKEY AS k FROM Orders", "SELECT o_orderkey AS k FROM orders"),
    "project_type_word": ("SELECT doc_id, text FROM documents WHERE lang = 'de'", "SELECT doc_id, text FROM documents WHERE lang = 'de'"),
    "project_const": ("SELECT 1 AS i, 2.5 AS f, 'x' AS s, TRUE AS b, FALSE AS c FROM region", "SELECT 1::BIGINT AS i, 2.5::DOUBLE AS f, 'x' AS s, 1::BIGINT AS b, 0::BIGINT AS c FROM region"),
    "arith_add": ("SELECT l_orderkey, l_linenumber + 10 AS i, l_quantity + 1 AS f FROM lineitem", "SELECT l_orderkey, l_linenumber::BIGINT + 10 AS i, l_quantity + 1 AS f FROM lineitem"),
    "arith_sub": ("SELECT l_linenumber - 10 AS i, l_quantity - l_tax AS f FROM lineitem", "SELECT l_linenumber::BIGINT - 10 AS i, l_quantity - l_tax AS f FROM lineitem"),
    "arith_mul": ("SELECT l_linenumber * l_linenumber AS i, l_quantity * 2 AS f FROM lineitem", "SELECT l_linenumber::BIGINT * l_linenumber AS i, l_quantity * 2 AS f FROM lineitem"),
    "arith_div_int": ("SELECT l_orderkey / 7 AS q, -l_orderkey / 7 AS m FROM lineitem", "SELECT l_orderkey // 7 AS q, (-l_orderkey) // 7 AS m FROM lineitem"),
    "arith_div_float": ("SELECT l_extendedprice / l_quantity AS u FROM lineitem", "SELECT l_extendedprice / l_quantity AS u FROM lineitem"),
    "arith_div_float_zero": (
        "SELECT l_orderkey, l_extendedprice / l_discount AS u FROM lineitem",
        "SELECT l_orderkey, CASE WHEN l_discount = 0 THEN 'inf'::DOUBLE ELSE l_extendedprice / l_discount END AS u FROM lineitem",
    ),
    "arith_precedence": ("SELECT 2 + l_linenumber * 3 - (4 - 1) AS i FROM lineitem", "SELECT 2 + l_linenumber::BIGINT * 3 - 3 AS i FROM lineitem"),
    "neg": ("SELECT -l_linenumber AS i, -l_tax AS f, -3 AS c FROM lineitem", "SELECT -l_linenumber::BIGINT AS i, -l_tax AS f, -3::BIGINT AS c FROM lineitem"),
    "not_value": ("SELECT NOT n_regionkey AS x, NOT n_name AS y FROM nation", "SELECT CAST(n_regionkey = 0 AS BIGINT) AS x, 0::BIGINT AS y FROM nation"),
    "not_precedence": ("SELECT n_nationkey FROM nation WHERE NOT n_regionkey = 1", "SELECT n_nationkey FROM nation WHERE n_regionkey <> 1"),
    "and_value": ("SELECT n_regionkey > 1 AND n_nationkey < 20 AS x FROM nation", "SELECT CAST(n_regionkey > 1 AND n_nationkey < 20 AS BIGINT) AS x FROM nation"),
    "or_value": ("SELECT n_regionkey > 3 OR n_nationkey < 5 AS x FROM nation", "SELECT CAST(n_regionkey > 3 OR n_nationkey < 5 AS BIGINT) AS x FROM nation"),
    "and_or_where": ("SELECT n_name FROM nation WHERE n_regionkey = 1 OR n_regionkey = 2 AND n_nationkey > 8", "SELECT n_name FROM nation WHERE n_regionkey = 1 OR (n_regionkey = 2 AND n_nationkey > 8)"),
    "guarded_division": ("SELECT n_nationkey FROM nation WHERE n_regionkey != 0 AND 10 / n_regionkey > 4", "SELECT n_nationkey FROM nation WHERE CASE WHEN n_regionkey <> 0 THEN 10 // n_regionkey > 4 ELSE FALSE END"),
    "cmp_chain": ("SELECT 1 < l_linenumber < 3 AS x FROM lineitem", "SELECT CAST(CAST(1 < l_linenumber AS BIGINT) < 3 AS BIGINT) AS x FROM lineitem"),
    "cmp_cross_class": (
        "SELECT l_returnflag > 5 AS x, l_returnflag = 5 AS y, 5 < l_returnflag AS z FROM lineitem",
        "SELECT 1::BIGINT AS x, 0::BIGINT AS y, 1::BIGINT AS z FROM lineitem",
    ),
    "cmp_cross_class_where": ("SELECT n_name FROM nation WHERE n_name > 99", "SELECT n_name FROM nation"),
    "cmp_int_float": ("SELECT l_orderkey, l_linenumber < 3.5 AS x FROM lineitem WHERE l_linenumber >= 1.5", "SELECT l_orderkey, CAST(l_linenumber < 3.5 AS BIGINT) AS x FROM lineitem WHERE l_linenumber >= 1.5"),
    "cmp_int_float_cols": ("SELECT l_linenumber < l_quantity AS x FROM lineitem", "SELECT CAST(l_linenumber < l_quantity AS BIGINT) AS x FROM lineitem"),
    "cmp_text_order": ("SELECT p_partkey, p_brand < 'Brand#2' AS x FROM part", "SELECT p_partkey, CAST(p_brand < 'Brand#2' AS BIGINT) AS x FROM part"),
    "bool_arith": ("SELECT (l_quantity > 25) + (l_tax = 0.05) AS x FROM lineitem", "SELECT CAST(l_quantity > 25 AS BIGINT) + CAST(l_tax = 0.05 AS BIGINT) AS x FROM lineitem"),
    "truthy_int": ("SELECT n_name FROM nation WHERE n_regionkey", "SELECT n_name FROM nation WHERE n_regionkey <> 0"),
    "truthy_float": ("SELECT l_orderkey FROM lineitem WHERE l_discount", "SELECT l_orderkey FROM lineitem WHERE l_discount <> 0"),
    "truthy_text": ("SELECT r_name FROM region WHERE r_name", "SELECT r_name FROM region WHERE r_name IS NOT NULL"),
    "null_eq": ("SELECT n_nationkey, r = r AS x, r != 1 AS y FROM nation_nulls", f"SELECT n_nationkey, 1::BIGINT AS x, CAST(r IS DISTINCT FROM 1 AS BIGINT) AS y FROM ({_NULLS})"),
    "null_lt": ("SELECT n_nationkey FROM nation_nulls WHERE r < 3", f"SELECT n_nationkey FROM ({_NULLS}) WHERE r IS NULL OR r < 3"),
    "null_gt_value": ("SELECT r > 1 AS x, r <= 1 AS y FROM nation_nulls", f"SELECT CAST(coalesce(r > 1, FALSE) AS BIGINT) AS x, CAST(NOT coalesce(r > 1, FALSE) AS BIGINT) AS y FROM ({_NULLS})"),
    "null_arith": ("SELECT n_nationkey, r + 1 < 0 AS x, r / 0.5 < 0 AS y FROM nation_nulls", f"SELECT n_nationkey, CAST(r IS NULL AS BIGINT) AS x, CAST(r IS NULL AS BIGINT) AS y FROM ({_NULLS})"),
    "null_not": ("SELECT NOT r AS x, NOT t AS y FROM nation_nulls", f"SELECT CAST(r IS NULL OR r = 0 AS BIGINT) AS x, CAST(t IS NULL AS BIGINT) AS y FROM ({_NULLS})"),
    "null_cross_class": ("SELECT r < t AS x, r = t AS y FROM nation_nulls", f"SELECT CAST(t IS NOT NULL AS BIGINT) AS x, CAST(r IS NULL AND t IS NULL AS BIGINT) AS y FROM ({_NULLS})"),
    "limit_cuts": ("SELECT l_returnflag, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 2 LIMIT 100", "SELECT l_returnflag, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 2 LIMIT 100"),
    "limit_zero": ("SELECT n_name FROM nation LIMIT 0", "SELECT n_name FROM nation LIMIT 0"),
    "limit_all": ("SELECT n_name FROM nation LIMIT 1000", "SELECT n_name FROM nation"),
    "limit_negative": ("SELECT n_name FROM nation LIMIT -1", "SELECT n_name FROM nation"),
    "limit_expr": ("SELECT 1 AS one FROM lineitem LIMIT 2 + 3 * 2", "SELECT 1::BIGINT AS one FROM lineitem LIMIT 8"),
    "limit_true": ("SELECT 1 AS one FROM lineitem LIMIT TRUE", "SELECT 1::BIGINT AS one FROM lineitem LIMIT 1"),
}
for _op, _sql in (("eq", "="), ("ne", "!="), ("gt", ">"), ("ge", ">="), ("lt", "<"), ("le", "<=")):
    STATEMENTS[f"cmp_{_op}"] = (
        f"SELECT l_orderkey, l_linenumber {_sql} 3 AS x, l_quantity {_sql} 25 AS y FROM lineitem WHERE l_returnflag {_sql} 'N'",
        f"SELECT l_orderkey, CAST(l_linenumber {_sql} 3 AS BIGINT) AS x, CAST(l_quantity {_sql} 25 AS BIGINT) AS y FROM lineitem WHERE l_returnflag {_sql} 'N'",
    )


def engine_for(spark: SparkSession, sf_dir: str, statement: str = "") -> Engine:
    """An engine with the driver's tables that a statement names."""
    engine = Engine(spark)
    for name in re.findall(r"FROM (\w+)", statement, re.IGNORECASE):
        if name == "nation_nulls":
            nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
            engine.register(name, nation.select("n_nationkey", "n_name", F.expr("nullif(n_regionkey, 2)").alias("r"), F.expr("nullif(n_name, 'CHINA')").alias("t")))
        else:
            engine.register(name, spark.read.parquet(f"{sf_dir}/{name.lower()}.parquet"))
    return engine


def run_statement(statement: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine_for(spark, sf_dir, statement).execute(statement)


def create_insert_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE TABLE, INSERT and SELECT over a stored table of its own."""
    engine, name = Engine(spark), f"made_{uuid.uuid4().hex[:12]}"
    engine.execute(f"CREATE TABLE {name} (id INTEGER PRIMARY KEY, name VARCHAR(20) NOT NULL, score FLOAT, b BLOB)")
    engine.execute(f"INSERT INTO {name} VALUES (1, 'one', 1.5, NULL)")
    engine.execute(f"INSERT INTO {name} VALUES (-2, 'two', -2.5, NULL);")
    return engine.execute(f"SELECT id, name, score, score > 0 AS positive FROM {name}")


def insert_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INSERT into a registered table."""
    engine = engine_for(spark, sf_dir, "FROM region")
    engine.execute("INSERT INTO region VALUES (99, 'NOWHERE')")
    return engine.execute("SELECT * FROM region")


def as_files(spark: SparkSession, sf_dir: str, name: str, rowid: str, page_size: int = 4096, parts: int = 4) -> str:
    """A driver table as a folder of database files, a file for each range of the column that gives the rowids."""
    path = new_path(spark, f"{name}-files")
    spark.dataSource.register(SqliteFileSource)
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    rows = rows.select(*[F.col(f.name) for f in rows.schema.fields if class_of(f.dataType) is not StorageClass.OPAQUE])
    rows = rows.repartitionByRange(parts, rowid).sortWithinPartitions(rowid)
    rows.write.format("sqlite_file").mode("append").options(path=path, table=name, rowid=rowid, page_size=page_size).save()
    return path


def file_statement(name: str, rowid: str, statement: str, spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """A statement over a driver table that was written as database files."""
    return Engine(spark).open_file(as_files(spark, sf_dir, name, rowid, **options)).execute(statement)


def file_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of one file from the largest rowid down, numbered as they come."""
    path = as_files(spark, sf_dir, "nation", "n_nationkey", parts=1)
    rows = spark.read.format("sqlite_file").options(path=path, table="nation", order="desc").load()
    return rows.select("n_nationkey", "n_name", (F.monotonically_increasing_id() + 1).alias("place"))


def file_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of an index in its order, from a small file in memory (nation has 25 rows)."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey").collect()
    with closing(sqlite3.connect(":memory:")) as db:
        db.execute("CREATE TABLE nation (n_nationkey INTEGER PRIMARY KEY, n_name TEXT, n_regionkey INT)")
        db.execute("CREATE INDEX by_region ON nation (n_regionkey, n_name)")
        db.executemany("INSERT INTO nation VALUES (?, ?, ?)", [tuple(r) for r in rows])
        db.commit()
        data = base64.b64encode(db.serialize()).decode()
    spark.dataSource.register(SqliteFileSource)
    entries = spark.read.format("sqlite_file").options(data=data, index="by_region").load()
    return entries.select("n_regionkey", "n_name", F.col("_rowid").alias("n_nationkey"), (F.monotonically_increasing_id() + 1).alias("place"))


def insert_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which INSERTs the classes of a table's columns let through."""
    engine, name = Engine(spark), f"made_{uuid.uuid4().hex[:12]}"
    engine.execute(f"CREATE TABLE {name} (i INTEGER, f FLOAT, t TEXT)")
    out = []
    for values in ('1, 1.5, "x"', '1, 1, "x"', '1.5, 1.5, "x"', '"1", 1.5, "x"', "1, 1.5", "NULL, NULL, NULL"):
        try:
            engine.execute(f"INSERT INTO {name} VALUES ({values})")
            out.append((values, 1))
        except AnalysisError:
            out.append((values, 0))
    return spark.createDataFrame(out, "row string, stored bigint")


def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns, declared types and classes of a table that CREATE TABLE made, as the catalog holds them."""
    engine, name = Engine(spark), f"made_{uuid.uuid4().hex[:12]}"
    engine.execute(f"CREATE TABLE {name} (id INTEGER PRIMARY KEY, name VARCHAR(20) NOT NULL, score FLOAT, d DECIMAL(10, 2))")
    return spark.createDataFrame([c[:3] for c in Engine(spark).catalog.describe(name)], "column string, declared string, class string")


def rendered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of region (5) as the shell prints them."""
    rows = engine_for(spark, sf_dir, "FROM region").execute("SELECT *, r_regionkey / 2.0 AS half FROM region").toLocalIterator()
    return spark.createDataFrame([(row_text(r),) for r in rows], "line string")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: partial(run_statement, statement) for name, (statement, _) in STATEMENTS.items()}
QUERIES |= {"create_insert_scan": create_insert_scan, "insert_registered": insert_registered, "insert_checks": insert_checks, "catalog_columns": catalog_columns, "rendered_rows": rendered_rows}
QUERIES |= {
    "sqlite_scan": partial(file_statement, "nation", "n_nationkey", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey != 3"),
    "file_seek": partial(file_statement, "orders", "o_orderkey", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 1000"),
    "file_range": partial(file_statement, "orders", "o_orderkey", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey > 99.5 AND 2000 >= o_orderkey AND o_custkey != 7"),
    "file_overflow": partial(file_statement, "documents", "doc_id", "SELECT doc_id, text, source FROM documents", page_size=1024),
    "file_columns": partial(file_statement, "orders", "o_orderkey", "SELECT o_totalprice * 2 AS twice FROM orders WHERE o_orderstatus < 'O'"),
    "file_limit": partial(file_statement, "nation", "n_nationkey", "SELECT n_nationkey, n_name FROM nation LIMIT 3 + 4", parts=1),  # a file reads in order of rowid
    "file_reverse": file_reverse,
    "file_index": file_index,
}

ORACLE_SQL: dict[str, str] = {name: sql for name, (_, sql) in STATEMENTS.items()}
ORACLE_SQL |= {
    "create_insert_scan": "SELECT * FROM (VALUES (1::BIGINT, 'one', 1.5::DOUBLE, 1::BIGINT), (-2::BIGINT, 'two', -2.5::DOUBLE, 0::BIGINT)) AS v(id, name, score, positive)",
    "insert_registered": "SELECT * FROM region UNION ALL SELECT 99, 'NOWHERE'",
    "insert_checks": "SELECT * FROM (VALUES ('1, 1.5, \"x\"', 1::BIGINT), ('1, 1, \"x\"', 0), ('1.5, 1.5, \"x\"', 0), ('\"1\", 1.5, \"x\"', 0), ('1, 1.5', 0), ('NULL, NULL, NULL', 1)) AS v(row, stored)",
    "catalog_columns": "SELECT * FROM (VALUES ('id', 'INTEGER', 'INTEGER'), ('name', 'VARCHAR', 'TEXT'), ('score', 'FLOAT', 'REAL'), ('d', 'DECIMAL', 'BLOB')) AS v(\"column\", declared, \"class\")",
    "rendered_rows": "SELECT r_regionkey || ', ' || r_name || ', ' || CASE WHEN r_regionkey % 2 = 0 THEN (r_regionkey // 2)::VARCHAR ELSE (r_regionkey / 2.0)::DOUBLE::VARCHAR END AS line FROM region",
    "file_seek": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 1000",
    "file_range": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey BETWEEN 100 AND 2000 AND o_custkey <> 7",
    "file_overflow": "SELECT doc_id, text, source FROM documents",
    "file_columns": "SELECT o_totalprice * 2 AS twice FROM orders WHERE o_orderstatus < 'O'",
    "file_limit": "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 7",
    "file_reverse": "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, row_number() OVER (ORDER BY n_nationkey DESC) AS place FROM nation",
    "file_index": "SELECT n_regionkey::BIGINT AS n_regionkey, n_name, n_nationkey::BIGINT AS n_nationkey, row_number() OVER (ORDER BY n_regionkey, n_name) AS place FROM nation",
    "sqlite_scan": "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation WHERE n_regionkey <> 3",
}
