import math
from itertools import product

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import types as T

from tarn.errors import AnalysisError
from tarn.functions.classes import StorageClass, affinity
from tarn.plans import constants
from tarn.plans.parser import parse
from tarn.render import row_text
from tarn.session import Engine
from tarn.shell import run

OPS = ("=", "!=", "<", "<=", ">", ">=")


def key(v):
    """Plain model of the total order: NULL, numbers (NaN highest), text, blobs."""
    if v is None:
        return (0,)
    if isinstance(v, float) and math.isnan(v):
        return (1, 1, 0)
    if isinstance(v, (int, float)):
        return (1, 0, v)
    return (2, v.encode()) if isinstance(v, str) else (3, bytes(v))


def holds(op, a, b):
    a, b = key(a), key(b)
    return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("schema,left,right", [
    ("a bigint, b bigint", [None, 1, 2, -5], [None, 1, 2, -5]),
    ("a double, b double", [None, 0.0, 1.0, -2.0, math.inf, -math.inf, math.nan], [None, 0.0, 1.0, -2.0, math.inf, -math.inf, math.nan]),
    ("a bigint, b double", [None, 0, 1, 2**53 + 1, -(2**53) - 1, 2**63 - 1, -(2**63)], [None, 0.5, float(2**53), -float(2**53), 2.0**63, -(2.0**63), 1e300, math.inf, -math.inf, math.nan]),
    ("a double, b bigint", [None, 0.5, float(2**53), 2.0**63, -(2.0**63), math.inf, math.nan], [None, 0, 2**53 + 1, 2**63 - 1, -(2**63)]),
    ("a string, b string", [None, "", "B", "a", "é", "z"], [None, "", "B", "a", "é", "z"]),
    ("a binary, b binary", [None, b"", b"\x01", b"\xc3", b"\xff"], [None, b"", b"\x01", b"\xc3", b"\xff"]),
    ("a bigint, b string", [None, 0, 7], [None, "", "7"]),
    ("a string, b binary", [None, "", "zz"], [None, b"", b"\x00"]),
    ("a binary, b double", [None, b""], [None, 1.5, math.nan]),
])
def test_total_order(spark, schema, left, right):
    pairs = list(product(left, right))
    engine = Engine(spark).register("t", frame(spark, pairs, schema))
    items = ", ".join(f"a {op} b AS c{i}" for i, op in enumerate(OPS))
    for row in engine.execute(f"SELECT a, b, {items} FROM t").collect():
        assert list(row[2:]) == [int(holds(op, row.a, row.b)) for op in OPS], row
    for op in OPS:
        kept = engine.execute(f"SELECT a, b FROM t WHERE a {op} b").count()
        assert kept == sum(holds(op, a, b) for a, b in pairs)


@pytest.mark.parametrize("literal,value", [("3", 3), ("9007199254740993", 2**53 + 1), ("-9007199254740993", -(2**53) - 1), ("9223372036854775807", 2**63 - 1), ("2.0", 2.0), ("2.5", 2.5), ("-1", -1), ("9.5", 9.5)])
def test_literal_filters(spark, literal, value):
    ints, floats = [None, -2, -1, 0, 2, 3, 4], [None, -1.0, 2.0, 2.5, 3.0, 2.0**53, 2.0**53 + 2, -(2.0**53), -(2.0**53) - 2, 2.0**63, math.nan, math.inf, -math.inf]
    engine = Engine(spark).register("i", frame(spark, [(x,) for x in ints], "a int")).register("f", frame(spark, [(x,) for x in floats], "a double"))
    for op in OPS:
        for table, rows in (("i", ints), ("f", floats)):
            assert engine.execute(f"SELECT a FROM {table} WHERE a {op} {literal}").count() == sum(holds(op, x, value) for x in rows), (op, table)
            assert engine.execute(f"SELECT a FROM {table} WHERE NOT a {op} {literal}").count() == sum(not holds(op, x, value) for x in rows), (op, table)
            assert engine.execute(f"SELECT a FROM {table} WHERE {literal} {op} a").count() == sum(holds(op, value, x) for x in rows), (op, table)


def test_boolean_columns_are_integers(spark):
    engine = Engine(spark).register("t", frame(spark, [(True,), (False,), (None,)], "b boolean"))
    for where, n in (("b = 1", 1), ("b < 1", 2), ("b > 0.5", 1), ("b", 1), ("b != TRUE", 2), ("b + 1 = 2", 1)):
        assert engine.execute(f"SELECT b FROM t WHERE {where}").count() == n, where
    assert [tuple(r) for r in engine.execute("SELECT b, b = 1 AS x, b < 0.5 AS y FROM t").collect()] == [(True, 1, 0), (False, 0, 1), (None, 0, 1)]


def test_truthiness(spark):
    rows = [(None, None, None, None), (0, 0.0, "", bytearray(b"")), (1, 0.5, "x", bytearray(b"x")), (-1, math.nan, "0", bytearray(b"\x00"))]
    engine = Engine(spark).register("t", frame(spark, rows, "i bigint, f double, t string, b binary"))
    for column, expected in (("i", 2), ("f", 2), ("t", 3), ("b", 0)):
        assert engine.execute(f"SELECT i FROM t WHERE {column}").count() == expected
        assert engine.execute(f"SELECT i FROM t WHERE NOT {column}").count() == 4 - expected
    values = engine.execute("SELECT i AND t AS x, i OR f AS y, NOT i AS z FROM t").collect()
    assert [tuple(r) for r in values] == [(0, 0, 1), (0, 0, 1), (1, 1, 0), (1, 1, 0)]


def test_arithmetic(spark):
    engine = Engine(spark).register("t", frame(spark, [(7, 2, 1.5), (-7, 2, 0.0), (None, 1, None)], "a int, b bigint, f double"))
    df = engine.execute("SELECT a / b AS q, a * b AS m, a + f AS s, -a AS n, (a > 1) + 1 AS p FROM t")
    assert [f.dataType for f in df.schema] == [T.LongType(), T.LongType(), T.DoubleType(), T.LongType(), T.LongType()]
    assert [tuple(r) for r in df.collect()] == [(3, 14, 8.5, -7, 2), (-3, -14, -7.0, 7, 1), (None, None, None, None, 1)]
    for query in ("SELECT a / 0 AS x FROM t", "SELECT b + 9223372036854775807 AS x FROM t"):
        with pytest.raises(PySparkException):
            engine.execute(query).collect()
    assert engine.execute("SELECT a FROM t WHERE f != 0 AND 1 / b < 5 LIMIT 1 + 1").count() == 2


def test_float_division(spark):
    values = [None, 0.0, 1.0, -2.0, math.inf, -math.inf, math.nan]
    engine = Engine(spark).register("t", frame(spark, list(product(values, values)), "a double, b double"))

    def divide(a, b):
        if a is None or b is None:
            return None
        if b == 0:
            return math.nan if a == 0 or math.isnan(a) else math.copysign(math.inf, a)
        return a / b

    for a, b, q in engine.execute("SELECT a, b, a / b AS q FROM t").collect():
        assert repr(q).lstrip("-") == repr(divide(a, b)).lstrip("-") and (q is None or not q < 0 < divide(a, b)), (a, b, q)


def test_limit_and_star(spark):
    engine = Engine(spark).register("t", spark.range(10).selectExpr("id AS A", "id * 2 AS b"))
    assert engine.execute("SELECT a, *, * FROM t LIMIT 3").columns == ["a", "A", "b", "A", "b"]
    for text, rows in (("0", 0), ("3", 3), ("-1", 10), ("2 + 3 * 2", 8), ("TRUE", 1), ("7 / 2", 3), ("99999999999", 10), ("1 < 2", 1), ("NOT 1", 0), ("2 > 'x'", 0)):
        assert engine.execute(f"SELECT 1 AS one FROM t LIMIT {text}").count() == rows, text
    for text in ("a", "1.5", "'x'", "1 / 0", "9223372036854775807 + 1", "'a' + 1"):
        with pytest.raises(AnalysisError):
            engine.execute(f"SELECT a FROM t LIMIT {text}")
    assert constants.evaluate(parse("SELECT -7 / 2 FROM t").items[0].expr) == -3


def test_names(spark):
    engine = Engine(spark).register("T", spark.range(2).selectExpr("id", "array(id) AS list", "'x' AS text"))
    assert engine.execute("SELECT LIST, text FROM t").count() == 2
    for query in ("SELECT nope FROM t", "SELECT id FROM nope", "SELECT list = 1 FROM t", "SELECT text + 1 FROM t", "SELECT -text FROM t", "SELECT * + 1 FROM t"):
        with pytest.raises(Exception) as e:
            engine.execute(query)
        assert type(e.value).__name__ in ("AnalysisError", "ParseError")


def test_pushdown(spark, tmp_path):
    spark.range(100).selectExpr("id AS a", "id * 1.0D AS f", "cast(id AS string) AS t").write.parquet(str(tmp_path / "t"))
    engine = Engine(spark).register("t", spark.read.parquet(str(tmp_path / "t")))
    for op, pushed in (("<", "LessThan(f,3.0)"), ("<=", "LessThanOrEqual(f,3.0)"), (">", "GreaterThan(f,3.0)"), (">=", "GreaterThanOrEqual(f,3.0)"), ("=", "EqualNullSafe(f,3.0)"), ("!=", "Not(EqualNullSafe(f,3.0))")):
        plan = engine.execute(f"SELECT f FROM t WHERE f {op} 3")._jdf.queryExecution().executedPlan().toString()
        assert pushed in plan, plan
    between = engine.execute("SELECT f FROM t WHERE f >= 9007199254740993")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(f,9.007199254740994E15)" in between, between
    for where, pushed in (("a < 5", "LessThan(a,5)"), ("a = 5", "EqualNullSafe(a,5)"), ("a > 5 AND f <= 2.5", "GreaterThan(a,5)"), ("a < 3.5", "LessThanOrEqual(a,3)"), ("a != 5 OR t = 'x'", "Or(Not(EqualNullSafe(a,5)),EqualNullSafe(t,x))")):
        plan = engine.execute(f"SELECT a FROM t WHERE {where}")._jdf.queryExecution().executedPlan().toString()
        assert pushed in plan, plan
        assert ("f:double" in plan) == ("f <=" in where)


def test_create_insert(spark):
    engine = Engine(spark)
    ddl = "CREATE TABLE people_t (id INTEGER PRIMARY KEY, Name VARCHAR(9) NOT NULL, score FLOAT, d DECIMAL(10, 2))"
    assert engine.execute(ddl).count() == 0
    engine.execute("INSERT INTO People_T VALUES (1, 'it is', 2.5, NULL)")
    engine.execute("INSERT INTO people_t VALUES (-2, \"x\", NULL, NULL)")
    assert sorted(map(tuple, engine.execute("SELECT id, name, score FROM people_t").collect())) == [(-2, "x", None), (1, "it is", 2.5)]
    assert engine.catalog.describe("people_t")[0] == ("id", "INTEGER", "INTEGER", ("PRIMARY KEY",)) and engine.catalog.describe("people_t")[3][2] == "BLOB"
    assert engine.catalog.ddl("people_t") == ddl and "people_t" in engine.catalog.tables()
    for bad in (ddl, "INSERT INTO people_t VALUES (1, 'a', 2, NULL)", "INSERT INTO people_t VALUES (1, 'a')", "INSERT INTO people_t VALUES ('x', 'a', 1.0, NULL)", "INSERT INTO nope VALUES (1)", "CREATE INDEX i ON people_t (id)"):
        with pytest.raises(AnalysisError):
            engine.execute(bad)
    spark.sql("DROP TABLE people_t")


def test_affinity():
    names = {"BIGINT": "INT", "POINT": "INT", "VARCHAR": "TEXT", "clob": "TEXT", "DOUBLE": "FLOAT", "real": "FLOAT", "NUMERIC": "BLOB", "DATE": "BLOB", "BOOLEAN": "BLOB", "BOOL": "INT", "CHARINT": "INT"}
    for name, cls in names.items():
        assert affinity(name) is StorageClass[cls], name


def test_render():
    assert row_text([None, 1, 1.0, 1e21, 2.5, math.nan, -math.inf, "x", b"\x01\x02", True]) == "Null, 1, 1, 1000000000000000000000, 2.5, NaN, -inf, x, [1, 2], 1"


def test_shell(spark):
    lines, out = iter(["SELECT id", "FROM t;", "SELECT x FROM t;", "", "quit"]), []
    run(Engine(spark).register("t", spark.range(2)), lambda _: next(lines), out.append)
    assert out[:2] == ["0", "1"] and out[2].startswith("Time elapsed") and "no column" in out[3]
