import pytest

from tarn.errors import LexError, ParseError
from tarn.plans import tree as t
from tarn.plans.parser import parse


def expr(text):
    return parse(f"SELECT {text} FROM t").items[0].expr


def test_precedence():
    a, b, c = t.Name("a"), t.Name("b"), t.Name("c")
    assert expr("a + b * c") == t.Binary("+", a, t.Binary("*", b, c))
    assert expr("(a + b) * c") == t.Binary("*", t.Binary("+", a, b), c)
    assert expr("a OR b AND c") == t.Binary("OR", a, t.Binary("AND", b, c))
    assert expr("NOT a = b") == t.Unary("NOT", t.Binary("=", a, b))
    assert expr("NOT a AND b") == t.Binary("AND", t.Unary("NOT", a), b)
    assert expr("a < b < c") == t.Binary("<", t.Binary("<", a, b), c)
    assert expr("a - b - c") == t.Binary("-", t.Binary("-", a, b), c)
    assert expr("-3") == t.Literal(-3) and expr("-a") == t.Unary("-", a)


def test_literals_and_names():
    assert expr("'it  is'") == t.Literal("it  is") and expr('"x"') == t.Literal("x")
    assert expr("TRUE") == t.Literal(1) and expr("false") == t.Literal(0) and expr("2.50") == t.Literal(2.5)
    assert expr("Text") == t.Name("text")
    assert parse("select *, a from T limit 1").table == "t"
    assert parse("SELECT a + 1 AS k FROM t").items[0].alias == "k"


@pytest.mark.parametrize("query", [
    "", "quit", "SELECT", "SELECT a", "SELECT a FROM", "SELECT a FROM t ORDER BY a", "SELECT a FROM t JOIN u", "SELECT a FROM t; SELECT a FROM t",
    "SELECT a FROM t WHERE a IS NULL LIMIT 1", "SELECT a FROM t WHERE a IN (1)", "SELECT a FROM t WHERE a BETWEEN 1 AND 2", "SELECT a FROM t WHERE a LIKE 'x'",
    "SELECT a % 2 FROM t", "SELECT a || b FROM t", "SELECT a <> b FROM t", "SELECT a == b FROM t", "SELECT count(*) FROM t", "SELECT --a FROM t", "SELECT -NOT a FROM t",
    "SELECT +a FROM t", "SELECT NULL FROM t", "SELECT a FROM t GROUP BY a", "SELECT key FROM t", "SELECT CASE WHEN a THEN b END FROM t", "SELECT a, FROM t",
    "INSERT INTO t VALUES (1), (2)", "INSERT INTO t (a) VALUES (1)", "INSERT INTO t VALUES (1 + 1)", "INSERT INTO t VALUES ()", "INSERT INTO t VALUES (-'x')",
    "CREATE TABLE IF NOT EXISTS t (a INT)", "CREATE TABLE t ()", "CREATE TABLE t (a)", "CREATE TABLE t (a DOUBLE PRECISION)", "CREATE TABLE t (a INTEGER(10))",
    "CREATE TABLE t (a INT DEFAULT 1)", "CREATE TABLE t (a INT, PRIMARY KEY (a))", "CREATE TABLE t (a VARCHAR(x))", "CREATE VIEW v", "UPDATE t SET a = 1", "DELETE FROM t", "DROP TABLE t",
])
def test_rejected(query):
    with pytest.raises(ParseError):
        parse(query)


@pytest.mark.parametrize("query", ["SELECT 'x FROM t", "SELECT (a FROM t", "SELECT a) FROM t", "SELECT 1. FROM t", "SELECT 9223372036854775808 FROM t", "SELECT a ? b FROM t", "SELECT 1x FROM t"])
def test_bad_tokens(query):
    with pytest.raises(LexError):
        parse(query)


def test_caret():
    with pytest.raises(ParseError) as e:
        parse("SELECT a FROM t ORDER BY a")
    assert str(e.value).splitlines()[1:] == ["SELECT a FROM t ORDER BY a", "                ^^^^^"]


def test_ddl():
    users = parse("CREATE TABLE Users (id INTEGER PRIMARY KEY, name TEXT NOT NULL, score FLOAT)")
    assert users.name == "users" and [(c.name, c.type_name, c.constraints) for c in users.columns] == [("id", "INTEGER", ("PRIMARY KEY",)), ("name", "TEXT", ("NOT NULL",)), ("score", "FLOAT", ())]
    sized = parse("CREATE TABLE t (a VARCHAR(255), b DECIMAL(10, 2), c BLOB NOTNULL UNIQUE);")
    assert [c.type_name for c in sized.columns] == ["VARCHAR", "DECIMAL", "BLOB"] and sized.columns[2].constraints == ("NOT NULL", "UNIQUE")
    assert parse("CREATE UNIQUE INDEX IF NOT EXISTS i ON users (email, id)") == t.CreateIndex("i", "users", ["email", "id"], True, True)
    assert parse("INSERT INTO t VALUES (1, -2.5, 'x', NULL, TRUE)").values == [t.Literal(1), t.Literal(-2.5), t.Literal("x"), t.Literal(None), t.Literal(1)]
