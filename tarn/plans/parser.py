"""Tokens to statements. A statement must end where its grammar ends."""

from __future__ import annotations

from ..errors import ParseError
from . import tree as t
from .lexer import TYPE_WORDS, Token, tokenize

_CHAINS = (("OR",), ("AND",), ("=", "!=", "<", "<=", ">", ">="), ("+", "-"), ("*", "/"))


def parse(query: str):
    """The one statement of a query; a closing semicolon may follow."""
    return _Parser(query).statement()


class _Parser:
    def __init__(self, query: str):
        self.query = query
        self.tokens = tokenize(query)
        self.at = 0

    @property
    def here(self) -> Token:
        return self.tokens[self.at]

    def fail(self, wanted: str):
        found = "the end" if self.here.kind == "end" else repr(self.query[self.here.start : self.here.end])
        raise ParseError(f"expected {wanted}, found {found}", self.query, self.here.start, max(self.here.end, self.here.start + 1))

    def take(self, *values: str) -> str | None:
        """Step over a keyword or mark of these, if one is here."""
        if self.here.kind in ("key", "mark") and self.here.value in values:
            self.at += 1
            return self.tokens[self.at - 1].value
        return None

    def need(self, *values: str) -> None:
        for value in values:
            if not self.take(value):
                self.fail(value)

    def name(self) -> str:
        token = self.here
        if token.kind == "word" or (token.kind == "key" and token.value in TYPE_WORDS):
            self.at += 1
            return self.query[token.start : token.end].lower()
        return self.fail("a name")

    def listed(self, one) -> list:
        out = [one()]
        while self.take(","):
            out.append(one())
        return out

    def statement(self):
        if self.take("SELECT"):
            out = self.select()
        elif self.take("INSERT"):
            out = self.insert()
        elif self.take("CREATE"):
            out = self.create()
        else:
            self.fail("SELECT, INSERT or CREATE")
        self.take(";")
        if self.here.kind != "end":
            self.fail("the end of the statement")
        return out

    def select(self) -> t.Select:
        items = self.listed(self.item)
        self.need("FROM")
        table = self.name()
        where = self.expression() if self.take("WHERE") else None
        limit = self.expression() if self.take("LIMIT") else None
        return t.Select(items, table, where, limit)

    def item(self) -> t.Item:
        if self.take("*"):
            return t.Item(t.Star(), None, "*")
        start = self.here.start
        expr = self.expression()
        text = self.query[start : self.tokens[self.at - 1].end]
        return t.Item(expr, self.name() if self.take("AS") else None, text)

    def expression(self, level: int = 0):
        if level == len(_CHAINS):
            return self.unary()
        left = self.expression(level + 1)
        while op := self.take(*_CHAINS[level]):
            left = t.Binary(op, left, self.expression(level + 1))
        return left

    def unary(self):
        if self.take("-"):
            of = self.factor()
            if isinstance(of, t.Literal) and isinstance(of.value, (int, float)):
                return t.Literal(-of.value)
            return t.Unary("-", of)
        if self.take("NOT"):
            return t.Unary("NOT", self.expression(2))
        return self.factor()

    def factor(self):
        token = self.here
        if self.take("("):
            inside = self.expression()
            self.need(")")
            return inside
        if token.kind in ("int", "float", "string"):
            self.at += 1
            return t.Literal(token.value)
        if word := self.take("TRUE", "FALSE"):
            return t.Literal(int(word == "TRUE"))
        if token.kind == "word" or (token.kind == "key" and token.value in TYPE_WORDS):
            return t.Name(self.name())
        return self.fail("an expression")

    def insert(self) -> t.Insert:
        self.need("INTO")
        table = self.name()
        self.need("VALUES", "(")
        values = self.listed(self.value)
        self.need(")")
        return t.Insert(table, values)

    def value(self) -> t.Literal:
        if self.take("NULL"):
            return t.Literal(None)
        minus = bool(self.take("-"))
        token = self.here
        if word := (None if minus else self.take("TRUE", "FALSE")):
            return t.Literal(int(word == "TRUE"))
        if token.kind in ("int", "float") or (token.kind == "string" and not minus):
            self.at += 1
            return t.Literal(-token.value if minus else token.value)
        return self.fail("a literal")

    def create(self):
        if self.take("TABLE"):
            name = self.name()
            self.need("(")
            columns = self.listed(self.column)
            self.need(")")
            return t.CreateTable(name, columns, self.query.strip().rstrip(";").strip())
        unique = bool(self.take("UNIQUE"))
        self.need("INDEX")
        absent = bool(self.take("IF"))
        if absent:
            self.need("NOT", "EXISTS")
        name = self.name()
        self.need("ON")
        table = self.name()
        self.need("(")
        columns = self.listed(self.name)
        self.need(")")
        return t.CreateIndex(name, table, columns, unique, absent)

    def column(self) -> t.ColumnDef:
        name = self.name()
        token = self.here
        if token.kind == "key" and token.value in TYPE_WORDS:
            type_name = self.name().upper()
        elif token.kind == "word":
            type_name = self.name().upper()
            if self.take("("):
                self.listed(self.size)
                self.need(")")
        else:
            self.fail("a type")
        constraints = []
        while True:
            if self.take("PRIMARY"):
                self.need("KEY")
                constraints.append("PRIMARY KEY")
            elif self.take("UNIQUE"):
                constraints.append("UNIQUE")
            elif self.take("NOTNULL"):
                constraints.append("NOT NULL")
            elif self.take("NOT"):
                self.need("NULL")
                constraints.append("NOT NULL")
            else:
                return t.ColumnDef(name, type_name, tuple(constraints))

    def size(self) -> int:
        if self.here.kind != "int":
            self.fail("a size")
        self.at += 1
        return self.tokens[self.at - 1].value
