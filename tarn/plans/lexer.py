"""Query text to tokens."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import LexError

# Words that are no identifiers; type words may still name a column or table.
TYPE_WORDS = frozenset("BOOL INT INTEGER TEXT FLOAT DOUBLE REAL BLOB".split())
RESERVED = TYPE_WORDS | frozenset(
    """CREATE TABLE INDEX IF PRIMARY KEY UNIQUE ON INSERT INTO VALUES SELECT FROM WHERE AND OR LIMIT NOT EXISTS NOTNULL NULL TRUE FALSE
    DROP CONSTRAINT CHECK DEFAULT WITHOUT ROWID DELETE UPDATE DESC ASC GROUP BY HAVING ORDER DISTINCT UNION ALL JOIN INNER OUTER LEFT
    RIGHT FULL CROSS AS IN BETWEEN LIKE IS CASE WHEN THEN ELSE END CAST ISNULL""".split()
)
INT_MAX = 2**63 - 1

_TOKEN = re.compile(
    r"""(?P<space>\s+)
    |(?P<word>[^\W\d]\w*)
    |(?P<number>\d+(?:\.\d*)?)
    |(?P<string>'[^']*'|"[^"]*")
    |(?P<open>['"])
    |(?P<mark><=|>=|!=|<<|>>|\|\||[-+*/=<>(),;%&|~.])""",
    re.VERBOSE,
)


@dataclass(frozen=True)
class Token:
    kind: str  # word, key, int, float, string, mark, end
    value: object
    start: int
    end: int


def tokenize(query: str) -> list[Token]:
    """Tokens of a query, closed by an ``end`` token; parentheses are balanced."""
    out, at, depth = [], 0, []
    while at < len(query):
        m = _TOKEN.match(query, at)
        if m is None:
            raise LexError(f"unexpected character {query[at]!r}", query, at)
        kind, text, start, at = m.lastgroup, m.group(), at, m.end()
        if kind == "open":
            raise LexError("unterminated string", query, start, len(query))
        if kind == "word":
            upper = text.upper()
            out.append(Token("key", upper, start, at) if upper in RESERVED else Token("word", text, start, at))
        elif kind == "number":
            out.append(_number(query, text, start, at))
        elif kind == "string":
            out.append(Token("string", text[1:-1], start, at))
        elif kind == "mark":
            if text == "(":
                depth.append(start)
            elif text == ")":
                if not depth:
                    raise LexError("closing parenthesis without an opening one", query, start)
                depth.pop()
            out.append(Token("mark", text, start, at))
    if depth:
        raise LexError("parenthesis is not closed", query, depth[-1])
    return [*out, Token("end", "", len(query), len(query))]


def _number(query: str, text: str, start: int, end: int) -> Token:
    if query[end : end + 1].isalnum() or query[end : end + 1] == "_":
        raise LexError("invalid number", query, start, end + 1)
    if "." in text:
        if text.endswith("."):
            raise LexError("invalid number", query, start, end)
        return Token("float", float(text), start, end)
    if int(text) > INT_MAX:
        raise LexError("integer out of range", query, start, end)
    return Token("int", int(text), start, end)
