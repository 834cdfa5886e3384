"""What a statement needs of its table: columns, and a range of rowids."""

from __future__ import annotations

import math
from collections.abc import Iterator

from . import tree

_MIRROR = {"=": "=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}
LOW, HIGH = -(2**63), 2**63 - 1


def _names(expr) -> Iterator[str | None]:
    if isinstance(expr, tree.Star):
        yield None
    elif isinstance(expr, tree.Name):
        yield expr.name.lower()
    elif isinstance(expr, tree.Unary):
        yield from _names(expr.of)
    elif isinstance(expr, tree.Binary):
        yield from _names(expr.left)
        yield from _names(expr.right)


def columns(statement: tree.Select) -> set[str] | None:
    """Names of the columns that a statement reads, in lower case; None for all."""
    found = {n for item in statement.items for n in _names(item.expr)} | set(_names(statement.where))
    return None if None in found else found


def rowids(where, rowid: str | None) -> tuple[int, int]:
    """The least and the largest rowid that a condition may let through, by its comparisons of the rowid with numbers."""
    if rowid is None or not isinstance(where, tree.Binary):
        return LOW, HIGH
    if where.op == "AND":
        a, b = rowids(where.left, rowid), rowids(where.right, rowid)
        return max(a[0], b[0]), min(a[1], b[1])
    op, left, right = where.op, where.left, where.right
    if isinstance(left, tree.Literal) and op in _MIRROR:
        op, left, right = _MIRROR[op], right, left
    if not (op in _MIRROR and isinstance(left, tree.Name) and left.name.lower() == rowid and isinstance(right, tree.Literal)):
        return LOW, HIGH
    value = right.value
    if not isinstance(value, (int, float)) or not math.isfinite(value):
        return LOW, HIGH
    low, high = LOW, HIGH
    if op in ("=", ">", ">="):
        low = math.floor(value) + 1 if op == ">" else math.ceil(value)
    if op in ("=", "<", "<="):
        high = math.ceil(value) - 1 if op == "<" else math.floor(value)
    return max(low, LOW), min(high, HIGH)
