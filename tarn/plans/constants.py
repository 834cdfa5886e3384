"""Expressions without columns, evaluated while planning (LIMIT)."""

from __future__ import annotations

import math
import operator

from ..errors import AnalysisError
from ..functions.classes import StorageClass as C
from ..functions.host import order_key
from . import tree

_INT = range(-(2**63), 2**63)


def class_of(value) -> C:
    """The class of a literal."""
    return C.INT if isinstance(value, int) else C.FLOAT if isinstance(value, float) else C.TEXT


def truth(value) -> bool:
    return True if isinstance(value, str) else value != 0


def evaluate(expr):
    """The value of a constant expression."""
    if isinstance(expr, tree.Literal):
        return expr.value
    if isinstance(expr, tree.Name):
        raise AnalysisError("columns are not allowed here")
    if isinstance(expr, tree.Unary):
        of = evaluate(expr.of)
        return int(not truth(of)) if expr.op == "NOT" else _arithmetic("-", 0 if isinstance(of, int) else -0.0, of)
    if expr.op == "AND":
        return int(truth(evaluate(expr.left)) and truth(evaluate(expr.right)))
    if expr.op == "OR":
        return int(truth(evaluate(expr.left)) or truth(evaluate(expr.right)))
    a, b = evaluate(expr.left), evaluate(expr.right)
    test = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}.get(expr.op)
    return int(test(order_key(a), order_key(b))) if test else _arithmetic(expr.op, a, b)


def _arithmetic(op: str, a, b):
    if isinstance(a, str) or isinstance(b, str):
        raise AnalysisError(f"{op} needs numbers, not TEXT")
    if isinstance(a, int) and isinstance(b, int):
        if op == "/":
            if b == 0:
                raise AnalysisError("division by zero")
            out = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
        else:
            out = {"+": a + b, "-": a - b, "*": a * b}[op]
        if out not in _INT:
            raise AnalysisError("integer overflow")
        return out
    a, b = float(a), float(b)
    if op == "/" and b == 0:
        return math.nan if a == 0 or math.isnan(a) else math.copysign(math.inf, a)
    return {"+": a + b, "-": a - b, "*": a * b, "/": a / b if b else 0.0}[op]


def limit(expr) -> int | None:
    """Rows that a LIMIT lets through; None if all: a negative one, or one above what Spark counts to."""
    value = evaluate(expr)
    if not isinstance(value, int):
        raise AnalysisError(f"LIMIT needs an INTEGER, not {class_of(value).value}")
    return value if 0 <= value < 2**31 else None
