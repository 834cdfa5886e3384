"""The value model on Columns: a total order with NULL lowest, two-valued logic, and arithmetic by class.

Every comparison here is true or false, never NULL. Forms are chosen so that Spark
can push them to the scan: OR, AND, <=> and plain comparisons.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .classes import StorageClass as C

TWO_63 = 2.0**63


def as_class(col: Column, cls: C) -> Column:
    """A numeric column at the width in which the class computes."""
    return col.cast("bigint") if cls is C.INT else col.cast("double") if cls is C.FLOAT else col


def three_way(i: Column, f: Column) -> Column:
    """-1, 0 or 1 as an integer is below, equal to or above a float, without rounding the integer; NaN is highest."""
    whole = f.cast("bigint")
    rest = f - whole.cast("double")
    near = F.when(i < whole, -1).when(i > whole, 1).when(rest > 0, -1).when(rest < 0, 1).otherwise(0)
    exact = F.when(F.isnan(f) | (f >= TWO_63), -1).when(f < -TWO_63, 1).otherwise(near)
    return F.when(i.isNotNull() & f.isNotNull(), exact)


def less(a: Column, ca: C, b: Column, cb: C) -> Column:
    """a < b in the total order."""
    below = a.isNull() & b.isNotNull()
    if ca.rank != cb.rank:
        return b.isNotNull() if ca.rank < cb.rank else below
    if ca is cb:
        return below | F.coalesce(a < b, F.lit(False))
    sign = three_way(a, b) if ca is C.INT else -three_way(b, a)
    return below | F.coalesce(sign < 0, F.lit(False))


def equal(a: Column, ca: C, b: Column, cb: C) -> Column:
    """a = b, where NULL equals NULL."""
    if ca.rank != cb.rank:
        return a.isNull() & b.isNull()
    if ca is cb:
        return a.eqNullSafe(b)
    sign = three_way(a, b) if ca is C.INT else three_way(b, a)
    return (a.isNull() & b.isNull()) | F.coalesce(sign == 0, F.lit(False))


def compare_literal(op: str, col: Column, cls: C, value) -> Column | None:
    """A comparison of a column with a literal of its class, or of two numbers, in a form that reaches the scan; None if there is none.

    ``>`` and ``>=`` are NULL for a NULL column, which a filter takes for false.
    """
    if cls is C.INT and isinstance(value, float):
        return _against_fraction(op, col, value)
    if cls is C.FLOAT and isinstance(value, int):
        return _against_whole(op, col, value)
    low = op in ("<", "<=")
    plain = {"<": col < value, "<=": col <= value, ">": col > value, ">=": col >= value, "=": col.eqNullSafe(F.lit(value)), "!=": ~col.eqNullSafe(F.lit(value))}[op]
    return (col.isNull() | plain) if low else plain


def _against_fraction(op: str, col: Column, value: float) -> Column | None:
    if not math.isfinite(value) or abs(value) >= TWO_63:
        return None
    whole = math.floor(value)
    if whole == value:
        return compare_literal(op, col, C.INT, int(whole))
    if op in ("=", "!="):
        return F.lit(op == "!=")
    return compare_literal("<=" if op in ("<", "<=") else ">", col, C.INT, whole)


def _against_whole(op: str, col: Column, value: int) -> Column | None:
    """A float column against an integer: against the same double, or the doubles on its two sides if there is none (NaN stays above them)."""
    near = float(value)
    if int(near) == value:
        return compare_literal(op, col, C.FLOAT, near)
    if op in ("=", "!="):
        return F.lit(op == "!=")
    if op in ("<", "<="):
        return compare_literal("<=", col, C.FLOAT, near if near < value else math.nextafter(near, -math.inf))
    return compare_literal(">=", col, C.FLOAT, near if near > value else math.nextafter(near, math.inf))


def truthy(col: Column, cls: C) -> Column:
    """Numbers other than zero and every text are true; NULL and blobs are false."""
    if cls.numeric:
        return F.coalesce(col != 0, F.lit(False))
    return col.isNotNull() if cls is C.TEXT else F.lit(False)


def divide(a: Column, b: Column, whole: bool) -> Column:
    """Truncating division of integers (zero raises), or IEEE division of floats."""
    if whole:
        return F.call_function("div", a, b)
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    by_zero = F.when((a == 0) | F.isnan(a), nan).when(a > 0, inf).otherwise(-inf)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, by_zero).otherwise(a / b)
