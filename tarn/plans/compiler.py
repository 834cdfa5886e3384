"""Expressions to Columns, by the static storage class of each part."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import AnalysisError
from ..functions import values
from ..functions.classes import StorageClass as C
from ..functions.classes import class_of
from . import constants, tree

_COMPARE = ("=", "!=", "<", "<=", ">", ">=")
_MIRROR = {"=": "=", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


@dataclass(frozen=True)
class Typed:
    """A compiled expression; a truth is a boolean Column that stands for the integers 1 and 0."""

    col: Column
    cls: C
    truth: bool = False
    raises: bool = False
    bare: bool = False

    @property
    def value(self) -> Column:
        return self.col.cast("bigint") if self.truth else self.col


class Compiler:
    """Compiles the expressions of one statement over one table."""

    def __init__(self, df: DataFrame):
        self.columns: dict[str, Typed] = {}
        self.booleans = {f.name.lower() for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)}
        for f in df.schema.fields:
            self.columns.setdefault(f.name.lower(), Typed(F.col("`" + f.name.replace("`", "``") + "`"), class_of(f.dataType), bare=True))

    def column(self, name: str) -> Typed:
        if name.lower() not in self.columns:
            raise AnalysisError(f"no column named {name!r}")
        return self.columns[name.lower()]

    def projected(self, expr) -> Column:
        """The Column of a select item; bare columns keep their type."""
        return self.column(expr.name).col if isinstance(expr, tree.Name) else self.compile(expr).value

    def compile(self, expr) -> Typed:
        if isinstance(expr, tree.Literal):
            cls = constants.class_of(expr.value)
            return Typed(F.lit(expr.value).cast("bigint") if cls is C.INT else F.lit(expr.value), cls)
        if isinstance(expr, tree.Name):
            found = self.column(expr.name)
            if found.cls is C.OPAQUE:
                raise AnalysisError(f"column {expr.name!r} can only be selected as it is")
            return found
        if isinstance(expr, tree.Unary):
            return self._not(expr) if expr.op == "NOT" else self._minus(expr)
        if isinstance(expr, tree.Binary):
            if expr.op in ("AND", "OR"):
                return self._logic(expr)
            return self._compare(expr) if expr.op in _COMPARE else self._arithmetic(expr)
        raise AnalysisError("* stands only for itself in a select list")

    def condition(self, expr) -> Column:
        """What WHERE keeps: true where the expression is, and false or NULL elsewhere, in forms that reach the scan."""
        if isinstance(expr, tree.Binary):
            if expr.op in ("AND", "OR"):
                right = self.compile(expr.right)
                if not right.raises:
                    a, b = self.condition(expr.left), self.condition(expr.right)
                    return a & b if expr.op == "AND" else a | b
            elif expr.op in _COMPARE and (plain := self._plain(expr)) is not None:
                return plain
        if isinstance(expr, tree.Name) and (found := self.column(expr.name)).cls.numeric:
            return found.col.cast("bigint") != 0 if found.cls is C.INT else found.col != 0
        return self.truth(self.compile(expr))

    def truth(self, x: Typed) -> Column:
        return x.col if x.truth else values.truthy(values.as_class(x.col, x.cls), x.cls)

    def _plain(self, expr: tree.Binary) -> Column | None:
        """Column against literal, for a filter."""
        op, left, right = expr.op, expr.left, expr.right
        if isinstance(left, tree.Literal):
            op, left, right = _MIRROR[op], right, left
        if not (isinstance(left, tree.Name) and isinstance(right, tree.Literal)):
            return None
        found, cls = self.compile(left), constants.class_of(right.value)
        if found.cls is cls or (found.cls.numeric and cls.numeric):
            col = found.col.cast("bigint") if left.name.lower() in self.booleans else found.col
            return values.compare_literal(op, col, found.cls, right.value)
        return None

    def _not(self, expr: tree.Unary) -> Typed:
        of = self.compile(expr.of)
        return Typed(~self.truth(of), C.INT, truth=True, raises=of.raises)

    def _minus(self, expr: tree.Unary) -> Typed:
        of = self._number(self.compile(expr.of), "-")
        return Typed(-of.col, of.cls, raises=of.raises or of.cls is C.INT)

    def _logic(self, expr: tree.Binary) -> Typed:
        left, right = self.compile(expr.left), self.compile(expr.right)
        a, b = self.truth(left), self.truth(right)
        if right.raises:  # only then is the order of evaluation worth a CASE
            col = F.when(a, b).otherwise(F.lit(False)) if expr.op == "AND" else F.when(a, F.lit(True)).otherwise(b)
        else:
            col = a & b if expr.op == "AND" else a | b
        return Typed(col, C.INT, truth=True, raises=left.raises or right.raises)

    def _compare(self, expr: tree.Binary) -> Typed:
        if (plain := self._plain(expr)) is not None:
            return Typed(F.coalesce(plain, F.lit(False)), C.INT, truth=True)
        left, right = self.compile(expr.left), self.compile(expr.right)
        a, b = values.as_class(left.value, left.cls), values.as_class(right.value, right.cls)
        less = lambda x, cx, y, cy: values.less(x, cx, y, cy)
        col = {
            "=": lambda: values.equal(a, left.cls, b, right.cls),
            "!=": lambda: ~values.equal(a, left.cls, b, right.cls),
            "<": lambda: less(a, left.cls, b, right.cls),
            "<=": lambda: ~less(b, right.cls, a, left.cls),
            ">": lambda: less(b, right.cls, a, left.cls),
            ">=": lambda: ~less(a, left.cls, b, right.cls),
        }[expr.op]()
        return Typed(col, C.INT, truth=True, raises=left.raises or right.raises)

    def _number(self, x: Typed, op: str) -> Typed:
        if not x.cls.numeric:
            raise AnalysisError(f"{op} needs numbers, not {x.cls.value}")
        return Typed(values.as_class(x.value, x.cls), x.cls, raises=x.raises)

    def _arithmetic(self, expr: tree.Binary) -> Typed:
        left, right = self._number(self.compile(expr.left), expr.op), self._number(self.compile(expr.right), expr.op)
        whole = left.cls is C.INT and right.cls is C.INT
        a, b = (left.col, right.col) if whole else (left.col.cast("double"), right.col.cast("double"))
        col = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: values.divide(a, b, whole)}[expr.op]()
        return Typed(col, C.INT if whole else C.FLOAT, raises=whole or left.raises or right.raises)
