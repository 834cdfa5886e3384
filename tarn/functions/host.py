"""Values in Python: their total order, class names, and checked conversions."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import total_ordering

from ..errors import AnalysisError

_NAMES = {type(None): "NULL", bool: "INTEGER", int: "INTEGER", float: "REAL", str: "TEXT", bytes: "BLOB", bytearray: "BLOB"}


def order_key(value) -> tuple:
    """A key by which values of all classes compare: NULL, numbers (exactly, NaN highest), text by bytes, blobs."""
    if value is None:
        return (0, 0, 0)
    if isinstance(value, float) and math.isnan(value):
        return (1, 1, 0)
    if isinstance(value, (int, float)):
        return (1, 0, value)
    return (2, 0, value.encode()) if isinstance(value, str) else (3, 0, bytes(value))


@total_ordering
@dataclass(frozen=True, eq=False)
class Value:
    """A value that compares with other values and with Python's own, on either side."""

    held: None | int | float | str | bytes

    def __post_init__(self):
        if type(self.held) not in _NAMES:
            raise AnalysisError(f"no value of the engine: {self.held!r:.60}")
        if isinstance(self.held, int) and not -(2**63) <= self.held < 2**63:
            raise AnalysisError(f"{self.held} does not fit an INTEGER")

    @property
    def type_name(self) -> str:
        return _NAMES[type(self.held)]

    def _key(self, other):
        return order_key(other.held if isinstance(other, Value) else other)

    def __eq__(self, other) -> bool:
        return order_key(self.held) == self._key(other)

    def __lt__(self, other) -> bool:
        return order_key(self.held) < self._key(other)

    def __hash__(self) -> int:
        return hash(order_key(self.held))

    def get_int(self) -> int:
        if self.type_name != "INTEGER":
            raise AnalysisError(f"{self.type_name} is no INTEGER")
        return int(self.held)

    def get_float(self) -> float:
        if self.type_name != "REAL":
            raise AnalysisError(f"{self.type_name} is no REAL")
        return self.held

    def __str__(self) -> str:
        from ..render import row_text

        return row_text([self.held])
