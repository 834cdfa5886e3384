"""Rows as text."""

from __future__ import annotations

import math
from decimal import Decimal


def value_text(value) -> str:
    """NULL as ``Null``, blobs as lists of bytes, floats in their shortest form without an exponent."""
    if value is None:
        return "Null"
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, (bytes, bytearray)):
        return "[" + ", ".join(map(str, value)) + "]"
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        if math.isinf(value):
            return "inf" if value > 0 else "-inf"
        text = format(Decimal(repr(value)), "f")
        return text.rstrip("0").rstrip(".") if "." in text else text
    return str(value)


def row_text(row) -> str:
    return ", ".join(map(value_text, row))
