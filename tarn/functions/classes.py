"""Storage classes, and how declared types and Spark types map to them."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import types as T


class StorageClass(Enum):
    """Classes in the order in which their values compare; integers and floats compare by value."""

    INT = "INTEGER"
    FLOAT = "REAL"
    TEXT = "TEXT"
    BLOB = "BLOB"
    OPAQUE = "OPAQUE"

    @property
    def numeric(self) -> bool:
        return self in (StorageClass.INT, StorageClass.FLOAT)

    @property
    def rank(self) -> int:
        return {"INTEGER": 1, "REAL": 1, "TEXT": 2, "BLOB": 3, "OPAQUE": 4}[self.value]


SPARK_TYPES = {StorageClass.INT: T.LongType(), StorageClass.FLOAT: T.DoubleType(), StorageClass.TEXT: T.StringType(), StorageClass.BLOB: T.BinaryType()}

# Type words with a class of their own, then fragments that decide for all other names, in order.
_WORDS = {
    "INT": StorageClass.INT, "INTEGER": StorageClass.INT, "BOOL": StorageClass.INT, "TEXT": StorageClass.TEXT,
    "FLOAT": StorageClass.FLOAT, "DOUBLE": StorageClass.FLOAT, "REAL": StorageClass.FLOAT, "BLOB": StorageClass.BLOB,
}
_FRAGMENTS = (
    (StorageClass.INT, ("INT",)),
    (StorageClass.TEXT, ("CHAR", "CLOB", "TEXT")),
    (StorageClass.FLOAT, ("REAL", "FLOA", "DOUB")),
)


def affinity(type_name: str) -> StorageClass:
    """The class that a declared type stores."""
    name = type_name.upper()
    if name in _WORDS:
        return _WORDS[name]
    return next((cls for cls, parts in _FRAGMENTS if any(p in name for p in parts)), StorageClass.BLOB)


def class_of(kind: T.DataType) -> StorageClass:
    """The class of a Spark column; types without one can only be projected."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return StorageClass.INT
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return StorageClass.FLOAT
    if isinstance(kind, T.StringType):
        return StorageClass.TEXT
    if isinstance(kind, T.BinaryType):
        return StorageClass.BLOB
    return StorageClass.OPAQUE
