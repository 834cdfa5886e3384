"""Scan, filter, limit, project, insert and create, each a thin layer over Catalyst."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..errors import AnalysisError
from ..functions.classes import SPARK_TYPES, affinity
from ..plans import constants, tree
from ..plans.compiler import Compiler


def select(df: DataFrame, statement: tree.Select) -> DataFrame:
    """Project(Limit(Filter(scan))); Spark prunes columns and pushes the filter into the scan."""
    compiler = Compiler(df)
    columns = []
    for item in statement.items:
        if isinstance(item.expr, tree.Star):
            columns += [compiler.column(name).col for name in df.columns]
        else:
            columns.append(compiler.projected(item.expr).alias(item.alias or (item.expr.name if isinstance(item.expr, tree.Name) else item.text)))
    out = df if statement.where is None else df.where(compiler.condition(statement.where))
    count = None if statement.limit is None else constants.limit(statement.limit)
    return (out if count is None else out.limit(count)).select(*columns)


def checked_row(columns: list[tree.ColumnDef], values: list[tree.Literal], table: str) -> list:
    """The values of an INSERT, if each has its column's class; NULL fits everywhere."""
    if len(values) != len(columns):
        raise AnalysisError(f"table {table!r} has {len(columns)} columns, {len(values)} values were given")
    for column, literal in zip(columns, values, strict=True):
        wanted = affinity(column.type_name)
        if literal.value is not None and constants.class_of(literal.value) is not wanted:
            raise AnalysisError(f"column {column.name!r} stores {wanted.value}, not {constants.class_of(literal.value).value}")
    return [literal.value for literal in values]


def spark_type(column: tree.ColumnDef):
    """The Spark type in which a declared column is stored."""
    return SPARK_TYPES[affinity(column.type_name)]
