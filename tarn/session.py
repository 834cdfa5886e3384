"""The engine: SQL text in, DataFrames out."""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .errors import AnalysisError
from .operators import relational
from .plans import tree
from .plans.parser import parse
from .sources.catalog import Catalog, FileTable


class Engine:
    """Runs statements of the dialect over a Spark session.

    ``database`` names a database of the Spark catalog, which holds the tables that
    CREATE TABLE makes. DDL and INSERT take effect at once and return an empty DataFrame; SELECT is lazy.
    """

    def __init__(self, spark: SparkSession, database: str = "default"):
        self.spark = spark
        self.catalog = Catalog(spark, database)

    def register(self, name: str, df: DataFrame) -> Engine:
        """Give a DataFrame a table name."""
        self.catalog.register(name, df)
        return self

    def open_file(self, source: str | bytes, **options) -> Engine:
        """Register every table of a database file, a folder of such files, or a small file in memory, under its name."""
        from .sources import sqlite_file

        self.spark.dataSource.register(sqlite_file.SqliteFileSource)
        self.spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        where = {"data": base64.b64encode(source).decode()} if isinstance(source, bytes) else {"path": source}
        first = sqlite_file.sources_of(where)[0]
        for name in sqlite_file.table_names(first):
            columns = sqlite_file.table_columns(first, name)[0]
            rowid = sqlite_file.rowid_column(columns)
            names = [c.name for c in columns]
            if options.get("rowid") == "true":
                names, rowid = [*names, "_rowid"], rowid or "_rowid"
            self.catalog.register(name, FileTable(self.spark, {**where, "table": name, "pushdown": "true", **{k: str(v) for k, v in options.items()}}, names, rowid))
        return self

    def execute(self, sql: str) -> DataFrame:
        """Parse, check and run one statement."""
        statement = parse(sql)
        if isinstance(statement, tree.Select):
            return relational.select(self.catalog.table(statement.table, statement), statement)
        if isinstance(statement, tree.Insert):
            self.catalog.table(statement.table)
            columns = self.catalog.columns(statement.table)
            self.catalog.insert(statement.table, columns, relational.checked_row(columns, statement.values, statement.table))
        elif isinstance(statement, tree.CreateTable):
            self.catalog.create(statement)
        else:
            raise AnalysisError("CREATE INDEX is parsed but has no execution: scans prune by Parquet statistics instead")
        return self.spark.createDataFrame([], T.StructType([]))
