"""Tables of an engine: registered DataFrames, and Parquet tables of the Spark catalog."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import AnalysisError
from ..functions.classes import affinity, class_of
from ..operators.relational import spark_type
from ..plans import needs, tree

DDL, COLUMNS = "engine.ddl", "engine.columns"


class FileTable:
    """A table of a database file: a statement reads the columns and the range of rowids that it needs."""

    def __init__(self, spark: SparkSession, options: dict[str, str], columns: list[str], rowid: str | None):
        self.spark, self.options, self.columns, self.rowid = spark, options, columns, rowid

    def frame(self, statement: tree.Select | None = None) -> DataFrame:
        options = dict(self.options)
        wanted = needs.columns(statement) if statement else None
        if wanted is not None and not any("," in c for c in self.columns):
            options["columns"] = ",".join([c for c in self.columns if c in wanted] or self.columns[:1])
        low, high = needs.rowids(statement.where, self.rowid) if statement else (needs.LOW, needs.HIGH)
        low, high = max(low, int(options.get("rowid_from", low))), min(high, int(options.get("rowid_to", high)))
        if (low, high) != (needs.LOW, needs.HIGH):
            options |= {"rowid_from": str(low), "rowid_to": str(high)}
        return self.spark.read.format("sqlite_file").options(**options).load()


class Catalog:
    """Names are case-insensitive. A registered DataFrame hides a stored table of its name."""

    def __init__(self, spark: SparkSession, database: str = "default"):
        self.spark, self.database = spark, database
        self.registered: dict[str, DataFrame | FileTable] = {}

    def _stored(self, name: str) -> str:
        return f"`{self.database}`.`{name.lower()}`"

    def register(self, name: str, df: DataFrame | FileTable) -> None:
        self.registered[name.lower()] = df

    def exists(self, name: str) -> bool:
        return name.lower() in self.registered or self.spark.catalog.tableExists(f"{self.database}.{name.lower()}")

    def table(self, name: str, statement: tree.Select | None = None) -> DataFrame:
        """A whole table, or as much of it as a statement needs."""
        if name.lower() in self.registered:
            found = self.registered[name.lower()]
            return found.frame(statement) if isinstance(found, FileTable) else found
        if not self.exists(name):
            raise AnalysisError(f"no table named {name!r}")
        return self.spark.table(self._stored(name))

    def tables(self) -> list[str]:
        stored = [t.name for t in self.spark.catalog.listTables(self.database) if not t.isTemporary]
        return sorted({*self.registered, *stored})

    def create(self, statement: tree.CreateTable) -> None:
        if self.exists(statement.name):
            raise AnalysisError(f"table {statement.name!r} exists already")
        held = [{"name": c.name, "type": c.type_name, "constraints": list(c.constraints)} for c in statement.columns]
        columns = ", ".join(f"`{c.name}` {spark_type(c).simpleString()}" for c in statement.columns)
        text = {DDL: statement.query, COLUMNS: json.dumps(held)}
        properties = ", ".join(f"{_quoted(k)} = {_quoted(v)}" for k, v in text.items())
        self.spark.sql(f"CREATE TABLE {self._stored(statement.name)} ({columns}) USING parquet TBLPROPERTIES ({properties})")

    def properties(self, name: str) -> dict[str, str]:
        return {r.key: r.value for r in self.spark.sql(f"SHOW TBLPROPERTIES {self._stored(name)}").collect()}

    def columns(self, name: str) -> list[tree.ColumnDef]:
        """Declared columns; for a registered or foreign table, those of its schema."""
        df = self.table(name)
        if name.lower() not in self.registered and (text := self.properties(name).get(COLUMNS)):
            return [tree.ColumnDef(c["name"], c["type"], tuple(c["constraints"])) for c in json.loads(text)]
        return [tree.ColumnDef(f.name, class_of(f.dataType).value) for f in df.schema.fields]

    def describe(self, name: str) -> list[tuple[str, str, str, tuple[str, ...]]]:
        """(name, declared type, storage class, constraints) of each column."""
        return [(c.name, c.type_name, affinity(c.type_name).value if c.type_name != "OPAQUE" else "OPAQUE", c.constraints) for c in self.columns(name)]

    def ddl(self, name: str) -> str | None:
        return None if name.lower() in self.registered else self.properties(name).get(DDL)

    def insert(self, name: str, columns: list[tree.ColumnDef], row: list) -> None:
        if name.lower() in self.registered:
            held = self.table(name)
            schema = held.schema
            new = self.spark.createDataFrame([row], T.StructType([T.StructField(c.name, spark_type(c)) for c in columns]))
            new = new.select(*[new[c.name].cast(f.dataType).alias(f.name) for c, f in zip(columns, schema.fields, strict=True)])
            self.registered[name.lower()] = held.unionByName(new)
            return
        schema = T.StructType([T.StructField(c.name, spark_type(c)) for c in columns])
        self.spark.createDataFrame([row], schema).write.insertInto(f"{self.database}.{name.lower()}")

    def append(self, name: str, df: DataFrame) -> None:
        """Append a DataFrame to a stored table in one job: the way to load more than a few rows."""
        df.write.insertInto(f"{self.database}.{name.lower()}")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
