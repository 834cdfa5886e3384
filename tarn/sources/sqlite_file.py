"""A Spark data source for single-file databases in the SQLite 3 format.

``spark.read.format("sqlite_file").options(path=..., table=...)`` reads one table, of a file or of all files (``*.db``) of a folder.
Subtrees of the table's trees are partitions (at least SPLITS a file, if there are as many), and their pages are read only when a task
runs; rows leave it as Arrow batches. Options:

* ``columns``: names, separated by commas; only these are decoded;
* ``rowid_from`` and ``rowid_to`` (both inclusive): a range of rowids; no page outside of it is read;
* ``index`` instead of ``table``: the entries of an index in its order, the key's columns and ``_rowid``;
* ``mode``: ``strict`` (a value that does not fit its column's class raises) or ``dynamic``
  (every column is a struct of tag, i, d, t and b that orders by class, then value);
* ``rowid`` = ``true`` adds ``_rowid``;
* ``order`` = ``desc``: partitions, and the rows in them, from the largest rowid down;
* ``pushdown`` = ``true``, with spark.sql.python.filterPushdown.enabled: filters on the rowid become ranges.

A path may be a URI of a file system that pyarrow knows; all executors must see it. Instead of one, ``data`` may hold a small file itself, in base 64.
``Engine.execute`` sets columns and ranges from the statement.

An INTEGER PRIMARY KEY reads as the rowid; rows that are shorter than the schema end in NULL.

``df.write.format("sqlite_file").options(path=folder, table=...)`` writes a file for each partition, with rowids from 1, or
with those of the integer column that the option ``rowid`` names, in whose order the rows of a partition must be.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import FileFormatError
from ..functions.classes import SPARK_TYPES, StorageClass, affinity, class_of
from .file_format import ROWID_MAX, ROWID_MIN, FileWriter, Pages, Split, record

BATCH = 4096
DYNAMIC = T.StructType([T.StructField("tag", T.ByteType()), T.StructField("i", T.LongType()), T.StructField("d", T.DoubleType()), T.StructField("t", T.StringType()), T.StructField("b", T.BinaryType())])


@dataclass(frozen=True)
class Column:
    name: str
    type_name: str
    is_rowid: bool = False


def parts_of(text: str) -> list[str]:
    """Pieces of a column list between commas outside of quotes and parentheses."""
    out, depth = [""], 0
    for m in re.finditer(r"""'(?:[^']|'')*'|"(?:[^"]|"")*"|`[^`]*`|\[[^\]]*\]|--[^\n]*|/\*.*?\*/|.""", text, re.DOTALL):
        piece = m.group()
        if piece.startswith(("--", "/*")):
            piece = " "
        depth += (piece == "(") - (piece == ")")
        if piece == "," and depth == 0:
            out.append("")
        else:
            out[-1] += piece
    return [p.strip() for p in out]


def parse_ddl(sql: str) -> list[Column]:
    """Columns of a CREATE TABLE as other programs write it: untyped columns, defaults, quoted names, table constraints."""
    if re.search(r"\bWITHOUT\s+ROWID\b[^)]*$", sql, re.IGNORECASE):
        raise FileFormatError("tables without rowid cannot be read")
    inside = sql[sql.index("(") + 1 : sql.rindex(")")]
    out, keys = [], []
    for part in parts_of(inside):
        if m := re.match(r"(?:CONSTRAINT\s+\S+\s+)?(PRIMARY\s+KEY|UNIQUE|CHECK|FOREIGN\s+KEY)\b\s*\(([^)]*)\)?", part, re.IGNORECASE):
            if m[1].upper().startswith("PRIMARY"):
                keys = [k.strip().strip("\"'`[]").lower() for k in m[2].split(",")]
            continue
        m = re.match(r"""("(?:[^"]|"")*"|'[^']*'|`[^`]*`|\[[^\]]*\]|[^\s(]+)\s*(.*)""", part, re.DOTALL)
        name, rest = m[1], m[2]
        name = name[1:-1].replace('""', '"') if name[0] in "\"'`[" else name
        stop = re.search(r"\b(CONSTRAINT|PRIMARY|NOT|NULL|UNIQUE|CHECK|DEFAULT|COLLATE|REFERENCES|GENERATED|AS)\b", rest, re.IGNORECASE)
        type_name = re.sub(r"\(.*", "", rest[: stop.start()] if stop else rest, flags=re.DOTALL).strip()
        out.append(Column(name.lower(), type_name, type_name.upper() == "INTEGER" and bool(re.search(r"\bPRIMARY\s+KEY\b(?!\s+DESC)", rest, re.IGNORECASE))))
    if len(keys) == 1:
        out = [Column(c.name, c.type_name, c.is_rowid or (c.name == keys[0] and c.type_name.upper() == "INTEGER")) for c in out]
    return out


def master(pages: Pages, kind: str = "table") -> list[tuple[str, int, str, str]]:
    """(name, root page, DDL, table) of the tables, or of the indexes."""
    rows = (values for _, values in pages.rows(1))
    return [(v[1], v[3], v[4], v[2]) for v in rows if v[0] == kind and v[4] and v[3] and not v[1].startswith("sqlite_")]


def files_of(path: str) -> list[str]:
    """The file itself, or the files of a folder in order."""
    from pyarrow import fs

    remote = re.match(r"[a-z][a-z0-9+.-]*:/", path)
    system, inner = fs.FileSystem.from_uri(path) if remote else (fs.LocalFileSystem(), path)
    if system.get_file_info(inner).type != fs.FileType.Directory:
        return [path]
    found = sorted(f.path for f in system.get_file_info(fs.FileSelector(inner)) if f.path.endswith(".db") and not f.base_name.startswith("."))
    if not found:
        raise FileFormatError(f"no database file in {path}")
    return [f"{path.rstrip('/')}/{f.rsplit('/', 1)[-1]}" for f in found]


def sources_of(options: dict) -> list[str | bytes]:
    return [base64.b64decode(options["data"])] if "data" in options else files_of(options["path"])


def table_names(source: str | bytes) -> list[str]:
    with Pages(source) as pages:
        return [name.lower() for name, *_ in master(pages)]


def rowid_column(columns: list[Column]) -> str | None:
    return next((c.name for c in columns if c.is_rowid), None)


def table_columns(source: str | bytes, table: str) -> tuple[list[Column], int]:
    """Columns and root page of a table."""
    with Pages(source) as pages:
        for name, root, sql, _ in master(pages):
            if name.lower() == table.lower():
                return parse_ddl(sql), root
    raise FileFormatError(f"no table named {table!r}")


def index_columns(source: str | bytes, index: str) -> tuple[list[Column], int]:
    """Columns of an index's key, and its root page."""
    with Pages(source) as pages:
        for name, root, sql, table in master(pages, "index"):
            if name.lower() == index.lower():
                held = {c.name: c for c in table_columns(source, table)[0]}
                inside = re.search(r"\bON\b[^(]*\((.*)\)", sql, re.IGNORECASE | re.DOTALL)[1]
                names = [re.sub(r"\s+(ASC|DESC|COLLATE\s+\w+)\b", "", part, flags=re.IGNORECASE).strip().strip("\"'`[]").lower() for part in parts_of(inside)]
                if re.search(r"\b(DESC|COLLATE)\b", inside, re.IGNORECASE) or not set(names) <= set(held):
                    raise FileFormatError(f"index {index!r} is not over plain columns in ascending order")
                return [Column(n, held[n].type_name) for n in names], root
    raise FileFormatError(f"no index named {index!r}")


@dataclass(frozen=True)
class FilePart(InputPartition):
    """A subtree of one of the files."""

    file: int
    split: Split


def _array(values: list, cls: StorageClass, column: Column) -> pa.Array:
    """Values of a column of a class; integers become floats, as the format stores whole floats as integers."""
    wanted, kind = {StorageClass.INT: (int, pa.int64()), StorageClass.FLOAT: (float, pa.float64()), StorageClass.TEXT: (str, pa.string()), StorageClass.BLOB: (bytes, pa.binary())}[cls]
    held = set(map(type, values)) - {type(None), wanted}
    if cls is StorageClass.FLOAT and held == {int}:
        values = [float(v) if isinstance(v, int) else v for v in values]
    elif held:
        odd = next(v for v in values if v is not None and not isinstance(v, wanted))
        raise FileFormatError(f"column {column.name!r} stores {cls.value} but holds {odd!r:.60}; mode=dynamic reads such columns")
    return pa.array(values, kind)


def _tagged(values: list) -> pa.Array:
    kinds = [None if v is None else 1 if isinstance(v, (int, float)) else 2 if isinstance(v, str) else 3 for v in values]
    parts = [pa.array([v if isinstance(v, cls) else None for v in values], kind) for cls, kind in ((int, pa.int64()), (float, pa.float64()), (str, pa.string()), (bytes, pa.binary()))]
    return pa.StructArray.from_arrays([pa.array(kinds, pa.int8()), *parts], ["tag", "i", "d", "t", "b"], mask=pa.array([k is None for k in kinds]))


class SqliteFileSource(DataSource):
    """The data source; see the module."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_file"

    def _columns(self) -> list[Column]:
        """The columns to read, in order."""
        source = sources_of(self.options)[0]
        held = index_columns(source, self.options["index"])[0] if "index" in self.options else table_columns(source, self.options["table"])[0]
        if "columns" not in self.options:
            return held
        wanted = [n for n in self.options["columns"].lower().split(",") if n]
        return [c for c in held if c.name in wanted]

    def schema(self) -> T.StructType:
        dynamic = self.options.get("mode", "strict") == "dynamic"
        fields = [T.StructField(c.name, DYNAMIC if dynamic else SPARK_TYPES[affinity(c.type_name or "BLOB")]) for c in self._columns()]
        if "index" in self.options or self.options.get("rowid", "false").lower() == "true":
            fields.append(T.StructField("_rowid", T.LongType()))
        return T.StructType(fields)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        if "index" in self.options:
            return _IndexReader(self.options, self._columns(), schema)
        kind = _PushingReader if self.options.get("pushdown", "false").lower() == "true" else _Reader
        return kind(self.options, self._columns(), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self.options["table"], schema, overwrite, int(self.options.get("page_size", 4096)), self.options.get("rowid"))


class _Reader(DataSourceReader):
    def __init__(self, options, columns: list[Column], schema: T.StructType):
        self.sources, self.table, self.columns, self.schema = sources_of(options), options.get("table"), columns, schema
        self.low, self.high = int(options.get("rowid_from", ROWID_MIN)), int(options.get("rowid_to", ROWID_MAX))
        self.dynamic, self.reverse = options.get("mode", "strict") == "dynamic", options.get("order", "asc").lower() == "desc"

    def partitions(self) -> list[InputPartition]:
        out = []
        for k, source in enumerate(self.sources):
            root = table_columns(source, self.table)[1]
            with Pages(source) as pages:
                out += [FilePart(k, Split(s.page, max(self.low, s.low), min(self.high, s.high))) for s in pages.splits(root) if s.low <= self.high and s.high >= self.low]
        return out[::-1] if self.reverse else out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        split, source = partition.split, self.sources[partition.file]
        number = {c.name: k for k, c in enumerate(table_columns(source, self.table)[0])}
        wanted = [number[c.name] for c in self.columns]
        with Pages(source) as pages:
            rowids, rows = [], []
            for rowid, row in pages.raw_rows(split.page, split.low, split.high, self.reverse):
                rowids.append(rowid)
                rows.append(record(row, wanted))
                if len(rows) == BATCH:
                    yield self._batch(rowids, rows)
                    rowids, rows = [], []
            if rows:
                yield self._batch(rowids, rows)

    def _batch(self, rowids: list[int], rows: list[list]) -> pa.RecordBatch:
        arrays = []
        for column, values in zip(self.columns, zip(*rows) if self.columns else (), strict=True):
            values = [r if v is None else v for r, v in zip(rowids, values)] if column.is_rowid else list(values)
            arrays.append(_tagged(values) if self.dynamic else _array(values, affinity(column.type_name or "BLOB"), column))
        if len(self.schema.fields) > len(self.columns):
            arrays.append(pa.array(rowids, pa.int64()))
        return pa.RecordBatch.from_arrays(arrays, schema=to_arrow_schema(self.schema))


class _PushingReader(_Reader):
    def pushFilters(self, filters: list[Filter]):
        """Ranges of the rowid from filters on it; Spark applies all filters again."""
        names = {"_rowid", rowid_column(self.columns)}
        for f in filters:
            value = getattr(f, "value", None)
            if len(getattr(f, "attribute", ())) == 1 and f.attribute[0] in names and isinstance(value, int):
                if isinstance(f, (EqualTo, EqualNullSafe, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, EqualNullSafe, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, value - isinstance(f, LessThan))
            yield f


class _IndexReader(_Reader):
    """An index is read by one task a file, in its order."""

    def __init__(self, options, columns: list[Column], schema: T.StructType):
        super().__init__(options, columns, schema)
        self.index = options["index"]

    def partitions(self) -> list[InputPartition]:
        return [FilePart(k, Split(index_columns(source, self.index)[1], ROWID_MIN, ROWID_MAX)) for k, source in enumerate(self.sources)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        held = [c.name for c in index_columns(self.sources[partition.file], self.index)[0]]
        wanted = [held.index(c.name) for c in self.columns]
        with Pages(self.sources[partition.file]) as pages:
            rowids, rows = [], []
            for entry in pages.entries(partition.split.page):
                rowids.append(entry[-1])
                rows.append([entry[k] for k in wanted])
                if len(rows) == BATCH:
                    yield self._batch(rowids, rows)
                    rowids, rows = [], []
            if rows:
                yield self._batch(rowids, rows)


class _Writer(DataSourceWriter):
    """A file for each partition; files of a failed job are deleted."""

    def __init__(self, path: str, table: str, schema: T.StructType, overwrite: bool, page_size: int, rowid: str | None = None):
        self.path, self.table, self.overwrite, self.page_size = path.rstrip("/"), table, overwrite, page_size
        quoted = lambda name: '"' + name.replace('"', '""') + '"'
        self.classes = [class_of(f.dataType) for f in schema.fields]
        if StorageClass.OPAQUE in self.classes:
            raise FileFormatError("only numbers, text and binary columns can be written")
        names = [f.name for f in schema.fields]
        self.key = None if rowid is None else names.index(rowid)
        if rowid is not None and self.classes[self.key] is not StorageClass.INT:
            raise FileFormatError("rowids are integers")
        keyed = [" PRIMARY KEY" if k == self.key else "" for k in range(len(names))]
        self.ddl = f"CREATE TABLE {quoted(table)} ({', '.join(f'{quoted(n)} {c.value}{key}' for n, c, key in zip(names, self.classes, keyed, strict=True))})"

    def _system(self):
        from pyarrow import fs

        remote = re.match(r"[a-z][a-z0-9+.-]*:/", self.path)
        return fs.FileSystem.from_uri(self.path) if remote else (fs.LocalFileSystem(), self.path)

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        file = FileWriter(self.page_size)
        file.table(self.table, self.ddl, map(self._row, enumerate(iterator, 1)))
        system, folder = self._system()
        system.create_dir(folder, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.db"
        with system.open_output_stream(f"{folder}/.{name}") as out:
            out.write(file.finish())
        return Written(name)

    def _row(self, numbered) -> tuple[int, list]:
        number, row = numbered
        values = [int(v) if isinstance(v, bool) else v for v in row]
        if self.key is not None:
            number, values[self.key] = values[self.key], None
        return number, values

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, folder = self._system()
        if self.overwrite:
            for old in self._listed():
                if old.path.endswith(".db") and not old.base_name.startswith("."):
                    system.delete_file(old.path)
        for m in messages:
            if m is not None:
                system.move(f"{folder}/.{m.name}", f"{folder}/{m.name}")

    def _listed(self):
        from pyarrow import fs

        system, folder = self._system()
        return system.get_file_info(fs.FileSelector(folder, allow_not_found=True))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, folder = self._system()
        for m in messages:
            if m is not None:
                system.delete_file(f"{folder}/.{m.name}")


@dataclass
class Written(WriterCommitMessage):
    name: str
