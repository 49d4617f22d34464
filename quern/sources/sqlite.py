"""SQLite archives as a Spark data source: ``spark.read.format("sqlite").option("path", ...).option("table", ...)``.

A table is read by ranges of its rowid, one a task, in Arrow batches, and only the columns of the schema are read. With the
option ``push`` comparisons are handed to SQLite, which may use its own indexes for them. A path may be a folder of archives, such as the sink
writes: each task of ``df.write.format("sqlite")`` makes one file. Files must lie where every executor can open them (a
mounted folder): SQLite opens nothing else. No row passes through the driver.
"""

from __future__ import annotations

import os
import sqlite3
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema

#: Declared types by what SQLite looks for in them; what is none of these is text.
_KINDS = (("INT", T.LongType()), ("CHAR", T.StringType()), ("CLOB", T.StringType()), ("TEXT", T.StringType()), ("BLOB", T.BinaryType()), ("REAL", T.DoubleType()), ("FLOA", T.DoubleType()), ("DOUB", T.DoubleType()))
_DECLARED = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "boolean": "INTEGER", "double": "REAL", "float": "REAL", "string": "TEXT", "binary": "BLOB"}
_COMPARES = {EqualTo: "=", EqualNullSafe: "IS", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
#: Rows of one Arrow batch.
BATCH_ROWS = 10_000


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _plain(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def connect(path: str) -> sqlite3.Connection:
    """Read-only: a file that isn't there is an error, not a new archive."""
    return sqlite3.connect(f"file:{_plain(path)}?mode=ro", uri=True)


def files(path: str) -> list[str]:
    """The archive itself, or those of a folder in order."""
    path = _plain(path)
    return sorted(f"{path}/{f}" for f in os.listdir(path) if f.endswith(".db")) if os.path.isdir(path) else [path]


def condition(f: Filter) -> tuple[str, list] | None:
    """A filter as SQLite's condition and its parameters; None where SQLite would not keep all that Spark keeps."""
    if isinstance(f, Not):
        inner = condition(f.child)
        return (f"NOT ({inner[0]})", inner[1]) if inner and isinstance(f.child, (EqualTo, EqualNullSafe, IsNull, IsNotNull, In)) else None
    if len(f.attribute) != 1:
        return None
    name = _quoted(f.attribute[0])
    if isinstance(f, (IsNull, IsNotNull)):
        return f"{name} IS {'NOT ' * isinstance(f, IsNotNull)}NULL", []
    values = list(f.value) if isinstance(f, In) else [f.value]
    if not all(isinstance(v, (str, bytes, int, float)) and v == v for v in values):  # dates, decimals and NaN stay with Spark
        return None
    if isinstance(f, In):
        return (f"{name} IN ({', '.join('?' * len(values))})", values) if len(values) < 900 else None
    if isinstance(f, StringStartsWith):
        return f"substr({name}, 1, ?) = ?", [len(values[0]), values[0]]
    if isinstance(f, StringContains):
        return f"instr({name}, ?) > 0", values
    op = _COMPARES.get(type(f))
    return (f"{name} {op} ?", values) if op else None


@dataclass
class Rows(InputPartition):
    """A file, and the rowids of one task: first and last, or none for a query or a table without rowids."""

    file: str
    first: int | None = None
    last: int | None = None


class SqliteReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.path, self.table, self.query = schema, options["path"], options.get("table"), options.get("query")
        self.per_file = int(options.get("partitions", 8))
        self.where: list[str] = []
        self.params: list = []

    def partitions(self) -> list[Rows]:
        out = []
        for file in files(self.path):
            with connect(file) as db:
                try:
                    first, last = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone() if self.table else (None, None)
                except sqlite3.OperationalError as e:
                    if "rowid" not in str(e):
                        raise
                    out.append(Rows(file))  # a table without rowids
                    continue
            if self.query:
                out.append(Rows(file))
            elif first is not None:
                step = (last - first) // self.per_file + 1
                out += [Rows(file, a, min(a + step - 1, last)) for a in range(first, last + 1, step)]
        return out

    def read(self, partition: Rows | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an empty table
            return
        kinds = to_arrow_schema(self.schema)
        names = ", ".join(_quoted(f.name) for f in self.schema.fields) or "1"
        if self.query:
            sql, params = f"SELECT {names} FROM ({self.query})", []
        else:
            where, params = list(self.where), list(self.params)
            if partition.first is not None:
                where.append("rowid BETWEEN ? AND ?")
                params += [partition.first, partition.last]
            sql = f"SELECT {names} FROM {_quoted(self.table)}" + (f" WHERE {' AND '.join(where)}" if where else "")
        with connect(partition.file) as db:
            found = db.execute(sql, params)
            while block := found.fetchmany(BATCH_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array([_as(v, k) for v in c], k) for c, k in zip(zip(*block), kinds.types)], schema=kinds)


class PushingReader(SqliteReader):
    """Hands comparisons to SQLite."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """All are also left to Spark, since an archive may hold values of other types than its columns declare."""
        for f in filters:
            if (made := condition(f)) and self.table:
                self.where.append(made[0])
                self.params += made[1]
        return filters


def _as(v, kind: pa.DataType):
    """A value in its column's declared type; null where it is of another, as SQLite allows."""
    if v is None or pa.types.is_string(kind) and isinstance(v, str) or pa.types.is_binary(kind) and isinstance(v, bytes):
        return v
    if pa.types.is_string(kind):
        return str(v) if isinstance(v, (int, float)) else None
    if pa.types.is_boolean(kind):
        return bool(v) if isinstance(v, int) else None
    if pa.types.is_integer(kind):
        return v if isinstance(v, int) else None
    return float(v) if isinstance(v, (int, float)) and pa.types.is_floating(kind) else None


class SqliteWriter(DataSourceArrowWriter):
    """Each task writes an archive of its own under a name that its commit gives it, so that what a lost task left is never
    read."""

    def __init__(self, schema: T.StructType, options: dict, overwrite: bool):
        self.schema, self.folder, self.table, self.overwrite = schema, _plain(options["path"]), options.get("table", "rows"), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        os.makedirs(self.folder, exist_ok=True)
        path = f"{self.folder}/{uuid.uuid4().hex}.part"
        columns = ", ".join(f"{_quoted(f.name)} {_DECLARED[f.dataType.simpleString()]}" for f in self.schema.fields)
        with sqlite3.connect(path) as db:
            db.execute(f"CREATE TABLE {_quoted(self.table)} ({columns})")
            for b in iterator:
                db.executemany(f"INSERT INTO {_quoted(self.table)} VALUES ({', '.join('?' * len(self.schema.fields))})", zip(*(c.to_pylist() for c in b.columns)))
        db.close()
        return Written(path)

    def commit(self, messages: list) -> None:
        if self.overwrite:
            for old in files(self.folder) if os.path.isdir(self.folder) else []:
                os.remove(old)
        for m in messages:
            if m is not None:
                os.rename(m.path, m.path.removesuffix(".part") + ".db")

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


@dataclass
class Written(WriterCommitMessage):
    path: str


class SqliteSource(DataSource):
    """Options: path (a file or a folder of them), and table, or query, which each archive answers as a whole; partitions:
    tasks for each file (8); push: true hands comparisons to SQLite. Spark 4.1 keeps them with the relation, so that a
    DataFrame loaded with push must be used for one query alone. The schema is the table's declared one unless another is given, of which the names count."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> T.StructType:
        found = files(self.options["path"])
        if not found:
            raise ValueError(f"no archive in {self.options['path']}")
        with connect(found[0]) as db:
            if query := self.options.get("query"):
                raise ValueError(f"the columns of a query must be told by a schema: {query[:60]}")
            columns = db.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if not columns:
            raise ValueError(f"{found[0]} has no table {self.options['table']}")
        kind = lambda declared: next((k for part, k in _KINDS if part in declared.upper()), T.StringType())
        return T.StructType([T.StructField(name, kind(declared or "")) for _, name, declared, *_ in columns])

    def reader(self, schema: T.StructType) -> SqliteReader:
        return (PushingReader if self.options.get("push", "").lower() == "true" else SqliteReader)(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> SqliteWriter:
        return SqliteWriter(schema, self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets Spark hand it comparisons."""
    from quern.sources.shared import ship

    ship(spark)
    spark.dataSource.register(SqliteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
