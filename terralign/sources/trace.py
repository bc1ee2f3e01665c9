"""Tables of a SQLite file, such as a profiler's trace, as a data source: spark.read.format("sqlite")."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable
from contextlib import closing
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual,
)
from pyspark.sql.types import StructType
from pyspark.sql.types import _parse_datatype_string as parsed

from terralign.sources.files import opened

COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
KINDS = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
ROWS = 10_000


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def connected(path: str) -> sqlite3.Connection:
    """A file that the machine sees is read in place; one on another store is taken into memory whole."""
    if path.startswith("file:"):
        path = path.removeprefix("file://").removeprefix("file:")
    if "://" not in path:
        return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)
    with opened(path) as f:
        content = f.read()
    con = sqlite3.connect(":memory:")
    con.deserialize(content)
    return con


def typed(con: sqlite3.Connection, table: str) -> str:
    """The table's columns as a schema, by SQLite's rules of affinity. ValueError if there is no such table, or it has no rowid."""
    columns = con.execute(f"PRAGMA table_info({quoted(table)})").fetchall()
    if not columns:
        raise ValueError(f"no table {table}")

    def kind(declared: str) -> str:
        d = declared.upper()
        return "bigint" if "INT" in d else "string" if any(x in d for x in ("CHAR", "CLOB", "TEXT")) else "binary" if "BLOB" in d or not d else "double"

    return ", ".join(f"`{name}` {kind(declared)}" for _, name, declared, *_ in columns)


@dataclass
class Rowids(InputPartition):
    lo: int
    hi: int


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.table, self.schema = options["path"], options["table"], schema
        self.parts = int(options.get("partitions", "8"))
        self.where: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Comparisons of a column with a number or text, and tests for null, are SQLite's work; the rest stays Spark's."""
        known = {f.name: f.dataType.simpleString() for f in self.schema}
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in known and type(f) is IsNotNull:
                self.where.append((name, "IS NOT NULL", None))
            elif name in known and type(f) in COMPARED and known[name] in ("bigint", "string") and isinstance(f.value, (int, str)):
                self.where.append((name, COMPARED[type(f)], f.value))
            else:
                yield f

    def partitions(self):
        with closing(connected(self.path)) as con:
            lo, hi = con.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
        if lo is None:
            return [Rowids(0, 0)]
        step = -(-(hi + 1 - lo) // self.parts)
        return [Rowids(a, min(a + step, hi + 1)) for a in range(lo, hi + 1, step)]

    def read(self, partition: Rowids):
        names = [f.name for f in self.schema]
        kinds = [KINDS[f.dataType.simpleString()] for f in self.schema]
        test = "".join(f" AND {quoted(n)} {op}" + (" ?" if value is not None else "") for n, op, value in self.where)
        values = [v for _, _, v in self.where if v is not None]
        with closing(connected(self.path)) as con:
            con.text_factory = lambda raw: raw.decode("utf-8", "replace")
            rows = con.execute(f"SELECT {', '.join(map(quoted, names))} FROM {quoted(self.table)} WHERE rowid >= ? AND rowid < ?{test}", [partition.lo, partition.hi, *values])
            while some := rows.fetchmany(ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*some, strict=True), kinds, strict=True)], names=names)


class SqliteSource(DataSource):
    """Options: path, table, partitions (ranges of rowid, 8 if not given). Columns are the table's, or those of schema() that it has, of type bigint, double, string or binary.

    Filters reach SQLite with spark.sql.python.filterPushdown.enabled.
    """

    @classmethod
    def name(cls):
        return "sqlite"

    def schema(self):
        with closing(connected(self.options["path"])) as con:
            return typed(con, self.options["table"])

    def reader(self, schema):
        if isinstance(schema, str):
            schema = parsed(schema)
        return SqliteReader(self.options, schema)
