"""Survey databases as files: SQLite tables read in ranges of rows, with filters that run in the database, and written as one database file a task.

For databases with a server there is ``readers.survey_table``.
"""

from __future__ import annotations

import os
import re
import sqlite3
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as S
from pyspark.sql import types as T

#: Rows that one task reads, and one batch holds.
RANGE, BATCH = 1_000_000, 10_000
TYPES = {"INTEGER": T.LongType(), "REAL": T.DoubleType(), "TEXT": T.StringType()}
COMPARED = {S.EqualTo: "=", S.GreaterThan: ">", S.GreaterThanOrEqual: ">=", S.LessThan: "<", S.LessThanOrEqual: "<="}


def local(path: str) -> str:
    """SQLite opens local paths only; on a cluster that is a folder that all executors mount."""
    if re.match(r"^(?!file:)[A-Za-z][\w+.-]*:", path):
        raise ValueError(f"survey databases are read from a mounted folder, not from {path}")
    return re.sub(r"^file:/+", "/", path)


def files(path: str) -> list[str]:
    path = local(path)
    return sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith(".db")) if os.path.isdir(path) else [path]


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def condition(f: S.Filter) -> tuple[str, list] | None:
    """A filter as SQL with parameters; None where the database would judge it in another way than Spark."""
    if isinstance(f, S.Not):
        inner = condition(f.child)
        return inner and (f"NOT ({inner[0]})", inner[1])
    name = quoted(".".join(f.attribute)) if hasattr(f, "attribute") else None
    if type(f) in COMPARED and isinstance(f.value, (int, float, str)) and f.value == f.value:
        return f"{name} {COMPARED[type(f)]} ?", [f.value]
    if isinstance(f, S.In) and all(isinstance(v, (int, float, str)) for v in f.value):
        return f"{name} IN ({', '.join('?' * len(f.value))})", list(f.value)
    if isinstance(f, (S.IsNull, S.IsNotNull)):
        return f"{name} IS {'NOT ' if isinstance(f, S.IsNotNull) else ''}NULL", []
    return None


class _Rows(S.InputPartition):
    def __init__(self, file: str, first: int, last: int):
        self.file, self.first, self.last = file, first, last


class _Reader(S.DataSourceReader):
    def __init__(self, path: str, table: str, schema: T.StructType, rows: int):
        self.path, self.table, self.schema, self.rows = path, table, schema, rows
        self.where, self.values = [], []

    def pushFilters(self, filters: list[S.Filter]):
        for f in filters:
            told = condition(f)
            if told is None:
                yield f
            else:
                self.where.append(told[0])
                self.values += told[1]

    def partitions(self) -> list[S.InputPartition]:
        found = []
        for file in files(self.path):
            with sqlite3.connect(f"file:{file}?mode=ro", uri=True) as con:
                low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
            if low is not None:
                found += [_Rows(file, a, min(a + self.rows - 1, high)) for a in range(low, high + 1, self.rows)]
        return found

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        if partition.file is None:
            return
        arrow = pa.schema([(f.name, {"bigint": pa.int64(), "double": pa.float64()}.get(f.dataType.simpleString(), pa.string())) for f in self.schema.fields])
        where = " AND ".join(["rowid BETWEEN ? AND ?", *self.where])
        con = sqlite3.connect(f"file:{partition.file}?mode=ro", uri=True)
        try:
            rows = con.execute(f"SELECT {', '.join(map(quoted, arrow.names))} FROM {quoted(self.table)} WHERE {where}", [partition.first, partition.last, *self.values])
            while some := rows.fetchmany(BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), arrow.types)], schema=arrow)
        finally:
            con.close()


class _Written(S.WriterCommitMessage):
    def __init__(self, draft: str, file: str):
        self.draft, self.file = draft, file


class _Writer(S.DataSourceArrowWriter):
    def __init__(self, path: str, table: str, schema: T.StructType):
        self.path, self.table, self.schema = local(path), table, schema

    def write(self, iterator: Iterator[pa.RecordBatch]) -> S.WriterCommitMessage:
        os.makedirs(self.path, exist_ok=True)
        name = uuid.uuid4().hex
        draft = os.path.join(self.path, f"_{name}.tmp")
        kinds = {v.simpleString(): k for k, v in TYPES.items()} | {"int": "INTEGER", "boolean": "INTEGER", "float": "REAL"}
        columns = ", ".join(f"{quoted(f.name)} {kinds[f.dataType.simpleString()]}" for f in self.schema.fields)
        con = sqlite3.connect(draft)
        con.execute(f"CREATE TABLE {quoted(self.table)} ({columns})")
        marks = ", ".join("?" * len(self.schema.fields))
        for batch in iterator:
            con.executemany(f"INSERT INTO {quoted(self.table)} VALUES ({marks})", zip(*(c.to_pylist() for c in batch.columns)))
        con.commit()
        con.close()
        return _Written(draft, os.path.join(self.path, f"part-{name}.db"))

    def commit(self, messages: list) -> None:
        for m in messages:
            if m is not None:
                os.replace(m.draft, m.file)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.draft):
                os.remove(m.draft)


class SurveyDb(S.DataSource):
    """Options: path (a database or a folder of .db files), table, rows (that one task reads)."""

    @classmethod
    def name(cls) -> str:
        return "survey_db"

    def _table(self) -> str:
        return self.options.get("table", "observations")

    def schema(self) -> T.StructType:
        with sqlite3.connect(f"file:{files(self.options['path'])[0]}?mode=ro", uri=True) as con:
            told = con.execute(f"SELECT name, type FROM pragma_table_info({chr(39) + self._table().replace(chr(39), chr(39) * 2) + chr(39)})").fetchall()
        return T.StructType([T.StructField(name, TYPES.get(kind.upper(), T.StringType())) for name, kind in told])

    def reader(self, schema: T.StructType) -> S.DataSourceReader:
        return _Reader(self.options["path"], self._table(), schema, int(self.options.get("rows", RANGE)))

    def writer(self, schema: T.StructType, overwrite: bool) -> S.DataSourceArrowWriter:
        return _Writer(self.options["path"], self._table(), schema)


def read(spark: SparkSession, path: str, table: str = "observations", rows: int = RANGE, columns: list[str] | None = None) -> DataFrame:
    """A survey table. Filters on it run in the database; name the columns to read only those."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SurveyDb)
    r = spark.read.format("survey_db").option("table", table).option("rows", rows)
    if columns:
        schema = r.load(path).schema
        r = r.schema(T.StructType([schema[c] for c in columns]))
    return r.load(path)


def write(df: DataFrame, path: str, table: str = "observations") -> None:
    df.sparkSession.dataSource.register(SurveyDb)
    df.write.format("survey_db").option("table", table).mode("append").save(path)
