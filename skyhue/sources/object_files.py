"""A sink that makes one CSV file, not one directory, for each object; Spark's own reader packs such small files into tasks."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pcsv
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


class _ObjectWriter(DataSourceArrowWriter):
    """Rows of a task come in order of the key. A file appears under its name when it is complete; a task that runs again makes the same files."""

    def __init__(self, path: str, key: str):
        self.path, self.key = path, key

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        name, sink, out, draft = None, None, None, None

        def close() -> None:
            if out is not None:
                out.close()
                sink.close()
                fs.move(draft, f"{root}/{name}.csv")

        for batch in iterator:
            place = batch.schema.get_field_index(self.key)
            keys, rest = batch.column(place), batch.remove_column(place)
            starts = [0, *(i + 1 for i in pc.indices_nonzero(pc.fill_null(pc.not_equal(keys.slice(1), keys.slice(0, max(len(keys) - 1, 0))), True)).to_pylist()), len(keys)]
            for a, b in zip(starts, starts[1:]):
                if a == b:
                    continue
                found = quote(str(keys[a].as_py()), safe=" ")
                if found != name:
                    close()
                    name, draft = found, f"{root}/_{uuid.uuid4().hex}.tmp"
                    sink = fs.open_output_stream(draft)
                    out = pcsv.CSVWriter(sink, rest.schema, write_options=pcsv.WriteOptions(quoting_style="needed"))
                out.write_batch(rest.slice(a, b - a))
        close()
        return WriterCommitMessage()


class ObjectFiles(DataSource):
    """Options: path, key."""

    @classmethod
    def name(cls) -> str:
        return "object_csv"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _ObjectWriter(self.options["path"], self.options["key"])


def write(df: DataFrame, path: str, key: str, order: list[str]) -> None:
    """``<key>.csv`` below path for each object, rows in order. A file is written by one task, which streams through its rows and holds one batch of them."""
    df.sparkSession.dataSource.register(ObjectFiles)
    df.repartition(key).sortWithinPartitions(key, *order).write.format("object_csv").option("key", key).mode("append").save(path)
