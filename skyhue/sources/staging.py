"""Intermediate tables that several consumers read.

A population's colour table is computed once and written; each product then scans the few columns it needs. The table
survives lost executors, cuts the lineage, and costs one write of a compact result instead of a recomputation per pass.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A fresh folder below the shared one the session names (spark.checkpoint.dir).

    Where none is named, a local session, whose executors are its driver, gets a folder of its own; on a cluster that is an error, as executors would
    write where others can't read.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return f"{shared.rstrip('/')}/{uuid.uuid4().hex}"
    if re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        return tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def materialize(df: DataFrame, *parts: str, compression: str | None = None) -> DataFrame:
    """Writes the table, divided by the columns ``parts`` if there are any, and returns a scan of it."""
    path = folder(df.sparkSession)
    w = df.write.mode("overwrite")
    if compression:
        w = w.option("compression", compression)
    (w.partitionBy(*parts) if parts else w).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(df.columns)


def discard(df: DataFrame) -> None:
    """Deletes a table that ``materialize`` wrote whole, once nothing reads it any more. Other files are left alone."""
    sc = df.sparkSession.sparkContext
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if re.fullmatch("[0-9a-f]{32}", path.rsplit("/", 1)[1]):
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
