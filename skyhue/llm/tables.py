"""Reading the given tables, writing intermediate ones to the shared folder, and keys of text shared by the operators."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyhue.sources import staging

#: Fixed value: what separates words (blank and U+0009 to U+000D), as a Java and RE2 pattern.
SPACE = r"[\x20\x09-\x0D]"


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where their path doesn't hold it: the driver's copy goes along as a zip file."""
    root = Path(__file__).resolve().parents[2]
    known = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    name = f"skyhue-{spark.sparkContext.applicationId}.zip"
    if str(root) in known or any(name in f for f in spark.sparkContext.listFiles):
        return
    made = shutil.make_archive(os.path.join(tempfile.mkdtemp(), name.removesuffix(".zip")), "zip", root, "skyhue")
    spark.sparkContext.addPyFile(made)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Writes the table to the shared folder and returns a scan of it: lost executors don't lose it, and plans stay short."""
    return staging.materialize(df, compression=compression)


def words(text: Column | str) -> Column:
    """The words of a text in order; none for null."""
    parts = F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), SPACE + "+")
    return F.array_remove(parts, "")


def text_key(text: Column | str) -> Column:
    """128 bits that stand for a text. Null stands for itself, apart from the empty text."""
    c = F.col(text) if isinstance(text, str) else text
    return F.struct(F.xxhash64(c.isNull(), c).alias("k1"), F.xxhash64(F.lit(7), c.isNull(), c).alias("k2"))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the table doesn't have, whatever extra columns it brings."""
    taken, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name.lower() in taken:
        name = f"__{stem}_{uuid.uuid4().hex[:6]}"
    return name


def others(df: DataFrame, *names: str) -> list[str]:
    """The table's columns but those named; Spark tells names apart without case, and so does this."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]
