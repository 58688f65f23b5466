"""Writers: partitioned, retry-safe through Spark's committers; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skyhue.sources import object_files


def population(df: DataFrame, path: str, rows_per_file: int = 1_000_000, key: str = "event_id") -> None:
    """Parquet parts in id order, so that a lookup by id skips files and row groups. A hot id spans several parts."""
    order = [key, *[c for c in ("t_days", "band") if c in df.columns]]
    (
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).option("compression", "zstd").parquet(path)
    )


def population_manifest(written: DataFrame, key: str = "event_id") -> DataFrame:
    """First and last id, events and rows of each part, read back from the written files."""
    part = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return written.select(part.alias("part"), key).groupBy("part").agg(
        F.min(key).alias("first_event"), F.max(key).alias("last_event"),
        F.count_distinct(key).alias("n_events"), F.count("*").alias("n_rows"),
    )


def per_object(df: DataFrame, path: str, key: str, order: tuple[str, ...] = ("t_days", "band")) -> None:
    """One CSV file per object, ``<key>.csv``, its rows in order; see ``object_files``."""
    object_files.write(df, path, key, [c for c in order if c in df.columns])


def table(df: DataFrame, path: str, compress: bool = False) -> None:
    w = df.write.mode("overwrite").option("header", True)
    (w.option("compression", "gzip") if compress else w).csv(path)


def summary_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def adapted_snia(df: DataFrame, path: str, renames: dict[str, str]) -> DataFrame:
    """SN Ia rows under the library's names, written as Parquet; returns the renamed rows."""
    out = df.withColumnsRenamed(renames)
    out.write.mode("overwrite").parquet(path)
    return out
