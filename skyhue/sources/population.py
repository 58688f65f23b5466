"""A population that lies in several files: where each event came from, what is missing, and a load that stops where two files hold one event.

Provenance is a combining aggregate of constant size for each event, whatever number of rows or files it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skyhue.functions import checks

SOURCE = "source_file"


def files_per_event(curves: DataFrame, key: str = "event_id", source: str = SOURCE) -> DataFrame:
    """key, n_rows, first_file, last_file: the two differ where an event lies in more than one file."""
    return curves.groupBy(key).agg(F.count("*").alias("n_rows"), F.min(source).alias("first_file"), F.max(source).alias("last_file"))


def _several() -> Column:
    return F.col("first_file") != F.col("last_file")


def load_report(curves: DataFrame, expected: DataFrame, key: str = "event_id", source: str = SOURCE) -> DataFrame:
    """key, status, n_rows, first_file, last_file of every event that is expected or found.

    status: ``loaded``, ``missing`` (expected, without rows), ``in_several_files``, ``not_expected``.
    """
    wanted = expected.select(key).distinct().withColumn("__wanted", F.lit(True))
    d = files_per_event(curves, key, source).join(wanted, key, "full_outer")
    status = F.when(F.col("n_rows").isNull(), "missing").when(_several(), "in_several_files").when(F.col("__wanted").isNull(), "not_expected").otherwise("loaded")
    return d.select(key, status.alias("status"), F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows"), "first_file", "last_file")


def missing_events(curves: DataFrame, expected: DataFrame, key: str = "event_id") -> DataFrame:
    """Expected events that no file holds."""
    return expected.select(key).distinct().join(curves.select(key), key, "left_anti")


def report_counts(report: DataFrame) -> DataFrame:
    """One row: events by status."""
    return report.agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("loaded", "missing", "in_several_files", "not_expected")])


def load(curves: DataFrame, expected: DataFrame | None = None, key: str = "event_id", source: str = SOURCE) -> DataFrame:
    """The curves of the expected events without their source; an event that lies in two files stops the query.

    The check reads keys and file names alone. Expected events without rows are no error: see ``load_report``.
    """
    twice = files_per_event(curves, key, source).where(_several()).agg(F.min(F.struct(F.col(key).cast("string").alias("k"), "first_file", "last_file")).alias("e"))
    text = F.format_string("event %s lies in %s and in %s", "e.k", "e.first_file", "e.last_file")
    d = checks.guard_with(curves.drop(source), twice.select(F.when(F.col("e").isNotNull(), text).alias("message")))
    return d if expected is None else d.join(expected.select(key), key, "left_semi")
