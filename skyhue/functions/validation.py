"""Validation reports of catalogues and runs: one aggregate each, and a strict form that raises."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skyhue.functions import columns as C


def catalogue_report(catalogue: DataFrame, index: str, single_valued: list[str], numeric: list[str]) -> DataFrame:
    """Rows, index range and repeats, distinct values of what must be one value, rows with a missing number."""
    bad = F.lit(False)
    for c in numeric:
        bad = bad | C.to_double(c).isNull()
    return catalogue.agg(
        F.count("*").alias("n_rows"), F.min(index).alias("first_index"), F.max(index).alias("last_index"),
        F.count_distinct(index).alias("n_distinct_index"), F.count_if(bad).alias("n_bad_numbers"),
        *[F.count_distinct(c).alias(f"n_{c}") for c in single_valued],
    ).withColumn(
        "index_is_dense", (F.col("first_index") == 0) & (F.col("last_index") == F.col("n_rows") - 1) & (F.col("n_distinct_index") == F.col("n_rows"))
    )


def require_catalogue(catalogue: DataFrame, index: str, single_valued: list[str], numeric: list[str]) -> None:
    row = catalogue_report(catalogue, index, single_valued, numeric).first()
    if not row["index_is_dense"]:
        raise ValueError("the index must be exactly 0..N-1")
    several = [c for c in single_valued if row[f"n_{c}"] != 1]
    if several:
        raise ValueError(f"more than one value of {several}")
    if row["n_bad_numbers"]:
        raise ValueError(f"{row['n_bad_numbers']} rows hold a non-finite number")


def run_report(summary: DataFrame, expected: int, lower: float, upper: float, latitude: str = "abs_b_deg") -> DataFrame:
    """Row count against the expected one and latitudes outside their bin (upper open, but closed at 90)."""
    eps = 1e-8
    b = F.col(latitude)
    above = (b > upper + eps) if upper >= 90.0 else (b >= upper + eps)
    return summary.agg(
        F.count("*").alias("n_rows"), F.count_if(b < lower - eps).alias("n_below"), F.count_if(above).alias("n_above"),
    ).withColumn("run_ok", (F.col("n_rows") == expected) & (F.col("n_below") == 0) & (F.col("n_above") == 0))
