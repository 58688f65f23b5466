"""The driver's tables read as the library's inputs: light curves, objects, visits, fields, depths.

Only the mapping of columns lives here; every query over these roles runs on the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skyhue.functions import checks, columns as C
from skyhue.operators import survey
from skyhue.operators.grid import TimeGrid

GRID = TimeGrid(0.4, 26.0, 0.4)
EPOCH_MICROS = 1_704_067_200_000_000  # 2024-01-01
BAND_OF_EVENT = {"view": "g", "click": "r", "purchase": "i", "signup": "z", "error": "y"}
BAND_OF_FLAG = {"A": "g", "N": "r", "R": "i"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lightcurves(spark: SparkSession, sf: str, bands=None) -> DataFrame:
    """All points, or those of some bands; the band filter is put on the stored column, so the scan applies it."""
    events = table(spark, sf, "events")
    if bands:
        events = events.where(F.col("event_type").isin([k for k, v in BAND_OF_EVENT.items() if v in bands]))
    band = F.create_map(*[F.lit(x) for kv in BAND_OF_EVENT.items() for x in kv])[F.col("event_type")]
    return events.select(
        F.col("user_id").alias("event_id"), F.lit("lsst").alias("photometric_system"), band.alias("band"),
        ((C.micros_since_epoch("ts") - F.lit(EPOCH_MICROS)) / F.lit(86400e6)).alias("t_days"),
        C.finite("value").alias("mag"), F.col("event_id").alias("row_id"),
    )


def dual_lightcurves(spark: SparkSession, sf: str, bands=None) -> DataFrame:
    """Each point in two systems; the second is fainter by a band term."""
    lc = lightcurves(spark, sf, bands)
    other = lc.withColumn("photometric_system", F.lit("ps1")).withColumn(
        "mag", F.col("mag") + F.when(F.col("band") == "g", F.lit(0.25)).otherwise(F.lit(0.1))
    )
    return lc.unionByName(other)


def objects(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        key.alias("event_id"),
        F.col("c_mktsegment").alias("population"),
        (F.lit(0.01) + (F.col("c_acctbal") + 1000) / 110000).alias("redshift"),
        (F.lit(40.0) + F.col("c_acctbal") / 50 + 20).alias("luminosity_distance"),
        F.pmod(key * 37, F.lit(91)).cast("double").alias("abs_b_deg"),
        (F.pmod(key * 13, F.lit(50)) / 100.0).alias("ebv_mw"),
        (F.lit(-3.0) + F.pmod(key * 7, F.lit(200)) / 100.0).alias("log10_mej_dyn"),
        (F.lit(-2.5) + F.col("c_acctbal") / 8000).alias("log10_mej_wind"),
        (F.pmod(key * 11, F.lit(157)) / 100.0).alias("inclination_EM"),
        F.pmod(key * 17, F.lit(90)).cast("double").alias("phi"),
    )


def visits(spark: SparkSession, sf: str, bands=None) -> DataFrame:
    items = table(spark, sf, "lineitem")
    if bands:
        items = items.where(F.col("l_returnflag").isin([k for k, v in BAND_OF_FLAG.items() if v in bands]))
    band = F.create_map(*[F.lit(x) for kv in BAND_OF_FLAG.items() for x in kv])[F.col("l_returnflag")]
    return items.select(
        F.col("l_suppkey").alias("field_index"),
        (F.lit(40587.0) + C.micros_since_epoch("l_shipdate") / F.lit(86400e6) + F.col("l_linenumber") / F.lit(16.0)).alias("MJD"),
        band.alias("band"),
        (F.lit(20.0) + F.col("l_discount") * 50 + F.col("l_tax")).alias("m5"),
    )


def fields(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("target_name"))
    return table(spark, sf, "supplier").join(nation, "s_nationkey").select(
        F.col("s_suppkey").alias("field_index"),
        F.pmod(F.col("s_suppkey") * 7, F.lit(360)).cast("double").alias("ra0_deg"),
        (F.col("s_acctbal") / 200 - 20).alias("dec0_deg"),
        "target_name",
        (F.pmod(F.col("s_suppkey") * 3, F.lit(40)) / 100.0).alias("ebv_mw"),
    )


def observations(spark: SparkSession, sf: str) -> DataFrame:
    """Visits with a pointing of their own, near their field."""
    f = fields(spark, sf)
    item = table(spark, sf, "lineitem")
    band = F.create_map(*[F.lit(x) for kv in BAND_OF_FLAG.items() for x in kv])[F.col("l_returnflag")]
    v = item.select(
        F.col("l_suppkey").alias("field_index"),
        (F.lit(40587.0) + C.micros_since_epoch("l_shipdate") / F.lit(86400e6)).alias("observationStartMJD"),
        band.alias("band"),
        (F.lit(20.0) + F.col("l_discount") * 50 + F.col("l_tax")).alias("fiveSigmaDepth"),
        (F.col("l_linenumber") / 4.0).alias("d_ra"), (F.col("l_quantity") / 40.0).alias("d_dec"),
    )
    return v.join(f, "field_index").select(
        "observationStartMJD", "band", "fiveSigmaDepth",
        F.pmod(F.col("ra0_deg") + F.col("d_ra"), F.lit(360.0)).alias("fieldRA"),
        (F.col("dec0_deg") + F.col("d_dec")).alias("fieldDec"), "target_name",
    )


def depths(spark: SparkSession, sf: str, bands=("g", "r")) -> dict[str, float]:
    """Median depth of the requested bands over all visits: a few numbers, checked to be complete."""
    return checks.require_bands(survey.resolve_depths(None, visits(spark, sf, bands), 50.0, bands), bands)


def snia(spark: SparkSession, sf: str) -> DataFrame:
    """Second population: the same points as epochs of eight hours with an error that is zero for some rows."""
    lc = lightcurves(spark, sf)
    return lc.select(
        F.col("event_id").alias("sn_id"), (F.lit(60310.0) + F.floor(F.col("t_days") * 3) / 3).alias("mjd"), "band", "mag",
        (F.pmod("row_id", F.lit(10)) / 10.0).alias("magerr"), "row_id",
    )


def photometry(spark: SparkSession, sf: str) -> DataFrame:
    """Points with a magnitude error and an observing time."""
    return lightcurves(spark, sf).withColumns({
        "mag_err": F.lit(0.02) + F.pmod("row_id", F.lit(7)) / 100.0, "time_mjd": F.lit(60310.0) + F.col("t_days"),
    })
