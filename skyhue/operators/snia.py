"""A second population (SN Ia) brought to the same times and sky as the first."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skyhue.operators import curves, ranks, series


def sky_mapping(sn: DataFrame, pool: DataFrame, seed: int, sn_id: str = "sn_id") -> DataFrame:
    """Each object gets a pool position: the pool in hash order, re-used from the start if it is short.

    sn: one row per object; pool: event_id, fieldRA, fieldDec.
    """
    usable = pool.where("fieldRA IS NOT NULL AND fieldDec IS NOT NULL").select("event_id", "fieldRA", "fieldDec")
    places = ranks.hash_rank(usable, "event_id", seed, "place")
    total = usable.agg(F.count("*").alias("n_pool"))
    here = ranks.id_rank(sn.select(sn_id), sn_id, "position").crossJoin(F.broadcast(total))
    slots = here.withColumn("place", F.pmod(F.col("position") - 1, F.col("n_pool")) + 1)
    return slots.join(places, "place").select(
        sn_id, F.col("event_id").alias("projected_event_id"), "fieldRA", "fieldDec", (F.col("position") > F.col("n_pool")).alias("reused"),
    )


def adapt(
    rows: DataFrame, mapping: DataFrame | None, reference: str = "first_observation", peak_band: str = "r",
    prominence: float = 0.05, sn_id: str = "sn_id",
) -> DataFrame:
    """Rows sn_id, mjd, band, mag[, t0] as light curves in days since the first observation, the band peak or the given t0."""
    if reference == "first_observation":
        d = series.key_totals(rows, [sn_id], t_ref=F.min("mjd"))
    elif reference == "band_peak":
        p = curves.peaks(rows.where(F.col("band") == peak_band), [sn_id], "mjd", "mag", prominence)
        d = rows.join(p.where("peak_used").select(sn_id, F.col("peak_time").alias("t_ref")), sn_id)
    elif reference == "t0":
        d = rows.where("t0 IS NOT NULL").withColumn("t_ref", F.col("t0"))
    else:
        raise ValueError("reference is first_observation, band_peak or t0")
    d = d.withColumn("t_days", F.col("mjd") - F.col("t_ref"))
    if reference == "first_observation":
        d = d.where("t_days >= 0")
    if mapping is not None:
        d = d.join(mapping.select(sn_id, "projected_event_id", "fieldRA", "fieldDec"), sn_id, "left")
    return d.withColumns({"event_id": F.col(sn_id), "photometric_system": F.lit("lsst")})


def interpolation_rule(reference: str) -> str:
    """Measured references use linear phase, a model's t0 logarithmic time."""
    return "log" if reference == "t0" else "linear"
