"""Row and object selections: validity, latitude, depth, detection, membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skyhue.functions import checks, columns as C
from skyhue.operators.curves import trim_after_last


def snia_faults(rows: DataFrame, bands) -> dict[str, Column]:
    """What makes a row unusable, by cause: id, time, magnitude, error, position (where the table has one) or band."""
    finite = lambda c: C.to_double(c).isNotNull() & (F.abs(C.to_double(c)) < float("inf"))
    good = {"id": finite("sn_id"), "time": finite("mjd"), "magnitude": finite("mag"), "error": finite("magerr") & (C.to_double("magerr") > 0), "band": C.norm_text("band").isin(*bands)}
    place = [c for c in ("ra", "dec") if c in rows.columns]
    if place:
        good["position"] = F.lit(True)
        for c in place:
            good["position"] &= finite(c)
    return {cause: ~F.coalesce(ok, F.lit(False)) for cause, ok in good.items()}


def usable_snia(rows: DataFrame, bands) -> DataFrame:
    """Rows without a fault. Of these, an id that isn't a whole number (within rounding) stops the query; it is no fault to be dropped."""
    bad = F.lit(False)
    for fault in snia_faults(rows, bands).values():
        bad |= fault
    number = C.to_double("sn_id")
    whole = F.when(F.abs(number - F.rint(number)) <= 1e-8 + 1e-5 * F.abs(F.rint(number)), F.rint(number).cast("long"))
    return rows.where(~bad).withColumn("sn_id", F.coalesce(whole, F.raise_error(F.lit("sn_id must hold whole numbers")).cast("long")))


def snia_quality(rows: DataFrame, bands) -> DataFrame:
    """Rows, rows kept and rejected, and the rejected by cause; a row may have several."""
    faults = snia_faults(rows, bands)
    bad = F.lit(False)
    for fault in faults.values():
        bad |= fault
    return rows.agg(F.count("*").alias("n_rows"), F.count_if(~bad).alias("n_kept"), F.count_if(bad).alias("n_rejected"), *(F.count_if(f).alias(f"n_bad_{c}") for c, f in sorted(faults.items())))


def latitude_cut(mode: str, lo: float = 20.0, hi: float = 90.0, latitude="abs_b_deg") -> Column:
    """all; high ``>= lo``; low ``< lo``; bin ``[lo, hi)``, closed where hi is 90."""
    b = F.abs(C.col(latitude))
    if mode == "all":
        return F.lit(True)
    if mode == "high":
        return b >= lo
    if mode == "low":
        return b < lo
    if mode == "bin":
        return (b >= lo) & ((b <= hi) if hi >= 90.0 else (b < hi))
    raise ValueError("mode is all, high, low or bin")


def detect_or_limit(rows: DataFrame, depths: dict[str, float]) -> DataFrame:
    """Rows fainter than their band's depth become limits: mag NULL, mag_err = depth."""
    m5 = F.lit(None).cast("double")
    for band, value in depths.items():
        m5 = F.when(F.col("band") == band, F.lit(float(value))).otherwise(m5)
    d = rows.withColumn("m5", m5).withColumn("detected", F.col("mag") <= F.col("m5"))
    return d.withColumns({
        "mag_err": F.when(F.col("detected"), F.col("mag_err")).otherwise(F.col("m5")),
        "mag": F.when(F.col("detected"), F.col("mag")),
    })


def within_band_depth(rows: DataFrame, depths: DataFrame) -> DataFrame:
    """Points within the depth of their band; bands without a depth are dropped. depths: one row per survey band."""
    return rows.join(depths.select("band", "m5"), "band").where(F.col("mag") <= F.col("m5"))


def export_mode(rows: DataFrame, mode: str) -> DataFrame:
    if mode == "complete":
        return rows
    if mode == "m5-detected":
        return rows.where(F.col("mag") <= F.col("m5"))
    raise ValueError("mode is 'complete' or 'm5-detected'")


def usable_photometry(columns: list[str], time="time_mjd", band="band", mag="mag", mag_error="mag_err", flux="flux", flux_error="flux_err") -> Column:
    """Finite time and a band where those columns exist, and a magnitude or a flux (with a positive error where one exists)."""
    def value_ok(v, e):
        if v not in columns:
            return F.lit(False)
        ok = C.to_double(v).isNotNull()
        return ok & (C.to_double(e) > 0) if e in columns else ok
    t = C.to_double(time).isNotNull() if time in columns else F.lit(True)
    b = (F.trim(F.col(band).cast("string")) != "") if band in columns else F.lit(True)
    return F.coalesce(t & b & (value_ok(mag, mag_error) | value_ok(flux, flux_error)), F.lit(False))


def sky_quality(rows: DataFrame, ra: str, dec: str, ebv: str | None = None) -> DataFrame:
    """Counts of unusable sky positions and extinctions."""
    aggs = [
        F.count("*").alias("n_rows"),
        F.count_if(C.to_double(ra).isNull() | C.to_double(dec).isNull()).alias("n_not_finite"),
        F.count_if(F.abs(C.to_double(dec)) > 90).alias("n_bad_dec"),
    ]
    if ebv:
        aggs.append(F.count_if(C.to_double(ebv).isNull() | (C.to_double(ebv) < 0)).alias("n_bad_ebv"))
    return rows.agg(*aggs)


def checked_sky(rows: DataFrame, ra: str, dec: str, ebv: str | None = None) -> DataFrame:
    """The rows with right ascension, declination and extinction as numbers, the first folded into [0, 360). A position that isn't finite, a declination
    outside +-90 or an extinction that is negative or not finite stops the query."""
    finite = lambda c: C.to_double(c).isNotNull() & (F.abs(C.to_double(c)) < float("inf"))
    d = checks.guard_rows(rows, finite(ra) & finite(dec), "sky positions must be finite")
    d = checks.guard_rows(d, F.abs(C.to_double(dec)) <= 90, F.concat(F.lit("declination outside [-90, 90]: "), F.col(dec).cast("string")))
    if ebv:
        d = checks.guard_rows(d, finite(ebv) & (C.to_double(ebv) >= 0), F.concat(F.lit("E(B-V) must be finite and not negative: "), F.coalesce(F.col(ebv).cast("string"), F.lit("null"))))
    out = {ra: F.pmod(C.to_double(ra), F.lit(360.0)), dec: C.to_double(dec)}
    return d.withColumns(out | ({ebv: C.to_double(ebv)} if ebv else {}))


def with_parameters(objects: DataFrame, required: list[str], optional: list[str] = (), key: str = "event_id", tie: list[str] = ()) -> DataFrame:
    """First row per key, objects lacking a required number dropped, absent optional numbers added as NULL."""
    have = objects.columns
    missing = [c for c in required if c not in have]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    rest = [c for c in have if c != key]
    order = F.struct(*(tie or rest))
    d = objects.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(key, "r.*")
    d = d.withColumns({c: C.to_double(c) if c in have else F.lit(None).cast("double") for c in [*required, *optional]})
    return d.dropna(subset=list(required))


def in_every_band(rows: DataFrame, key: str, bands: list[str]) -> DataFrame:
    """Keys with at least one row in each band."""
    n = rows.where(F.col("band").isin(bands)).groupBy(key).agg(F.count_distinct("band").alias("n"))
    return n.where(F.col("n") == len(bands)).select(key)


def per_event_detections(rows: DataFrame, detected: Column, minimum: int = 0, t: str = "t_days") -> DataFrame:
    """Detection counts and first and last times per event; events below a minimum are dropped."""
    return rows.groupBy("event_id").agg(
        F.count("*").alias("n_rows"), F.count_if(detected).alias("n_detected"), F.bool_or(detected).alias("any_detected"),
        F.min(F.when(detected, F.col(t))).alias("first_detection_days"), F.max(F.when(detected, F.col(t))).alias("last_detection_days"),
        F.min(F.when(~detected, F.col(t))).alias("first_non_detection_days"),
    ).where(F.col("n_detected") >= minimum)


__all__ = [n for n in dir() if not n.startswith("_")]
