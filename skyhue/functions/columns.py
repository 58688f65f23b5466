"""Scalar column expressions: cleaning, identifiers, photometry, sky coordinates."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, functions as F

# The six survey bands, blue to red.
BANDS = ("u", "g", "r", "i", "z", "y")

# Attenuation per unit E(B-V), by photometric system and band.
ATTENUATION = {
    "lsst": {
        "u": 4.757217815396922, "g": 3.6605664439892616, "r": 2.70136780871597,
        "i": 2.0536599130965882, "z": 1.5900964472616756, "y": 1.3077049588254708,
    },
    "ps1": {"g": 3.172, "r": 2.271, "i": 1.682, "z": 1.322, "y": 1.087},
}

# Row 3 of the equatorial to galactic rotation.
GALACTIC_Z = (-0.8676661490, -0.1980763734, 0.4559837762)

# Error-law gamma per band, and the broker's default depths.
ERROR_GAMMA = {"u": 0.038, "g": 0.039, "r": 0.039, "i": 0.039, "z": 0.039, "y": 0.039}
DEFAULT_DEPTH = {"u": 23.7, "g": 24.8, "r": 24.4, "i": 23.9, "z": 23.3, "y": 22.3}
SYSTEMATIC_ERROR_MAG = 0.005

# Words that stand for true and for a missing value.
TRUE_WORDS = ("1", "true", "yes", "y", "t")
MISSING_WORDS = ("", "nan", "none", "null")


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def finite(c) -> Column:
    """NaN and infinities become NULL; call it once, at the scan."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def to_double(c) -> Column:
    """Numeric coercion: text that is no number, NaN and infinities become NULL."""
    return finite(col(c).try_cast("double"))


def norm_text(c) -> Column:
    return F.lower(F.trim(col(c).cast("string")))


def norm_visit_band(c) -> Column:
    """``LSST_G`` or `` lsstg`` -> ``g``."""
    return F.right(F.regexp_replace(norm_text(c), "^lsst", ""), F.lit(1))


def id_plain(c) -> Column:
    """Whole numbers lose their leading zeros (``007`` -> ``7``), other ids are trimmed."""
    text = F.trim(col(c).cast("string"))
    number = F.regexp_replace(text, "^([+-]?)0*(\\d)", "$1$2")
    number = F.regexp_replace(number, "^\\+", "")
    return F.when(text.rlike("^[+-]?\\d+$"), F.when(number == "-0", F.lit("0")).otherwise(number)).otherwise(text)


def id_padded(c, width: int = 6) -> Column:
    """``7`` and ``7.0`` -> ``000007``; never shortens a longer number."""
    text = F.trim(col(c).cast("string"))
    digits = F.regexp_replace(F.regexp_extract(text, "^(\\d+)(\\.0+)?$", 1), "^0+(\\d)", "$1")
    padded = F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0"))
    return F.when(text.rlike("^\\d+(\\.0+)?$"), padded).otherwise(text)


def id_float_like(c) -> Column:
    """``7.0`` -> ``7``; empty, nan, none, null -> NULL."""
    text = F.trim(col(c).cast("string"))
    number = text.try_cast("double")
    whole = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < 1e18) & (number == F.floor(number))
    return (
        F.when(text.isNull() | F.lower(text).isin(*MISSING_WORDS), F.lit(None).cast("string"))
        .when(text.rlike("^[+-]?\\d+(\\.0*)?$"), id_plain(F.regexp_replace(text, "\\.0*$", "")))
        .when(whole, number.try_cast("bigint").cast("string"))
        .otherwise(text)
    )


def to_bool(c) -> Column:
    """Text flags 1, true, yes, y, t; NULL is false."""
    return F.coalesce(norm_text(c).isin(*TRUE_WORDS), F.lit(False))


def number_to_bool(c) -> Column:
    return F.coalesce(to_double(c) != 0, F.lit(False))


def first_finite(*columns) -> Column:
    return F.coalesce(*[to_double(c) for c in columns])


def percent(q) -> Column:
    """A quantile given as a fraction (``<= 1``) or a percentage, as a percentage."""
    q = col(q)
    return F.when(q <= 1, q * 100.0).otherwise(q)


def colour_pairs(text: str, bands=BANDS) -> list[tuple[str, str]]:
    """``"g-r,r-i"`` or ``"all"`` (every ordered pair, blue first)."""
    if text.strip().lower() == "all":
        return list(combinations(bands, 2))
    pairs = []
    for item in text.split(","):
        parts = [p.strip().lower() for p in item.replace("_", "-").split("-")]
        if len(parts) != 2 or parts[0] == parts[1] or not set(parts) <= set(bands):
            raise ValueError(f"not a colour: {item!r}")
        pairs.append((parts[0], parts[1]))
    return pairs


def galactic_latitude(ra_deg, dec_deg) -> Column:
    ra, dec = F.radians(col(ra_deg)), F.radians(col(dec_deg))
    z = (
        F.lit(GALACTIC_Z[0]) * F.cos(dec) * F.cos(ra)
        + F.lit(GALACTIC_Z[1]) * F.cos(dec) * F.sin(ra)
        + F.lit(GALACTIC_Z[2]) * F.sin(dec)
    )
    return F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z))))


def separation_deg(ra1, dec1, ra2, dec2) -> Column:
    """Great-circle distance (haversine form)."""
    d1, d2 = F.radians(col(dec1)), F.radians(col(dec2))
    half_dec = F.pow(F.sin((d2 - d1) / 2), 2)
    half_ra = F.pow(F.sin(F.radians(col(ra2) - col(ra1)) / 2), 2)
    h = F.greatest(F.lit(0.0), F.least(F.lit(1.0), half_dec + F.cos(d1) * F.cos(d2) * half_ra))
    return F.degrees(2 * F.asin(F.sqrt(h)))


def latitude_group(b_deg, threshold_deg: float) -> Column:
    """high / low, the boundary counts as high; NULL for an unusable latitude."""
    b = F.abs(to_double(b_deg))
    return F.when(b.isNull(), F.lit(None)).when(b >= threshold_deg, F.lit("high")).otherwise(F.lit("low"))


def distance_modulus(distance_mpc) -> Column:
    return 5 * F.log10(col(distance_mpc)) + 25


def observer_time(source_time, redshift) -> Column:
    return col(source_time) * (1 + col(redshift))


def source_time(observed_time, redshift) -> Column:
    return col(observed_time) / (1 + col(redshift))


def coefficient(system, band) -> Column:
    """Literal attenuation coefficient chosen by the system and band columns."""
    out = F.lit(None).cast("double")
    for name, table in ATTENUATION.items():
        for b, value in table.items():
            out = F.when((col(system) == name) & (col(band) == b), F.lit(value)).otherwise(out)
    return out


def attenuation(ebv, system, band, saved=None) -> Column:
    """R x E(B-V); a saved value wins; a negative or missing result is an error."""
    value = col(ebv) * coefficient(system, band)
    if saved is not None:
        value = F.coalesce(to_double(saved), value)
    return F.when(value >= 0, value).otherwise(
        F.raise_error(F.concat(F.lit("invalid attenuation in band "), col(band))).cast("double")
    )


def gamma_of(band) -> Column:
    return F.when(col(band) == "u", F.lit(ERROR_GAMMA["u"])).otherwise(F.lit(ERROR_GAMMA["g"]))


def magnitude_error(mag, m5, band, systematic: float = SYSTEMATIC_ERROR_MAG) -> Column:
    x = F.pow(F.lit(10.0), F.lit(0.4) * (col(mag) - col(m5)))
    g = gamma_of(band)
    return F.sqrt(F.lit(systematic * systematic) + (F.lit(0.04) - g) * x + g * x * x)


def relative_flux(mag) -> Column:
    return F.pow(F.lit(10.0), F.lit(-0.4) * col(mag))


def signal_to_noise(mag, m5) -> Column:
    """Five sigma at the depth."""
    return F.lit(5.0) * F.pow(F.lit(10.0), F.lit(-0.4) * (col(mag) - col(m5)))


def magnitude_of_flux(flux) -> Column:
    f = col(flux)
    return F.when(f > 0, F.lit(-2.5) * F.log10(f))


def colour(mag1, mag2) -> Column:
    return col(mag1) - col(mag2)


def colour_error(err1, err2) -> Column:
    return F.hypot(col(err1), col(err2))


def utc_to_mjd(text) -> Column:
    """UTC text to modified Julian date, whatever the session time zone is."""
    stamp = F.to_timestamp_ntz(F.regexp_replace(F.trim(col(text)), "Z$", ""))
    return F.lit(40587.0) + micros_since_epoch(stamp) / F.lit(86400e6)


def micros_since_epoch(ts) -> Column:
    """Microseconds of a zone-free timestamp, built from its fields so no time zone enters."""
    ts = col(ts)
    return (
        F.unix_date(F.to_date(ts)).cast("bigint") * F.lit(86_400_000_000)
        + F.hour(ts).cast("bigint") * F.lit(3_600_000_000)
        + F.minute(ts).cast("bigint") * F.lit(60_000_000)
        + (F.extract(F.lit("SECOND"), ts) * F.lit(1_000_000)).cast("bigint")
    )


def percentile_label(q) -> Column:
    """0.5 -> p0p5, 16 -> p16."""
    text = F.format_string("%.6f", col(q).cast("double"))
    text = F.regexp_replace(F.regexp_replace(text, "0+$", ""), "\\.$", "")
    return F.concat(F.lit("p"), F.replace(text, F.lit("."), F.lit("p")))


def candidate_id(object_id, sequence, width: int = 4) -> Column:
    """0007_3; the width grows with the largest id but never cuts one."""
    text = col(object_id).cast("string")
    return F.concat(F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0")), F.lit("_"), col(sequence).cast("string"))


def survey_candidate_id(object_id, sequence, survey: str = "LSST", width: int = 4) -> Column:
    """0007_LSST_000003."""
    text = col(object_id).cast("string")
    head = F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))
    return F.concat(head, F.lit(f"_{survey}_"), F.lpad(col(sequence).cast("string"), 6, "0"))


def slug(text) -> Column:
    kept = F.regexp_replace(norm_text(text), "[^a-z0-9]+", "_")
    return F.regexp_replace(kept, "^_+|_+$", "")


def error_flag(message: str) -> Column:
    return F.raise_error(F.lit(message))
