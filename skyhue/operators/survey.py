"""Survey pointing tables: selections, centres, sampling, coverage, depth and cadence summaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from skyhue.functions import checks, columns as C
from skyhue.operators import curves, ranks, skew
from skyhue.operators.grid import interval_join
from skyhue.operators.quantiles import exact_quantiles
from skyhue.sources import readers

# Depth scenarios as percentiles.
SCENARIOS = {"worst_p25": 25.0, "median_p50": 50.0, "best_p75": 75.0}
SKY_DEG2 = 41253.0
SUMMARY_PERCENTS = (1, 5, 16, 50, 84, 95, 99)


def selection(mode: str, name: str | None = None) -> tuple[Column, str]:
    """Predicate and label of one of the six target selections."""
    target = F.upper(F.col("target_name"))
    is_deep = F.instr(target, "DDF") > 0
    mode = mode.upper()
    if mode == "ALL_SURVEY":
        return F.lit(True), "all_survey"
    if mode == "ALL_DDF":
        return is_deep, "all_ddf"
    if mode == "ALL_NON_DDF":
        return F.instr(target, "DDF") == 0, "all_non_ddf"
    if mode == "LOWDUST":
        return F.col("target_name") == "lowdust", "lowdust"
    if mode in ("ONE_DDF", "TARGET"):
        if not name:
            raise ValueError(f"{mode} needs a name")
        label = "_".join("".join(ch if ch.isalnum() and ch.isascii() else " " for ch in name.lower()).split())
        if mode == "ONE_DDF":
            return is_deep & (F.instr(target, name.upper()) > 0), label
        return F.col("target_name") == name, label
    raise ValueError(f"unknown selection mode {mode!r}")


def target_counts(obs: DataFrame, top: int | None = None) -> DataFrame:
    out = obs.groupBy("target_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "target_name")
    return out.limit(top) if top else out


def centres(obs: DataFrame) -> DataFrame:
    """Unique centres with the names that point at them."""
    names = obs.groupBy("fieldRA", "fieldDec", "target_name").agg(F.count("*").alias("n"))
    return names.groupBy("fieldRA", "fieldDec").agg(
        F.array_join(F.array_sort(F.collect_set("target_name")), ",").alias("target_name"),
        F.count("target_name").alias("n_target_names"),
    )


def centres_by_target(obs: DataFrame) -> DataFrame:
    return obs.groupBy("target_name", "fieldRA", "fieldDec").agg(F.count("*").alias("n_obs_center"))


def strata(by_target: DataFrame) -> DataFrame:
    return by_target.groupBy("target_name").agg(
        F.count("*").alias("n_centers"), F.sum("n_obs_center").alias("n_obs")
    )


def allocate(strata_df: DataFrame, total: int, weight: str = "n_centers", minimum: int = 1) -> DataFrame:
    """Largest-remainder allocation over strata (a table of target names), clipped to the capacity last."""
    everything = W.partitionBy(F.lit(0))
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
    heaviest = F.row_number().over(everything.orderBy(F.desc("__w"), "target_name"))
    d = strata_df.withColumn("__w", w).withColumns({
        "__n": F.count("*").over(everything), "__sum": F.sum("__w").over(everything), "__heavy": heaviest,
    })
    left = F.lit(total) - F.col("__n") * minimum
    share = F.when(F.col("__sum") > 0, F.col("__w") / F.col("__sum")).otherwise(F.lit(1.0) / F.col("__n"))
    d = d.withColumn("__raw", F.greatest(left, F.lit(0)) * share).withColumn("__floor", F.floor("__raw"))
    d = d.withColumn("__rest", F.greatest(left, F.lit(0)) - F.sum("__floor").over(everything))
    by_remainder = F.row_number().over(everything.orderBy(F.desc(F.col("__raw") - F.col("__floor")), F.desc("__w"), "target_name"))
    d = d.withColumn("__order", by_remainder)
    few = (F.lit(total) < F.col("__n")) | (left < 0)
    given = F.when(F.lit(total <= 0), F.lit(0)).when(few, (F.col("__heavy") <= total).cast("bigint")).otherwise(
        F.lit(minimum) + F.col("__floor") + (F.col("__order") <= F.col("__rest")).cast("bigint")
    )
    keep = strata_df.columns
    return d.select(*keep, F.least(given, F.col("n_centers")).cast("bigint").alias("n_alloc"))


def _centre_key() -> Column:
    return F.concat_ws("/", F.format_string("%.6f", F.col("fieldRA")), F.format_string("%.6f", F.col("fieldDec")))


def sample_uniform(obs: DataFrame, n_fields: int, seed: int) -> DataFrame:
    """``n_fields`` distinct centres by hash rank. With fewer centres than fields the ranking is repeated."""
    c = centres(obs).withColumn("__key", _centre_key())
    ranked = ranks.hash_rank(c, "__key", seed).drop("__key")
    total = ranked.agg(F.count("*").alias("__total"))
    # row `rank` serves draws rank, rank + total, rank + 2 total, ... up to n_fields
    return (
        ranked.crossJoin(F.broadcast(total)).where(F.col("rank") <= n_fields)
        .withColumn("draw", F.explode(F.sequence(F.col("rank"), F.lit(n_fields).cast("bigint"), F.col("__total"))))
        .drop("__total")
    )


def sample_stratified(obs: DataFrame, n_fields: int, seed: int, weight: str = "n_centers", minimum: int = 1):
    """(sampled centres, report per stratum): allocate, sample in each stratum, dedupe, top up from the rest."""
    by_target = centres_by_target(obs)
    allocation = allocate(strata(by_target), n_fields, weight, minimum)
    keyed = by_target.withColumn("__key", _centre_key())
    ranked = ranks.hash_rank(keyed, "__key", seed, "rank", ("target_name",))
    drawn = ranked.join(allocation.select("target_name", "n_alloc"), "target_name").where("rank <= n_alloc")
    parent = centres(obs)
    unique = drawn.select("fieldRA", "fieldDec").distinct().withColumn("source", F.lit("stratum"))
    chosen = parent.join(unique, ["fieldRA", "fieldDec"])
    rest = parent.join(unique, ["fieldRA", "fieldDec"], "left_anti").withColumn("__key", _centre_key())
    missing = unique.agg((F.lit(n_fields) - F.count("*")).alias("__missing"))
    top_up = (
        ranks.hash_rank(rest, "__key", seed).crossJoin(F.broadcast(missing)).where("rank <= __missing")
        .select(*parent.columns, F.lit("top_up").alias("source"))
    )
    sampled = chosen.unionByName(top_up)
    report = allocation.join(
        drawn.groupBy("target_name").agg(F.count("*").alias("n_sampled")), "target_name", "left"
    ).withColumn("n_sampled", F.coalesce("n_sampled", F.lit(0).cast("bigint")))
    return sampled, report


def cone_join(fields: DataFrame, visits: DataFrame, radius_deg: float, rows_per_part: int = skew.ROWS) -> DataFrame:
    """Every field with the visits whose centre lies within ``radius_deg``.

    Sky zones of one radius in declination, cut into cells in right ascension that are at least as wide as the
    radius at that declination. A field is copied to its 3 x 3 cells, a visit to one, and the join is an equi-join
    on the cell followed by the exact separation. The visits of a crowded cell, a deep field's, are dealt to several parts (``skew.split_join``).
    fields: field_index, ra0_deg, dec0_deg; visits: fieldRA, fieldDec, ...
    """
    r = F.lit(float(radius_deg))
    s = math.sin(math.radians(radius_deg) / 2)

    def n_cells(zone: Column) -> Column:
        far = F.greatest(F.abs(zone * r), F.abs((zone + 1) * r)) + r
        c = F.cos(F.radians(far))
        reach = F.when((far < 89.9) & (F.lit(s) < c), F.degrees(2 * F.asin(F.lit(s) / c))).otherwise(F.lit(360.0))
        return F.greatest(F.lit(1), F.floor(F.lit(360.0) / (reach * 1.000001)).cast("int"))

    def cell(ra: Column, n: Column) -> Column:
        return F.least(n - 1, F.floor(F.pmod(ra, F.lit(360.0)) / 360.0 * n).cast("int"))

    zone_of = lambda dec: F.floor(F.col(dec) / r).cast("int")
    f = fields.withColumn("__zone", F.explode(F.transform(
        F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: zone_of("dec0_deg") + d
    )))
    f = f.withColumn("__n", n_cells(F.col("__zone"))).withColumn("__c", cell(F.col("ra0_deg"), F.col("__n")))
    f = f.withColumn("__cell", F.explode(F.array_distinct(F.transform(
        F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(F.col("__c") + d, F.col("__n"))
    )))).drop("__c", "__n")
    v = visits.withColumn("__zone", zone_of("fieldDec")).withColumn("__cell", cell(F.col("fieldRA"), n_cells(F.col("__zone"))))
    return (
        skew.split_join(v, f, ["__zone", "__cell"], rows_per_part)
        .withColumn("separation_deg", C.separation_deg("ra0_deg", "dec0_deg", "fieldRA", "fieldDec"))
        .where(F.col("separation_deg") <= r).drop("__zone", "__cell")
    )


def depth_quantiles(visits: DataFrame, field_groups: DataFrame | None, threshold_deg: float = 20.0) -> DataFrame:
    """Depth percentiles per band, over all visits and per latitude group of their field.

    visits: field_index, band, m5; field_groups: field_index, latitude_group (every field must have one).
    """
    d = visits.where(F.col("m5").isNotNull()).select("field_index", "band", "m5")
    both = F.struct(F.lit("common_global").alias("threshold_scope"), F.lit("both").alias("threshold_latitude_group"))
    if field_groups is None:
        d = d.withColumn("__s", both)
    else:
        d = d.join(field_groups.select("field_index", "latitude_group"), "field_index", "left")
        own = F.struct(
            F.lit("latitude_conditioned").alias("threshold_scope"),
            F.coalesce("latitude_group", F.raise_error(F.lit("a visited field has no latitude group")).cast("string"))
            .alias("threshold_latitude_group"),
        )
        d = d.withColumn("__s", F.explode(F.array(both, own)))
    d = d.select("__s.*", "band", "m5")
    keys = ["threshold_scope", "threshold_latitude_group", "band"]
    q = exact_quantiles(d, keys, "m5", list(SCENARIOS.values()), "select", "N_visits", "q")
    rows = F.array(*[
        F.struct(F.lit(name).alias("scenario"), F.lit(p / 100.0).alias("quantile"), F.col("q")[i].alias("m5"))
        for i, (name, p) in enumerate(SCENARIOS.items())
    ])
    return q.select(*keys, "N_visits", F.explode(rows).alias("s")).select(
        *keys, "s.*", "N_visits",
        F.when(F.col("threshold_scope") != "common_global", F.lit(threshold_deg)).alias("latitude_threshold_deg"),
    )


def depth_summary(visits: DataFrame, percentile: float = 50.0) -> DataFrame:
    """Per band: count, moments, range, seven percentiles and the threshold percentile."""
    d = visits.where(F.col("m5").isNotNull())
    moments = d.groupBy("band").agg(
        F.avg("m5").alias("mean"), F.stddev_samp("m5").alias("std"), F.min("m5").alias("min"), F.max("m5").alias("max"),
    )
    q = exact_quantiles(d, ["band"], "m5", [*SUMMARY_PERCENTS, percentile], "select", "N_visits", "q")
    return moments.join(q, "band").select(
        "band", "N_visits", "mean", "std", "min", "max", F.col("q")[SUMMARY_PERCENTS.index(50)].alias("median"),
        *[F.col("q")[i].alias(f"p{p}") for i, p in enumerate(SUMMARY_PERCENTS)],
        F.col("q")[len(SUMMARY_PERCENTS)].alias("m5_threshold"),
    )


def band_medians(visits: DataFrame, bands=C.BANDS) -> DataFrame:
    """Median depth and rows of every band of the survey, also of bands without visits."""
    q = exact_quantiles(visits, ["band"], "m5", [50.0], "select", "N_exported_visit_rows", "q")
    all_bands = visits.sparkSession.createDataFrame([(b,) for b in bands], "band string")
    return all_bands.join(q, "band", "left").select(
        "band", F.col("q")[0].alias("m5_median"),
        F.coalesce("N_exported_visit_rows", F.lit(0)).cast("bigint").alias("N_exported_visit_rows"),
    )


def depth_spread(visits: DataFrame, percents=(16.0, 25.0, 50.0, 75.0, 84.0)) -> DataFrame:
    """Percentiles of bands with at least two values."""
    q = exact_quantiles(visits, ["band"], "m5", list(percents), "select", "n", "q").where("n >= 2")
    return q.select("band", "n", *[F.col("q")[i].alias(f"p{int(p)}") for i, p in enumerate(percents)])


def time_span(obs: DataFrame, t: str = "observationStartMJD") -> DataFrame:
    return obs.agg(F.min(t).alias("mjd_min"), F.max(t).alias("mjd_max"), F.count("*").alias("n_visits")).select(
        "mjd_min", "mjd_max", (F.col("mjd_max") - F.col("mjd_min")).alias("span_days"),
        ((F.col("mjd_max") - F.col("mjd_min")) / 365.25).alias("span_years"), "n_visits",
    )


def field_index(fields: DataFrame, visits: DataFrame, bands=C.BANDS) -> DataFrame:
    """Fields with visit counts and spans (fields without visits stay), and attenuation per band."""
    spans = visits.groupBy("field_index").agg(
        F.count("*").alias("Nvisits"), F.min("MJD").alias("field_mjd_min"), F.max("MJD").alias("field_mjd_max")
    )
    out = fields.join(spans, "field_index", "left").withColumns({
        "Nvisits": F.coalesce("Nvisits", F.lit(0).cast("bigint")),
        "field_span_days": F.col("field_mjd_max") - F.col("field_mjd_min"),
    })
    return out.withColumn("field_span_years", F.col("field_span_days") / 365.25).withColumns(
        {f"A_{b}_mw": F.col("ebv_mw") * F.lit(C.ATTENUATION["lsst"][b]) for b in bands}
    )


def _medians(df: DataFrame, keys: list[str], names: dict[str, str]) -> DataFrame:
    """Medians of several columns for each key, from one pass that holds no group: keys, and the columns under their new names."""
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(new).alias("name"), F.col(c).cast("double").alias("value")) for c, new in names.items()])).alias("x")).select(*keys, "x.*")
    m = exact_quantiles(long, [*keys, "name"], "value", [50.0])
    return m.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == new, F.col("quantiles")[0])).alias(new) for new in names.values()])


def survey_summary(index: DataFrame, medians: DataFrame, parent: DataFrame, bands=C.BANDS) -> DataFrame:
    """One row over fields, band medians and the parent selection; all three are small aggregates."""
    f = index.agg(
        F.count("*").alias("N_fields_exported"),
        F.min("field_mjd_min").alias("exported_mjd_min"), F.max("field_mjd_max").alias("exported_mjd_max"),
        F.avg("field_span_years").alias("mean_field_span_years"),
        F.min("ebv_mw").alias("exported_ebv_mw_min"), F.max("ebv_mw").alias("exported_ebv_mw_max"),
    ).crossJoin(_medians(index, [], {"field_span_years": "median_field_span_years", "ebv_mw": "exported_ebv_mw_median"})).withColumn("exported_span_days", F.col("exported_mjd_max") - F.col("exported_mjd_min"))
    m = medians.agg(*[F.max(F.when(F.col("band") == b, F.col("m5_median"))).alias(f"m5_median_{b}") for b in bands])
    p = time_span(parent)
    p = p.select(*[F.col(c).alias(f"parent_{c}") for c in p.columns])
    return f.crossJoin(m).crossJoin(p)


def revisit_gaps(visits: DataFrame, t: str = "MJD", chunk_days: float = 30.0) -> DataFrame:
    return curves.gaps(visits, ["field_index", "band"], t, chunk_days)


def gap_histogram(gaps: DataFrame, bins: int, logarithmic: bool = False, gap: str = "gap_days") -> DataFrame:
    """Counts per band and bin between that band's smallest and largest gap; the last bin is closed."""
    d = gaps.where(F.col(gap) > 0) if logarithmic else gaps.where(F.col(gap).isNotNull())
    x = F.log10(gap) if logarithmic else F.col(gap)
    d = d.select("band", x.alias("__x"))
    ends = d.groupBy("band").agg(F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / bins
    i = F.when(width > 0, F.least(F.floor((F.col("__x") - F.col("__lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    return d.join(ends, "band").groupBy("band", i.cast("int").alias("bin_index")).agg(
        F.count("*").alias("n"), F.first("__lo").alias("x_min"), F.first("__hi").alias("x_max")
    )


def field_summary(visits: DataFrame, keys=("field_index",)) -> DataFrame:
    """Median pointing and the first non-NULL target name (in time order) of each field."""
    named = visits.groupBy(*keys).agg(
        F.min_by("target_name", F.when(F.col("target_name").isNotNull(), F.struct("observationStartMJD", "target_name"))).alias("target_name"),
        F.count("*").alias("n_visits"),
    )
    return named.join(_medians(visits, list(keys), {"fieldRA": "fieldRA", "fieldDec": "fieldDec"}), list(keys), "left").select(*keys, "fieldRA", "fieldDec", "target_name", "n_visits")


def sky_area(positions: DataFrame, radius_deg: float, n_ra: int = 720, n_z: int = 360) -> DataFrame:
    """Area of the union of discs: distinct covered equal-area cells (RA x sin Dec), tested at the cell centre.

    A field is copied only to the cells of its own bounding box.
    """
    r = float(radius_deg)
    dec_lo = F.greatest(F.lit(-90.0), F.col("dec0_deg") - r)
    dec_hi = F.least(F.lit(90.0), F.col("dec0_deg") + r)
    row = lambda dec: F.greatest(F.lit(0), F.least(F.lit(n_z - 1), F.floor((F.sin(F.radians(dec)) + 1) / 2 * n_z).cast("int")))
    far = F.greatest(F.abs(dec_lo), F.abs(dec_hi))
    c = F.cos(F.radians(far))
    s = math.sin(math.radians(r) / 2)
    half = F.when((far < 89.9) & (F.lit(s) < c), F.degrees(2 * F.asin(F.lit(s) / c))).otherwise(F.lit(180.0))
    span = F.least(F.lit(n_ra // 2), F.ceil(half / 360.0 * n_ra).cast("int") + 1)
    own = F.floor(F.pmod("ra0_deg", F.lit(360.0)) / 360.0 * n_ra).cast("int")
    boxes = positions.where("ra0_deg IS NOT NULL AND dec0_deg IS NOT NULL").select(
        "ra0_deg", "dec0_deg", F.explode(F.sequence(row(dec_lo), row(dec_hi))).alias("iz"), own.alias("own"), span.alias("span")
    ).withColumn("d", F.explode(F.sequence(-F.col("span"), F.col("span")))).withColumn("ir", F.pmod(F.col("own") + F.col("d"), F.lit(n_ra)))
    ra = (F.col("ir") + 0.5) * F.lit(360.0 / n_ra)
    dec = F.degrees(F.asin((F.col("iz") + 0.5) * F.lit(2.0 / n_z) - 1))
    covered = boxes.where(C.separation_deg("ra0_deg", "dec0_deg", ra, dec) <= r).select("ir", "iz").distinct()
    cell = 4 * math.pi * (180 / math.pi) ** 2 / (n_ra * n_z)
    return covered.agg(F.count("*").alias("n_cells")).select(
        "n_cells", (F.col("n_cells") * F.lit(cell)).alias("area_deg2"),
        (F.col("n_cells") * F.lit(cell) / F.lit(SKY_DEG2)).alias("f_sky"),
    )


def draw_summary(draws: DataFrame, value: str = "m5") -> DataFrame:
    """Percentiles, mean and deviation per band of a table of depth draws."""
    percents = [1.0, 5.0, 16.0, 25.0, 50.0, 75.0, 84.0, 95.0, 99.0]
    q = exact_quantiles(draws, ["band"], value, percents, "select", "n", "q")
    m = draws.groupBy("band").agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return q.join(m, "band").select("band", "n", "mean", "std", *[F.col("q")[i].alias(f"p{int(p)}") for i, p in enumerate(percents)])


def resolve_depths(table: DataFrame | None, visits: DataFrame, percentile: float, bands, scope: str = "common_global") -> DataFrame:
    """Depth per band: from a depth table (see readers.depth_table) if it has the percentile for every band, else the exact percentile of the visits.

    Visits stand in for the global scope only. A band that neither gives is an error.
    """
    if table is not None:
        try:
            found = readers.depth_table(table, percentile, scope).where(F.col("band").isin(list(bands)))
            checks.require_bands(found, bands)
            return found
        except ValueError:  # the table lacks the percentile or a band, or has it twice
            if scope != "common_global":
                raise
    if scope != "common_global":
        raise ValueError("raw visits can only stand in for the global scope")
    d = visits.where(F.col("band").isin(list(bands)))
    return exact_quantiles(d, ["band"], "m5", [percentile], "select", "N_visits", "q").select("band", F.col("q")[0].alias("m5"))


def distance_summary(objects: DataFrame) -> DataFrame:
    """Long table of counts, means and nine percentiles of redshift and distance."""
    percents = [1.0, 5.0, 16.0, 25.0, 50.0, 75.0, 84.0, 95.0, 99.0]
    units = {"redshift": "", "luminosity_distance": "Mpc"}
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("quantity"), F.lit(u).alias("unit"), F.col(n).alias("v")) for n, u in units.items()]))
    long = objects.select(pairs.alias("p")).select("p.*").where("v IS NOT NULL")
    q = exact_quantiles(long, ["quantity", "unit"], "v", percents, "select", "n", "q")
    d = q.join(long.groupBy("quantity").agg(F.avg("v").alias("mean")), "quantity")
    rows = [F.struct(F.lit("n").alias("statistic"), F.col("n").cast("double").alias("value")), F.struct(F.lit("mean").alias("statistic"), F.col("mean").alias("value"))]
    rows += [F.struct(F.lit(f"p{int(p)}").alias("statistic"), F.col("q")[i].alias("value")) for i, p in enumerate(percents)]
    return d.select("quantity", "unit", F.explode(F.array(*rows)).alias("s")).select("quantity", "s.*", "unit")


def external_depths(spark, bands, manual: dict[str, float] | None = None, table: DataFrame | None = None) -> DataFrame:
    """Depths given as values or as a table; each band exactly once and within 0 to 40, else an error."""
    d = spark.createDataFrame(list(manual.items()), "band string, m5 double") if manual else table.where(F.col("band").isin(list(bands)))
    found = checks.require_bands(d, bands)
    bad = [b for b, m in found.items() if not 0.0 <= m <= 40.0]
    if bad:
        raise ValueError(f"depth out of range in {bad}")
    return spark.createDataFrame([(b, found[b]) for b in bands], "band string, m5 double")


def distances(objects: DataFrame, table: DataFrame, redshift: str = "redshift", cell: float = 0.01) -> DataFrame:
    """Luminosity distance by linear interpolation in a supplied redshift table (z, d); outside the table it is NULL."""
    w = W.partitionBy(F.lit(0)).orderBy("z")  # over the table, never over objects
    seg = table.select("z", "d", F.lead("z").over(w).alias("z1"), F.lead("d").over(w).alias("d1")).withColumn("__top", F.coalesce("z1", "z"))
    x = F.col(redshift)
    inside = (x >= F.col("z")) & ((x < F.col("z1")) | (F.col("z1").isNull() & (x == F.col("z"))))
    value = F.when(x == F.col("z"), F.col("d")).otherwise(
        F.col("d") + (F.col("d1") - F.col("d")) * (x - F.col("z")) / (F.col("z1") - F.col("z")))
    return interval_join(objects, redshift, seg, "z", "__top", inside, cell).withColumn("distance_mpc", value).drop("z", "d", "z1", "d1", "__top")
