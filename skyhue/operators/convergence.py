"""How stable envelope percentiles and horizons are under nested subsets and repetitions.

Sizes, repetitions, bins and percentiles are parameters, so every table after ``profiles`` is small; only
``profiles`` touches the population.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from skyhue.operators import ranks
from skyhue.operators.grid import TimeGrid
from skyhue.operators.quantiles import exact_quantiles, infinity_quantile, nearest_sample

# Percentiles of a profile and the families compared together.
PERCENTS = (5.0, 16.0, 25.0, 50.0, 75.0, 84.0, 95.0)
FAMILIES = {
    "central_90": ("p5", "p50", "p95"), "central_68": ("p16", "p50", "p84"), "central_50": ("p25", "p50", "p75"),
}
COMPONENTS = ("color_min", "color_median", "color_max")
ROUNDOFF = 32 * 2.220446049250313e-16
RUN = ["repetition", "sample_size"]


def estimator_id(q: float) -> str:
    return "p" + f"{q:g}".replace(".", "p")


def subset_values(values: DataFrame, population: DataFrame, seeds: list[int], sizes: list[int]) -> DataFrame:
    """Values of every nested subset. Each value is copied to the subsets that hold its event, map side."""
    members = ranks.memberships(population, "event_id", seeds, sizes)
    return values.join(members.select("event_id", "repetition", "sample_size"), "event_id")


def _tabulate(values: DataFrame, keys: list[str], percents, method: str) -> DataFrame:
    percents = percents if isinstance(percents, DataFrame) else list(percents)
    return exact_quantiles(values, [*keys, "bin_index"], "color", percents, method, "N_available", "q")


def _runs(spark, seeds, sizes) -> DataFrame:
    return spark.createDataFrame([(i, s) for i in range(len(seeds)) for s in sizes], "repetition int, sample_size int")


def _with_full(values, population, seeds, sizes, percents, method):
    """Percentiles of all subsets, and of the whole population once, then copied to the repetitions."""
    spark = values.sparkSession
    part = _tabulate(subset_values(values.select("event_id", "bin_index", "color"), population, seeds, sizes), RUN, percents, method)
    total = population.agg(F.count("*").cast("int").alias("sample_size"))
    reps = spark.createDataFrame([(i,) for i in range(len(seeds))], "repetition int")
    full = _tabulate(values, [], percents, method).crossJoin(F.broadcast(reps)).crossJoin(F.broadcast(total))
    got = part.select(*RUN, "bin_index", "N_available", "q").unionByName(full.select(*RUN, "bin_index", "N_available", "q"))
    runs = _runs(spark, seeds, sizes).unionByName(reps.crossJoin(total))
    return got, runs


def profiles(
    values: DataFrame, population: DataFrame, grid: TimeGrid, seeds: list[int], sizes: list[int], method: str = "select",
) -> DataFrame:
    """Seven percentiles per (repetition, size, bin), empty bins kept as invalid. The whole population is the largest size."""
    got, runs = _with_full(values, population, seeds, sizes, PERCENTS, method)
    dense = runs.crossJoin(F.broadcast(grid.frame(values.sparkSession)))
    rows = dense.join(got, RUN + ["bin_index"], "left")
    est = F.array(*[F.struct(F.lit(estimator_id(q)).alias("estimator_id"), F.lit(q).alias("percentile")) for q in PERCENTS])
    d = rows.select(*RUN, "bin_index", "t_min_days", "t_max_days", "t_center_days", "N_available", "q", F.posexplode(est).alias("pos", "e"))
    n = F.coalesce("N_available", F.lit(0).cast("bigint"))
    return d.select(
        *RUN, "bin_index", "t_min_days", "t_max_days", "t_center_days", "e.estimator_id", "e.percentile",
        n.alias("N_available"), F.element_at("q", F.col("pos") + 1).alias("value"), F.col("q").isNotNull().alias("valid"),
        F.when(n > 0, n * F.least("e.percentile", 100.0 - F.col("e.percentile")) / 100.0).alias("expected_nearest_tail_events"),
    )


def envelope_profiles(
    values: DataFrame, population: DataFrame, grid: TimeGrid, seeds: list[int], sizes: list[int], low: float = 1.0,
    allow_degenerate: bool = False, method: str = "select", bounds: DataFrame | None = None,
) -> DataFrame:
    """One interval per bin that ends at its first invalid bin.

    bounds: a reference profile (bin_index, valid, low_percentile). Every subset's percentiles are then those of the reference at that bin, where it is
    valid; ``low`` holds elsewhere.
    """
    bins = grid.frame(values.sparkSession).withColumn("low", F.lit(float(low)))
    percents = (low, 50.0, 100.0 - low)
    if bounds is not None:
        given = bounds.where("valid").select("bin_index", F.col("low_percentile").cast("double").alias("__given"))
        bins = bins.join(given, "bin_index", "left").withColumn("low", F.coalesce("__given", "low")).drop("__given")
        percents = bins.select("bin_index", F.array(F.col("low"), F.lit(50.0), 100.0 - F.col("low")).alias("percents"))
    got, runs = _with_full(values, population, seeds, sizes, percents, method)
    d = runs.crossJoin(bins).join(got, RUN + ["bin_index"], "left")
    some = F.col("q").isNotNull()
    usable = some if allow_degenerate else some & (F.col("low") < 50)
    w = W.partitionBy(*RUN).orderBy("bin_index").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*RUN).orderBy("bin_index").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("__ok", usable).withColumns({
        "valid": F.min("__ok").over(w), "__open": F.coalesce(F.min("__ok").over(before), F.lit(True)),
    })
    v = F.col("valid")
    return d.select(
        *RUN, "bin_index", "t_min_days", "t_max_days", "t_center_days", "valid",
        F.when(~F.col("__open"), "after_first_invalid_bin").when(~some, "insufficient_events")
        .when(~usable, "degenerate_p50_p50_excluded").otherwise("valid").alias("status"),
        F.when(F.col("__open"), F.coalesce("N_available", F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias("N_available"),
        F.when(v, F.col("low")).alias("low_percentile"), F.when(v, 100.0 - F.col("low")).alias("high_percentile"),
        *[F.when(v, F.col("q")[i]).alias(c) for i, c in enumerate(COMPONENTS)],
    )


def errors(value, reference, mode: str = "absolute", relative: float = 0.10, absolute: float = 0.10) -> dict[str, Column]:
    """difference, relative error (0/0 = 0, x/0 = infinity) and pass with roundoff slack; missing fails."""
    v = value if isinstance(value, Column) else F.col(value)
    r = reference if isinstance(reference, Column) else F.col(reference)
    known = v.isNotNull() & r.isNotNull()
    diff = F.abs(v - r)
    rel = F.when(~known, F.lit(float("inf"))).when(r != 0, F.try_divide(diff, F.abs(r))).when(diff == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))
    if mode == "absolute":
        tolerance = F.lit(float(absolute))
    elif mode == "relative":
        tolerance = F.lit(float(relative)) * F.abs(r)
    else:
        raise ValueError("mode is 'absolute' or 'relative'")
    slack = F.lit(ROUNDOFF) * F.greatest(F.lit(1.0), F.abs(v), F.abs(r))
    return {"difference": diff, "relative": rel, "passes": F.coalesce(known & (diff <= tolerance + slack), F.lit(False))}


def largest(runs: DataFrame) -> DataFrame:
    """Rows of the largest size of each repetition: the reference."""
    w = W.partitionBy("repetition")
    return runs.withColumn("__m", F.max("sample_size").over(w)).where(F.col("sample_size") == F.col("__m")).drop("__m")


def compare_profiles(profile: DataFrame, mode="absolute", relative=0.10, absolute=0.10) -> DataFrame:
    """Envelope profiles against the largest size on every bin where that one is valid."""
    ref = largest(profile).where("valid").select(
        "repetition", "bin_index", *[F.col(c).alias(f"reference_{c}") for c in COMPONENTS],
        F.col("N_available").alias("reference_N_available"),
    )
    d = profile.join(ref, ["repetition", "bin_index"])
    out = {}
    joint = F.col("valid")
    for c in COMPONENTS:
        e = errors(c, f"reference_{c}", mode, relative, absolute)
        out[f"absolute_error_{c}_mag"] = e["difference"]
        out[f"relative_error_{c}"] = F.when(F.col("valid"), e["relative"]).otherwise(F.lit(float("inf")))
        out[f"passes_{c}"] = e["passes"] & F.col("valid")
        joint = joint & e["passes"]
    return d.withColumns(out).withColumn("all_three_pass", joint).withColumnRenamed("valid", "sample_bin_valid")


def profile_records(compared: DataFrame, mode: str = "absolute") -> DataFrame:
    """One row per repetition and size."""
    worst_abs = {c: F.max(f"absolute_error_{c}_mag") for c in COMPONENTS}
    worst_rel = {c: F.max(f"relative_error_{c}") for c in COMPONENTS}
    d = compared.groupBy(*RUN).agg(
        F.count("*").alias("N_reference_bins"), F.count_if("sample_bin_valid").alias("N_supported_reference_bins"),
        F.count_if("all_three_pass").alias("N_bins_all_three_pass"), F.bool_and("all_three_pass").alias("all_reference_bins_pass"),
        *[worst_abs[c].alias(f"max_absolute_error_{c}_mag") for c in COMPONENTS],
        *[worst_rel[c].alias(f"max_relative_error_{c}") for c in COMPONENTS],
        *[F.bool_and(f"passes_{c}").alias(f"all_bins_pass_{c}") for c in COMPONENTS],
    )
    d = d.withColumns({
        "max_absolute_error_all_mag": F.greatest(*[f"max_absolute_error_{c}_mag" for c in COMPONENTS]),
        "max_relative_error_all": F.greatest(*[f"max_relative_error_{c}" for c in COMPONENTS]),
    })
    return d.withColumn("max_metric_error_all", F.col("max_absolute_error_all_mag" if mode == "absolute" else "max_relative_error_all"))


def families(profile: DataFrame) -> DataFrame:
    """Profile rows per family they belong to."""
    member = F.array(*[
        F.when(F.col("estimator_id").isin(*ids), F.lit(name)) for name, ids in FAMILIES.items()
    ])
    return profile.withColumn("group_id", F.explode(F.array_compact(member)))


def last_edges(profile: DataFrame) -> DataFrame:
    """Per run and family: last upper edge of the initial run of bins whose three members are all valid."""
    per_bin = families(profile).groupBy(*RUN, "group_id", "bin_index", "t_max_days").agg(
        (F.bool_and("valid") & (F.count("*") == 3)).alias("ok")
    )
    w = W.partitionBy(*RUN, "group_id").orderBy("bin_index").rowsBetween(W.unboundedPreceding, 0)
    d = per_bin.withColumn("open", F.min("ok").over(w))
    return d.groupBy(*RUN, "group_id").agg(
        F.max(F.when(F.col("open"), F.col("t_max_days"))).alias("last_valid_time_days"),
        F.count_if("open").alias("N_consecutive_valid_bins"),
    )


def compare_shape(
    profile: DataFrame, t_max: float, mode="absolute", relative=0.10, absolute=0.10, horizon: str = "fixed",
    tolerance_days: float = 0.4,
) -> DataFrame:
    """Family members against the largest size on each bin of the window.

    The window ends at ``t_max``, or (``reference_minus_tolerance``) at the family's own reference edge less a tolerance.
    """
    f = families(profile)
    if horizon == "fixed":
        f = f.where(F.col("t_max_days") <= t_max + 1e-10)
    elif horizon == "reference_minus_tolerance":
        edge = largest(last_edges(profile)).select("repetition", "group_id", F.col("last_valid_time_days").alias("__edge"))
        f = f.join(F.broadcast(edge), ["repetition", "group_id"]).where(
            F.col("t_max_days") <= F.col("__edge") - tolerance_days + 1e-10
        ).drop("__edge")
    else:
        raise ValueError("horizon is 'fixed' or 'reference_minus_tolerance'")
    keys = ["repetition", "group_id", "bin_index", "estimator_id"]
    ref = largest(f).select(*keys, F.col("value").alias("reference_value"), F.col("valid").alias("reference_valid"))
    d = f.join(ref, keys)
    e = errors("value", "reference_value", mode, relative, absolute)
    both = F.col("valid") & F.col("reference_valid")
    return d.select(
        *RUN, "group_id", "bin_index", "estimator_id", "t_max_days", "value", "reference_value", "valid", "reference_valid",
        both.alias("both_supported"), e["difference"].alias("absolute_error_mag"), e["relative"].alias("relative_error"),
        (e["passes"] & both).alias("passes_tolerance"),
    )


def shape_records(compared: DataFrame, mode: str = "absolute") -> DataFrame:
    per_bin = compared.groupBy(*RUN, "group_id", "bin_index").agg(
        F.count("*").alias("n"), F.count_if("both_supported").alias("n_sup"), F.count_if("passes_tolerance").alias("n_pass"),
        F.bool_and("valid").alias("v"), F.bool_and("reference_valid").alias("rv"), F.max("t_max_days").alias("t"),
        F.max(F.when(F.col("both_supported"), F.col("absolute_error_mag"))).alias("a"),
        F.max(F.when(F.col("both_supported"), F.col("relative_error"))).alias("r"),
    )
    d = per_bin.groupBy(*RUN, "group_id").agg(
        F.max("t").alias("shape_horizon_days"), F.count("*").alias("N_shape_bins"),
        F.count_if("rv").alias("N_reference_supported_shape_bins"), F.count_if("v").alias("N_sample_supported_shape_bins"),
        F.sum("n").alias("N_values_required"), F.sum("n_sup").alias("N_values_supported"), F.sum("n_pass").alias("N_values_passing"),
        F.bool_and("rv").alias("reference_shape_supported"), F.bool_and("v").alias("sample_shape_supported"),
        F.max("a").alias("max_absolute_error_supported_mag"), F.max("r").alias("max_relative_error_supported"),
    )
    return d.withColumns({
        "max_metric_error_supported": F.col("max_absolute_error_supported_mag" if mode == "absolute" else "max_relative_error_supported"),
        "all_shape_values_pass": F.col("N_values_passing") == F.col("N_values_required"),
    })


def extent_records(edges: DataFrame, tolerance_days: float = 0.4) -> DataFrame:
    ref = largest(edges).select(
        "repetition", "group_id", F.col("last_valid_time_days").alias("reference_last_valid_time_days"),
        F.col("N_consecutive_valid_bins").alias("reference_consecutive_valid_bins"),
    )
    diff = F.abs(F.col("last_valid_time_days") - F.col("reference_last_valid_time_days"))
    return edges.join(ref, ["repetition", "group_id"]).withColumns({
        "absolute_extent_error_days": diff, "extent_within_tolerance": F.coalesce(diff <= tolerance_days + 1e-12, F.lit(False)),
    })


def with_threshold(summary: DataFrame, keys: list[str], passes: str = "point_passes_stability") -> DataFrame:
    """Adds 'all larger sizes pass too' and the first size from which that holds."""
    part = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    stable = F.min(passes).over(part.orderBy("sample_size").rowsBetween(W.currentRow, W.unboundedFollowing))
    d = summary.withColumn("all_larger_sizes_also_stable", stable)
    return d.withColumn("threshold_size", F.min(F.when(F.col("all_larger_sizes_also_stable"), F.col("sample_size"))).over(part))


def _quantile_columns(columns, rule, skip_missing=True) -> list[Column]:
    """p16, median, p84 over the repetitions; their number is a parameter, so the array is small.

    Missing values are left out, or else counted by the rule.
    """
    out = []
    for c in columns:
        missing = [] if skip_missing else [F.count("*") - F.count(c)]
        for label, q in (("p16", 0.16), ("median", 0.5), ("p84", 0.84)):
            out.append(rule(F.collect_list(c), q, *missing).alias(f"{c}_{label}"))
    return out


def aggregate_colour(records: DataFrame, required: float = 0.9) -> DataFrame:
    columns = [f"max_absolute_error_{c}_mag" for c in (*COMPONENTS, "all")] + [f"max_relative_error_{c}" for c in (*COMPONENTS, "all")] + ["max_metric_error_all"]
    s = records.groupBy("sample_size").agg(
        F.count("*").alias("repetitions"), F.avg(F.col("all_reference_bins_pass").cast("double")).alias("fraction_pass"),
        F.min("N_supported_reference_bins").alias("minimum_supported_reference_bins"),
        *_quantile_columns(columns, infinity_quantile),
    ).withColumn("point_passes_stability", F.col("fraction_pass") + 1e-12 >= required)
    return with_threshold(s, [])


def aggregate_shape(records: DataFrame, required: float = 0.9) -> DataFrame:
    s = records.groupBy("group_id", "sample_size").agg(
        F.count("*").alias("repetitions"), F.avg(F.col("all_shape_values_pass").cast("double")).alias("fraction_pass"),
        F.min("N_sample_supported_shape_bins").alias("minimum_supported_shape_bins"),
        F.min("N_values_supported").alias("minimum_supported_values"), F.median("shape_horizon_days").alias("shape_horizon_days"),
        *_quantile_columns(["max_absolute_error_supported_mag", "max_relative_error_supported", "max_metric_error_supported"], infinity_quantile),
    ).withColumn("point_passes_stability", F.col("fraction_pass") + 1e-12 >= required)
    return with_threshold(s, ["group_id"])


def aggregate_extent(records: DataFrame, required: float = 0.9, skip_missing: bool = True) -> DataFrame:
    """Last valid times per family and size. A repetition without a valid bin has none: its time is left out, or else comes after every other."""
    s = records.groupBy("group_id", "sample_size").agg(
        F.count("*").alias("repetitions"), F.avg(F.col("extent_within_tolerance").cast("double")).alias("fraction_pass"),
        *_quantile_columns(["last_valid_time_days", "reference_last_valid_time_days"], nearest_sample, skip_missing),
        *_quantile_columns(["absolute_extent_error_days"], nearest_sample),
    ).withColumn("point_passes_stability", F.col("fraction_pass") + 1e-12 >= required)
    return with_threshold(s, ["group_id"])


def aggregate_last_time(runs: DataFrame, tolerance: float = 0.4, required: float = 0.9) -> DataFrame:
    """Last valid times per size against each repetition's largest size. runs: repetition, sample_size, last_valid_time_days."""
    ref = largest(runs).select("repetition", F.col("last_valid_time_days").alias("reference_time_days"))
    d = runs.join(ref, "repetition", "left")
    diff = F.abs(F.col("last_valid_time_days") - F.col("reference_time_days"))
    d = d.withColumns({"__diff": diff, "__within": F.coalesce(diff <= tolerance + 1e-12, F.lit(False))})
    s = d.groupBy("sample_size").agg(
        F.count("repetition").alias("repetitions"), F.median("last_valid_time_days").alias("last_time_median"),
        infinity_quantile(F.collect_list("last_valid_time_days"), 0.16).alias("last_time_p16"),
        infinity_quantile(F.collect_list("last_valid_time_days"), 0.84).alias("last_time_p84"),
        F.avg(F.col("__within").cast("double")).alias("fraction_within_reference"),
        F.median("__diff").alias("median_absolute_difference_days"),
    )
    everything = W.partitionBy(F.lit(0)).orderBy("sample_size").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    reference = F.last("last_time_median").over(everything)
    near = F.coalesce(F.abs(F.col("last_time_median") - F.col("__ref")) <= tolerance + 1e-12, F.lit(False))
    s = s.withColumn("__ref", reference).withColumn("median_within_reference_tolerance", near).drop("__ref")
    s = s.withColumn("point_passes_stability", F.col("median_within_reference_tolerance") & (F.col("fraction_within_reference") >= required))
    return with_threshold(s, [])


def thresholds(shape: DataFrame, extent: DataFrame) -> DataFrame:
    """Per family: size from which shape and extent are stable, the larger of both, and whether it is below the reference."""
    a = shape.groupBy("group_id").agg(F.max("threshold_size").alias("N_shape_stable"), F.max("sample_size").alias("__largest"))
    b = extent.groupBy("group_id").agg(F.max("threshold_size").alias("N_extent_stable"))
    both = F.when(F.col("N_shape_stable").isNotNull() & F.col("N_extent_stable").isNotNull(), F.greatest("N_shape_stable", "N_extent_stable"))
    below = lambda c: F.coalesce(F.col(c) < F.col("__largest"), F.lit(False))
    return a.join(b, "group_id", "full_outer").withColumn("N_recommended_both", both).withColumns({
        "shape_plateau_below_reference": below("N_shape_stable"), "extent_plateau_below_reference": below("N_extent_stable"),
        "both_plateau_below_reference": below("N_recommended_both"),
    }).drop("__largest")


def value_table(summary: DataFrame, value: str, decimals: int, groups=("central_90", "central_68")) -> DataFrame:
    """Compact text per size and family: ``median [p16, p84]``, percent of repetitions, Yes / No / Ref."""
    f = f"%.{decimals}f [%.{decimals}f, %.{decimals}f]"
    m, lo, hi = (F.col(f"{value}_{s}") for s in ("median", "p16", "p84"))
    last = F.max("sample_size").over(W.partitionBy(F.lit(0)))
    d = summary.where(F.col("group_id").isin(*groups)).withColumns({
        "text": F.when(m.isNotNull() & lo.isNotNull() & hi.isNotNull(), F.format_string(f, m, lo, hi)).otherwise(F.lit("-")),
        "share": F.format_string("%.0f", F.col("fraction_pass") * 100),
        "plateau": F.when(F.col("sample_size") == last, "Ref.").when(F.col("all_larger_sizes_also_stable"), "Yes").otherwise("No"),
    })
    pick = lambda g, c: F.coalesce(F.max(F.when(F.col("group_id") == g, F.col(c))), F.lit("-"))
    return d.groupBy("sample_size").agg(*[
        pick(g, c).alias(f"{g}_{c}") for g in groups for c in ("text", "share", "plateau")
    ])


def realizations(values: DataFrame, sizes: list[int], grid_times: DataFrame, keys: list[str], method: str = "select") -> DataFrame:
    """Nested id prefixes (``event_id < size``) per realization and time: count, share, p16, p50, p84; empty times kept.

    values: keys, event_id, bin_index, color; grid_times: bin_index (one row per requested time).
    """
    fits = F.filter(F.array(*[F.lit(int(s)) for s in sizes]), lambda s: F.col("event_id") < s)
    d = values.select(*keys, "bin_index", "color", F.explode(fits).alias("population_size"))
    got = exact_quantiles(d, [*keys, "population_size", "bin_index"], "color", [16.0, 50.0, 84.0], method, "n_valid", "q")
    spark = values.sparkSession
    dense = values.select(*keys).distinct().crossJoin(
        F.broadcast(grid_times.crossJoin(spark.createDataFrame([(int(s),) for s in sizes], "population_size int")))
    )
    n = F.coalesce("n_valid", F.lit(0).cast("bigint"))
    return dense.join(got, [*keys, "population_size", "bin_index"], "left").select(
        *keys, "population_size", "bin_index", n.alias("n_valid"), (n / F.col("population_size")).alias("valid_fraction"),
        F.col("q")[0].alias("p16"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p84"), (n > 0).alias("envelope_valid"),
    )
