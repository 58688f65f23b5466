"""Percentile envelopes of a colour population per time bin, and everything compared with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from skyhue.operators import curves, series
from skyhue.operators.grid import TimeGrid, match_interval
from skyhue.operators.quantiles import exact_quantiles, nearest_rank

STAGES = ("no_m5", "m5")

# Default lower-tail percentiles of the diagnostics.
DEFAULT_TAILS = (
    0.02, 0.05, 0.1, 0.25, 0.5, 0.53, 1, 2.5, 5, 10, 16, 20, 25, 30, 35, 40, 42, 44, 45, 46, 47, 48, 49, 50,
)


def selection_system(system: str) -> str:
    """Depths belong to the survey's own system, also for colours in another one."""
    return "lsst" if system == "ps1" else system


def population_colours(
    lightcurves: DataFrame, grid: TimeGrid, band1: str, band2: str, system: str = "lsst", how: str = "log",
    min_knots: int = 1,
) -> DataFrame:
    """event_id, bin_index, mag1, mag2, sel1, sel2, color: both bands supported at the bin centre."""
    own = selection_system(system)
    d = lightcurves.where(F.col("band").isin(band1, band2) & F.col("photometric_system").isin(system, own))
    d = d.select("event_id", "photometric_system", "band", "t_days", "mag")
    at = curves.interpolate(d, grid, how, min_knots, event_keys=["event_id"])
    pick = lambda s, b: F.max(F.when((F.col("photometric_system") == s) & (F.col("band") == b), F.col("mag")))
    wide = at.groupBy("event_id", "bin_index").agg(
        pick(system, band1).alias("mag1"), pick(system, band2).alias("mag2"),
        pick(own, band1).alias("sel1"), pick(own, band2).alias("sel2"),
    )
    return wide.withColumn("color", F.col("mag1") - F.col("mag2"))


def with_depths(colours: DataFrame, depths: dict[str, float], band1: str, band2: str) -> DataFrame:
    """Adds the two depths as literals; they are numbers by now, see ``checks.require_bands``."""
    return colours.withColumns({"m5_1": F.lit(float(depths[band1])), "m5_2": F.lit(float(depths[band2]))})


def passes_depth() -> Column:
    """Inclusive, in both bands, on the selection magnitudes."""
    return (F.col("sel1") <= F.col("m5_1")) & (F.col("sel2") <= F.col("m5_2"))


def stages(colours: DataFrame, depths: dict[str, float], band1: str, band2: str, wanted=STAGES) -> DataFrame:
    """Supported colours per stage in one pass: every supported bin, and those within both depths."""
    d = with_depths(colours.where("color IS NOT NULL"), depths, band1, band2)
    labels = []
    if "no_m5" in wanted:
        labels.append(F.lit("no_m5"))
    if "m5" in wanted:
        labels.append(F.when(passes_depth(), F.lit("m5")))
    return (
        d.withColumn("stage", F.explode(F.array_compact(F.array(*labels))))
        .select("stage", *[c for c in colours.columns])
    )


def choose_tail(tails) -> tuple[float, int]:
    """First usable lower percentile of an ordered list, with its rank."""
    ordered = list(dict.fromkeys(float(q) for q in tails if 0.0 <= float(q) <= 50.0))
    if not ordered:
        raise ValueError("no percentile lies in [0, 50]")
    return ordered[0], 1


def rules(
    values: DataFrame, keys: list[str], grid: TimeGrid, tails=(1.0,), method: str = "select", value: str = "color",
) -> DataFrame:
    """One row per key and non-empty bin: the percentile interval, its median, counts and expected tails."""
    q, _ = choose_tail(tails)
    return rules_of(percentile_table(values, keys, [q, 50.0, 100.0 - q], method, value), keys, grid, [q, 50.0, 100.0 - q], tails)


def percentile_table(values: DataFrame, keys: list[str], percents: list[float], method: str = "select", value: str = "color") -> DataFrame:
    """keys, bin_index, N_population_events, q (in the order of percents): what rules and diagnostics of several populations and stages are read from."""
    return exact_quantiles(values, [*keys, "bin_index"], value, percents, method, "N_population_events", "q")


def product_percents(tails=(1.0,), diagnostic_tails=DEFAULT_TAILS) -> list[float]:
    """Percentiles that both the rules and the diagnostics need."""
    lower = [choose_tail(tails)[0], *(float(q) for q in diagnostic_tails if 0 <= q <= 50)]
    return sorted(set(lower + [100.0 - q for q in lower] + [50.0]))


def rules_of(table: DataFrame, keys: list[str], grid: TimeGrid, percents: list[float], tails=(1.0,)) -> DataFrame:
    """Rules read from a table of percentiles."""
    q, rank = choose_tail(tails)
    at = lambda p: F.col("q")[percents.index(p)]
    d = grid.with_times(table)
    w = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy("bin_index")
    tail = F.col("N_population_events") * q / 100.0
    return d.select(
        *keys, "bin_index", "t_min_days", "t_max_days", "t_center_days", F.lit(grid.width).alias("bin_width_days"),
        "N_population_events",
        (F.row_number().over(w) - 1 == F.col("bin_index")).alias("initial_consecutive_valid"),
        F.lit(q).alias("low_percentile"), F.lit(100.0 - q).alias("high_percentile"),
        at(q).alias("color_min"), at(50.0).alias("color_median"), at(100.0 - q).alias("color_max"),
        tail.alias("expected_lower_tail_events"), tail.alias("expected_upper_tail_events"),
        F.lit(100.0 - 2 * q).alias("nominal_coverage_percent"),
        F.lit("median_only" if q == 50 else f"p{q:g}-p{100 - q:g}").alias("envelope_definition"),
        F.lit(rank).alias("selection_rank"), F.lit(q == 50).alias("median_only"),
    )


def with_rule_id(rule_table: DataFrame, stage: str = "stage") -> DataFrame:
    return rule_table.withColumn("rule_id", F.format_string("%s_bin_%03d", F.col(stage), F.col("bin_index")))


def diagnostics(
    values: DataFrame, keys: list[str], grid: TimeGrid, tails=DEFAULT_TAILS, method: str = "select", value: str = "color",
) -> DataFrame:
    """Long table bin x percentile of both tails and the median."""
    lower = [float(q) for q in dict.fromkeys(tails) if 0 <= q <= 50]
    percents = sorted(set(lower + [100.0 - q for q in lower] + [50.0]))
    return diagnostics_of(percentile_table(values, keys, percents, method, value), keys, grid, percents, tails)


def diagnostics_of(table: DataFrame, keys: list[str], grid: TimeGrid, percents: list[float], tails=DEFAULT_TAILS) -> DataFrame:
    """Diagnostics read from a table of percentiles."""
    lower = [float(q) for q in tails if 0 <= q <= 50]
    wanted = set(lower + [100.0 - q for q in lower] + [50.0])
    p = F.array(*[F.lit(x) for x in percents])
    d = table.select(*keys, "bin_index", "N_population_events", F.posexplode("q").alias("pos", "value"))
    d = d.withColumn("percentile", F.element_at(p, F.col("pos") + 1)).drop("pos")
    if wanted != set(percents):
        d = d.where(F.col("percentile").isin(sorted(wanted)))
    return grid.with_times(d).withColumn(
        "expected_nearest_tail_events",
        F.col("N_population_events") * F.least("percentile", F.lit(100.0) - F.col("percentile")) / 100.0,
    )


def availability(
    staged: DataFrame, supported: DataFrame, population: DataFrame, grid: TimeGrid, stage_names=STAGES,
) -> DataFrame:
    """Counts of every bin and stage, empty ones included."""
    spark = staged.sparkSession
    dense = grid.frame(spark).withColumn("stage", F.explode(F.array(*[F.lit(s) for s in stage_names])))
    total = population.agg(F.count("*").alias("N_population_total"))
    sup = supported.where("color IS NOT NULL").groupBy("bin_index").agg(F.count("*").alias("N_population_model_supported"))
    here = staged.groupBy("stage", "bin_index").agg(F.count("*").alias("N_population_stage_available"))
    d = dense.join(sup, "bin_index", "left").join(here, ["stage", "bin_index"], "left").crossJoin(F.broadcast(total))
    zero = F.lit(0).cast("bigint")
    d = d.withColumns({
        "N_population_model_supported": F.coalesce("N_population_model_supported", zero),
        "N_population_stage_available": F.coalesce("N_population_stage_available", zero),
    }).withColumn("candidate_envelope_valid", F.col("N_population_stage_available") > 0)
    run = W.partitionBy("stage").orderBy("bin_index").rowsBetween(W.unboundedPreceding, 0)
    return d.withColumn("initial_consecutive_valid", F.min("candidate_envelope_valid").over(run))


def first_valid_run(df: DataFrame, keys: list[str], index: str, valid: str, name: str = "in_first_run") -> DataFrame:
    """First contiguous valid run of a bin table; leading invalid bins are allowed."""
    w = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy(index)
    broken = F.sum((F.col("__started") & ~F.col(valid)).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))
    return (
        df.withColumn("__started", F.max(valid).over(w.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn(name, F.col(valid) & (broken == 0)).drop("__started")
    )


def stage_summary(rule_table: DataFrame, native_points: DataFrame, exit_counts: DataFrame | None = None) -> DataFrame:
    """Per stage: valid bins, consecutive bins, the last consecutive edge, native points."""
    s = rule_table.groupBy("stage").agg(
        F.count("*").alias("N_valid_bins_anywhere"),
        F.count_if("initial_consecutive_valid").alias("N_initial_consecutive_valid_bins"),
        F.max(F.when(F.col("initial_consecutive_valid"), F.col("t_max_days"))).alias("last_initial_consecutive_time_days"),
    ).crossJoin(F.broadcast(native_points.agg(F.count("*").alias("N_native_population_points"))))
    if exit_counts is not None:
        s = s.join(exit_counts, "stage", "left").na.fill(0, [c for c in exit_counts.columns if c != "stage"])
    return s


def overlap(rules_a: DataFrame, rules_b: DataFrame, values_a: DataFrame, values_b: DataFrame, keys: list[str]) -> DataFrame:
    """Per common bin: intersection and union of two envelopes, and each population inside the other's."""
    on = [*keys, "bin_index"]
    a = rules_a.select(*on, "t_min_days", "t_max_days", "t_center_days", F.col("color_min").alias("a_min"), F.col("color_max").alias("a_max"))
    b = rules_b.select(*on, F.col("color_min").alias("b_min"), F.col("color_max").alias("b_max"))
    both = a.join(b, on)

    def inside(values, lo, hi, n, n_in):
        c = F.col("color")
        return values.where("color IS NOT NULL").join(both.select(*on, lo, hi), on).groupBy(*on).agg(
            F.count("*").alias(n), F.count_if((c >= F.col(lo)) & (c <= F.col(hi))).alias(n_in)
        )

    counts_b = inside(values_b, "a_min", "a_max", "N_b_available", "N_b_inside_a")
    counts_a = inside(values_a, "b_min", "b_max", "N_a_available", "N_a_inside_b")
    d = both.join(counts_a, on, "left").join(counts_b, on, "left")
    zero = F.lit(0).cast("bigint")
    low, high = F.greatest("a_min", "b_min"), F.least("a_max", "b_max")
    width = F.greatest(F.lit(0.0), high - low)
    union = F.greatest("a_max", "b_max") - F.least("a_min", "b_min")
    same = ((F.col("a_min") == F.col("b_min")) & (F.col("a_max") == F.col("b_max"))).cast("double")
    d = d.withColumns({c: F.coalesce(c, zero) for c in ("N_a_available", "N_a_inside_b", "N_b_available", "N_b_inside_a")})
    d = d.withColumns({"overlap_width_mag": width, "union_width_mag": union})
    w, u = F.col("overlap_width_mag"), F.col("union_width_mag")
    return d.withColumns({
        "overlap_color_min": F.when(w > 0, low), "overlap_color_max": F.when(w > 0, high),
        "overlap_fraction_union": F.when(u > 0, F.try_divide(w, u)).otherwise(same),
        "overlap_fraction_a_width": F.try_divide(w, F.col("a_max") - F.col("a_min")),
        "overlap_fraction_b_width": F.try_divide(w, F.col("b_max") - F.col("b_min")),
        "fraction_b_inside_a": F.try_divide("N_b_inside_a", "N_b_available"),
        "fraction_a_inside_b": F.try_divide("N_a_inside_b", "N_a_available"),
    })


def overlap_summary(table: DataFrame, keys: list[str]) -> DataFrame:
    return table.groupBy(*keys).agg(
        F.count("*").alias("N_common_valid_bins"),
        F.count_if(F.col("overlap_width_mag") > 0).alias("N_bins_with_overlap"),
        F.avg((F.col("overlap_width_mag") > 0).cast("double")).alias("fraction_bins_with_overlap"),
        F.try_divide(F.sum("overlap_width_mag"), F.sum("union_width_mag")).alias("total_overlap_fraction_union"),
        F.avg("overlap_fraction_union").alias("mean_overlap_fraction_union"),
        F.avg("fraction_b_inside_a").alias("mean_fraction_b_inside_a"),
        F.avg("fraction_a_inside_b").alias("mean_fraction_a_inside_b"),
    )


def exits(values: DataFrame, rule_table: DataFrame, keys: list[str], minimum_bins: int = 3) -> DataFrame:
    """Events whose last comparable bins all lie outside after an earlier one inside.

    keys: columns shared by values and rules (for example stage). Rows per event are at most the bins.
    """
    on = [*keys, "bin_index"]
    r = rule_table.select(*on, "t_center_days", "color_min", "color_max")
    last_rule = r.groupBy(*keys).agg(F.max("bin_index").alias("final_rule_bin")) if keys else r.agg(F.max("bin_index").alias("final_rule_bin"))
    r = r.join(last_rule, keys) if keys else r.crossJoin(last_rule)
    c = F.col("color")
    d = values.where("color IS NOT NULL").select("event_id", *on, "color").join(r, on)
    d = d.withColumn("above", c > F.col("color_max")).withColumn("below", c < F.col("color_min"))
    d = d.withColumn("outside", F.col("above") | F.col("below"))
    event = W.partitionBy("event_id", *keys)
    d = d.withColumns({
        "last_bin": F.max("bin_index").over(event),
        "first_inside": F.min(F.when(~F.col("outside"), F.col("bin_index"))).over(event),
        "run": F.col("bin_index") - F.row_number().over(W.partitionBy("event_id", *keys, "outside").orderBy("bin_index")),
    }).where("outside")
    excursion = F.when(F.col("below"), F.col("color_min") - c).otherwise(c - F.col("color_max"))
    runs = d.groupBy("event_id", *keys, "run", "last_bin", "first_inside", "final_rule_bin").agg(
        F.count("*").alias("n_run"),
        F.min("bin_index").alias("first_outside_bin"), F.min("t_center_days").alias("first_outside_time_days"),
        F.max("bin_index").alias("run_last_bin"), F.max("t_center_days").alias("last_outside_time_days"),
        F.bool_and("above").alias("all_above"), F.bool_and("below").alias("all_below"),
        F.max(excursion).alias("maximum_excursion_mag"),
    )
    return runs.where(
        (F.col("run_last_bin") == F.col("last_bin")) & (F.col("n_run") >= minimum_bins)
        & (F.col("first_inside") < F.col("first_outside_bin"))
    ).select(
        "event_id", *keys, "first_outside_bin", "first_outside_time_days", F.col("run_last_bin").alias("last_outside_bin"),
        "last_outside_time_days", F.col("n_run").alias("n_final_outside_bins"),
        F.when(F.col("all_above"), "redder").when(F.col("all_below"), "bluer").otherwise("mixed").alias("exit_direction"),
        "maximum_excursion_mag", (F.col("run_last_bin") < F.col("final_rule_bin")).alias("right_censored"),
    )


def physical_parameters(objects: DataFrame) -> DataFrame:
    """Masses from logarithms, inclination in degrees; columns that are absent become NULL."""
    have = set(objects.columns)
    power = lambda c: F.pow(F.lit(10.0), F.col(c)) if c in have else F.lit(None).cast("double")
    plain = lambda c: F.col(c).cast("double") if c in have else F.lit(None).cast("double")
    return objects.select(
        "event_id", power("log10_mej_dyn").alias("M_ej_dyn_Msun"), plain("v_ej_dyn").alias("v_ej_dyn_c"),
        plain("Ye_dyn").alias("Ye_dyn"), power("log10_mej_wind").alias("M_ej_wind_Msun"),
        plain("v_ej_wind").alias("v_ej_wind_c"), plain("Ye_wind").alias("Ye_wind"), plain("phi").alias("phi_deg"),
        F.degrees(plain("inclination_EM")).alias("inclination_deg"),
        plain("luminosity_distance").alias("luminosity_distance_Mpc"), plain("redshift").alias("redshift"),
        power("log10_mej").alias("M_ej_Msun"), power("log10_vej").alias("v_min_c"), plain("beta").alias("beta"),
        power("log10_kappa_r").alias("kappa_r_cm2_g"),
    )


def evaluate_points(
    points: DataFrame, rule_table: DataFrame, t_min: float, t_max: float, sigma: float = 1.0, phase: str = "phase_days",
    keys: list[str] = (),
) -> DataFrame:
    """Points with an error interval against the bin of their time; the first bin wins on a shared edge.

    points must carry row_id. Bins are ``[lo, hi)``, or up to ``hi`` within rounding.
    """
    keys = list(keys)
    r = rule_table.select(*keys, "bin_index", "t_min_days", "t_max_days", "color_min", "color_median", "color_max")
    p, hi = F.col(phase), F.col("t_max_days")
    near = F.abs(p - hi) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(hi)
    in_range = (p >= t_min) & (p <= t_max)
    match = in_range & (F.col("t_min_days") <= p) & ((p < hi) | near)
    for k in keys:
        match = match & points[k].eqNullSafe(r[k])
    joined = points.join(F.broadcast(r), match, "left")
    rule_columns = ["bin_index", "t_min_days", "t_max_days", "color_min", "color_median", "color_max"]
    base = [points[c] for c in points.columns]
    joined = joined.select(*base, *[r[c].alias(f"rule_{c}") for c in rule_columns])
    # at most two bins can hold a point, so the choice needs one small aggregate per point
    first = joined.groupBy(*points.columns).agg(
        F.min(F.struct(*[F.col(f"rule_{c}") for c in rule_columns])).alias("r")
    )
    lo, up = F.col("r.rule_color_min"), F.col("r.rule_color_max")
    c, e = F.col("color"), F.col("color_error")
    d = first.withColumns({"color_interval_min": c - sigma * e, "color_interval_max": c + sigma * e})
    il, iu = F.col("color_interval_min"), F.col("color_interval_max")
    has = F.col("r.rule_bin_index").isNotNull()
    central = (c >= lo) & (c <= up)
    result = (
        F.when(~in_range, "outside_requested_time_range").when(~has, "no_valid_envelope_bin")
        .when(iu < lo, "bluer").when(il > up, "redder").when(central, "pass_central").otherwise("pass_with_photometric_error")
    )
    return d.select(
        *points.columns, has.alias("evaluated"),
        F.when(has, (iu >= lo) & (il <= up)).alias("passes_filter"),
        F.when(has, central).alias("passes_filter_central_value"),
        result.alias("result"),
        F.when(has, il).alias("color_interval_min"), F.when(has, iu).alias("color_interval_max"),
        F.col("r.rule_bin_index").alias("bin_index"), lo.alias("color_min"),
        F.col("r.rule_color_median").alias("color_median"), up.alias("color_max"),
        F.when(has, F.when(iu < lo, lo - iu).when(il > up, il - up).otherwise(F.lit(0.0))).alias("excursion_beyond_envelope_mag"),
    )


def point_counts(evaluated: DataFrame, keys: list[str]) -> DataFrame:
    ok, central = F.coalesce("passes_filter", F.lit(False)), F.coalesce("passes_filter_central_value", F.lit(False))
    return evaluated.groupBy(*keys).agg(
        F.count("*").alias("N_paired_points"), F.count_if("evaluated").alias("N_evaluated_points"),
        F.count_if(ok).alias("N_passing_points"), F.count_if(central).alias("N_passing_central_points"),
        F.count_if(ok & ~central).alias("N_passing_via_photometric_error_points"),
        F.count_if(F.col("evaluated") & ~ok).alias("N_failing_points"),
    )


def apply_rules(colours: DataFrame, rule_table: DataFrame, row: list[str], phase: str = "t_color_available_days") -> DataFrame:
    """Measured colours against ``(lo, hi]`` rules; where rules overlap the later one wins.

    row: columns that identify a measured colour.
    """
    r = rule_table.select("rule_order", "rule_id", "t_min_days", "t_max_days", "color_min", "color_max")
    joined = match_interval(colours, phase, r, "left_open")
    keep = [c for c in colours.columns if c not in row]
    best = joined.groupBy(*row).agg(
        *[F.first(c).alias(c) for c in keep],
        F.max(F.when(F.col("rule_id").isNotNull(), F.struct("rule_order", "rule_id", "color_min", "color_max"))).alias("r"),
    )
    c = F.col("color")
    return best.select(
        *row, *keep, F.col("r").isNotNull().alias("evaluated"),
        F.coalesce((c >= F.col("r.color_min")) & (c <= F.col("r.color_max")), F.lit(False)).alias("passes_cut"),
        F.col("r.rule_id").alias("rule_id"), F.col("r.color_min").alias("color_min"), F.col("r.color_max").alias("color_max"),
    )


def criteria(evaluated: DataFrame, key: str, phase: str, tie: str) -> DataFrame:
    """Per event: does its first colour pass, do two distinct bins pass, does any; with selection times.

    The per-rule step comes first, so an event contributes at most one row per rule to the last aggregate.
    """
    d = evaluated.where("evaluated")
    order = F.struct(F.col(phase).alias("t"), F.col(tie).alias("tie"))
    per_rule = d.groupBy(key, "rule_id").agg(
        F.min(F.when(F.col("passes_cut"), F.col(phase))).alias("first_pass"),
        F.min(order).alias("o"), F.min_by("passes_cut", order).alias("p"),
    )
    e = per_rule.groupBy(key).agg(
        F.min_by("p", "o").alias("first_passed"), F.min("o.t").alias("first_time"),
        F.min("first_pass").alias("ever_time"), F.count("*").alias("n_rules"),
        F.count("first_pass").alias("n_passing"), F.array_sort(F.collect_list("first_pass")).alias("times"),
    )
    two = F.col("n_passing") >= 2
    return e.select(
        key, F.col("first_passed").alias("first_color_passed"),
        F.when(F.col("first_passed"), F.col("first_time")).alias("first_color_time_days"),
        (F.col("n_rules") >= 2).alias("two_bins_evaluable"), two.alias("two_bins_passed"),
        F.when(two, F.element_at("times", 2)).alias("two_bins_time_days"),
        (F.col("n_passing") > 0).alias("ever_passed"), F.col("ever_time").alias("ever_time_days"),
    )


def censor(colours: DataFrame) -> DataFrame:
    """Detection state of a supported pair at fixed depths, with the bounds it puts on the colour.

    0 unknown, 1 both detected, 2 band 1 is a limit, 3 band 2 is a limit, 4 both are. Needs mag1, mag2, m5_1, m5_2.
    """
    a, b, m1, m2 = (F.col(c) for c in ("mag1", "mag2", "m5_1", "m5_2"))
    known = a.isNotNull() & b.isNotNull()
    d1, d2 = a <= m1, b <= m2
    status = F.when(~known, 0).when(d1 & d2, 1).when(d2, 2).when(d1, 3).otherwise(4)
    inf = F.lit(float("inf"))
    d = colours.withColumn("state", status)
    s = F.col("state")
    return d.withColumns({
        "lower_bound": F.when(s == 1, a - b).when(s == 2, m1 - b).when(s > 0, -inf),
        "upper_bound": F.when(s == 1, a - b).when(s == 3, a - m2).when(s > 0, inf),
    })


STATE_NAMES = {1: "both_detected", 2: "band1_ul_band2_detected", 3: "band1_detected_band2_ul", 4: "both_ul"}


def limit_states(censored: DataFrame, grid: TimeGrid, totals: DataFrame) -> DataFrame:
    """Counts of states per bin for all events and for the envelope population; unknown is the remainder.

    censored carries in_population; totals is one row N_all, N_population.
    """
    a, b = F.col("mag1"), F.col("mag2")
    pop = F.col("in_population")
    aggs = []
    for prefix, cond in (("all", F.lit(True)), ("population", pop)):
        for code, name in STATE_NAMES.items():
            aggs.append(F.count_if(cond & (F.col("state") == code)).alias(f"N_{prefix}_{name}"))
        aggs += [
            F.count_if(cond & (a <= F.col("m5_1"))).alias(f"N_{prefix}_band1_detected"),
            F.count_if(cond & (b <= F.col("m5_2"))).alias(f"N_{prefix}_band2_detected"),
            F.count_if(cond & a.isNotNull()).alias(f"__{prefix}_known1"), F.count_if(cond & b.isNotNull()).alias(f"__{prefix}_known2"),
        ]
    counts = censored.groupBy("bin_index").agg(*aggs)
    d = grid.frame(censored.sparkSession).join(counts, "bin_index", "left").na.fill(0).crossJoin(F.broadcast(totals))
    for prefix in ("all", "population"):
        n = F.col(f"N_{prefix}")
        known = sum((F.col(f"N_{prefix}_{name}") for name in STATE_NAMES.values()), F.lit(0))
        d = d.withColumns({
            f"N_{prefix}_unknown_model": n - known,
            f"N_{prefix}_band1_unknown": n - F.col(f"__{prefix}_known1"),
            f"N_{prefix}_band2_unknown": n - F.col(f"__{prefix}_known2"),
        }).drop(f"__{prefix}_known1", f"__{prefix}_known2")
    sample = F.col("N_population_both_detected") + F.col("N_population_band1_ul_band2_detected")
    return d.withColumns({
        "N_population_lower_bound_sample": sample,
        "fraction_population_lower_bound_sample": F.when(F.col("N_population") > 0, F.try_divide(sample, "N_population")).otherwise(F.lit(0.0)),
        "usable_lower_bound_bin": sample > 0,
    })


def lower_bound_sample(censored: DataFrame) -> DataFrame:
    return censored.where(F.col("in_population") & F.col("state").isin(1, 2))


def lower_bound_rules(censored: DataFrame, grid: TimeGrid, tails=(1.0,), method: str = "select") -> DataFrame:
    """Percentile interval of the lower bound per bin, with the number of limits in it."""
    sample = lower_bound_sample(censored)
    limits = sample.groupBy("bin_index").agg(F.count_if(F.col("state") == 2).alias("N_population_ul"))
    return rules(sample, [], grid, tails, method, "lower_bound").join(limits, "bin_index")


def identification_intervals(censored: DataFrame, grid: TimeGrid, tails=(1.0,)) -> DataFrame:
    """Inverse-ECDF quantiles of the lower and the upper bounds of the same sample."""
    percents = sorted(set([float(t) for t in tails] + [100.0 - t for t in tails] + [50.0]))
    sample = lower_bound_sample(censored)
    sides = sample.select("bin_index", F.explode(F.map_from_arrays(
        F.array(F.lit("lower"), F.lit("upper")), F.array("lower_bound", "upper_bound"))).alias("side", "bound"))
    q = nearest_rank(sides, ["bin_index", "side"], "bound", percents, "n", "q")
    long = q.select("bin_index", "side", "n", F.posexplode("q").alias("pos", "v")).withColumn(
        "percentile", F.element_at(F.array(*[F.lit(p) for p in percents]), F.col("pos") + 1)
    )
    both = long.groupBy("bin_index", "percentile").agg(
        F.max("n").alias("N_population_events"),
        F.max(F.when(F.col("side") == "lower", F.col("v"))).alias("colour_quantile_lower"),
        F.max(F.when(F.col("side") == "upper", F.col("v"))).alias("colour_quantile_upper"),
    )
    return grid.with_times(both).withColumn("upper_is_finite", F.col("colour_quantile_upper") < F.lit(float("inf")))


def horizon(states: DataFrame, grid: TimeGrid) -> DataFrame:
    """First and last usable bin, last bin with a detection per band, and whether they reach the end."""
    use, i = F.col("usable_lower_bound_bin"), F.col("bin_index")
    last = grid.n - 1
    seen = lambda b: F.max(F.when(F.col(f"N_all_{b}_detected") > 0, i))
    return states.agg(
        F.min(F.when(use, F.col("t_min_days"))).alias("first_supported_edge_days"),
        F.max(F.when(use, F.col("t_max_days"))).alias("supported_until_edge_days"),
        F.coalesce(F.max(F.when(use, i)) == last, F.lit(False)).alias("support_reaches_grid_end"),
        F.max(F.when(F.col("N_all_band1_detected") > 0, F.col("t_center_days"))).alias("last_band1_detection_days"),
        F.coalesce(seen("band1") == last, F.lit(False)).alias("band1_reaches_grid_end"),
        F.max(F.when(F.col("N_all_band2_detected") > 0, F.col("t_center_days"))).alias("last_band2_detection_days"),
        F.coalesce(seen("band2") == last, F.lit(False)).alias("band2_reaches_grid_end"),
    )


def without_colour_rows(objects: DataFrame, lightcurves: DataFrame, bands: list[str]) -> DataFrame:
    """Objects that have no row in any requested band."""
    return objects.join(lightcurves.where(F.col("band").isin(bands)).select("event_id"), "event_id", "left_anti")
