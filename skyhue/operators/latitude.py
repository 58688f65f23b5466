"""Losses to survey depth and dust by sky latitude, their rates and plateaus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from skyhue.functions import checks, columns as C

COMPONENTS = ("m5_only", "additional_mw_given_m5", "combined")
WILSON_Z = 1.959963984540054


def _one():
    """Window over a whole table of parameters (cuts or latitude bins), never of events."""
    return W.partitionBy(F.lit(0))



def _usable() -> Column:
    dust = C.to_double("ebv_mw")
    return F.coalesce(C.to_double("abs_b_deg").between(0, 90) & dust.isNotNull() & (F.abs(dust) < float("inf")), F.lit(False))


def excluded_objects(objects: DataFrame) -> DataFrame:
    """One row: objects, and those that loss counts leave out for want of a latitude or an E(B-V)."""
    return objects.agg(F.count("*").alias("n_objects"), F.count_if(_usable()).alias("n_used"), F.count_if(~_usable()).alias("n_excluded"))


def loss_counts(colours: DataFrame, objects: DataFrame, seen: DataFrame, band1: str, band2: str, system: str = "lsst") -> DataFrame:
    """Per object: bins with a colour, within depth, and within depth behind dust; every object has a row.

    Objects without a latitude or an E(B-V) are left out (see excluded_objects); a negative E(B-V) stops the query.

    colours: event_id, sel1, sel2, color, m5_1, m5_2; objects: event_id, abs_b_deg, ebv_mw; seen: event_id of saved rows.
    The attenuation joins the per-event sums only through the events' own rows, so the population is shuffled once.
    """
    own = "lsst" if system == "ps1" else system
    dust = objects.where(_usable()).select(
        "event_id", "abs_b_deg", "ebv_mw",
        C.attenuation("ebv_mw", F.lit(own), F.lit(band1)).alias("a1"), C.attenuation("ebv_mw", F.lit(own), F.lit(band2)).alias("a2"),
    )
    d = colours.where("color IS NOT NULL").join(dust.select("event_id", "a1", "a2"), "event_id")
    m1, m2 = F.col("sel1"), F.col("sel2")
    no_dust = (m1 <= F.col("m5_1")) & (m2 <= F.col("m5_2"))
    dusty = (m1 + F.col("a1") <= F.col("m5_1")) & (m2 + F.col("a2") <= F.col("m5_2"))
    counts = d.groupBy("event_id").agg(
        F.count("*").alias("N_bins_baseline"), F.count_if(no_dust).alias("N_bins_m5_no_mw"), F.count_if(dusty).alias("N_bins_m5_with_mw")
    )
    has = seen.select("event_id").distinct().withColumn("has_saved_rows", F.lit(True))
    out = dust.drop("a1", "a2").join(counts, "event_id", "left").join(has, "event_id", "left")
    zero = F.lit(0).cast("bigint")
    out = out.withColumns({c: F.coalesce(c, zero) for c in ("N_bins_baseline", "N_bins_m5_no_mw", "N_bins_m5_with_mw")})
    b, n, w = (F.col(c) for c in ("N_bins_baseline", "N_bins_m5_no_mw", "N_bins_m5_with_mw"))
    fine = F.when((w <= n) & (n <= b), b - w).otherwise(F.raise_error(F.lit("dust increased availability")).cast("bigint"))
    return out.withColumns({
        "has_saved_rows": F.coalesce("has_saved_rows", F.lit(False)),
        "has_any_baseline": b > 0, "has_any_m5_no_mw": n > 0, "has_any_m5_with_mw": w > 0,
        "N_bins_lost_m5_only": b - n, "N_bins_lost_additional_mw_given_m5": n - w, "N_bins_lost_combined": fine,
    })


def _sums() -> list[Column]:
    yes = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return [
        F.count("*").alias("N_injected"), yes("has_any_baseline").alias("N_events_with_baseline_color"),
        yes("has_any_m5_no_mw").alias("N_events_m5_no_mw"), yes("has_any_m5_with_mw").alias("N_events_m5_with_mw"),
        total("N_bins_baseline").alias("N_event_bin_opportunities"), total("N_bins_m5_no_mw").alias("N_bins_m5_no_mw"),
        total("N_bins_m5_with_mw").alias("N_bins_m5_with_mw"),
    ]


SUM_NAMES = (
    "N_injected", "N_events_with_baseline_color", "N_events_m5_no_mw", "N_events_m5_with_mw",
    "N_event_bin_opportunities", "N_bins_m5_no_mw", "N_bins_m5_with_mw",
)


def wilson(success: Column, total: Column) -> tuple[Column, Column]:
    z = F.lit(WILSON_Z)
    p = F.try_divide(success, total)
    denominator = 1 + z * z / F.nullif(total, F.lit(0))
    centre = F.try_divide(p + F.try_divide(z * z, 2 * total), denominator)
    spread = z / denominator * F.sqrt(F.try_divide(p * (1 - p), total) + F.try_divide(z * z, 4 * total * total))
    return centre - spread, centre + spread


def rate_ratio_interval(lost_low, total_low, lost_high, total_high) -> tuple[Column, Column]:
    a, na, b, nb = (C.col(c).cast("double") for c in (lost_low, total_low, lost_high, total_high))
    ok = F.least(a, na, b, nb) > 0
    safe = lambda x: F.when(ok, x)
    rr = safe(F.try_divide(F.try_divide(a, na), F.try_divide(b, nb)))
    se = safe(F.sqrt(F.try_divide(F.lit(1.0), a) - F.try_divide(F.lit(1.0), na) + F.try_divide(F.lit(1.0), b) - F.try_divide(F.lit(1.0), nb)))
    return rr * F.exp(-1.96 * se), rr * F.exp(1.96 * se)


def _losses(d: DataFrame, prefix: str = "") -> DataFrame:
    """Losses and rates of each component from the seven sums; undefined rates are NULL."""
    c = lambda n: F.col(prefix + n)
    ev, e5, eb = c("N_events_with_baseline_color"), c("N_events_m5_no_mw"), c("N_events_m5_with_mw")
    bins, b5, bb = c("N_event_bin_opportunities"), c("N_bins_m5_no_mw"), c("N_bins_m5_with_mw")
    lost = {"event": (ev - e5, e5 - eb, ev - eb), "bin": (bins - b5, b5 - bb, bins - bb)}
    out = {}
    for i, k in enumerate(COMPONENTS):
        out[f"{prefix}event_loss_{k}"], out[f"{prefix}bin_loss_{k}"] = lost["event"][i], lost["bin"][i]
        out[f"{prefix}event_loss_rate_{k}"] = F.try_divide(lost["event"][i], ev)
        out[f"{prefix}bin_loss_rate_{k}"] = F.try_divide(lost["bin"][i], bins)
        lo, hi = wilson(lost["event"][i], ev)
        out[f"{prefix}event_loss_rate_{k}_ci95_low"], out[f"{prefix}event_loss_rate_{k}_ci95_high"] = lo, hi
        out[f"{prefix}event_loss_fraction_all_injected_{k}"] = F.try_divide(lost["event"][i], c("N_injected"))
    out[f"{prefix}event_mw_penalty_given_m5"] = F.try_divide(e5 - eb, e5)
    out[f"{prefix}bin_mw_penalty_given_m5"] = F.try_divide(b5 - bb, b5)
    out[f"{prefix}baseline_color_fraction_all_injected"] = F.try_divide(ev, c("N_injected"))
    return d.withColumns(out)


def metrics(events: DataFrame, keys: list[str] = ()) -> DataFrame:
    return _losses(events.groupBy(*keys).agg(*_sums()))


def by_bin(events: DataFrame, width: float = 5.0) -> DataFrame:
    """Metrics per latitude bin, the last one closed at 90; empty bins kept."""
    n = -int(-90.0 // width)
    b = F.col("abs_b_deg")
    guess = F.floor(b / F.lit(width)).cast("int")
    i = F.when(b >= 90.0, F.lit(n - 1)).otherwise(guess)
    sums = events.where((b >= 0) & (b <= 90)).groupBy(i.alias("lat_bin")).agg(*_sums())
    dense = events.sparkSession.range(n).select(F.col("id").cast("int").alias("lat_bin"))
    d = dense.join(sums, "lat_bin", "left").na.fill(0)
    lo, hi = F.col("lat_bin") * F.lit(float(width)), F.least(F.lit(90.0), (F.col("lat_bin") + 1) * F.lit(float(width)))
    return _losses(d).withColumns({"b_min_deg": lo, "b_max_deg": hi, "b_center_deg": (lo + hi) / 2})


def _cumulative(events: DataFrame, cuts: list[float]) -> DataFrame:
    """Sums below and from each cut on, from one pass: counts per interval between cuts, then a running sum over the cuts."""
    edges = sorted(float(c) for c in cuts)
    # the boundary belongs to the high side: interval k holds |b| with exactly k cuts at or below it
    k = sum(((F.col("abs_b_deg") >= e).cast("int") for e in edges), F.lit(0))
    per = events.groupBy(k.alias("cell")).agg(*_sums())
    cells = events.sparkSession.createDataFrame([(i, e) for i, e in enumerate([*edges, None])], "cell int, threshold_deg double")
    d = cells.join(per, "cell", "left").na.fill(0, list(SUM_NAMES))
    run = _one().orderBy("cell").rowsBetween(W.unboundedPreceding, 0)
    total = _one().orderBy("cell").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    d = d.withColumns({f"low_{n}": F.sum(n).over(run) for n in SUM_NAMES} | {f"__t_{n}": F.sum(n).over(total) for n in SUM_NAMES})
    d = d.withColumns({f"high_{n}": F.col(f"__t_{n}") - F.col(f"low_{n}") for n in SUM_NAMES})
    return d.where("threshold_deg IS NOT NULL").drop("cell", *SUM_NAMES, *[f"__t_{n}" for n in SUM_NAMES])


def cut_scan(events: DataFrame, cuts: list[float], minimum_events: int = 1) -> DataFrame:
    """Low against high latitude for each cut: rates, ratios and the log rate-ratio interval."""
    d = _losses(_losses(_cumulative(events, cuts), "low_"), "high_")
    eligible = (F.col("low_N_events_with_baseline_color") >= minimum_events) & (F.col("high_N_events_with_baseline_color") >= minimum_events)
    d = d.withColumn("eligible_min_events", eligible)
    out = {}
    for k in COMPONENTS:
        for level in ("event", "bin"):
            ratio = F.try_divide(f"low_{level}_loss_rate_{k}", f"high_{level}_loss_rate_{k}")
            out[f"{level}_low_over_high_{k}"] = F.when(F.col("eligible_min_events"), ratio)
        lo, hi = rate_ratio_interval(
            f"low_event_loss_{k}", "low_N_events_with_baseline_color", f"high_event_loss_{k}", "high_N_events_with_baseline_color"
        )
        out[f"event_low_over_high_{k}_ci95_low"] = F.when(F.col("eligible_min_events"), lo)
        out[f"event_low_over_high_{k}_ci95_high"] = F.when(F.col("eligible_min_events"), hi)
    return d.withColumns(out)


def plateau_absolute(scan: DataFrame, column: str, tolerance: float = 0.02, minimum: int = 3) -> DataFrame:
    """First cut from which the column stays within a tolerance of the median of its last ``minimum`` values."""
    v = scan.where(F.col("eligible_min_events") & F.col(column).isNotNull()).select("threshold_deg", F.col(column).alias("v"))
    desc = F.row_number().over(_one().orderBy(F.desc("threshold_deg")))
    d = v.withColumn("from_end", desc)
    ref = d.where(F.col("from_end") <= minimum).agg(F.median("v").alias("reference_value"))
    d = d.crossJoin(F.broadcast(ref)).withColumn("diff", F.abs(F.col("v") - F.col("reference_value")))
    d = d.withColumn("tail_max", F.max("diff").over(_one().orderBy("threshold_deg").rowsBetween(W.currentRow, W.unboundedFollowing)))
    ok = (F.col("from_end") >= minimum) & (F.col("tail_max") <= tolerance)
    s = d.agg(
        F.count("*").alias("n"), F.max(F.abs("v")).alias("largest"), F.max("reference_value").alias("reference_value"),
        F.min(F.when(ok, F.col("threshold_deg"))).alias("candidate_deg"), F.max(F.when(ok, F.col("from_end"))).cast("bigint").alias("n_remaining"),
    )
    few, silent = F.col("n") < minimum, F.col("largest") == 0
    quiet = few | silent
    return s.select(
        F.when(few, "insufficient_valid_thresholds").when(silent, "no_measurable_signal")
        .when(F.col("candidate_deg").isNotNull(), "heuristic_candidate").otherwise("no_stable_plateau").alias("status"),
        F.when(~quiet, F.col("candidate_deg")).alias("candidate_deg"),
        F.when(~few, F.col("reference_value")).alias("reference_value"),
        F.when(~quiet, F.col("n_remaining")).alias("n_remaining_thresholds"),
    )


def tails(table: DataFrame, index: str, value: str) -> DataFrame:
    """For each start: its tail's length, completeness, smallest value, median and largest relative deviation.

    The table has one row per cut or latitude bin (at most a hundred), so the tails are a self-join of parameters.
    """
    a = table.select(F.col(index).alias("start"))
    b = table.select(F.col(index).alias("__j"), F.col(value).alias("__v"))
    t = a.join(F.broadcast(b), F.col("__j") >= F.col("start"))
    per = t.groupBy("start").agg(
        F.count("*").alias("n_tail"), F.count("__v").alias("n_known"), F.min("__v").alias("tail_min"),
        F.median("__v").alias("tail_median"), F.max("__v").alias("tail_max"),
    )
    # the extreme relative deviations lie at the smallest and the largest value
    m = F.col("tail_median")
    worst = F.greatest(F.abs(F.try_divide("tail_max", m) - 1), F.abs(F.try_divide("tail_min", m) - 1))
    return per.withColumn("tail_deviation", F.when(m > 0, worst)).withColumnRenamed("start", index)


def plateau_relative(bins: DataFrame, index: str, lower: str, ratio: str, tolerance: float = 0.10, minimum: int = 3) -> DataFrame:
    """First tail, the reference bin excepted, whose positive ratios all lie within a relative tolerance of their median."""
    t = bins.select(index, lower).join(tails(bins, index, ratio), index)
    first = bins.agg(F.min(index).alias("__first"))
    ok = (
        (F.col(index) > F.col("__first")) & (F.col("n_tail") >= minimum) & (F.col("n_known") == F.col("n_tail"))
        & (F.col("tail_min") > 0) & (F.col("tail_deviation") <= tolerance)
    )
    d = t.crossJoin(F.broadcast(first)).where(ok)
    best = F.min(F.struct(F.col(index), F.col(lower).alias("plateau_deg"), F.col("tail_median").alias("level"), F.col("tail_deviation").alias("deviation")))
    return d.agg(best.alias("b")).select("b.plateau_deg", "b.level", "b.deviation")


def outcomes(events: DataFrame) -> DataFrame:
    """baseline, depth loss and extra dust loss per event."""
    b = F.col("N_bins_baseline") > 0
    return events.withColumns({
        "baseline": b, "m5_loss": b & (F.col("N_bins_m5_no_mw") == 0),
        "mw_loss": b & (F.col("N_bins_m5_no_mw") > 0) & (F.col("N_bins_m5_with_mw") == 0),
    })


def paired_bins(events: DataFrame, bin_column: str, lower: str) -> DataFrame:
    """Counts, rates and ratios to the lowest bin, of events with counts or of ``paired_outcomes``."""
    d = events if {"baseline", "m5_loss", "mw_loss"} <= set(events.columns) else outcomes(events)
    o = d.groupBy(bin_column, lower).agg(
        F.count_if("baseline").alias("n_baseline"), F.count_if("m5_loss").alias("n_m5_loss"), F.count_if("mw_loss").alias("n_mw_loss")
    ).withColumn("n_total_loss", F.col("n_m5_loss") + F.col("n_mw_loss"))
    w = _one().orderBy(lower).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    out = {f"rate_{k}": F.try_divide(f"n_{k}", "n_baseline") for k in ("m5_loss", "mw_loss", "total_loss")}
    o = o.withColumns(out)
    return o.withColumns({f"ratio_{k}": F.try_divide(F.col(f"rate_{k}"), F.first(f"rate_{k}").over(w)) for k in ("m5_loss", "mw_loss", "total_loss")})


PAIRED_COLUMNS = ("event_id", "abs_b_deg", "N_bins_baseline", "N_bins_m5_no_mw", "N_bins_m5_with_mw")
EDGE = 1e-8


def paired_outcomes(bins: list[tuple[float, float, DataFrame]], minimum_bins: int = 4) -> DataFrame:
    """event_id, bin_index, lower_deg, upper_deg, baseline, m5_loss, mw_loss from one table for each latitude bin (lower, upper, table) of the same events.

    Intervals lie in 0 to 90 degrees and join without a gap; each table has PAIRED_COLUMNS, finite numbers with N_with_mw <= N_no_mw <= N_baseline,
    latitudes inside its interval (open above, but closed at 90), and every event once. What can be told from the arguments raises at the call, the rest stops the
    query: all tables go through one aggregate by event, which counts the event's rows in each bin and keeps its outcomes.
    """
    if len(bins) < minimum_bins:
        raise ValueError(f"need at least {minimum_bins} latitude bins")
    bins = sorted(bins, key=lambda b: b[0])
    for lower, upper, table in bins:
        if not 0.0 <= lower < upper <= 90.0:
            raise ValueError(f"no latitude interval: [{lower}, {upper})")
        checks.require_columns(table, *PAIRED_COLUMNS)
    for (_, upper, _), (lower, _, _) in zip(bins, bins[1:]):
        if abs(upper - lower) > EDGE:
            raise ValueError(f"latitude bins must join: one ends at {upper}, the next begins at {lower}")
    parts = []
    for k, (lower, upper, table) in enumerate(bins):
        d = table.select(F.col("event_id"), *[C.to_double(c).alias(c) for c in PAIRED_COLUMNS[1:]])
        b, n0, n1, n2 = (F.col(c) for c in PAIRED_COLUMNS[1:])
        here = f"[{lower:g}, {upper:g}"
        known = F.col("event_id").isNotNull()
        for c in (b, n0, n1, n2):
            known = known & c.isNotNull() & (F.abs(c) < float("inf"))
        d = checks.guard_rows(d, known, f"empty event_id or number in the table of {here}")
        d = checks.guard_rows(d, (n2 <= n1) & (n1 <= n0), f"expected N_bins_m5_with_mw <= N_bins_m5_no_mw <= N_bins_baseline in {here}")
        above = b <= upper + EDGE if upper > 90.0 - EDGE else b < upper + EDGE
        d = checks.guard_rows(d, (b >= lower - EDGE) & above, F.concat(F.lit(f"an object of {here} lies at "), b.cast("string")))
        parts.append(outcomes(d).select("event_id", F.lit(k).alias("bin_index"), F.struct("baseline", "m5_loss", "mw_loss").alias("o")))
    per = reduce(DataFrame.unionByName, parts).groupBy("event_id")
    at = [F.col("bin_index") == k for k in range(len(bins))]
    d = per.agg(*[F.count_if(a).alias(f"n{k}") for k, a in enumerate(at)], *[F.max(F.when(a, F.col("o"))).alias(f"o{k}") for k, a in enumerate(at)])
    for k, (lower, upper, _) in enumerate(bins):
        text = F.concat(F.lit("event "), F.col("event_id").cast("string"))
        d = checks.guard_rows(d, F.col(f"n{k}") > 0, F.concat(text, F.lit(f" is missing from [{lower:g}, {upper:g}")))
        d = checks.guard_rows(d, F.col(f"n{k}") == 1, F.concat(text, F.lit(f" is repeated in [{lower:g}, {upper:g}")))
    rows = F.array(*[F.struct(F.lit(k).alias("bin_index"), F.lit(float(lo)).alias("lower_deg"), F.lit(float(up)).alias("upper_deg"), F.col(f"o{k}").alias("o")) for k, (lo, up, _) in enumerate(bins)])
    return d.select("event_id", F.explode(rows).alias("r")).select("event_id", "r.bin_index", "r.lower_deg", "r.upper_deg", "r.o.*")


def paired_table(bins: DataFrame, plateau: DataFrame, lower: str) -> DataFrame:
    """Percent table of paired bins: rate, ratio, reduction, plateau mark."""
    return bins.crossJoin(F.broadcast(plateau)).select(
        F.col(lower), "n_baseline", "n_mw_loss", (100 * F.col("rate_mw_loss")).alias("mw_loss_percent"), F.col("ratio_mw_loss"),
        (100 * (1 - F.col("ratio_mw_loss"))).alias("reduction_percent"), "ratio_m5_loss", "ratio_total_loss",
        F.coalesce(F.abs(F.col(lower) - F.col("plateau_deg")) < 1e-9, F.lit(False)).alias("is_plateau_start"),
    )


def moving_cut(events: DataFrame, cuts: list[float]) -> DataFrame:
    """Counts on both sides of each cut and Q, the high rate of extra dust loss over the low one; a cut's own value is high."""
    edges = sorted(float(c) for c in cuts)
    o = outcomes(events).where("baseline")
    k = sum(((F.col("abs_b_deg") >= e).cast("int") for e in edges), F.lit(0))
    per = o.groupBy(k.alias("cell")).agg(F.count("*").alias("n"), F.count_if("m5_loss").alias("m5"), F.count_if("mw_loss").alias("mw"))
    cells = events.sparkSession.createDataFrame([(i, e) for i, e in enumerate([*edges, None])], "cell int, cut_deg double")
    d = cells.join(per, "cell", "left").na.fill(0, ["n", "m5", "mw"])
    run = _one().orderBy("cell").rowsBetween(W.unboundedPreceding, 0)
    total = _one().orderBy("cell").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    d = d.withColumns({f"{c}_low": F.sum(c).over(run) for c in ("n", "m5", "mw")} | {f"{c}_high": F.sum(c).over(total) - F.sum(c).over(run) for c in ("n", "m5", "mw")})
    return with_q(d.where("cut_deg IS NOT NULL").drop("cell", "n", "m5", "mw"))


def pair_counts(low: DataFrame, high: DataFrame) -> DataFrame:
    """Counts from separate low and high populations, one pair per ``cut_deg``; an event on the wrong side is an error."""
    def side(events, name, ok):
        checked = F.when(ok, F.col("abs_b_deg")).otherwise(F.raise_error(F.lit(f"event on the wrong side of its cut: {name}")).cast("double"))
        o = outcomes(events).where("baseline").withColumn("__b", checked)
        return o.groupBy("cut_deg").agg(
            F.count("__b").alias(f"n_{name}"), F.count_if("m5_loss").alias(f"m5_{name}"), F.count_if("mw_loss").alias(f"mw_{name}")
        )
    a = side(low, "low", F.col("abs_b_deg") < F.col("cut_deg"))
    b = side(high, "high", F.col("abs_b_deg") >= F.col("cut_deg"))
    return with_q(a.join(b, "cut_deg"))


def with_q(counts: DataFrame) -> DataFrame:
    d = counts.withColumns({
        "rate_low": F.try_divide("mw_low", "n_low"), "rate_high": F.try_divide("mw_high", "n_high"),
    })
    return d.withColumn("q_high_over_low", F.try_divide("rate_high", "rate_low"))


def assess_plateau(scan: DataFrame, tolerance: float = 0.10, minimum_points: int = 3, minimum_span: float = 10.0) -> DataFrame:
    """Per cut: does its whole tail of Q stay within a relative tolerance of the tail's median, over enough cuts and degrees."""
    t = scan.join(tails(scan, "cut_deg", "q_high_over_low"), "cut_deg")
    top = scan.agg(F.max("cut_deg").alias("__top"))
    d = t.crossJoin(F.broadcast(top))
    enough = (F.col("n_tail") >= minimum_points) & (F.col("__top") - F.col("cut_deg") >= minimum_span)
    complete = F.col("n_known") == F.col("n_tail")
    fits = F.coalesce((F.col("tail_min") >= 0) & (F.col("tail_deviation") <= tolerance), F.lit(False))
    d = d.withColumns({
        "status": F.when(~enough, "span_too_short").when(~complete, "undefined_ratio").when(fits, "plateau").otherwise("outside_tolerance"),
        "deviation": F.when(enough & complete, F.col("tail_deviation")),
        "reduction": 1 - F.col("q_high_over_low"),
    })
    first = F.min(F.when(F.col("status") == "plateau", F.col("cut_deg"))).over(_one())
    return d.withColumn("is_selected", F.coalesce(F.col("cut_deg") == first, F.lit(False))).drop("n_known", "tail_min", "tail_max", "__top")


def same_configuration(configs: DataFrame, names: list[str]) -> DataFrame:
    """parameter, number of distinct values, consistent. configs: one row per input."""
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("parameter"), F.col(n).cast("string").alias("v")) for n in names]))
    return configs.select(rows.alias("r")).select("r.*").groupBy("parameter").agg(
        F.count_distinct("v").alias("n_values")
    ).withColumn("consistent", F.col("n_values") <= 1)
