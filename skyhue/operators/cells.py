"""Colour over a grid of two physical parameters, per time bin."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from skyhue.functions.columns import col
from skyhue.operators.grid import TimeGrid
from skyhue.operators.quantiles import exact_quantiles

# Parameters derived from a stored column.
DERIVED = {
    "mej_dyn": ("log10_mej_dyn", "power"), "mej_wind": ("log10_mej_wind", "power"),
    "inclination_deg": ("inclination_EM", "degrees"), "cos_inclination": ("inclination_EM", "cosine"),
}


def parameter(objects: DataFrame, name: str) -> Column:
    """A stored or derived physical parameter."""
    if name in objects.columns:
        return F.col(name).cast("double")
    if name not in DERIVED or DERIVED[name][0] not in objects.columns:
        raise ValueError(f"no parameter {name!r}")
    source, kind = DERIVED[name]
    c = F.col(source).cast("double")
    return {"power": F.pow(F.lit(10.0), c), "degrees": F.degrees(c), "cosine": F.cos(c)}[kind]


def domains(objects: DataFrame, names: list[str]) -> DataFrame:
    """parameter, low, high; a constant parameter is an error."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("parameter"), parameter(objects, n).alias("v")) for n in names]))
    d = objects.select(pairs.alias("p")).select("p.*").where("v IS NOT NULL").groupBy("parameter").agg(
        F.min("v").alias("low"), F.max("v").alias("high")
    )
    bad = F.raise_error(F.concat(F.lit("constant parameter "), F.col("parameter"))).cast("double")
    return d.withColumn("high", F.when(F.col("high") > F.col("low"), F.col("high")).otherwise(bad))


def display_domain(mode: str, sampled: tuple[float, float], bounds: tuple[float, float] | None, name: str):
    """Axis limits: the sampled range, or the model's own validity range mapped to the shown parameter."""
    if mode == "sample" or bounds is None:
        return sampled
    kind = DERIVED.get(name, (None, None))[1]
    if kind == "power":
        return tuple(10.0 ** b for b in bounds)
    if kind == "degrees":
        return tuple(math.degrees(b) for b in bounds)
    if kind == "cosine":
        return tuple(sorted(math.cos(b) for b in bounds))
    return tuple(bounds)


def cell_of(value, lo, hi, n: int) -> Column:
    """Index of a regular cell, the last one closed; NULL outside."""
    v, lo, hi = col(value), col(lo), col(hi)
    w = (hi - lo) / F.lit(n)
    guess = F.floor((v - lo) / w).cast("int")
    edge = lambda i: lo + i.cast("double") * w
    i = guess + F.when(v >= edge(guess + 1), 1).otherwise(0) - F.when(v < edge(guess), 1).otherwise(0)
    i = F.when((i >= n) & (v <= hi), F.lit(n - 1)).otherwise(i)
    return F.when((i >= 0) & (i < n), i.cast("int"))


def cell_grid(
    values: DataFrame, x_range: DataFrame, y_range: DataFrame, n_x: int, n_y: int, keys: list[str], method: str = "select",
) -> DataFrame:
    """Occupied cells: count and p16, p50, p84 of colour. values: keys, x, y, color; ranges: one row low, high."""
    xr = x_range.select(F.col("low").alias("__x0"), F.col("high").alias("__x1"))
    yr = y_range.select(F.col("low").alias("__y0"), F.col("high").alias("__y1"))
    d = values.where("x IS NOT NULL AND y IS NOT NULL AND color IS NOT NULL").crossJoin(F.broadcast(xr)).crossJoin(F.broadcast(yr))
    d = d.select(*keys, cell_of("x", "__x0", "__x1", n_x).alias("ix"), cell_of("y", "__y0", "__y1", n_y).alias("iy"), "color")
    q = exact_quantiles(d.where("ix IS NOT NULL AND iy IS NOT NULL"), [*keys, "ix", "iy"], "color", [16.0, 50.0, 84.0], method, "N_cell", "q")
    return q.select(*keys, "ix", "iy", "N_cell", *[F.col("q")[i].alias(f"colour_p{p}") for i, p in enumerate((16, 50, 84))])


def dense_grid(cells: DataFrame, groups: DataFrame, n_x: int, n_y: int, keys: list[str]) -> DataFrame:
    """All cells of every group; groups, cells and bins are parameters."""
    ix = F.explode(F.sequence(F.lit(0), F.lit(n_x - 1))).alias("ix")
    iy = F.explode(F.sequence(F.lit(0), F.lit(n_y - 1))).alias("iy")
    d = groups.select(*keys, ix).select(*keys, "ix", iy).join(cells, [*keys, "ix", "iy"], "left")
    n = F.coalesce("N_cell", F.lit(0).cast("bigint"))
    return d.withColumns({"N_cell": n, "cell_supported": n > 0})


def smooth(dense: DataFrame, keys: list[str], n_x: int, n_y: int, sigma: float, value: str = "colour_p50") -> DataFrame:
    """Support-aware Gaussian smoothing: weighted sums of value and support, edges clamped, empty cells stay empty."""
    radius = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    kernel = [w / sum(raw) for w in raw]
    offsets = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in zip(range(-radius, radius + 1), kernel)]))
    base = dense.select(
        *keys, "ix", "iy", F.coalesce(F.when(F.col("cell_supported"), F.col(value)), F.lit(0.0)).alias("num"),
        F.col("cell_supported").cast("double").alias("den"),
    )

    def along(df: DataFrame, axis: str, n: int) -> DataFrame:
        other = "iy" if axis == "ix" else "ix"
        wanted = dense.select(*keys, F.col(axis).alias("target"), other, offsets.alias("o")).select(
            *keys, "target", other, F.greatest(F.lit(0), F.least(F.lit(n - 1), F.col("target") + F.col("o.k"))).alias(axis), F.col("o.w").alias("w")
        )
        return wanted.join(df, [*keys, axis, other]).groupBy(*keys, "target", other).agg(
            F.sum(F.col("w") * F.col("num")).alias("num"), F.sum(F.col("w") * F.col("den")).alias("den")
        ).withColumnRenamed("target", axis)

    done = along(along(base, "ix", n_x), "iy", n_y)
    ratio = F.when(F.col("cell_supported") & (F.col("den") > 1e-8), F.try_divide("num", "den"))
    return dense.join(done, [*keys, "ix", "iy"]).withColumn("smoothed_colour_p50", ratio).drop("num", "den")


def grid_table(dense: DataFrame, x_range: DataFrame, y_range: DataFrame, n_x: int, n_y: int, grid: TimeGrid) -> DataFrame:
    """Dense cells with their edges, centres and widths."""
    d = dense.crossJoin(F.broadcast(x_range.select(F.col("low").alias("x0"), F.col("high").alias("x1"))))
    d = d.crossJoin(F.broadcast(y_range.select(F.col("low").alias("y0"), F.col("high").alias("y1"))))
    xw, yw = (F.col("x1") - F.col("x0")) / n_x, (F.col("y1") - F.col("y0")) / n_y
    d = d.withColumns({
        "x_low": F.col("x0") + F.col("ix") * xw, "x_high": F.col("x0") + (F.col("ix") + 1) * xw,
        "y_low": F.col("y0") + F.col("iy") * yw, "y_high": F.col("y0") + (F.col("iy") + 1) * yw,
        "colour_p16_p84_width": F.col("colour_p84") - F.col("colour_p16"),
    }).drop("x0", "x1", "y0", "y1")
    d = d.withColumns({"x_center": 0.5 * (F.col("x_low") + F.col("x_high")), "y_center": 0.5 * (F.col("y_low") + F.col("y_high"))})
    return grid.with_times(d) if "bin_index" in d.columns else d


def grid_summary(dense: DataFrame, keys: list[str]) -> DataFrame:
    return dense.groupBy(*keys).agg(
        F.sum("N_cell").alias("N_stage_available"), F.count_if("cell_supported").alias("N_supported_cells")
    )


def selection_bias(staged: DataFrame, grid: TimeGrid, method: str = "select") -> DataFrame:
    """Colour percentiles before and after the depth cut per bin, retained share and median shift; empty bins kept."""
    q = exact_quantiles(staged, ["stage", "bin_index"], "color", [16.0, 50.0, 84.0], method, "n", "q")
    side = lambda s, c: F.max(F.when(F.col("stage") == s, c))
    wide = q.groupBy("bin_index").agg(
        side("no_m5", F.col("n")).alias("n0"), side("m5", F.col("n")).alias("n1"),
        *[side(s, F.col("q")[i]).alias(f"{s}_colour_p{p}") for s in ("no_m5", "m5") for i, p in enumerate((16, 50, 84))],
    )
    d = grid.frame(staged.sparkSession).join(wide, "bin_index", "left")
    zero = F.lit(0).cast("bigint")
    return d.withColumns({"N_model_supported": F.coalesce("n0", zero), "N_m5_selected": F.coalesce("n1", zero)}).withColumns({
        "m5_retained_fraction": F.try_divide("N_m5_selected", "N_model_supported"),
        "median_shift_m5_minus_no_m5": F.col("m5_colour_p50") - F.col("no_m5_colour_p50"),
    }).drop("n0", "n1")


def bounds_at(rules: DataFrame, times: list[float]) -> DataFrame:
    """Bounds of the bin that holds each requested time: ``[lo, hi)``, the end of the table closed; none is NULL, two an error.

    rules: t_min_days, t_max_days, color_min, color_max.
    """
    spark = rules.sparkSession
    end = rules.agg(F.max("t_max_days").alias("end"))
    asked = spark.createDataFrame([(float(t),) for t in times], "time_days double").crossJoin(F.broadcast(end))
    t, lo, hi, e = F.col("time_days"), F.col("t_min_days"), F.col("t_max_days"), F.col("end")
    at_end = F.abs(t - e) <= 1e-10
    match = F.when(at_end, (hi == e) & (lo <= t)).otherwise((lo <= t) & (hi > t))
    r = rules.select("t_min_days", "t_max_days", "color_min", "color_max")
    d = asked.join(F.broadcast(r), match, "left").groupBy("time_days").agg(
        F.count("t_min_days").alias("n"), F.max("color_min").alias("color_min"), F.max("color_max").alias("color_max")
    )
    one = F.when(F.col("n") > 1, F.raise_error(F.lit("several bins hold the time")).cast("boolean")).otherwise(F.col("n") == 1)
    ok = one & (F.col("color_min") <= F.col("color_max"))
    return d.select(
        "time_days", F.when(ok, F.col("color_min")).alias("color_min"), F.when(ok, F.col("color_max")).alias("color_max"),
        F.when(F.coalesce(ok, F.lit(False)), "valid").otherwise("missing_or_invalid").alias("bounds_status"),
    )


def profile_bounds(profile: DataFrame, low: float = 5.0, high: float = 95.0, repetition: int = 0) -> DataFrame:
    """Bounds table of a profile: one repetition, its largest size, two percentiles as color_min and color_max."""
    d = profile.where(F.col("repetition") == repetition)
    top = d.agg(F.max("sample_size").alias("__m"))
    d = d.crossJoin(F.broadcast(top)).where(F.col("sample_size") == F.col("__m")).where("valid")
    pick = lambda q: F.max(F.when(F.col("percentile") == q, F.col("value")))
    return d.groupBy("bin_index", "t_min_days", "t_max_days").agg(pick(low).alias("color_min"), pick(high).alias("color_max"))


def fixed_levels(start: float, stop: float, step: float) -> list[float]:
    if step <= 0 or stop < start:
        raise ValueError("need start <= stop and step > 0")
    n = math.ceil((stop + 0.5 * step - start) / step)
    return [0.0 if abs(start + i * step) <= 1e-12 else start + i * step for i in range(n)]


def levels(bounds: DataFrame, step: float) -> DataFrame:
    """Contour levels rounded out from valid bounds; an invalid bound has none."""
    lo, hi = F.floor(F.col("color_min") / step), F.ceil(F.col("color_max") / step)
    values = F.transform(
        F.sequence(lo, hi), lambda i: F.when(F.abs(i * F.lit(step)) <= 1e-12, F.lit(0.0)).otherwise(i * F.lit(step))
    )
    return bounds.withColumn("levels", F.when(F.col("bounds_status") == "valid", values).otherwise(F.array().cast("array<double>")))
