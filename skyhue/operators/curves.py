"""Operators along a light curve: collapse, interpolate, pair, align, stagger.

Input rows: event_id, photometric_system, band, t_days, mag (finite values; NULL = missing).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from skyhue.functions import checks
from skyhue.functions.columns import col
from skyhue.operators import pairing, prominence, ranks, series, skew
from skyhue.operators.grid import TimeGrid
from skyhue.sources import workers

SERIES = ["event_id", "photometric_system", "band"]
EVENT = ["event_id", "photometric_system"]


def collapse(df: DataFrame, keys: list[str] = SERIES, t: str = "t_days", mag: str = "mag") -> DataFrame:
    """One point per (series, time): the median of repeats. Keyed by time, so a long series is spread."""
    return (
        df.where(F.col(t).isNotNull() & F.col(mag).isNotNull())
        .groupBy(*keys, t).agg(F.median(mag).alias(mag))
    )


def _weight(c: Column, t0: Column, t1: Column, how: str) -> Column:
    if how == "log":
        return (F.log10(c) - F.log10(t0)) / (F.log10(t1) - F.log10(t0))
    return (c - t0) / (t1 - t0)


#: Fixed value: days between a lone knot and a centre that it still holds for.
LONE_KNOT = 1e-10


def interpolate(
    df: DataFrame, grid: TimeGrid, how: str = "log", min_knots: int = 1, keys: list[str] = SERIES,
    t: str = "t_days", mag: str = "mag", event_keys: list[str] | None = None,
) -> DataFrame:
    """Magnitudes at the grid centres: keys, bin_index, mag. No extrapolation; unsupported centres give no row.

    Only the first and last knot between two neighbouring centres can matter. They come from one map-side combined
    aggregate per (series, cell), so at most one row per centre and series reaches the per-series window,
    however many points a series has.
    """
    if how not in ("log", "linear"):
        raise ValueError("how is 'log' or 'linear'")
    points = collapse(df.where(F.col(t) > 0) if how == "log" else df, keys, t, mag)
    cells = (
        points.withColumn("__cell", grid.centre_cell(t))
        .groupBy(*keys, "__cell")
        .agg(
            F.min(t).alias("__t0"), F.min_by(mag, t).alias("__m0"),
            F.max(t).alias("__t1"), F.max_by(mag, t).alias("__m1"), F.count("*").alias("__k"),
        )
    )
    # the event keys alone decide the partition, so pairing bands afterwards needs no further shuffle
    cells = cells.repartition(*(event_keys or [k for k in keys if k != "band"]))
    w = W.partitionBy(*keys).orderBy("__cell")
    cells = cells.withColumns({
        "__next_cell": F.lead("__cell").over(w), "__nt": F.lead("__t0").over(w), "__nm": F.lead("__m0").over(w),
    })
    cells = cells.withColumn("__total", F.sum("__k").over(W.partitionBy(*keys)))
    if min_knots > 1:
        cells = cells.where(F.col("__total") >= min_knots)
    # a lone knot holds for a centre within rounding of it, on either side; of several knots none is stretched
    lone = F.col("__total") == 1
    under = lone & (F.col("__cell") > 0) & (F.col("__t1") - grid.centre(F.col("__cell") - 1) <= LONE_KNOT)
    cells = cells.withColumn("__cell", F.when(under, F.col("__cell") - 1).otherwise(F.col("__cell")))
    last = F.least(F.coalesce(F.col("__next_cell") - 1, F.col("__cell")), F.lit(grid.n - 1))
    c = grid.centre(F.col("bin_index"))
    exact = (F.col("__t1") == c) | (lone & (F.abs(F.col("__t1") - c) <= LONE_KNOT))
    # multiplied before it is divided: another order gives other last digits, which a limit or a rounding may show
    at = (lambda x: F.log10(x)) if how == "log" else (lambda x: x)
    t0, t1 = at(F.col("__t1")), at(F.col("__nt"))
    value = F.when(exact, F.col("__m1")).otherwise(
        F.col("__m0_left") + (F.col("__nm") - F.col("__m0_left")) * (at(c) - t0) / (t1 - t0)
    )
    return (
        cells.where((F.col("__cell") < grid.n) & (F.col("__cell") <= last))
        .withColumn("__m0_left", F.col("__m1"))
        .withColumn("bin_index", F.explode(F.sequence(F.col("__cell"), last)))
        .withColumn(mag, value).where(F.col(mag).isNotNull())
        .select(*keys, "bin_index", mag)
    )


def interpolate_at(
    knots: DataFrame, queries: DataFrame, keys: list[str], t: str = "t_days", mag: str = "mag",
    how: str = "log", min_knots: int = 2, chunk_width: float = 1.0, name: str = "mag_interp",
) -> DataFrame:
    """A curve at irregular query times; NULL magnitudes are no knots; outside the knots the result is NULL.

    One union and one as-of scan in both directions (``series.bracket``); no join between knots and queries.
    """
    points = collapse(knots.where(F.col(t) > 0) if how == "log" else knots, keys, t, mag)
    extra = [c for c in queries.columns if c not in keys + [t]]
    query_row = F.struct(*[F.col(c) for c in extra]) if extra else F.struct(F.lit(True).alias("is_query"))
    left = points.select(*keys, t, F.struct(F.col(t).alias("t"), F.col(mag).alias("m")).alias("__knot"))
    right = queries.select(*keys, t, query_row.alias("__query"))
    both = left.unionByName(right, allowMissingColumns=True)
    both = series.bracket(both, keys, [t], "__knot", series.chunk_by(t, chunk_width), "__p", "__f")
    if min_knots > 1:
        counts = points.groupBy(*keys).agg((F.count("*") >= min_knots).alias("__enough"))
        both = both.join(counts, keys, "left")
    else:
        both = both.withColumn("__enough", F.lit(True))
    x = F.col(t)
    usable = F.col("__enough") & F.col("__p").isNotNull() & F.col("__f").isNotNull()
    if how == "log":
        usable = usable & (x > 0)
    y0, y1 = F.col("__p.m"), F.col("__f.m")
    value = F.when(
        usable,
        F.when(F.col("__p.t") == F.col("__f.t"), y0)
        .otherwise(y0 + (y1 - y0) * _weight(x, F.col("__p.t"), F.col("__f.t"), how)),
    )
    return both.where(F.col("__query").isNotNull()).select(
        *keys, t, *([F.col(f"__query.{c}").alias(c) for c in extra]), value.alias(name)
    )


def resample(
    knots: DataFrame, event_keys: list[str], cadence: float, t: str = "t_days", mag: str = "mag", how: str = "log",
    chunk_width: float = 1.0,
) -> DataFrame:
    """Every band of an event on ``first + k*cadence``, the event's last time appended; unsupported times are NULL."""
    keys = [*event_keys, "band"]
    spans = knots.where(F.col(t).isNotNull()).groupBy(*event_keys).agg(
        F.min(t).alias("__lo"), F.max(t).alias("__hi"), F.collect_set("band").alias("__bands")
    )
    steps = F.floor((F.col("__hi") - F.col("__lo")) / F.lit(cadence))
    regular = F.transform(F.sequence(F.lit(0).cast("bigint"), steps), lambda i: F.col("__lo") + F.lit(cadence) * i)
    slack = max(1e-12, 1e-9 * cadence)
    times = F.when(
        F.col("__hi") - (F.col("__lo") + F.lit(cadence) * steps) > slack, F.concat(regular, F.array("__hi"))
    ).otherwise(regular)
    queries = spans.select(*event_keys, "__bands", F.explode(times).alias(t)).select(
        *event_keys, F.explode("__bands").alias("band"), t
    )
    return interpolate_at(knots, queries, keys, t, mag, how, 2, chunk_width, mag)


def native_pairs(df: DataFrame, band1: str, band2: str, keys: list[str] = EVENT, t: str = "t_days") -> DataFrame:
    """Colours at times where both bands have a point."""
    one = lambda b: F.median(F.when(F.col("band") == b, F.col("mag")))
    return (
        df.where(F.col("band").isin(band1, band2) & F.col("mag").isNotNull() & F.col(t).isNotNull())
        .groupBy(*keys, t).agg(one(band1).alias("mag1"), one(band2).alias("mag2"))
        .where("mag1 IS NOT NULL AND mag2 IS NOT NULL")
        .withColumn("color", F.col("mag1") - F.col("mag2"))
    )


def wide_bands(interpolated: DataFrame, bands: dict[str, str], keys: list[str]) -> DataFrame:
    """Band rows to columns ``{name: band}`` by conditional aggregates."""
    return interpolated.groupBy(*keys, "bin_index").agg(
        *[F.max(F.when(F.col("band") == b, F.col("mag"))).alias(n) for n, b in bands.items()]
    )


def to_long(df: DataFrame, bands: dict[str, str], keys: list[str], faint_limit: float | None = None) -> DataFrame:
    """Wide magnitudes (column -> band) to long finite rows, faint values capped."""
    pairs = F.array(*[F.struct(F.lit(b).alias("band"), F.col(c).cast("double").alias("mag"), F.lit(i).alias("band_order"))
                      for i, (c, b) in enumerate(bands.items())])
    out = df.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*")
    out = out.where(F.col("mag").isNotNull() & ~F.isnan("mag") & (F.abs("mag") != float("inf")))
    if faint_limit is not None:
        out = out.withColumn("mag", F.least("mag", F.lit(faint_limit)))
    return out


def rereference(df: DataFrame, references: DataFrame, keys: list[str], reference: str, t: str = "t_days") -> DataFrame:
    """Times relative to a per-key reference time; keys without one are dropped."""
    return (
        df.join(references.select(*keys, F.col(reference).alias("__t0")), keys)
        .where("__t0 IS NOT NULL").withColumn(t, F.col(t) - F.col("__t0")).drop("__t0")
    )


def since_first(df: DataFrame, keys: list[str], t: str) -> DataFrame:
    """Times relative to the first row of the key."""
    return series.key_totals(df, keys, __first=F.min(t)).withColumn(t, F.col(t) - F.col("__first")).drop("__first")


def trim_after_last(df: DataFrame, keys: list[str], t: str, detected: Column, days: float) -> DataFrame:
    """Keeps rows up to the last detection plus ``days``; keys without a detection keep everything."""
    return (
        series.key_totals(df, keys, __last=F.max(F.when(detected, F.col(t))))
        .where(F.col("__last").isNull() | (F.col(t) <= F.col("__last") + F.lit(days))).drop("__last")
    )


def mask_from_first(df: DataFrame, keys: list[str], t: str, bad: Column) -> DataFrame:
    """Drops every row of the key from its first ``bad`` row on."""
    return (
        series.key_totals(df, keys, __first=F.min(F.when(bad, F.col(t))))
        .where(F.col("__first").isNull() | (F.col(t) < F.col("__first"))).drop("__first")
    )


def gaps(df: DataFrame, keys: list[str], t: str, chunk_width: float, tie: list[str] = ()) -> DataFrame:
    """Time since the previous row of the key; rows without one are dropped."""
    out = series.neighbours(df, keys, [t, *tie], [t], series.chunk_by(t, chunk_width), "__p", None)
    return out.where("__p IS NOT NULL").withColumn("gap_days", F.col(t) - F.col(f"__p.{t}")).drop("__p")


def _shifted(df: DataFrame, key: str, t: str, order: list[str], chunk_width: float) -> tuple[DataFrame, Column, Column, Column]:
    """Rows in series, and of each: its place among simultaneous ones (from 0), how many those are, and the next epoch."""
    d = series.scan(df, [key], t, order, series.chunk_by(t, chunk_width))
    return d, F.col("scan.place"), F.col("scan.together"), F.col("scan.next")


def stagger_fixed(
    df: DataFrame, key: str, t: str, order: list[str], seconds: float, chunk_width: float = 1.0,
) -> DataFrame:
    """Simultaneous rows moved apart by a fixed step; ``shift_ok`` is false where a shift reaches the next epoch. Keeps ``scan`` (see ``series.scan``)."""
    d, place, _, following = _shifted(df, key, t, order, chunk_width)
    new = F.col(t) + place * F.lit(seconds / 86400.0)
    return d.withColumns({"t_shifted": new, "shift_ok": following.isNull() | (place == 0) | (new < following)})


def stagger_fit(
    df: DataFrame, key: str, t: str, order: list[str], seconds: float, chunk_width: float = 1.0,
) -> DataFrame:
    """As above, but the step shrinks to ``gap / count`` where the next epoch is near."""
    step = seconds / 86400.0
    d, place, together, following = _shifted(df, key, t, order, chunk_width)
    fitted = F.least(F.lit(step), F.coalesce((following - F.col(t)) / together, F.lit(step)))
    return d.withColumn("t_shifted", F.col(t) + place * fitted)


def peaks(
    df: DataFrame, keys: list[str], t: str, mag: str, minimum_prominence: float = 0.05,
    first_point_fallback: bool = False, chunk_width: float = 1.0,
) -> DataFrame:
    """The most prominent interior brightness peak of each curve, one row per key.

    A peak is a strict magnitude minimum (a flat one counts at its middle sample). Its prominence is the smaller
    climb to either side before something brighter or the end. Greatest prominence, then brightest, then earliest
    wins; a convex three-point parabola bracketed by its neighbours refines the time. Optionally the first point
    stands in when it is the brightest and no peak qualifies.

    Chunks of time are folded point by point to one summary each, and a curve's summaries in their order (``prominence``): linear in the points, and no
    more of a long curve than its summaries meets in one task.
    """
    workers.ship(df.sparkSession)
    points = collapse(df, keys, t, mag)
    groups = [F.col(k).alias(f"g{i}") for i, k in enumerate(keys)]
    at = points.select(*groups, series.chunk_by(t, chunk_width).alias(f"g{len(keys)}"), F.col(t).cast("double").alias("x"), F.col(mag).cast("double").alias("y"))
    kinds = ", ".join(f"g{i} {points.schema[k].dataType.simpleString()}" for i, k in enumerate(keys))
    names, chunk = [f"g{i}" for i in range(len(keys))], f"g{len(keys)}"
    parts = at.repartition(*names, chunk).sortWithinPartitions(*names, chunk, "x").mapInArrow(prominence.folded(len(keys) + 1, minimum_prominence, False), f"{kinds}, {chunk} bigint, part binary")
    whole = parts.repartition(*names).sortWithinPartitions(*names, chunk).select(*names, "part").mapInArrow(prominence.folded(len(keys), minimum_prominence, True), f"{kinds}, {prominence.RESULT}")
    peak = F.struct((-F.col("climb")).alias("order1"), F.col("y").alias("order2"), F.col("x").alias("order3"), F.col("climb").alias("prominence"), "xp", "yp", "xn", "yn")
    found = whole.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "n_points", "n_interior", F.when(F.col("climb").isNotNull(), peak).alias("b"), "x_first", "y_first", "y_min")
    return _peak_table(found, keys, first_point_fallback)


def _peak_table(found_peaks: DataFrame, keys: list[str], first_point_fallback: bool) -> DataFrame:
    bright = F.abs(F.col("y_first") - F.col("y_min")) <= F.lit(1e-12) + F.lit(1e-5) * F.abs("y_min")
    curve = found_peaks.withColumn("first_point_is_brightest", bright)
    # Parabola through three points, about the sample itself.
    b = F.col("b")
    u0, u2 = b["xp"] - b["order3"], b["xn"] - b["order3"]
    d0, d2 = (b["yp"] - b["order2"]) / u0, (b["yn"] - b["order2"]) / u2
    a2 = (d2 - d0) / (u2 - u0)
    a1 = d0 - a2 * u0
    vertex = F.when(a2 > 0, b["order3"] - a1 / (2 * a2))
    bracketed = vertex.isNotNull() & (vertex >= b["xp"]) & (vertex <= b["xn"])
    failure = (
        F.when(F.col("n_points") < 3, F.lit("insufficient_points"))
        .when(F.col("n_interior") > 0, F.lit("below_minimum_prominence")).otherwise(F.lit("no_interior_peak"))
    )
    found = b.isNotNull()
    proxy = ~found & F.col("first_point_is_brightest") & F.lit(first_point_fallback)
    return curve.select(
        *keys,
        F.when(found, F.when(bracketed, F.lit("valid_quadratic")).otherwise(F.lit("valid_discrete")))
        .when(proxy, F.concat(F.lit("valid_boundary_first_point_"), failure)).otherwise(failure).alias("status"),
        F.when(found, F.when(bracketed, vertex).otherwise(b["order3"])).when(proxy, F.col("x_first")).alias("peak_time"),
        F.when(found, b["order3"]).when(proxy, F.col("x_first")).alias("discrete_peak_time"),
        F.when(found, b["order2"]).when(proxy, F.col("y_first")).alias("peak_magnitude"),
        F.when(found, b["prominence"]).alias("prominence_mag"),
        F.col("first_point_is_brightest"),
        proxy.alias("peak_is_boundary_proxy"),
        (found | proxy).alias("peak_used"),
    )


def pair_colours(
    df: DataFrame, key: str, band1: str, band2: str, window: float, t: str = "t_days", mag: str = "mag",
    error: str = "mag_err", row: str = "row_id", tie: str = "later", chunk_width: float = 1.0,
) -> DataFrame:
    """Greedy one-to-one pairing of two bands: smallest separation first, inside a window.

    ``tie`` orders equal separations: ``later`` by the later time of the pair, ``row`` by row order. A window of zero
    pairs times equal to 1e-10. Row ids are unique. See ``pairing`` for how long chains and crowded events are dealt out.
    """
    workers.ship(df.sparkSession)
    zero = window <= 1e-12
    x = F.round(F.col(t), 10) if zero else F.col(t)
    points = df.where(F.col("band").isin(band1, band2) & F.col(mag).isNotNull() & F.col(t).isNotNull()).select(
        F.col(key).alias("key"), (F.col("band") == band1).alias("first"), F.col(t).cast("double").alias("t"), x.cast("double").alias("x"),
        F.col(mag).cast("double").alias("m"), F.col(error).cast("double").alias("e"), F.col(row).alias("row"),
    )
    reach = 0.0 if zero else window + (1e-12 if tie == "row" else 0.0)
    p = pairing.greedy(points, reach, zero, tie == "later", chunk_width)
    return p.select(
        F.col("key").alias(key), F.col("row").alias("row_band1"), F.col("row2").alias("row_band2"),
        F.col("t").alias("t_band1_days"), F.col("t2").alias("t_band2_days"), (F.lit(0.0) if zero else F.abs(F.col("t") - F.col("t2"))).alias("time_separation_days"),
        (F.lit(0.5) * (F.col("t") + F.col("t2"))).alias("t_color_mean_days"),
        F.greatest("t", "t2").alias("t_color_available_days"),
        F.col("m").alias("mag_band1"), F.col("m2").alias("mag_band2"),
        (F.col("m") - F.col("m2")).alias("color"), F.hypot("e", "e2").alias("color_error"),
    )


def observe(rows: DataFrame, threshold: float = 5.0) -> DataFrame:
    """Simulated measurement of ``mag`` at depth ``m5`` with a supplied noise draw (in sigmas): SNR, detection, magnitude or limit."""
    snr = 5.0 * F.pow(F.lit(10.0), F.lit(-0.4) * (F.col("mag") - F.col("m5")))
    flux = F.pow(F.lit(10.0), F.lit(-0.4) * F.col("mag"))
    d = rows.withColumns({"expected_snr": snr, "__flux": flux}).withColumn("__sigma", F.col("__flux") / F.col("expected_snr"))
    d = d.withColumn("__seen", F.col("__flux") + F.col("noise") * F.col("__sigma"))
    hit = (F.col("__seen") / F.col("__sigma") >= threshold) & (F.col("__seen") > 0)
    return d.withColumn("detected", hit).withColumns({
        "mag_observed": F.when(F.col("detected"), F.lit(-2.5) * F.log10("__seen")), "mag_limit": F.when(~F.col("detected"), F.col("m5")),
    }).drop("__flux", "__sigma", "__seen")


def validation_sample(peak_rows: DataFrame, bin_counts: DataFrame, size: int, seed: int, parameters: DataFrame | None = None) -> DataFrame:
    """Random order of events with a usable peak and at least one bin, with the events' parameters if a table of them is given.

    Each table has one row per event; a repeated event stops the query.
    """
    eligible = checks.one_to_one(peak_rows.where("peak_used"), bin_counts.where("n_bins > 0"), "event_id")
    ordered = ranks.hash_rank(eligible, "event_id", seed, "random_order").where(F.col("random_order") <= size)
    return ordered if parameters is None else checks.one_to_one(ordered, parameters, "event_id", how="left")


def pairs_within(df: DataFrame, key: str, band1: str, band2: str, window: float, t: str = "t_days", rows_per_part: int = skew.ROWS) -> DataFrame:
    """All pairs of two bands within a window: an equi-join on time buckets of one window, then the exact test. A bucket of a crowded event is dealt
    to several parts."""
    bucket = F.floor(F.col(t) / F.lit(window)).cast("bigint")
    a = df.where(F.col("band") == band1).select(key, F.col(t).alias("t1"), F.col("row_id").alias("row_band1"), F.col("mag").alias("mag_band1"),
        F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("__b"))
    b = df.where(F.col("band") == band2).select(key, F.col(t).alias("t2"), F.col("row_id").alias("row_band2"), F.col("mag").alias("mag_band2"), bucket.alias("__b"))
    d = skew.split_join(a, b, [key, "__b"], rows_per_part).where(F.abs(F.col("t1") - F.col("t2")) <= window)
    return d.withColumn("t_color_available_days", F.greatest("t1", "t2")).drop("__b")
