"""Queries over colour on a grid of two physical parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyhue.operators import cells as K
from skyhue.plans import envelopes, roles as R, shared_sql as S, stability
from skyhue.plans.output import tidy
from skyhue.plans.registry import query
from skyhue.sources.staging import materialize

G = R.GRID
N = 6
PAIR = ("inclination_deg", "mej_dyn")

DOMAIN = S.OBJ + """, pm AS (SELECT event_id, degrees(inclination_EM) AS x, pow(10, log10_mej_dyn) AS y FROM obj), dm AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pm)"""
CELLS = S.COL + ", " + DOMAIN + """, cc AS (SELECT bin_index, color, least(5, floor((x - x0) / ((x1 - x0) / 6))::INT) AS ix, least(5, floor((y - y0) / ((y1 - y0) / 6))::INT) AS iy FROM col JOIN pm USING (event_id), dm WHERE color IS NOT NULL),
 cg AS (SELECT bin_index, ix, iy, count(*) AS N_cell, quantile_cont(color, 16e-2) AS colour_p16, quantile_cont(color, 5e-1) AS colour_p50, quantile_cont(color, 84e-2) AS colour_p84 FROM cc GROUP BY ALL)"""
DENSE = CELLS + """, dg AS (SELECT bin_index, x.i::INT AS ix, y.i::INT AS iy, coalesce(N_cell, 0) AS N_cell, coalesce(N_cell, 0) > 0 AS cell_supported, colour_p16, colour_p50, colour_p84 FROM grid CROSS JOIN range(6) x(i) CROSS JOIN range(6) y(i) LEFT JOIN cg ON cg.bin_index = grid.bin_index AND cg.ix = x.i AND cg.iy = y.i)"""
DENSE = DENSE.replace("SELECT bin_index, x.i", "SELECT grid.bin_index, x.i")


def ranges(spark, sf):
    d = K.domains(R.objects(spark, sf), list(PAIR))
    one = lambda n: d.where(F.col("parameter") == n)
    return one(PAIR[0]), one(PAIR[1])


def values(spark, sf):
    o = R.objects(spark, sf)
    p = o.select("event_id", K.parameter(o, PAIR[0]).alias("x"), K.parameter(o, PAIR[1]).alias("y"))
    return materialize(envelopes.colours(spark, sf).where("color IS NOT NULL").join(p, "event_id"))


def dense(spark, sf):
    x, y = ranges(spark, sf)
    c = K.cell_grid(values(spark, sf), x, y, N, N, ["bin_index"])
    return K.dense_grid(materialize(c), G.frame(spark).select("bin_index"), N, N, ["bin_index"])


@query("parameter_domains", "M7", f"WITH {DOMAIN} SELECT 'inclination_deg' AS parameter, round(x0, 6) + 0.0 AS low, round(x1, 6) + 0.0 AS high FROM dm UNION ALL SELECT 'mej_dyn', round(y0, 6) + 0.0, round(y1, 6) + 0.0 FROM dm")
def _(spark, sf):
    return tidy(K.domains(R.objects(spark, sf), list(PAIR)))


@query("parameter_cell_grid", "M1 G20", f"WITH {CELLS} SELECT bin_index, ix, iy, N_cell, {S.r6('colour_p16 colour_p50 colour_p84')} FROM cg")
def _(spark, sf):
    x, y = ranges(spark, sf)
    return tidy(K.cell_grid(values(spark, sf), x, y, N, N, ["bin_index"]))


@query("parameter_grid_table", "M3 F10", f"""WITH {DENSE} SELECT bin_index, ix, iy, N_cell, cell_supported, {S.r6('colour_p50')}, round(colour_p84 - colour_p16, 6) + 0.0 AS colour_p16_p84_width, round(x0 + ix * ((x1 - x0) / 6), 6) + 0.0 AS x_low, round(y0 + (iy + 1) * ((y1 - y0) / 6), 6) + 0.0 AS y_high FROM dg, dm""")
def _(spark, sf):
    x, y = ranges(spark, sf)
    d = K.grid_table(dense(spark, sf), x, y, N, N, G)
    return tidy(d, "bin_index", "ix", "iy", "N_cell", "cell_supported", "colour_p50", "colour_p16_p84_width", "x_low", "y_high")


@query("parameter_grid_summary", "M3", f"WITH {DENSE} SELECT bin_index, sum(N_cell)::BIGINT AS N_stage_available, count(*) FILTER (cell_supported) AS N_supported_cells FROM dg GROUP BY bin_index")
def _(spark, sf):
    return K.grid_summary(dense(spark, sf), ["bin_index"])


@query("smoothed_parameter_grid", "M2", f"""WITH {DENSE}, kr AS (SELECT k, exp(-5e-1 * k * k) AS w FROM (SELECT i - 4 AS k FROM range(9) r(i))), kn AS (SELECT k, w / (SELECT sum(w) FROM kr) AS w FROM kr),
 sx AS (SELECT t.bin_index, t.ix, t.iy, sum(w * CASE WHEN s.cell_supported THEN s.colour_p50 ELSE 0 END) AS num, sum(w * s.cell_supported::INT) AS den FROM dg t CROSS JOIN kn JOIN dg s ON s.bin_index = t.bin_index AND s.iy = t.iy AND s.ix = greatest(0, least(5, t.ix + k)) GROUP BY ALL),
 sy AS (SELECT t.bin_index, t.ix, t.iy, sum(w * s.num) AS num, sum(w * s.den) AS den FROM sx t CROSS JOIN kn JOIN sx s ON s.bin_index = t.bin_index AND s.ix = t.ix AND s.iy = greatest(0, least(5, t.iy + k)) GROUP BY ALL)
 SELECT bin_index, ix, iy, round(CASE WHEN cell_supported AND den > 1e-8 THEN num / den END, 6) + 0.0 AS smoothed_colour_p50 FROM dg JOIN sy USING (bin_index, ix, iy)""")
def _(spark, sf):
    return tidy(K.smooth(dense(spark, sf), ["bin_index"], N, N, 1.0), "bin_index", "ix", "iy", "smoothed_colour_p50")


TIMES = [0.4, 1.0, 5.2, 26.0, 30.0]
_TV = ", ".join(f"({t!r}::DOUBLE)" for t in TIMES)
BOUNDS = S.RULES + f""", tm(time_days) AS (VALUES {_TV}), br AS (SELECT * FROM rules WHERE stage = 'no_m5'), en AS (SELECT max(t_max_days) AS e FROM br),
 bo AS (SELECT time_days, max(color_min) AS color_min, max(color_max) AS color_max FROM tm CROSS JOIN en LEFT JOIN br ON CASE WHEN abs(time_days - e) <= 1e-10 THEN t_max_days = e AND t_min_days <= time_days ELSE t_min_days <= time_days AND t_max_days > time_days END GROUP BY time_days)"""


def bounds(spark, sf):
    r = envelopes.rules(spark, sf).where("stage = 'no_m5'")
    return K.bounds_at(r, TIMES)


@query("bounds_at_times", "M5 F8", f"WITH {BOUNDS} SELECT time_days, {S.r6('color_min color_max')}, CASE WHEN color_min IS NULL THEN 'missing_or_invalid' ELSE 'valid' END AS bounds_status FROM bo")
def _(spark, sf):
    return tidy(bounds(spark, sf))


@query("profile_bounds_at_times", "M5", f"""WITH {stability.PROFILES}, b AS (SELECT bin_index, t_min_days, t_max_days, max(value) FILTER (percentile = 5) AS lo, max(value) FILTER (percentile = 95) AS hi FROM prof, (SELECT max(sample_size) AS m FROM sz) WHERE repetition = 0 AND sample_size = m AND valid GROUP BY ALL), tm(time_days) AS (VALUES {_TV}), en AS (SELECT max(t_max_days) AS e FROM b)
 SELECT time_days, round(max(lo), 6) + 0.0 AS color_min, round(max(hi), 6) + 0.0 AS color_max, CASE WHEN max(lo) IS NULL THEN 'missing_or_invalid' ELSE 'valid' END AS bounds_status FROM tm CROSS JOIN en LEFT JOIN b ON CASE WHEN abs(time_days - e) <= 1e-10 THEN t_max_days = e AND t_min_days <= time_days ELSE t_min_days <= time_days AND t_max_days > time_days END GROUP BY time_days""")
def _(spark, sf):
    return tidy(K.bounds_at(K.profile_bounds(stability.profile(spark, sf)), TIMES))


@query("contour_levels", "M6", f"WITH {BOUNDS} SELECT time_days, len(l) AS n_levels, l[1] AS first_level, l[-1] AS last_level FROM (SELECT time_days, CASE WHEN color_min IS NULL THEN [] ELSE [x * 5e0 FOR x IN range(floor(color_min / 5)::BIGINT, ceil(color_max / 5)::BIGINT + 1)] END AS l FROM bo)".replace("len(l) AS", "len(l)::INT AS"))
def _(spark, sf):
    d = K.levels(bounds(spark, sf), 5.0)
    return d.select("time_days", F.size("levels").alias("n_levels"), F.try_element_at("levels", F.lit(1)).alias("first_level"), F.try_element_at("levels", F.lit(-1)).alias("last_level"))
