"""Queries over the operators along a light curve."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyhue.functions import columns as C
from skyhue.operators import broker, curves, envelope, series
from skyhue.plans import roles as R, shared_sql as S
from skyhue.plans.output import tidy
from skyhue.plans.registry import query

DAYS = f"{S.LC}, days AS (SELECT event_id, photometric_system, band, floor(t_days) AS t_days, mag, row_id FROM lc)"


def by_day(spark, sf, bands=None):
    """Points on whole days, so that times repeat."""
    return R.lightcurves(spark, sf, bands).withColumn("t_days", F.floor("t_days").cast("double"))


@query("collapse_equal_times", "E1", f"WITH {DAYS} SELECT event_id, band, t_days, round(median(mag), 6) + 0.0 AS mag FROM days GROUP BY ALL")
def _(spark, sf):
    return tidy(curves.collapse(by_day(spark, sf)), "event_id", "band", "t_days", "mag")


@query("interpolate_log_time", "E2 F12", f"WITH {S.LC}, {S.GRID}, {S.at_centres('lc')} SELECT event_id, band, bin_index, round(mag, 6) + 0.0 AS mag FROM atc")
def _(spark, sf):
    return tidy(curves.interpolate(R.lightcurves(spark, sf), R.GRID), "event_id", "band", "bin_index", "mag")


@query("interpolate_log_time_two_knots", "E2", f"WITH {DAYS}, {S.GRID}, {S.at_centres('days', 'log', 2)} SELECT event_id, band, bin_index, round(mag, 6) + 0.0 AS mag FROM atc")
def _(spark, sf):
    return tidy(curves.interpolate(by_day(spark, sf), R.GRID, "log", 2), "event_id", "band", "bin_index", "mag")


@query("interpolate_linear_phase", "E3", f"WITH {S.LC}, {S.GRID}, sh AS (SELECT event_id, photometric_system, band, t_days - 5 AS t_days, mag FROM lc), {S.at_centres('sh', 'linear')} SELECT event_id, band, bin_index, round(mag, 6) + 0.0 AS mag FROM atc")
def _(spark, sf):
    d = R.lightcurves(spark, sf).withColumn("t_days", F.col("t_days") - 5)
    return tidy(curves.interpolate(d, R.GRID, "linear"), "event_id", "band", "bin_index", "mag")


AT_VISITS = f"""{S.LC}, kn AS (SELECT event_id, band, t_days, median(mag) AS mag FROM lc WHERE band = 'g' AND t_days > 0 GROUP BY ALL),
 sg AS (SELECT *, lead(t_days) OVER w AS t1, lead(mag) OVER w AS m1, count(*) OVER (PARTITION BY event_id) AS k FROM kn WINDOW w AS (PARTITION BY event_id ORDER BY t_days)),
 vq AS (SELECT event_id, t_days, mag, row_id FROM lc WHERE band = 'r'),
 vi AS (SELECT vq.event_id, vq.t_days, vq.mag, vq.row_id, CASE WHEN sg.t_days = vq.t_days THEN sg.mag ELSE sg.mag + (sg.m1 - sg.mag) * (log10(vq.t_days) - log10(sg.t_days)) / (log10(sg.t1) - log10(sg.t_days)) END AS mag_interp
 FROM vq LEFT JOIN sg ON vq.event_id = sg.event_id AND k >= 2 AND vq.t_days > 0 AND vq.t_days >= sg.t_days AND (vq.t_days < sg.t1 OR (sg.t1 IS NULL AND vq.t_days = sg.t_days)))"""


def at_visits(spark, sf):
    """The g curve of each event at the times of its r points."""
    g = R.lightcurves(spark, sf, ("g",)).select("event_id", "t_days", "mag")
    r = R.lightcurves(spark, sf, ("r",)).select("event_id", "t_days", F.col("mag").alias("m_r"), "row_id")
    return curves.interpolate_at(g, r, ["event_id"])


@query("interpolate_at_visits", "E4 F12", f"WITH {AT_VISITS} SELECT event_id, row_id, round(mag_interp, 6) + 0.0 AS mag_interp FROM vi")
def _(spark, sf):
    return tidy(at_visits(spark, sf), "event_id", "row_id", "mag_interp")


@query("simulated_observations", "E14 C14", f"""WITH {AT_VISITS}, o AS (SELECT row_id, 18 + mag_interp / 50 AS m, 18e0 + mag / 50 AS m5, ((row_id % 11) - 5) / 1e1 AS noise FROM vi WHERE mag_interp IS NOT NULL),
 s AS (SELECT *, 5 * pow(10, -4e-1 * (m - m5)) AS snr, pow(10, -4e-1 * m) AS flux FROM o), f AS (SELECT *, flux + noise * flux / snr AS observed FROM s)
 SELECT row_id, round(snr, 6) + 0.0 AS expected_snr, observed / (flux / snr) >= 5 AND observed > 0 AS detected, round(CASE WHEN observed / (flux / snr) >= 5 AND observed > 0 THEN -25e-1 * log10(observed) END, 6) + 0.0 AS mag_observed,
 round(CASE WHEN NOT (observed / (flux / snr) >= 5 AND observed > 0) THEN m5 END, 6) + 0.0 AS mag_limit FROM f""")
def _(spark, sf):
    d = at_visits(spark, sf).where("mag_interp IS NOT NULL").select(
        "row_id", (18 + F.col("mag_interp") / 50).alias("mag"), (18.0 + F.col("m_r") / 50).alias("m5"), ((F.pmod("row_id", F.lit(11)) - 5) / 10.0).alias("noise"))
    return tidy(curves.observe(d, 5.0), "row_id", "expected_snr", "detected", "mag_observed", "mag_limit")


@query("regular_cadence_resample", "E5", f"""WITH {S.LC}, sp AS (SELECT event_id, min(t_days) AS lo, max(t_days) AS hi FROM lc WHERE t_days > 0 GROUP BY event_id), bd AS (SELECT DISTINCT event_id, band FROM lc),
 ts AS (SELECT event_id, lo + 15e-1 * i AS t_days FROM sp, range(40) r(i) WHERE i <= floor((hi - lo) / 15e-1) UNION ALL SELECT event_id, hi FROM sp WHERE hi - (lo + 15e-1 * floor((hi - lo) / 15e-1)) > 15e-10),
 kn AS (SELECT event_id, band, t_days, median(mag) AS mag FROM lc WHERE t_days > 0 GROUP BY ALL), sg AS (SELECT *, lead(t_days) OVER w AS t1, lead(mag) OVER w AS m1, count(*) OVER (PARTITION BY event_id, band) AS k FROM kn WINDOW w AS (PARTITION BY event_id, band ORDER BY t_days))
 SELECT q.event_id, q.band, round(q.t_days, 6) + 0.0 AS t_days, round(CASE WHEN sg.t_days = q.t_days THEN sg.mag ELSE sg.mag + (m1 - sg.mag) * (log10(q.t_days) - log10(sg.t_days)) / (log10(t1) - log10(sg.t_days)) END, 6) + 0.0 AS mag
 FROM (SELECT event_id, band, t_days FROM ts JOIN bd USING (event_id)) q LEFT JOIN sg ON q.event_id = sg.event_id AND q.band = sg.band AND k >= 2 AND q.t_days >= sg.t_days AND (q.t_days < t1 OR (t1 IS NULL AND q.t_days = sg.t_days))""")
def _(spark, sf):
    d = R.lightcurves(spark, sf).where("t_days > 0")
    return tidy(curves.resample(d, ["event_id"], 1.5), "event_id", "band", "t_days", "mag")


@query("wide_to_long_measurements", "E6", f"""WITH {DAYS}, w AS (SELECT event_id, t_days, median(mag) FILTER (band = 'g') AS g, median(mag) FILTER (band = 'r') AS r FROM days GROUP BY ALL),
 l AS (SELECT event_id, t_days, 'g' AS band, 0 AS band_order, least(g, 1e2) AS mag FROM w WHERE g IS NOT NULL UNION ALL SELECT event_id, t_days, 'r', 1, least(r, 1e2) FROM w WHERE r IS NOT NULL)
 SELECT event_id, t_days, band, round(mag, 6) + 0.0 AS mag, row_number() OVER (PARTITION BY event_id ORDER BY t_days, band_order) AS sequence FROM l""")
def _(spark, sf):
    one = lambda b: F.median(F.when(F.col("band") == b, F.col("mag"))).alias(b)
    wide = by_day(spark, sf).groupBy("event_id", "t_days").agg(one("g"), one("r"))
    long = curves.to_long(wide, {"g": "g", "r": "r"}, ["event_id", "t_days"], 100.0)
    d = series.row_numbers(long, ["event_id"], ["t_days", "band_order"], series.chunk_by("t_days", 1.0), "sequence")
    return tidy(d, "event_id", "t_days", "band", "mag", "sequence")


PEAKS = f"""{S.LC}, pp AS (SELECT event_id, t_days AS x, median(mag) AS y FROM lc WHERE band = 'g' GROUP BY ALL),
 p1 AS (SELECT *, row_number() OVER w AS pos, lag(x) OVER w AS xp, lag(y) OVER w AS yp, lead(x) OVER w AS xn, lead(y) OVER w AS yn FROM pp WINDOW w AS (PARTITION BY event_id ORDER BY x)),
 p2 AS (SELECT *, sum(CASE WHEN yp IS NULL OR yp <> y THEN 1 ELSE 0 END) OVER (PARTITION BY event_id ORDER BY x) AS run FROM p1),
 p3 AS (SELECT *, (min(pos) OVER (PARTITION BY event_id, run) + max(pos) OVER (PARTITION BY event_id, run)) // 2 AS mid FROM p2),
 rn AS (SELECT event_id, run, any_value(y) AS y, min(x) AS x0, max(x) FILTER (pos = mid) AS x, max(xp) FILTER (pos = mid) AS xp, max(yp) FILTER (pos = mid) AS yp, max(xn) FILTER (pos = mid) AS xn, max(yn) FILTER (pos = mid) AS yn FROM p3 GROUP BY ALL),
 rp AS (SELECT *, lag(y) OVER w AS y_before, lead(y) OVER w AS y_after FROM rn WINDOW w AS (PARTITION BY event_id ORDER BY run)),
 cd AS (SELECT * FROM rp WHERE y_before > y AND y_after > y),
 lb AS (SELECT c.event_id, c.run, max(q.run) FILTER (q.run < c.run AND q.y < c.y) AS l, min(q.run) FILTER (q.run > c.run AND q.y < c.y) AS r FROM cd c JOIN rn q USING (event_id) GROUP BY ALL),
 pr AS (SELECT c.event_id, c.run, any_value(c.y) AS y, least(max(q.y) FILTER (q.run < c.run AND q.run > coalesce(l, 0)), max(q.y) FILTER (q.run > c.run AND q.run < coalesce(r, 1000000000))) - any_value(c.y) AS prominence
 FROM cd c JOIN lb USING (event_id, run) JOIN rn q USING (event_id) GROUP BY ALL),
 bs AS (SELECT * FROM (SELECT pr.event_id, pr.run, pr.prominence, c.y, c.x, c.xp, c.yp, c.xn, c.yn, row_number() OVER (PARTITION BY pr.event_id ORDER BY prominence DESC, c.y, c.x) AS k FROM pr JOIN cd c USING (event_id, run) WHERE prominence >= 5e-2) WHERE k = 1),
 ev AS (SELECT event_id, count(*) AS n, arg_min(x, x) AS x_first, arg_min(y, x) AS y_first, min(y) AS y_min FROM pp GROUP BY event_id),
 ni AS (SELECT event_id, count(*) AS n_int FROM cd GROUP BY event_id),
 qa AS (SELECT *, (yp - y) / (xp - x) AS d0, (yn - y) / (xn - x) AS d2 FROM bs), qb AS (SELECT *, (d2 - d0) / (xn - xp) AS a2 FROM qa),
 qc AS (SELECT *, CASE WHEN a2 > 0 THEN x - (d0 - a2 * (xp - x)) / (2 * a2) END AS vertex FROM qb),
 pk0 AS (SELECT ev.event_id, x_first, y_first, qc.x, qc.y, prominence, vertex, vertex IS NOT NULL AND vertex >= xp AND vertex <= xn AS ok, qc.run IS NOT NULL AS found,
  abs(y_first - y_min) <= 1e-12 + 1e-5 * abs(y_min) AS first_bright, CASE WHEN n < 3 THEN 'insufficient_points' WHEN coalesce(n_int, 0) > 0 THEN 'below_minimum_prominence' ELSE 'no_interior_peak' END AS failure
  FROM ev LEFT JOIN ni USING (event_id) LEFT JOIN qc USING (event_id)),
 pk AS (SELECT event_id, CASE WHEN found THEN CASE WHEN ok THEN 'valid_quadratic' ELSE 'valid_discrete' END WHEN first_bright THEN 'valid_boundary_first_point_' || failure ELSE failure END AS status,
  CASE WHEN found THEN CASE WHEN ok THEN vertex ELSE x END WHEN first_bright THEN x_first END AS peak_time, CASE WHEN found THEN x WHEN first_bright THEN x_first END AS discrete_peak_time,
  CASE WHEN found THEN y WHEN first_bright THEN y_first END AS peak_magnitude, CASE WHEN found THEN prominence END AS prominence_mag, first_bright AS first_point_is_brightest, NOT found AND first_bright AS peak_is_boundary_proxy,
  found OR first_bright AS peak_used FROM pk0)"""


def peak_table(spark, sf):
    return curves.peaks(R.lightcurves(spark, sf, ("g",)), ["event_id"], "t_days", "mag", 0.05, True)


@query("peak_search", "E8 I2 K20", f"WITH {PEAKS} SELECT event_id, status, {S.r6('peak_time discrete_peak_time peak_magnitude prominence_mag')}, first_point_is_brightest, peak_is_boundary_proxy, peak_used FROM pk")
def _(spark, sf):
    return tidy(peak_table(spark, sf))


@query("peak_relative_colours", "E9 E3 K1", f"""WITH {PEAKS}, {S.GRID}, al AS (SELECT event_id, band, t_days - peak_time AS t_days, mag FROM lc JOIN pk USING (event_id) WHERE peak_used AND band IN ('g', 'r')), {S.at_centres('al', 'linear', keys='event_id, band')}
 SELECT event_id, bin_index, round(max(mag) FILTER (band = 'g') - max(mag) FILTER (band = 'r'), 6) + 0.0 AS color FROM atc GROUP BY ALL HAVING count(*) = 2""")
def _(spark, sf):
    p = peak_table(spark, sf).where("peak_used")
    d = curves.rereference(R.lightcurves(spark, sf, ("g", "r")), p, ["event_id"], "peak_time")
    c = envelope.population_colours(d, R.GRID, "g", "r", how="linear").where("color IS NOT NULL")
    return tidy(c, "event_id", "bin_index", "color")


@query("times_since_first", "E9 H3", f"WITH {S.LC} SELECT row_id, round(t_days - min(t_days) OVER (PARTITION BY event_id), 6) + 0.0 AS phase_days FROM lc")
def _(spark, sf):
    d = curves.since_first(R.lightcurves(spark, sf), ["event_id"], "t_days")
    return tidy(d.select("row_id", F.col("t_days").alias("phase_days")))


@query("peak_validation_sample", "K20 F3 I4", f"""WITH {PEAKS}, {S.GRID}, {S.at_centres('lc')}, nb AS (SELECT event_id, count(*) AS n_bins FROM (SELECT event_id, bin_index FROM atc WHERE band IN ('g', 'r') GROUP BY ALL HAVING count(*) = 2) GROUP BY event_id)
, {S.OBJ}
 SELECT event_id, status, n_bins, random_order, round(redshift, 6) + 0.0 AS redshift, round(log10_mej_dyn, 6) + 0.0 AS log10_mej_dyn FROM (SELECT event_id, status, n_bins, row_number() OVER (ORDER BY md5('5:' || event_id), event_id) AS random_order FROM pk JOIN nb USING (event_id) WHERE peak_used) LEFT JOIN obj USING (event_id) WHERE random_order <= 20""")
def _(spark, sf):
    bins = envelope.population_colours(R.lightcurves(spark, sf, ("g", "r")), R.GRID, "g", "r").where("color IS NOT NULL")
    n = bins.groupBy("event_id").agg(F.count("*").alias("n_bins"))
    p = R.objects(spark, sf).select("event_id", "redshift", "log10_mej_dyn")
    return tidy(curves.validation_sample(peak_table(spark, sf), n, 20, 5, p), "event_id", "status", "n_bins", "random_order", "redshift", "log10_mej_dyn")


STEP = "3e1 / 86400"


@query("stagger_fixed_step", "E11 H2", f"""WITH {S.SNIA}, r AS (SELECT *, row_number() OVER (PARTITION BY sn_id, mjd ORDER BY list_position(['u', 'g', 'r', 'i', 'z', 'y'], band), row_id) - 1 AS i FROM sn), e AS (SELECT sn_id, mjd, lead(mjd) OVER (PARTITION BY sn_id ORDER BY mjd) AS nx FROM (SELECT DISTINCT sn_id, mjd FROM sn))
 SELECT row_id, round(mjd + i * ({STEP}), 6) + 0.0 AS t_shifted, nx IS NULL OR i = 0 OR mjd + i * ({STEP}) < nx AS shift_ok FROM r JOIN e USING (sn_id, mjd)""")
def _(spark, sf):
    rows, order = broker.survey_order(R.snia(spark, sf))
    return tidy(curves.stagger_fixed(rows, "sn_id", "mjd", order, 30.0), "row_id", "t_shifted", "shift_ok")


@query("stagger_fitted_step", "E12", f"""WITH {S.SNIA}, r AS (SELECT *, row_number() OVER (PARTITION BY sn_id, mjd ORDER BY row_id) - 1 AS i FROM sn), e AS (SELECT sn_id, mjd, n, lead(mjd) OVER (PARTITION BY sn_id ORDER BY mjd) AS nx FROM (SELECT sn_id, mjd, count(*) AS n FROM sn GROUP BY ALL))
 SELECT row_id, round(mjd + i * least(18e3 / 86400, coalesce((nx - mjd) / n, 18e3 / 86400)), 6) + 0.0 AS t_shifted FROM r JOIN e USING (sn_id, mjd)""")
def _(spark, sf):
    return tidy(curves.stagger_fit(R.snia(spark, sf), "sn_id", "mjd", ["row_id"], 18000.0), "row_id", "t_shifted")


@query("revisit_gaps", "E13 H2", f"""WITH {S.VISITS} SELECT field_index, band, count(*) AS n, round(sum(gap), 4) + 0.0 AS total, round(max(gap), 6) + 0.0 AS longest FROM (SELECT field_index, band, MJD - lag(MJD) OVER (PARTITION BY field_index, band ORDER BY MJD) AS gap FROM visits) WHERE gap IS NOT NULL GROUP BY ALL""")
def _(spark, sf):
    from skyhue.operators import survey
    g = survey.revisit_gaps(R.visits(spark, sf)).groupBy("field_index", "band").agg(F.count("*").alias("n"), F.sum("gap_days").alias("total"), F.max("gap_days").alias("longest"))
    return tidy(g.withColumn("total", F.round("total", 4)))


@query("phase_of_later_band", "E15 F7", f"""WITH {S.LC} SELECT a.row_id AS row_band1, b.row_id AS row_band2, round(greatest(a.t_days, b.t_days), 6) + 0.0 AS t_color_available_days FROM lc a JOIN lc b ON a.event_id = b.event_id AND a.band = 'g' AND b.band = 'r' AND abs(a.t_days - b.t_days) <= 1e-1""")
def _(spark, sf):
    d = curves.pairs_within(R.lightcurves(spark, sf, ("g", "r")), "event_id", "g", "r", 0.1)
    return tidy(d, "row_band1", "row_band2", "t_color_available_days")


def colour_pairs(spark, sf, window=0.4, tie="later"):
    d = R.photometry(spark, sf).where(F.col("band").isin("g", "r"))
    return curves.pair_colours(d, "event_id", "g", "r", window, tie=tie)


def _greedy_sql(window: str, tie: str) -> str:
    later = "greatest(a.t_days, b.t_days)" if tie == "later" else "0e0"
    return f"""WITH RECURSIVE {S.PHOT}, e AS (SELECT a.event_id, a.row_id AS r1, b.row_id AS r2, a.t_days AS o1, b.t_days AS o2, abs(a.t_days - b.t_days) AS sep, a.mag AS m1, b.mag AS m2, a.mag_err AS e1, b.mag_err AS e2,
 row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.t_days - b.t_days), {later}, a.t_days, a.row_id, b.t_days, b.row_id) AS k FROM phot a JOIN phot b ON a.event_id = b.event_id AND a.band = 'g' AND b.band = 'r' AND abs(a.t_days - b.t_days) <= {window}),
 g AS (SELECT DISTINCT event_id, 0::BIGINT AS k, []::BIGINT[] AS u1, []::BIGINT[] AS u2, false AS hit FROM e
 UNION ALL SELECT g.event_id, e.k, CASE WHEN list_contains(u1, r1) OR list_contains(u2, r2) THEN u1 ELSE list_append(u1, r1) END, CASE WHEN list_contains(u1, r1) OR list_contains(u2, r2) THEN u2 ELSE list_append(u2, r2) END,
 NOT (list_contains(u1, r1) OR list_contains(u2, r2)) FROM g JOIN e ON e.event_id = g.event_id AND e.k = g.k + 1)
 SELECT event_id, r1 AS row_band1, r2 AS row_band2, round(o1, 6) + 0.0 AS t_band1_days, round(o2, 6) + 0.0 AS t_band2_days, round(sep, 6) + 0.0 AS time_separation_days, round(5e-1 * (o1 + o2), 6) + 0.0 AS t_color_mean_days,
 round(greatest(o1, o2), 6) + 0.0 AS t_color_available_days, round(m1, 6) + 0.0 AS mag_band1, round(m2, 6) + 0.0 AS mag_band2, round(m1 - m2, 6) + 0.0 AS color, round(sqrt(e1 * e1 + e2 * e2), 6) + 0.0 AS color_error FROM g JOIN e USING (event_id, k) WHERE hit"""


@query("greedy_colour_pairs", "E10 F7 E15 C17", _greedy_sql("4e-1", "later"))
def _(spark, sf):
    return tidy(colour_pairs(spark, sf))


@query("greedy_colour_pairs_row_ties", "E10", _greedy_sql("(1e0 + 1e-12)", "row"))
def _(spark, sf):
    return tidy(colour_pairs(spark, sf, 1.0, "row"))
