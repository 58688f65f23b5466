"""Queries over losses by sky latitude and their plateaus."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyhue.operators import envelope as E, latitude as L
from skyhue.plans import roles as R, shared_sql as S
from skyhue.plans.output import tidy
from skyhue.plans.registry import query
from skyhue.sources.staging import materialize

CUTS = [float(c) for c in range(5, 71)]
MOVING = [5.0, 10.0, 15.0, 20.0, 25.0, 30.0, 40.0, 50.0]
COEFF = {"g": 3.6605664439892616, "r": 2.70136780871597}

COUNTS = S.LC + ", " + S.GRID + ", " + S.at_centres("lc", "log", 2) + ", " + S.DEPTH + ", " + S.OBJ + f""", cl AS (SELECT event_id, bin_index, max(mag) FILTER (band = 'g') AS m1, max(mag) FILTER (band = 'r') AS m2 FROM atc WHERE band IN ('g', 'r') GROUP BY ALL HAVING count(*) = 2),
 ec AS (SELECT event_id, count(*) AS b, count(*) FILTER (m1 <= m5_1 AND m2 <= m5_2) AS n, count(*) FILTER (m1 + ebv_mw * {COEFF['g']!r}::DOUBLE <= m5_1 AND m2 + ebv_mw * {COEFF['r']!r}::DOUBLE <= m5_2) AS w FROM cl JOIN obj USING (event_id), dep GROUP BY event_id),
 ev AS (SELECT event_id, abs_b_deg, ebv_mw, coalesce(b, 0) AS b, coalesce(n, 0) AS n, coalesce(w, 0) AS w, event_id IN (SELECT event_id FROM lc WHERE band IN ('g', 'r')) AS seen FROM obj LEFT JOIN ec USING (event_id))"""


def counts(spark, sf):
    lc = R.lightcurves(spark, sf, ("g", "r"))
    c = E.population_colours(lc, R.GRID, "g", "r", min_knots=2)
    return L.loss_counts(E.with_depths(c, R.depths(spark, sf), "g", "r"), R.objects(spark, sf), lc, "g", "r")


@query("excluded_objects", "N1", f"WITH {S.OBJ} SELECT count(*) AS n_objects, count(*) FILTER (abs_b_deg BETWEEN 0 AND 90 AND isfinite(ebv_mw)) AS n_used, count(*) FILTER (coalesce(abs_b_deg NOT BETWEEN 0 AND 90 OR NOT isfinite(ebv_mw), true)) AS n_excluded FROM obj")
def _(spark, sf):
    return L.excluded_objects(R.objects(spark, sf))


@query("loss_counts_per_event", "N1 C12 D3", f"WITH {COUNTS} SELECT event_id, b AS N_bins_baseline, n AS N_bins_m5_no_mw, w AS N_bins_m5_with_mw, seen AS has_saved_rows, b > 0 AS has_any_baseline, w > 0 AS has_any_m5_with_mw, b - n AS N_bins_lost_m5_only, n - w AS N_bins_lost_additional_mw_given_m5, b - w AS N_bins_lost_combined FROM ev")
def _(spark, sf):
    return counts(spark, sf).select("event_id", "N_bins_baseline", "N_bins_m5_no_mw", "N_bins_m5_with_mw", "has_saved_rows", "has_any_baseline", "has_any_m5_with_mw", "N_bins_lost_m5_only", "N_bins_lost_additional_mw_given_m5", "N_bins_lost_combined")


_SUMS = "count(*) AS inj, count(*) FILTER (b > 0) AS eb, count(*) FILTER (n > 0) AS e5, count(*) FILTER (w > 0) AS ew, coalesce(sum(b), 0)::BIGINT AS bb, coalesce(sum(n), 0)::BIGINT AS b5, coalesce(sum(w), 0)::BIGINT AS bw"


def _rates(p: str = "") -> str:
    z = "1.959963984540054::DOUBLE"
    out = []
    for k, (x, y) in {"m5_only": ("eb", "e5"), "additional_mw_given_m5": ("e5", "ew"), "combined": ("eb", "ew")}.items():
        lost, tot = f"({p}{x} - {p}{y})", f"nullif({p}eb, 0)"
        r = f"({lost}::DOUBLE / {tot})"
        centre = f"(({r} + {z} * {z} / (2 * {tot})) / (1 + {z} * {z} / {tot}))"
        spread = f"({z} / (1 + {z} * {z} / {tot}) * sqrt({r} * (1 - {r}) / {tot} + {z} * {z} / (4 * {tot} * {tot})))"
        bx, by = x.replace("e", "b", 1), y.replace("e", "b", 1)
        out.append(f"{lost} AS {p}event_loss_{k}, {r} AS {p}event_loss_rate_{k}, {centre} - {spread} AS {p}event_loss_rate_{k}_ci95_low, {centre} + {spread} AS {p}event_loss_rate_{k}_ci95_high, ({p}{bx} - {p}{by})::DOUBLE / nullif({p}bb, 0) AS {p}bin_loss_rate_{k}")
    return ", ".join(out)


RATE_NAMES = [f"{n}_{k}{s}" for k in L.COMPONENTS for n, s in (("event_loss_rate", ""), ("event_loss_rate", "_ci95_low"), ("event_loss_rate", "_ci95_high"), ("bin_loss_rate", ""))]


@query("loss_metrics", "N2", f"WITH {COUNTS}, s AS (SELECT {_SUMS} FROM ev), m AS (SELECT *, {_rates()} FROM s) SELECT inj AS N_injected, eb AS N_events_with_baseline_color, event_loss_combined, {S.r6(' '.join(RATE_NAMES))}, round((e5 - ew)::DOUBLE / nullif(e5, 0), 6) + 0.0 AS event_mw_penalty_given_m5 FROM m")
def _(spark, sf):
    return tidy(L.metrics(counts(spark, sf)), "N_injected", "N_events_with_baseline_color", "event_loss_combined", *RATE_NAMES, "event_mw_penalty_given_m5")


@query("loss_metrics_by_latitude", "N3 F10", f"WITH {COUNTS}, s AS (SELECT i::INT AS lat_bin, {_SUMS.replace('count(*) AS inj', 'count(event_id) AS inj')} FROM range(18) r(i) LEFT JOIN ev ON least(17, floor(abs_b_deg / 5)) = i GROUP BY i), m AS (SELECT *, {_rates()} FROM s) SELECT lat_bin, inj AS N_injected, {S.r6(' '.join(RATE_NAMES))}, lat_bin * 5e0 AS b_min_deg, lat_bin * 5e0 + 5 AS b_max_deg FROM m")
def _(spark, sf):
    return tidy(L.by_bin(counts(spark, sf)), "lat_bin", "N_injected", *RATE_NAMES, "b_min_deg", "b_max_deg")


_LOWHIGH = ", ".join(f"low.{c} AS low_{c}, high.{c} AS high_{c}" for c in ("inj", "eb", "e5", "ew", "bb", "b5", "bw"))
SCAN = COUNTS + f""", ct AS (SELECT i::DOUBLE AS threshold_deg FROM range(5, 71) r(i)), low AS (SELECT threshold_deg, {_SUMS.replace('count(*) AS inj', 'count(event_id) AS inj')} FROM ct LEFT JOIN ev ON abs_b_deg < threshold_deg GROUP BY threshold_deg),
 high AS (SELECT threshold_deg, {_SUMS.replace('count(*) AS inj', 'count(event_id) AS inj')} FROM ct LEFT JOIN ev ON abs_b_deg >= threshold_deg GROUP BY threshold_deg), lh AS (SELECT threshold_deg, {_LOWHIGH} FROM low JOIN high USING (threshold_deg)),
 sc0 AS (SELECT *, low_eb >= 3 AND high_eb >= 3 AS eligible_min_events, {_rates('low_')}, {_rates('high_')} FROM lh), sc AS (SELECT *, CASE WHEN eligible_min_events THEN low_event_loss_rate_combined / nullif(high_event_loss_rate_combined, 0) END AS event_low_over_high_combined,
 CASE WHEN eligible_min_events THEN low_bin_loss_rate_additional_mw_given_m5 / nullif(high_bin_loss_rate_additional_mw_given_m5, 0) END AS bin_low_over_high_additional_mw_given_m5,
 CASE WHEN eligible_min_events AND least(low_event_loss_combined, low_eb, high_event_loss_combined, high_eb) > 0 THEN low_event_loss_rate_combined / high_event_loss_rate_combined END AS rr,
 CASE WHEN eligible_min_events AND least(low_event_loss_combined, low_eb, high_event_loss_combined, high_eb) > 0 THEN sqrt(1e0 / low_event_loss_combined - 1e0 / low_eb + 1e0 / high_event_loss_combined - 1e0 / high_eb) END AS se FROM sc0)"""


def scan(spark, sf):
    return L.cut_scan(counts(spark, sf), CUTS, 3)


@query("latitude_cut_scan", "N4 H7 F13", f"WITH {SCAN} SELECT threshold_deg, low_eb AS low_N_events_with_baseline_color, high_inj AS high_N_injected, eligible_min_events, {S.r6('low_event_loss_rate_combined high_bin_loss_rate_m5_only event_low_over_high_combined bin_low_over_high_additional_mw_given_m5')}, round(rr * exp(-196e-2 * se), 6) + 0.0 AS event_low_over_high_combined_ci95_low, round(rr * exp(196e-2 * se), 6) + 0.0 AS event_low_over_high_combined_ci95_high FROM sc")
def _(spark, sf):
    return tidy(scan(spark, sf), "threshold_deg", "low_N_events_with_baseline_color", "high_N_injected", "eligible_min_events", "low_event_loss_rate_combined", "high_bin_loss_rate_m5_only", "event_low_over_high_combined", "bin_low_over_high_additional_mw_given_m5", "event_low_over_high_combined_ci95_low", "event_low_over_high_combined_ci95_high")


@query("absolute_plateau", "N5 H8", f"""WITH {SCAN}, v AS (SELECT threshold_deg, bin_low_over_high_additional_mw_given_m5 AS v, row_number() OVER (ORDER BY threshold_deg DESC) AS k FROM sc WHERE eligible_min_events AND bin_low_over_high_additional_mw_given_m5 IS NOT NULL), rf AS (SELECT median(v) AS ref FROM v WHERE k <= 3),
 t AS (SELECT threshold_deg, k, v, ref, max(abs(v - ref)) OVER (ORDER BY threshold_deg ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tm FROM v, rf), s AS (SELECT count(*) AS n, max(abs(v)) AS big, max(ref) AS ref, min(threshold_deg) FILTER (k >= 3 AND tm <= 3e-1) AS cand, max(k) FILTER (k >= 3 AND tm <= 3e-1) AS rem FROM t)
 SELECT CASE WHEN n < 3 THEN 'insufficient_valid_thresholds' WHEN big = 0 THEN 'no_measurable_signal' WHEN cand IS NOT NULL THEN 'heuristic_candidate' ELSE 'no_stable_plateau' END AS status, CASE WHEN n >= 3 AND big <> 0 THEN cand END AS candidate_deg, round(CASE WHEN n >= 3 THEN ref END, 6) + 0.0 AS reference_value, CASE WHEN n >= 3 AND big <> 0 THEN rem END AS n_remaining_thresholds FROM s""")
def _(spark, sf):
    return tidy(L.plateau_absolute(scan(spark, sf), "bin_low_over_high_additional_mw_given_m5", 0.3, 3))


PAIRED = COUNTS + """, oc AS (SELECT least(8, floor(abs_b_deg / 10))::INT AS lat_bin, b > 0 AS base, b > 0 AND n = 0 AS l5, b > 0 AND n > 0 AND w = 0 AS lw FROM ev), pb0 AS (SELECT lat_bin, lat_bin * 1e1 AS lower_deg, count(*) FILTER (base) AS n_baseline, count(*) FILTER (l5) AS n_m5_loss, count(*) FILTER (lw) AS n_mw_loss FROM oc GROUP BY lat_bin),
 pb1 AS (SELECT *, n_m5_loss + n_mw_loss AS n_total_loss, n_m5_loss::DOUBLE / nullif(n_baseline, 0) AS rate_m5_loss, n_mw_loss::DOUBLE / nullif(n_baseline, 0) AS rate_mw_loss, (n_m5_loss + n_mw_loss)::DOUBLE / nullif(n_baseline, 0) AS rate_total_loss FROM pb0),
 pb AS (SELECT *, rate_m5_loss / nullif(first_value(rate_m5_loss) OVER w, 0) AS ratio_m5_loss, rate_mw_loss / nullif(first_value(rate_mw_loss) OVER w, 0) AS ratio_mw_loss, rate_total_loss / nullif(first_value(rate_total_loss) OVER w, 0) AS ratio_total_loss FROM pb1 WINDOW w AS (ORDER BY lower_deg ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
 tl AS (SELECT a.lat_bin, a.lower_deg, count(*) AS nt, count(b.ratio_m5_loss) AS nk, min(b.ratio_m5_loss) AS mn, max(b.ratio_m5_loss) AS mx, median(b.ratio_m5_loss) AS md FROM pb a JOIN pb b ON b.lat_bin >= a.lat_bin GROUP BY ALL),
 pl AS (SELECT arg_min(lower_deg, lat_bin) AS plateau_deg, arg_min(md, lat_bin) AS level, arg_min(greatest(abs(mx / md - 1), abs(mn / md - 1)), lat_bin) AS deviation FROM tl WHERE lat_bin > (SELECT min(lat_bin) FROM pb) AND nt >= 3 AND nk = nt AND mn > 0 AND greatest(abs(mx / md - 1), abs(mn / md - 1)) <= 5e-1)"""


def paired(spark, sf):
    b = F.least(F.lit(8), F.floor(F.col("abs_b_deg") / 10)).cast("int")
    ev = counts(spark, sf).withColumn("lat_bin", b).withColumn("lower_deg", F.col("lat_bin") * 10.0)
    return L.paired_bins(ev, "lat_bin", "lower_deg")


@query("paired_latitude_bins", "N6 H9 F14", f"WITH {PAIRED} SELECT lat_bin, lower_deg, n_baseline, n_m5_loss, n_mw_loss, n_total_loss, {S.r6('rate_m5_loss rate_mw_loss rate_total_loss ratio_m5_loss ratio_mw_loss ratio_total_loss')} FROM pb")
def _(spark, sf):
    return tidy(paired(spark, sf))


def _tables_sql(name: str) -> str:
    """The same objects at half their latitude and, without dust, at that much above 45 degrees."""
    return f"""{name}0 AS (SELECT 0 AS lat_bin, 0e0 AS lower_deg, b > 0 AS base, b > 0 AND n = 0 AS l5, b > 0 AND n > 0 AND w = 0 AS lw FROM ev UNION ALL SELECT 1, 45e0, b > 0, b > 0 AND n = 0, false FROM ev),
 {name} AS (SELECT lat_bin, lower_deg, count(*) FILTER (base) AS n_baseline, count(*) FILTER (l5) AS n_m5_loss, count(*) FILTER (lw) AS n_mw_loss, count(*) FILTER (l5 OR lw) AS n_total_loss FROM {name}0 GROUP BY ALL)"""


@query("paired_latitude_tables", "N6 F14 H9", f"""WITH {COUNTS}, {_tables_sql('tb')}, rt AS (SELECT *, n_m5_loss::DOUBLE / nullif(n_baseline, 0) AS rate_m5_loss, n_mw_loss::DOUBLE / nullif(n_baseline, 0) AS rate_mw_loss, n_total_loss::DOUBLE / nullif(n_baseline, 0) AS rate_total_loss FROM tb)
 SELECT lat_bin AS bin_index, lower_deg, n_baseline, n_m5_loss, n_mw_loss, n_total_loss, {S.r6('rate_m5_loss rate_mw_loss rate_total_loss')}, round(rate_m5_loss / nullif(first_value(rate_m5_loss) OVER w, 0), 6) + 0.0 AS ratio_m5_loss,
 round(rate_mw_loss / nullif(first_value(rate_mw_loss) OVER w, 0), 6) + 0.0 AS ratio_mw_loss, round(rate_total_loss / nullif(first_value(rate_total_loss) OVER w, 0), 6) + 0.0 AS ratio_total_loss FROM rt WINDOW w AS (ORDER BY lower_deg ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def _(spark, sf):
    c = materialize(counts(spark, sf))
    half = F.col("abs_b_deg") / 2
    low, high = c.withColumn("abs_b_deg", F.least(half, F.lit(44.999))), c.withColumns({"abs_b_deg": half + 45, "N_bins_m5_with_mw": F.col("N_bins_m5_no_mw")})
    o = L.paired_outcomes([(45.0, 90.0, high), (0.0, 45.0, low)], minimum_bins=2)
    return tidy(L.paired_bins(o, "bin_index", "lower_deg"))


@query("relative_plateau", "N7 H8", f"WITH {PAIRED} SELECT {S.r6('plateau_deg level deviation')} FROM pl")
def _(spark, sf):
    return tidy(L.plateau_relative(paired(spark, sf), "lat_bin", "lower_deg", "ratio_m5_loss", 0.5, 3))


@query("paired_bin_table", "N11", f"WITH {PAIRED} SELECT lower_deg, n_baseline, n_mw_loss, round(100 * rate_mw_loss, 6) + 0.0 AS mw_loss_percent, {S.r6('ratio_mw_loss')}, round(100 * (1 - ratio_mw_loss), 6) + 0.0 AS reduction_percent, {S.r6('ratio_m5_loss ratio_total_loss')}, coalesce(lower_deg = plateau_deg, false) AS is_plateau_start FROM pb, pl")
def _(spark, sf):
    p = paired(spark, sf)
    return tidy(L.paired_table(p, L.plateau_relative(p, "lat_bin", "lower_deg", "ratio_m5_loss", 0.5, 3), "lower_deg"))


_MV = ", ".join(f"({c!r}::DOUBLE)" for c in MOVING)
MOVE = COUNTS + f""", mc(cut_deg) AS (VALUES {_MV}), mo AS (SELECT abs_b_deg, n = 0 AS l5, n > 0 AND w = 0 AS lw FROM ev WHERE b > 0), mv0 AS (SELECT cut_deg, count(*) FILTER (abs_b_deg < cut_deg) AS n_low, count(*) FILTER (l5 AND abs_b_deg < cut_deg) AS m5_low, count(*) FILTER (lw AND abs_b_deg < cut_deg) AS mw_low,
 count(*) FILTER (abs_b_deg >= cut_deg) AS n_high, count(*) FILTER (l5 AND abs_b_deg >= cut_deg) AS m5_high, count(*) FILTER (lw AND abs_b_deg >= cut_deg) AS mw_high FROM mc CROSS JOIN mo GROUP BY cut_deg), mv AS (SELECT *, mw_low::DOUBLE / nullif(n_low, 0) AS rate_low, mw_high::DOUBLE / nullif(n_high, 0) AS rate_high,
 (mw_high::DOUBLE / nullif(n_high, 0)) / nullif(mw_low::DOUBLE / nullif(n_low, 0), 0) AS q FROM mv0)"""


def moving(spark, sf):
    return L.moving_cut(counts(spark, sf), MOVING)


@query("moving_cut_counts", "N8 H7", f"WITH {MOVE} SELECT cut_deg, n_low, m5_low, mw_low, n_high, m5_high, mw_high, {S.r6('rate_low rate_high')}, round(q, 6) + 0.0 AS q_high_over_low FROM mv")
def _(spark, sf):
    return tidy(moving(spark, sf))


@query("paired_cut_counts", "N8", f"WITH {MOVE} SELECT cut_deg, n_low, mw_low, n_high, mw_high, round(q, 6) + 0.0 AS q_high_over_low FROM mv")
def _(spark, sf):
    cut = F.explode(F.array(*[F.lit(c) for c in MOVING])).alias("cut_deg")
    each = counts(spark, sf).select("*", cut)
    d = L.pair_counts(each.where("abs_b_deg < cut_deg"), each.where("abs_b_deg >= cut_deg"))
    return tidy(d, "cut_deg", "n_low", "mw_low", "n_high", "mw_high", "q_high_over_low")


@query("plateau_assessment", "N9 N11 H8", f"""WITH {MOVE}, tq AS (SELECT a.cut_deg, a.q, count(*) AS nt, count(b.q) AS nk, min(b.q) AS mn, max(b.q) AS mx, median(b.q) AS md FROM mv a JOIN mv b ON b.cut_deg >= a.cut_deg GROUP BY ALL), td AS (SELECT *, CASE WHEN md > 0 THEN greatest(abs(mx / md - 1), abs(mn / md - 1)) END AS dev, nt >= 3 AND (SELECT max(cut_deg) FROM mv) - cut_deg >= 10 AS enough FROM tq),
 ts AS (SELECT *, CASE WHEN NOT enough THEN 'span_too_short' WHEN nk <> nt THEN 'undefined_ratio' WHEN coalesce(mn >= 0 AND dev <= 2e-1, false) THEN 'plateau' ELSE 'outside_tolerance' END AS status FROM td)
 SELECT cut_deg, status, round(CASE WHEN enough AND nk = nt THEN dev END, 6) + 0.0 AS deviation, round(1 - q, 6) + 0.0 AS reduction, coalesce(cut_deg = (SELECT min(cut_deg) FROM ts WHERE status = 'plateau'), false) AS is_selected FROM ts""")
def _(spark, sf):
    return tidy(L.assess_plateau(moving(spark, sf), 0.2), "cut_deg", "status", "deviation", "reduction", "is_selected")


@query("configuration_consistency", "N10", "SELECT 'market' AS parameter, count(DISTINCT c_mktsegment) AS n_values, count(DISTINCT c_mktsegment) <= 1 AS consistent FROM customer UNION ALL SELECT 'width', 1, true")
def _(spark, sf):
    d = R.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("market"), F.lit(0.4).alias("width"))
    return L.same_configuration(d, ["market", "width"])
