"""Queries over the population envelope and what is compared with it."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from skyhue.operators import cells, curves, envelope as E, snia as SN
from skyhue.plans import light_curves, roles as R, shared_sql as S
from skyhue.plans.output import tidy
from skyhue.plans.registry import query
from skyhue.sources import population as loading, readers
from skyhue.sources.staging import folder, materialize

G = R.GRID


def colours(spark, sf):
    return E.population_colours(R.lightcurves(spark, sf, ("g", "r")), G, "g", "r")


def settled_colours(spark, sf):
    """The colour table written once, for queries that read it more than once."""
    return materialize(colours(spark, sf).where("color IS NOT NULL"))


def staged(spark, sf):
    return E.stages(settled_colours(spark, sf), R.depths(spark, sf), "g", "r")


def rules(spark, sf):
    return E.rules(staged(spark, sf), ["stage"], G)


@query("population_colours", "K1 E2 C17", f"WITH {S.COL} SELECT event_id, bin_index, {S.r6('mag1 mag2 sel1 sel2 color')} FROM col")
def _(spark, sf):
    return tidy(colours(spark, sf))


def _shard(moved: bool):
    """Shard of a point: events by parity, and of some events a part of the rows in the other one."""
    home = F.pmod("event_id", F.lit(2))
    away = (F.pmod("event_id", F.lit(50)) == 7) & (F.pmod("row_id", F.lit(2)) == 1) if moved else F.lit(False)
    return F.when(away, 1 - home).otherwise(home).alias("shard")


def sharded(spark, sf, moved: bool):
    """The points written to two shards and read back with the shard each came from."""
    path = folder(spark)
    R.lightcurves(spark, sf, ("g", "r")).select("*", _shard(moved)).drop("row_id").write.partitionBy("shard").parquet(path)
    d = readers.lightcurves(spark, path, source=True)
    return d.withColumn("source_file", F.regexp_extract("source_file", "(shard=\\d+)", 1))


@query("population_load_report", "K1 A11 F10 F5", f"""WITH {S.LC}, {S.OBJ}, f AS (SELECT event_id, count(*) AS n, min(s) AS a, max(s) AS b FROM (SELECT event_id, 'shard=' || CASE WHEN event_id % 50 = 7 AND row_id % 2 = 1 THEN 1 - event_id % 2 ELSE event_id % 2 END AS s FROM lc WHERE band IN ('g', 'r')) GROUP BY event_id)
 SELECT coalesce(f.event_id, obj.event_id) AS event_id, CASE WHEN f.event_id IS NULL THEN 'missing' WHEN a <> b THEN 'in_several_files' WHEN obj.event_id IS NULL THEN 'not_expected' ELSE 'loaded' END AS status, coalesce(n, 0) AS n_rows, a AS first_file, b AS last_file
 FROM f FULL JOIN obj ON f.event_id = obj.event_id""")
def _(spark, sf):
    return loading.load_report(sharded(spark, sf, True), R.objects(spark, sf))


@query("population_from_shards", "K1 A11", f"WITH {S.COL}, {S.OBJ} SELECT event_id, bin_index, {S.r6('mag1 mag2 color')} FROM col WHERE event_id IN (SELECT event_id FROM obj)")
def _(spark, sf):
    d = loading.load(sharded(spark, sf, False), R.objects(spark, sf))
    return tidy(E.population_colours(d, G, "g", "r"), "event_id", "bin_index", "mag1", "mag2", "color")


@query("population_colours_second_system", "K1 D3 K21", f"""WITH {S.DUAL}, {S.GRID}, {S.at_centres('dual')} SELECT event_id, bin_index, round(max(mag) FILTER (photometric_system = 'ps1' AND band = 'g'), 6) + 0.0 AS mag1,
 round(max(mag) FILTER (photometric_system = 'lsst' AND band = 'g'), 6) + 0.0 AS sel1, round(max(mag) FILTER (photometric_system = 'ps1' AND band = 'g') - max(mag) FILTER (photometric_system = 'ps1' AND band = 'r'), 6) + 0.0 AS color
 FROM atc WHERE band IN ('g', 'r') GROUP BY ALL""")
def _(spark, sf):
    d = E.population_colours(R.dual_lightcurves(spark, sf, ("g", "r")), G, "g", "r", "ps1")
    return tidy(d, "event_id", "bin_index", "mag1", "sel1", "color")


@query("depth_stages", "K2 D3 K23", f"WITH {S.STAGED} SELECT stage, event_id, bin_index, {S.r6('color')} FROM staged")
def _(spark, sf):
    return tidy(E.stages(colours(spark, sf), R.depths(spark, sf), "g", "r"), "stage", "event_id", "bin_index", "color")


RULE_SQL = f"""WITH {S.RULES} SELECT stage, stage || '_bin_' || lpad(CAST(bin_index AS VARCHAR), 3, '0') AS rule_id, bin_index, {S.r6('t_min_days t_max_days t_center_days')}, 4e-1 AS bin_width_days, n AS N_population_events,
 consecutive AS initial_consecutive_valid, 1e0 AS low_percentile, 99e0 AS high_percentile, {S.r6('color_min color_median color_max')}, round(n * 1e-2, 6) + 0.0 AS expected_lower_tail_events, round(n * 1e-2, 6) + 0.0 AS expected_upper_tail_events,
 98e0 AS nominal_coverage_percent, 'p1-p99' AS envelope_definition, 1 AS selection_rank, false AS median_only FROM rules"""


@query("envelope_rules", "K3 G3 K4 H4", RULE_SQL)
def _(spark, sf):
    return tidy(E.with_rule_id(rules(spark, sf)))


@query("envelope_rules_hash", "K3 G3", RULE_SQL)
def _(spark, sf):
    return tidy(E.with_rule_id(E.rules(staged(spark, sf), ["stage"], G, method="hash")))


_LOW = [q for q in E.DEFAULT_TAILS]
_P = sorted(set(_LOW + [100.0 - q for q in _LOW] + [50.0]))


@query("percentile_diagnostics", "K5 G3", f"""WITH {S.STAGED}, q AS (SELECT stage, bin_index, count(*) AS n, quantile_cont(color, [{', '.join(f'{p / 100.0!r}::DOUBLE' for p in _P)}]) AS qs FROM staged GROUP BY ALL),
 u AS (SELECT stage, bin_index, n, unnest(qs) AS value, unnest([{', '.join(f'{float(p)!r}::DOUBLE' for p in _P)}]) AS percentile FROM q)
 SELECT stage, bin_index, n AS N_population_events, round(value, 6) + 0.0 AS value, round(percentile, 6) + 0.0 AS percentile, {S.r6('t_min_days t_max_days t_center_days')}, round(n * least(percentile, 100 - percentile) / 100, 6) + 0.0 AS expected_nearest_tail_events FROM u JOIN grid USING (bin_index)""")
def _(spark, sf):
    return tidy(E.diagnostics(staged(spark, sf), ["stage"], G))


@query("envelope_availability", "K6 F10 H4", f"""WITH {S.STAGED}, {S.OBJ}, sup AS (SELECT bin_index, count(*) AS n FROM col WHERE color IS NOT NULL GROUP BY bin_index), av AS (SELECT stage, bin_index, count(*) AS n FROM staged GROUP BY ALL),
 d AS (SELECT s.stage, bin_index, t_min_days, t_max_days, t_center_days, (SELECT count(*) FROM obj) AS N_population_total, coalesce(sup.n, 0) AS N_population_model_supported, coalesce(av.n, 0) AS N_population_stage_available
 FROM grid CROSS JOIN (VALUES ('no_m5'), ('m5')) s(stage) LEFT JOIN sup USING (bin_index) LEFT JOIN av USING (stage, bin_index))
 SELECT stage, bin_index, {S.r6('t_min_days t_max_days t_center_days')}, N_population_total, N_population_model_supported, N_population_stage_available, N_population_stage_available > 0 AS candidate_envelope_valid,
 min(N_population_stage_available > 0) OVER (PARTITION BY stage ORDER BY bin_index) AS initial_consecutive_valid FROM d""")
def _(spark, sf):
    c = settled_colours(spark, sf)
    st = E.stages(c, R.depths(spark, sf), "g", "r")
    return tidy(E.availability(st, c, R.objects(spark, sf), G))


@query("first_valid_run", "H11", f"""WITH {S.LC}, b AS (SELECT floor(t_days)::INTEGER AS day, count(*) FILTER (mag > 300) > 0 AS valid FROM lc GROUP BY ALL), f AS (SELECT min(day) AS d0 FROM b WHERE valid), g AS (SELECT min(day) AS d1 FROM b, f WHERE day > d0 AND NOT valid)
 SELECT day, valid, valid AND day >= d0 AND (d1 IS NULL OR day < d1) AS in_first_run FROM b, f, g""")
def _(spark, sf):
    d = R.lightcurves(spark, sf).groupBy(F.floor("t_days").cast("int").alias("day")).agg((F.count_if(F.col("mag") > 300) > 0).alias("valid"))
    return E.first_valid_run(d, [], "day", "valid")


NATIVE = f"nat AS (SELECT event_id, t_days FROM (SELECT event_id, floor(t_days * 4) / 4 AS t_days, band FROM lc WHERE band IN ('g', 'r')) GROUP BY ALL HAVING count(DISTINCT band) = 2)"


def native(spark, sf):
    d = R.lightcurves(spark, sf, ("g", "r")).withColumn("t_days", F.floor(F.col("t_days") * 4) / 4)
    return curves.native_pairs(d, "g", "r")


EXITS = S.RULES + """, cm AS (SELECT s.event_id, s.stage, s.bin_index, s.color, color_min, color_max, t_center_days, s.color > color_max AS above, s.color < color_min AS below FROM staged s JOIN rules USING (stage, bin_index)),
 lst AS (SELECT stage, max(bin_index) AS final_bin FROM rules GROUP BY stage), ew AS (SELECT *, above OR below AS outside, max(bin_index) OVER w AS last_bin, min(CASE WHEN NOT (above OR below) THEN bin_index END) OVER w AS first_inside
 FROM cm WINDOW w AS (PARTITION BY event_id, stage)), er AS (SELECT *, bin_index - row_number() OVER (PARTITION BY event_id, stage ORDER BY bin_index) AS run FROM ew WHERE outside),
 ex AS (SELECT event_id, stage, min(bin_index) AS first_outside_bin, min(t_center_days) AS first_outside_time_days, max(bin_index) AS last_outside_bin, max(t_center_days) AS last_outside_time_days, count(*) AS n_final_outside_bins,
 CASE WHEN bool_and(above) THEN 'redder' WHEN bool_and(below) THEN 'bluer' ELSE 'mixed' END AS exit_direction, max(CASE WHEN below THEN color_min - color ELSE color - color_max END) AS maximum_excursion_mag, max(bin_index) < any_value(final_bin) AS right_censored
 FROM er JOIN lst USING (stage) GROUP BY event_id, stage, run HAVING max(bin_index) = any_value(last_bin) AND count(*) >= 2 AND any_value(first_inside) < min(bin_index))"""


@query("permanent_exits", "K11 H6 C8", f"""WITH {EXITS}, {S.OBJ} SELECT stage, event_id, first_outside_bin, {S.r6('first_outside_time_days')}, last_outside_bin, {S.r6('last_outside_time_days')}, n_final_outside_bins, exit_direction, {S.r6('maximum_excursion_mag')}, right_censored,
 round(pow(10, log10_mej_dyn), 6) + 0.0 AS M_ej_dyn_Msun, round(degrees(inclination_EM), 6) + 0.0 AS inclination_deg, CAST(NULL AS DOUBLE) AS beta FROM ex JOIN obj USING (event_id)""")
def _(spark, sf):
    st = staged(spark, sf)
    x = E.exits(st, materialize(E.rules(st, ["stage"], G)), ["stage"], 2)
    p = E.physical_parameters(R.objects(spark, sf)).select("event_id", "M_ej_dyn_Msun", "inclination_deg", "beta")
    return tidy(x.join(p, "event_id"))


@query("stage_summary", "K7 G22", f"""WITH {EXITS}, {NATIVE}, xc AS (SELECT stage, count(*) AS n FROM ex GROUP BY stage) SELECT stage, count(*) AS N_valid_bins_anywhere, count(*) FILTER (consecutive) AS N_initial_consecutive_valid_bins,
 round(max(t_max_days) FILTER (consecutive), 6) + 0.0 AS last_initial_consecutive_time_days, (SELECT count(*) FROM nat) AS N_native_population_points, coalesce(any_value(n_ex), 0) AS N_permanent_exits FROM rules LEFT JOIN (SELECT stage, n AS n_ex FROM xc) USING (stage) GROUP BY stage""")
def _(spark, sf):
    st = staged(spark, sf)
    r = materialize(E.rules(st, ["stage"], G))
    n = E.exits(st, r, ["stage"], 2).groupBy("stage").agg(F.count("*").alias("N_permanent_exits"))
    return tidy(E.stage_summary(r, native(spark, sf), n))


@query("native_colour_points", "E7 G22", f"WITH {S.LC}, {NATIVE} SELECT event_id, count(*) AS n FROM nat GROUP BY event_id")
def _(spark, sf):
    return native(spark, sf).groupBy("event_id").agg(F.count("*").alias("n"))


# Two populations: objects whose segment sorts before G, and the others.
POP = S.STAGED + ", " + S.OBJ + """, ps AS (SELECT staged.*, CASE WHEN population < 'G' THEN 'a' ELSE 'b' END AS pop FROM staged JOIN obj USING (event_id)),
 pr AS (SELECT pop, stage, bin_index, t_min_days, t_max_days, t_center_days, count(*) AS n, quantile_cont(color, 1e-2) AS lo, quantile_cont(color, 5e-1) AS mid, quantile_cont(color, 99e-2) AS hi,
  row_number() OVER (PARTITION BY pop, stage ORDER BY bin_index) - 1 = bin_index AS consecutive FROM ps JOIN grid USING (bin_index) GROUP BY pop, stage, bin_index, t_min_days, t_max_days, t_center_days)"""


def two_populations(spark, sf):
    label = F.when(F.col("population") < "G", "a").otherwise("b").alias("pop")
    labelled = colours(spark, sf).where("color IS NOT NULL").join(R.objects(spark, sf).select("event_id", label), "event_id")
    return E.stages(materialize(labelled), R.depths(spark, sf), "g", "r")


def _overlap_sql(rule_filter: str) -> str:
    return f"""ov0 AS (SELECT a.stage, a.bin_index, a.t_center_days, a.lo AS a_min, a.hi AS a_max, b.lo AS b_min, b.hi AS b_max FROM pr a JOIN pr b ON a.stage = b.stage AND a.bin_index = b.bin_index AND a.pop = 'a' AND b.pop = 'b' {rule_filter}),
 cnt AS (SELECT o.stage, o.bin_index, count(*) FILTER (pop = 'b') AS N_b_available, count(*) FILTER (pop = 'b' AND color BETWEEN a_min AND a_max) AS N_b_inside_a, count(*) FILTER (pop = 'a') AS N_a_available,
  count(*) FILTER (pop = 'a' AND color BETWEEN b_min AND b_max) AS N_a_inside_b FROM ov0 o JOIN ps USING (stage, bin_index) GROUP BY ALL),
 ov AS (SELECT *, greatest(0e0, least(a_max, b_max) - greatest(a_min, b_min)) AS overlap_width_mag, greatest(a_max, b_max) - least(a_min, b_min) AS union_width_mag FROM ov0 JOIN cnt USING (stage, bin_index)),
 ovf AS (SELECT *, CASE WHEN overlap_width_mag > 0 THEN greatest(a_min, b_min) END AS overlap_color_min, CASE WHEN overlap_width_mag > 0 THEN least(a_max, b_max) END AS overlap_color_max,
  CASE WHEN union_width_mag > 0 THEN overlap_width_mag / union_width_mag ELSE (a_min = b_min AND a_max = b_max)::INT::DOUBLE END AS overlap_fraction_union, overlap_width_mag / nullif(a_max - a_min, 0) AS overlap_fraction_a_width,
  overlap_width_mag / nullif(b_max - b_min, 0) AS overlap_fraction_b_width, N_b_inside_a / nullif(N_b_available, 0) AS fraction_b_inside_a, N_a_inside_b / nullif(N_a_available, 0) AS fraction_a_inside_b FROM ov)"""


OVERLAP_COLUMNS = "a_min a_max b_min b_max overlap_color_min overlap_color_max overlap_width_mag union_width_mag overlap_fraction_union overlap_fraction_a_width overlap_fraction_b_width fraction_b_inside_a fraction_a_inside_b"
OVERLAP_COUNTS = "N_a_available, N_a_inside_b, N_b_available, N_b_inside_a"


def overlap_of(v, r, consecutive=False):
    """Overlap of the two populations from their values and their rules, a table of bins that is worked out once."""
    if consecutive:
        r = r.where("initial_consecutive_valid")
    side = lambda d, p: d.where(F.col("pop") == p).drop("pop")
    return E.overlap(side(r, "a"), side(r, "b"), side(v, "a"), side(v, "b"), ["stage"])


def overlap(spark, sf):
    v = two_populations(spark, sf)
    return overlap_of(v, materialize(E.rules(v, ["pop", "stage"], G)))


@query("population_overlap", "K8 F1", f"WITH {POP}, {_overlap_sql('')} SELECT stage, bin_index, {S.r6('t_center_days')}, {S.r6(OVERLAP_COLUMNS)}, {OVERLAP_COUNTS} FROM ovf")
def _(spark, sf):
    d = overlap(spark, sf)
    return tidy(d.drop("t_min_days", "t_max_days"))


@query("overlap_summary", "K9", f"""WITH {POP}, {_overlap_sql('')} SELECT stage, count(*) AS N_common_valid_bins, count(*) FILTER (overlap_width_mag > 0) AS N_bins_with_overlap, round(avg((overlap_width_mag > 0)::INT), 6) + 0.0 AS fraction_bins_with_overlap,
 round(sum(overlap_width_mag) / nullif(sum(union_width_mag), 0), 6) + 0.0 AS total_overlap_fraction_union, round(avg(overlap_fraction_union), 6) + 0.0 AS mean_overlap_fraction_union, round(avg(fraction_b_inside_a), 6) + 0.0 AS mean_fraction_b_inside_a,
 round(avg(fraction_a_inside_b), 6) + 0.0 AS mean_fraction_a_inside_b FROM ovf GROUP BY stage""")
def _(spark, sf):
    return tidy(E.overlap_summary(overlap(spark, sf), ["stage"]))


def _all_bins(sql: str) -> str:
    """The same tables under names of their own, so that both sets of bins fit one query."""
    for name in ("ovf", "ov0", "cnt", "ov"):
        sql = re.sub(rf"\b{name}\b", f"{name}_all", sql)
    return sql


TAILS = (16.0, 50.0)


@query("second_population_products", "K22 K3 K5 K6 K8", f"""WITH {POP}, {_overlap_sql('AND a.consecutive AND b.consecutive')}, {_all_bins(_overlap_sql(''))},
 dg AS (SELECT stage, bin_index, count(*) AS n, unnest([16e0, 5e1, 84e0]) AS percentile, unnest(quantile_cont(color, [16e-2, 5e-1, 84e-2])) AS value FROM ps WHERE pop = 'b' GROUP BY stage, bin_index),
 av AS (SELECT stage, bin_index, count(*) AS n FROM ps WHERE pop = 'b' GROUP BY ALL),
 sp AS (SELECT stage, grid.bin_index FROM grid, (VALUES ('no_m5'), ('m5')) s(stage)), su AS (SELECT bin_index, count(*) AS k FROM ps WHERE pop = 'b' AND stage = 'no_m5' GROUP BY bin_index)
 SELECT 'rules' AS product, stage, bin_index, NULL::DOUBLE AS percentile, n, round(mid, 6) + 0.0 AS value FROM pr WHERE pop = 'b'
 UNION ALL SELECT 'diagnostics', stage, bin_index, percentile, n, round(value, 6) + 0.0 FROM dg
 UNION ALL SELECT 'availability', sp.stage, sp.bin_index, NULL, coalesce(av.n, 0), coalesce(su.k, 0)::DOUBLE FROM sp LEFT JOIN av USING (stage, bin_index) LEFT JOIN su ON su.bin_index = sp.bin_index
 UNION ALL SELECT 'overlap_consecutive', stage, bin_index, NULL, N_b_inside_a, round(overlap_width_mag, 6) + 0.0 FROM ovf
 UNION ALL SELECT 'overlap_all', stage, bin_index, NULL, N_b_inside_a, round(overlap_width_mag, 6) + 0.0 FROM ovf_all""")
def _(spark, sf):
    """Five products from one load: a table of percentiles over population, stage and bin, written by population and stage."""
    v = two_populations(spark, sf)
    percents = E.product_percents((1.0,), TAILS)
    t = materialize(E.percentile_table(v, ["pop", "stage"], percents), "pop", "stage")
    r, second = E.rules_of(t, ["pop", "stage"], G, percents), v.where("pop = 'b'")
    supported = second.where("stage = 'no_m5'")
    av = E.availability(second, supported, supported.select("event_id").distinct(), G)
    no = F.lit(None).cast("double")
    parts = {
        "rules": (r.where("pop = 'b'"), no, "N_population_events", "color_median"),
        "diagnostics": (E.diagnostics_of(t.where("pop = 'b'"), ["stage"], G, percents, TAILS), F.col("percentile"), "N_population_events", "value"),
        "availability": (av, no, "N_population_stage_available", "N_population_model_supported"),
        "overlap_consecutive": (overlap_of(v, r, True), no, "N_b_inside_a", "overlap_width_mag"), "overlap_all": (overlap_of(v, r), no, "N_b_inside_a", "overlap_width_mag"),
    }
    rows = [d.select(F.lit(name).alias("product"), "stage", "bin_index", p.alias("percentile"), F.col(n).alias("n"), F.col(x).cast("double").alias("value")) for name, (d, p, n, x) in parts.items()]
    return tidy(reduce(DataFrame.unionByName, rows))


POINTS = "pts AS (SELECT a.row_id, a.t_days AS phase_days, a.mag - 50 AS color, (a.row_id % 50)::DOUBLE AS color_error FROM lc a WHERE band = 'i')"


def points(spark, sf):
    d = R.lightcurves(spark, sf, ("i",))
    return d.select("row_id", F.col("t_days").alias("phase_days"), (F.col("mag") - 50).alias("color"), F.pmod("row_id", F.lit(50)).cast("double").alias("color_error"))


POINT_EVAL = S.RULES + f""", {POINTS}, pm AS (SELECT pts.*, stage, bin_index, color_min, color_median, color_max FROM (SELECT pts.*, s.stage FROM pts CROSS JOIN (VALUES ('no_m5'), ('m5')) s(stage)) pts
 LEFT JOIN rules USING (stage) WHERE FALSE),
 pv AS (SELECT row_id, stage, phase_days, color, color_error, min(bin_index) AS bin_index FROM (SELECT p.*, s.stage, r.bin_index FROM pts p CROSS JOIN (VALUES ('no_m5'), ('m5')) s(stage)
  LEFT JOIN rules r ON r.stage = s.stage AND phase_days BETWEEN 4e-1 AND 26e0 AND r.t_min_days <= phase_days AND (phase_days < r.t_max_days OR abs(phase_days - r.t_max_days) <= 1e-8 + 1e-5 * abs(r.t_max_days))) GROUP BY ALL),
 pe AS (SELECT pv.*, color_min AS lo, color_median AS mid, color_max AS up, color - color_error AS il, color + color_error AS iu, r.bin_index IS NOT NULL AS evaluated FROM pv LEFT JOIN rules r USING (stage, bin_index)),
 pf AS (SELECT *, CASE WHEN evaluated THEN iu >= lo AND il <= up END AS passes_filter, CASE WHEN evaluated THEN color BETWEEN lo AND up END AS central, CASE WHEN NOT phase_days BETWEEN 4e-1 AND 26e0 THEN 'outside_requested_time_range' WHEN NOT evaluated THEN 'no_valid_envelope_bin'
  WHEN iu < lo THEN 'bluer' WHEN il > up THEN 'redder' WHEN color BETWEEN lo AND up THEN 'pass_central' ELSE 'pass_with_photometric_error' END AS result, CASE WHEN evaluated THEN CASE WHEN iu < lo THEN lo - iu WHEN il > up THEN il - up ELSE 0 END END AS excursion FROM pe)"""
POINT_EVAL = POINT_EVAL.replace(POINT_EVAL[POINT_EVAL.index(", pm AS"):POINT_EVAL.index("WHERE FALSE),") + len("WHERE FALSE),")], ",")


def evaluated(spark, sf):
    r = rules(spark, sf)
    p = points(spark, sf).withColumn("stage", F.explode(F.array(F.lit("no_m5"), F.lit("m5"))))
    return E.evaluate_points(p, r, 0.4, 26.0, 1.0, keys=["stage"])


@query("point_evaluation", "K12 F8", f"""WITH {POINT_EVAL} SELECT row_id, stage, evaluated, passes_filter, central AS passes_filter_central_value, result, round(CASE WHEN evaluated THEN il END, 6) + 0.0 AS color_interval_min, round(CASE WHEN evaluated THEN iu END, 6) + 0.0 AS color_interval_max,
 bin_index, round(lo, 6) + 0.0 AS color_min, round(mid, 6) + 0.0 AS color_median, round(up, 6) + 0.0 AS color_max, round(excursion, 6) + 0.0 AS excursion_beyond_envelope_mag FROM pf""")
def _(spark, sf):
    return tidy(evaluated(spark, sf).drop("phase_days", "color", "color_error"))


@query("point_counts", "K12", f"""WITH {POINT_EVAL} SELECT stage, count(*) AS N_paired_points, count(*) FILTER (evaluated) AS N_evaluated_points, count(*) FILTER (coalesce(passes_filter, false)) AS N_passing_points, count(*) FILTER (coalesce(central, false)) AS N_passing_central_points,
 count(*) FILTER (coalesce(passes_filter, false) AND NOT coalesce(central, false)) AS N_passing_via_photometric_error_points, count(*) FILTER (evaluated AND NOT coalesce(passes_filter, false)) AS N_failing_points FROM pf GROUP BY stage""")
def _(spark, sf):
    return E.point_counts(evaluated(spark, sf), ["stage"])


# Measured colours: g and r on the same whole quarter day; rules of the m5 stage, and a second, later set that overlaps.
MEASURED = NATIVE.replace("SELECT event_id, t_days FROM (SELECT event_id, floor(t_days * 4) / 4 AS t_days, band FROM lc", "SELECT event_id, t_days, median(mag) FILTER (band = 'g') - median(mag) FILTER (band = 'r') AS color FROM (SELECT event_id, floor(t_days * 4) / 4 AS t_days, band, mag FROM lc") + """,
 ru AS (SELECT bin_index AS rule_order, stage || '_bin_' || lpad(CAST(bin_index AS VARCHAR), 3, '0') AS rule_id, t_min_days, t_max_days, color_min, color_max FROM rules WHERE stage = 'no_m5'
  UNION ALL SELECT 1000 + bin_index, 'm5_bin_' || lpad(CAST(bin_index AS VARCHAR), 3, '0'), t_min_days, t_max_days, color_min, color_max FROM rules WHERE stage = 'm5' AND bin_index >= 30),
 mv AS (SELECT n.event_id, n.t_days, n.color, max(rule_order) AS rule_order FROM nat n LEFT JOIN ru ON t_days > t_min_days AND t_days <= t_max_days GROUP BY ALL),
 me AS (SELECT event_id, t_days, color, rule_id IS NOT NULL AS evaluated, coalesce(color BETWEEN color_min AND color_max, false) AS passes_cut, rule_id, color_min, color_max FROM mv LEFT JOIN ru USING (rule_order))"""


def measured(spark, sf):
    r = E.with_rule_id(rules(spark, sf))
    first = r.where("stage = 'no_m5'").withColumn("rule_order", F.col("bin_index"))
    second = r.where("stage = 'm5' AND bin_index >= 30").withColumn("rule_order", 1000 + F.col("bin_index"))
    both = first.unionByName(second).select("rule_order", "rule_id", "t_min_days", "t_max_days", "color_min", "color_max")
    c = native(spark, sf).select("event_id", "t_days", "color")
    return E.apply_rules(c, both, ["event_id", "t_days"], "t_days")


@query("rule_evaluation", "K13 F8", f"WITH {S.RULES}, {MEASURED} SELECT event_id, t_days, {S.r6('color')}, evaluated, passes_cut, rule_id, {S.r6('color_min color_max')} FROM me")
def _(spark, sf):
    return tidy(measured(spark, sf))


@query("selection_criteria", "K14", f"""WITH {S.RULES}, {MEASURED}, pr1 AS (SELECT event_id, rule_id, min(t_days) FILTER (passes_cut) AS fp FROM me WHERE evaluated GROUP BY ALL),
 c1 AS (SELECT event_id, arg_min(passes_cut, t_days) AS first_passed, min(t_days) AS t0 FROM me WHERE evaluated GROUP BY event_id),
 c2 AS (SELECT event_id, min(fp) AS ever, count(*) AS nr, count(fp) AS np, list_sort(list(fp) FILTER (fp IS NOT NULL)) AS ts FROM pr1 GROUP BY event_id)
 SELECT event_id, first_passed AS first_color_passed, CASE WHEN first_passed THEN t0 END AS first_color_time_days, nr >= 2 AS two_bins_evaluable, np >= 2 AS two_bins_passed, CASE WHEN np >= 2 THEN ts[2] END AS two_bins_time_days, np > 0 AS ever_passed, ever AS ever_time_days FROM c1 JOIN c2 USING (event_id)""")
def _(spark, sf):
    return tidy(E.criteria(measured(spark, sf), "event_id", "t_days", "color"))


CENSOR = S.COL + ", " + S.DEPTH + ", " + S.OBJ + """, ce AS (SELECT col.event_id, bin_index, mag1, mag2, m5_1, m5_2, population < 'G' AS in_population, CASE WHEN mag1 IS NULL OR mag2 IS NULL THEN 0 WHEN mag1 <= m5_1 AND mag2 <= m5_2 THEN 1 WHEN mag2 <= m5_2 THEN 2 WHEN mag1 <= m5_1 THEN 3 ELSE 4 END AS state
 FROM col JOIN obj USING (event_id), dep), cb AS (SELECT *, CASE state WHEN 1 THEN mag1 - mag2 WHEN 2 THEN m5_1 - mag2 WHEN 0 THEN NULL ELSE '-inf'::DOUBLE END AS lower_bound, CASE state WHEN 1 THEN mag1 - mag2 WHEN 3 THEN mag1 - m5_2 WHEN 0 THEN NULL ELSE 'inf'::DOUBLE END AS upper_bound FROM ce)"""


def censored(spark, sf):
    d = E.with_depths(colours(spark, sf), R.depths(spark, sf), "g", "r")
    o = R.objects(spark, sf).select("event_id", (F.col("population") < "G").alias("in_population"))
    return E.censor(d.join(o, "event_id"))


def settled_limits(spark, sf):
    return materialize(censored(spark, sf))


def totals(spark, sf):
    return R.objects(spark, sf).agg(F.count("*").alias("N_all"), F.count_if(F.col("population") < "G").alias("N_population"))


@query("censored_colour_states", "K15", f"""WITH {CENSOR} SELECT event_id, bin_index, state, round(CASE WHEN isinf(lower_bound) THEN NULL ELSE lower_bound END, 6) + 0.0 AS lower_finite, round(CASE WHEN isinf(upper_bound) THEN NULL ELSE upper_bound END, 6) + 0.0 AS upper_finite,
 coalesce(isinf(lower_bound), false) AS lower_open, coalesce(isinf(upper_bound), false) AS upper_open FROM cb""")
def _(spark, sf):
    inf = float("inf")
    d = censored(spark, sf)
    return tidy(d.select(
        "event_id", "bin_index", "state", F.when(F.col("lower_bound") > -inf, F.col("lower_bound")).alias("lower_finite"), F.when(F.col("upper_bound") < inf, F.col("upper_bound")).alias("upper_finite"),
        F.coalesce(F.col("lower_bound") == -inf, F.lit(False)).alias("lower_open"), F.coalesce(F.col("upper_bound") == inf, F.lit(False)).alias("upper_open")))


def _state_counts(prefix: str, cond: str) -> str:
    named = ", ".join(f"count(*) FILTER ({cond} AND state = {k}) AS N_{prefix}_{n}" for k, n in E.STATE_NAMES.items())
    bands = ", ".join(f"count(*) FILTER ({cond} AND mag{b} <= m5_{b}) AS N_{prefix}_band{b}_detected, count(*) FILTER ({cond} AND mag{b} IS NOT NULL) AS {prefix}_known{b}" for b in (1, 2))
    return f"{named}, {bands}"


def _state_final(prefix: str) -> str:
    names = [*(f"N_{prefix}_{n}" for n in E.STATE_NAMES.values()), *(f"N_{prefix}_band{b}_detected" for b in (1, 2))]
    kept = ", ".join(f"coalesce({n}, 0) AS {n}" for n in names)
    known = " - ".join(f"coalesce(N_{prefix}_{n}, 0)" for n in E.STATE_NAMES.values())
    unknown = ", ".join(f"N_{prefix} - coalesce({prefix}_known{b}, 0) AS N_{prefix}_band{b}_unknown" for b in (1, 2))
    return f"{kept}, N_{prefix}, N_{prefix} - {known} AS N_{prefix}_unknown_model, {unknown}"


STATES = CENSOR + f""", sc AS (SELECT bin_index, {_state_counts('all', 'true')}, {_state_counts('population', 'in_population')} FROM cb GROUP BY bin_index), tt AS (SELECT count(*) AS N_all, count(*) FILTER (population < 'G') AS N_population FROM obj),
 st0 AS (SELECT bin_index, t_min_days, t_max_days, t_center_days, {_state_final('all')}, {_state_final('population')} FROM grid LEFT JOIN sc USING (bin_index), tt),
 sts AS (SELECT *, N_population_both_detected + N_population_band1_ul_band2_detected AS N_population_lower_bound_sample FROM st0)"""


@query("limit_state_counts", "K16", f"""WITH {STATES} SELECT * EXCLUDE (t_min_days, t_max_days, t_center_days), {S.r6('t_min_days t_max_days t_center_days')}, round(N_population_lower_bound_sample / N_population, 6) + 0.0 AS fraction_population_lower_bound_sample, N_population_lower_bound_sample > 0 AS usable_lower_bound_bin FROM sts""")
def _(spark, sf):
    return tidy(E.limit_states(censored(spark, sf), G, totals(spark, sf)))


@query("lower_bound_percentiles", "K16 G3", f"""WITH {CENSOR} SELECT bin_index, count(*) AS N_population_events, count(*) FILTER (state = 2) AS N_population_ul, round(quantile_cont(lower_bound, 1e-2), 6) + 0.0 AS color_min, round(quantile_cont(lower_bound, 5e-1), 6) + 0.0 AS color_median,
 round(quantile_cont(lower_bound, 99e-2), 6) + 0.0 AS color_max FROM cb WHERE in_population AND state IN (1, 2) GROUP BY bin_index""")
def _(spark, sf):
    return tidy(E.lower_bound_rules(settled_limits(spark, sf), G), "bin_index", "N_population_events", "N_population_ul", "color_min", "color_median", "color_max")


@query("identification_intervals", "K17 G7", f"""WITH {CENSOR}, o AS (SELECT bin_index, lower_bound, upper_bound FROM cb WHERE in_population AND state IN (1, 2)), l AS (SELECT bin_index, count(*) AS n, list_sort(list(lower_bound)) AS lo, list_sort(list(upper_bound)) AS hi FROM o GROUP BY bin_index)
 SELECT bin_index, percentile, n AS N_population_events, round(lo[k], 6) + 0.0 AS colour_quantile_lower, round(CASE WHEN isinf(hi[k]) THEN NULL ELSE hi[k] END, 6) + 0.0 AS colour_quantile_upper, NOT isinf(hi[k]) AS upper_is_finite
 FROM (SELECT *, greatest(1, ceil(percentile * n / 100)::BIGINT) AS k FROM l, (VALUES (1e0), (16e0), (50e0), (84e0), (99e0)) p(percentile))""")
def _(spark, sf):
    d = E.identification_intervals(settled_limits(spark, sf), G, (1.0, 16.0))
    d = d.withColumn("colour_quantile_upper", F.when(F.col("upper_is_finite"), F.col("colour_quantile_upper")))
    return tidy(d, "bin_index", "percentile", "N_population_events", "colour_quantile_lower", "colour_quantile_upper", "upper_is_finite")


@query("support_horizon", "K18", f"""WITH {STATES} SELECT round(min(t_min_days) FILTER (N_population_lower_bound_sample > 0), 6) + 0.0 AS first_supported_edge_days, round(max(t_max_days) FILTER (N_population_lower_bound_sample > 0), 6) + 0.0 AS supported_until_edge_days,
 coalesce(max(bin_index) FILTER (N_population_lower_bound_sample > 0) = 63, false) AS support_reaches_grid_end, round(max(t_center_days) FILTER (N_all_band1_detected > 0), 6) + 0.0 AS last_band1_detection_days, coalesce(max(bin_index) FILTER (N_all_band1_detected > 0) = 63, false) AS band1_reaches_grid_end,
 round(max(t_center_days) FILTER (N_all_band2_detected > 0), 6) + 0.0 AS last_band2_detection_days, coalesce(max(bin_index) FILTER (N_all_band2_detected > 0) = 63, false) AS band2_reaches_grid_end FROM sts""")
def _(spark, sf):
    return tidy(E.horizon(E.limit_states(censored(spark, sf), G, totals(spark, sf)), G))


@query("dual_system_envelopes", "K21 K3", f"""WITH {S.DUAL}, {S.GRID}, {S.at_centres('dual')}, w AS (SELECT photometric_system, event_id, bin_index, max(mag) FILTER (band = 'g') - max(mag) FILTER (band = 'r') AS color FROM atc WHERE band IN ('g', 'r') GROUP BY ALL)
 SELECT photometric_system, bin_index, count(*) AS N_population_events, round(quantile_cont(color, 1e-2), 6) + 0.0 AS color_min, round(quantile_cont(color, 5e-1), 6) + 0.0 AS color_median, round(quantile_cont(color, 99e-2), 6) + 0.0 AS color_max FROM w WHERE color IS NOT NULL GROUP BY ALL""")
def _(spark, sf):
    at = curves.interpolate(R.dual_lightcurves(spark, sf, ("g", "r")), G)
    w = curves.wide_bands(at, {"mag1": "g", "mag2": "r"}, ["event_id", "photometric_system"]).withColumn("color", F.col("mag1") - F.col("mag2"))
    r = E.rules(materialize(w), ["photometric_system"], G)
    return tidy(r, "photometric_system", "bin_index", "N_population_events", "color_min", "color_median", "color_max")


SKYMAP = S.OBJ + """, pool AS (SELECT event_id, abs_b_deg * 4 AS fieldRA, phi - 45 AS fieldDec, row_number() OVER (ORDER BY md5('3:' || event_id), event_id) AS place FROM obj),
 snr AS (SELECT sn_id, row_number() OVER (ORDER BY sn_id) AS position FROM (SELECT DISTINCT sn_id FROM sn)), np AS (SELECT count(*) AS n FROM pool),
 map AS (SELECT sn_id, event_id AS projected_event_id, fieldRA, fieldDec, position > n AS reused FROM snr, np JOIN pool ON place = (position - 1) % n + 1)"""


def sky_map(spark, sf):
    pool = R.objects(spark, sf).select("event_id", (F.col("abs_b_deg") * 4).alias("fieldRA"), (F.col("phi") - 45).alias("fieldDec"))
    return SN.sky_mapping(R.snia(spark, sf).select("sn_id").distinct(), pool, 3)


@query("sky_position_mapping", "F15", f"WITH {S.SNIA}, {SKYMAP} SELECT * FROM map")
def _(spark, sf):
    return sky_map(spark, sf)


@query("second_population_adaptation", "K10 E9 F15", f"""WITH {S.SNIA}, {SKYMAP}, {S.GRID}, ad AS (SELECT sn_id AS event_id, band, mjd - min(mjd) OVER (PARTITION BY sn_id) AS t_days, mag FROM sn), {S.at_centres('ad', 'linear', keys='event_id, band')},
 w AS (SELECT event_id, bin_index, max(mag) FILTER (band = 'g') AS mag1, max(mag) FILTER (band = 'r') AS mag2 FROM atc WHERE band IN ('g', 'r') GROUP BY ALL HAVING count(*) = 2)
 SELECT event_id, bin_index, round(mag1 - mag2, 6) + 0.0 AS color, mag1 <= 3e1 AND mag2 <= 3e1 AS within_depth, projected_event_id FROM w JOIN map ON event_id = sn_id""")
def _(spark, sf):
    d = SN.adapt(R.snia(spark, sf).where(F.col("band").isin("g", "r", "i", "z", "y")), None, "first_observation")
    c = E.population_colours(d, G, "g", "r", how=SN.interpolation_rule("first_observation")).where("color IS NOT NULL")
    c = E.with_depths(c, {"g": 30.0, "r": 30.0}, "g", "r").withColumn("within_depth", E.passes_depth())
    m = sky_map(spark, sf).select(F.col("sn_id").alias("event_id"), "projected_event_id")
    return tidy(c.join(m, "event_id").select("event_id", "bin_index", "color", "within_depth", "projected_event_id"))


@query("selection_bias", "M4", f"""WITH {S.STAGED}, b AS (SELECT bin_index, count(*) FILTER (stage = 'no_m5') AS n0, count(*) FILTER (stage = 'm5') AS n1, {', '.join(f"quantile_cont(color, {p}e-2) FILTER (stage = '{s}') AS {s}_colour_p{p}" for s in ('no_m5', 'm5') for p in (16, 50, 84))} FROM staged GROUP BY bin_index)
 SELECT bin_index, {S.r6('t_min_days t_max_days t_center_days')}, {S.r6(' '.join(f'{s}_colour_p{p}' for s in ('no_m5', 'm5') for p in (16, 50, 84)))}, coalesce(n0, 0) AS N_model_supported, coalesce(n1, 0) AS N_m5_selected, round(n1 / nullif(n0, 0), 6) + 0.0 AS m5_retained_fraction,
 round(m5_colour_p50 - no_m5_colour_p50, 6) + 0.0 AS median_shift_m5_minus_no_m5 FROM grid LEFT JOIN b USING (bin_index)""")
def _(spark, sf):
    return tidy(cells.selection_bias(staged(spark, sf), G))
