"""Queries over survey pointings, depths, coverage and cadence."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyhue.operators import curves, survey as V
from skyhue.plans import roles as R, shared_sql as S
from skyhue.plans.output import tidy
from skyhue.plans.registry import query
from skyhue.functions import columns as C

N_FIELDS = 60
RADIUS = 1.75


@query("unique_centres", "G2", f"WITH {S.OBS} SELECT round(fieldRA, 6) + 0.0 AS fieldRA, round(fieldDec, 6) + 0.0 AS fieldDec, string_agg(DISTINCT target_name, ',' ORDER BY target_name) AS target_name, count(DISTINCT target_name) AS n_target_names FROM obs GROUP BY obs.fieldRA, obs.fieldDec")
def _(spark, sf):
    return tidy(V.centres(R.observations(spark, sf)))


ALLOC = S.OBS + """, bt AS (SELECT target_name, fieldRA, fieldDec, count(*) AS n_obs_center FROM obs GROUP BY ALL), sr AS (SELECT target_name, count(*) AS n_centers, sum(n_obs_center)::BIGINT AS n_obs FROM bt GROUP BY ALL), a0 AS (SELECT *, count(*) OVER () AS k, sum(n_centers) OVER () AS s FROM sr),
 a1 AS (SELECT *, (60 - k) * (n_centers::DOUBLE / s) AS raw FROM a0), a2 AS (SELECT *, 60 - k - sum(floor(raw)) OVER () AS rest, row_number() OVER (ORDER BY raw - floor(raw) DESC, n_centers DESC, target_name) AS o FROM a1),
 al AS (SELECT target_name, n_centers, n_obs, least(1 + floor(raw) + CASE WHEN o <= rest THEN 1 ELSE 0 END, n_centers)::BIGINT AS n_alloc FROM a2)"""


@query("stratum_allocation", "H10", f"WITH {ALLOC} SELECT * FROM al")
def _(spark, sf):
    return V.allocate(V.strata(V.centres_by_target(R.observations(spark, sf))), N_FIELDS)


KEY = "printf('%.6f', fieldRA) || '/' || printf('%.6f', fieldDec)"
PARENT = """pc AS (SELECT fieldRA, fieldDec, string_agg(DISTINCT target_name, ',' ORDER BY target_name) AS target_name, count(DISTINCT target_name) AS n_target_names FROM obs GROUP BY fieldRA, fieldDec)"""


@query("uniform_field_sample", "I6", f"WITH {S.OBS}, {PARENT} SELECT round(fieldRA, 6) + 0.0 AS fieldRA, round(fieldDec, 6) + 0.0 AS fieldDec, target_name, rank FROM (SELECT *, row_number() OVER (ORDER BY md5('9:' || {KEY}), {KEY}) AS rank FROM pc) WHERE rank <= 60")
def _(spark, sf):
    return tidy(V.sample_uniform(R.observations(spark, sf), N_FIELDS, 9), "fieldRA", "fieldDec", "target_name", "rank")


@query("stratified_field_sample", "I7 F5 I8", f"""WITH {ALLOC}, {PARENT}, rk AS (SELECT *, row_number() OVER (PARTITION BY target_name ORDER BY md5('9:' || {KEY}), {KEY}) AS rank FROM bt), dr AS (SELECT * FROM rk JOIN al USING (target_name) WHERE rank <= n_alloc), un AS (SELECT DISTINCT fieldRA, fieldDec FROM dr),
 rs AS (SELECT pc.*, row_number() OVER (ORDER BY md5('9:' || {KEY}), {KEY}) AS rank FROM pc ANTI JOIN un USING (fieldRA, fieldDec))
 SELECT round(fieldRA, 6) + 0.0 AS fieldRA, round(fieldDec, 6) + 0.0 AS fieldDec, target_name, n_target_names, source FROM (SELECT pc.*, 'stratum' AS source FROM pc JOIN un USING (fieldRA, fieldDec) UNION ALL SELECT fieldRA, fieldDec, target_name, n_target_names, 'top_up' FROM rs WHERE rank <= 60 - (SELECT count(*) FROM un))""")
def _(spark, sf):
    return tidy(V.sample_stratified(R.observations(spark, sf), N_FIELDS, 9)[0])


@query("stratified_sample_report", "I7 H10", f"WITH {ALLOC} SELECT *, n_alloc AS n_sampled FROM al")
def _(spark, sf):
    return V.sample_stratified(R.observations(spark, sf), N_FIELDS, 9)[1]


SEP = "degrees(2 * asin(sqrt(pow(sin(radians(fieldDec - dec0_deg) / 2), 2) + cos(radians(dec0_deg)) * cos(radians(fieldDec)) * pow(sin(radians(fieldRA - ra0_deg) / 2), 2))))"


@query("cone_search_visits", "F6 D8", f"WITH {S.OBS} SELECT field_index, count(*) AS n_visits, round(max({SEP}), 6) + 0.0 AS farthest_deg, round(min(observationStartMJD), 6) + 0.0 AS first_mjd FROM fields JOIN obs ON fieldDec BETWEEN dec0_deg - 18e-1 AND dec0_deg + 18e-1 AND {SEP} <= 175e-2 GROUP BY field_index")
def _(spark, sf):
    f = R.fields(spark, sf).select("field_index", "ra0_deg", "dec0_deg")
    d = V.cone_join(f, R.observations(spark, sf), RADIUS).groupBy("field_index").agg(
        F.count("*").alias("n_visits"), F.max("separation_deg").alias("farthest_deg"), F.min("observationStartMJD").alias("first_mjd"))
    return tidy(d)


@query("depth_summary", "G5 G3", f"WITH {S.VISITS} SELECT band, count(*) AS N_visits, round(avg(m5), 6) + 0.0 AS mean, round(stddev_samp(m5), 6) + 0.0 AS std, round(min(m5), 6) + 0.0 AS min, round(max(m5), 6) + 0.0 AS max, round(median(m5), 6) + 0.0 AS median, {', '.join(f'round(quantile_cont(m5, {p}e-2), 6) + 0.0 AS p{p}' for p in V.SUMMARY_PERCENTS)}, round(quantile_cont(m5, 3e-1), 6) + 0.0 AS m5_threshold FROM visits GROUP BY band")
def _(spark, sf):
    return tidy(V.depth_summary(R.visits(spark, sf), 30.0))


@query("band_median_depths", "G6", f"WITH {S.VISITS} SELECT b.band, round(median(m5), 6) + 0.0 AS m5_median, count(m5) AS N_exported_visit_rows FROM (VALUES ('u'), ('g'), ('r'), ('i'), ('z'), ('y')) b(band) LEFT JOIN visits USING (band) GROUP BY b.band")
def _(spark, sf):
    return tidy(V.band_medians(R.visits(spark, sf)))


@query("depth_spread", "G27", f"WITH {S.VISITS} SELECT band, count(*) AS n, {', '.join(f'round(quantile_cont(m5, {p}e-2), 6) + 0.0 AS p{p}' for p in (16, 25, 50, 75, 84))} FROM visits GROUP BY band HAVING count(*) >= 2")
def _(spark, sf):
    return tidy(V.depth_spread(R.visits(spark, sf)))


@query("selection_time_span", "G17", f"WITH {S.OBS} SELECT {S.r6('mjd_min mjd_max')}, round(mjd_max - mjd_min, 6) + 0.0 AS span_days, round((mjd_max - mjd_min) / 365.25, 6) + 0.0 AS span_years, n_visits FROM (SELECT min(observationStartMJD) AS mjd_min, max(observationStartMJD) AS mjd_max, count(*) AS n_visits FROM obs)")
def _(spark, sf):
    return tidy(V.time_span(R.observations(spark, sf)))


INDEX = S.VISITS + ", " + S.FIELDS + """, fi AS (SELECT fields.*, coalesce(n, 0) AS Nvisits, lo AS field_mjd_min, hi AS field_mjd_max, (hi - lo) / 365.25 AS field_span_years FROM fields LEFT JOIN (SELECT field_index, count(*) AS n, min(MJD) AS lo, max(MJD) AS hi FROM visits GROUP BY ALL) USING (field_index))"""


@query("field_index", "G19 C12", f"WITH {INDEX} SELECT field_index, {S.r6('ra0_deg dec0_deg ebv_mw')}, target_name, Nvisits, {S.r6('field_mjd_min field_mjd_max field_span_years')}, {', '.join(f'round(ebv_mw * {C.ATTENUATION['lsst'][b]!r}::DOUBLE, 6) + 0.0 AS A_{b}_mw' for b in C.BANDS)} FROM fi")
def _(spark, sf):
    return tidy(V.field_index(R.fields(spark, sf), R.visits(spark, sf)).drop("field_span_days"))


@query("survey_summary", "G18", f"""WITH {INDEX} SELECT count(*) AS N_fields_exported, round(min(field_mjd_min), 6) + 0.0 AS exported_mjd_min, round(max(field_mjd_max), 6) + 0.0 AS exported_mjd_max, round(avg(field_span_years), 6) + 0.0 AS mean_field_span_years, round(median(field_span_years), 6) + 0.0 AS median_field_span_years,
 round(min(ebv_mw), 6) + 0.0 AS exported_ebv_mw_min, round(median(ebv_mw), 6) + 0.0 AS exported_ebv_mw_median, round(max(ebv_mw), 6) + 0.0 AS exported_ebv_mw_max, {', '.join(f"(SELECT round(median(m5), 6) + 0.0 FROM visits WHERE band = '{b}') AS m5_median_{b}" for b in C.BANDS)}, (SELECT count(*) FROM visits) AS parent_n_visits FROM fi""")
def _(spark, sf):
    v = R.visits(spark, sf)
    d = V.survey_summary(V.field_index(R.fields(spark, sf), v), V.band_medians(v), v.withColumnRenamed("MJD", "observationStartMJD"))
    return tidy(d.drop("exported_span_days", "parent_mjd_min", "parent_mjd_max", "parent_span_days", "parent_span_years"))


GAPS = S.VISITS + """, gp AS (SELECT * FROM (SELECT band, MJD - lag(MJD) OVER (PARTITION BY field_index, band ORDER BY MJD) AS g FROM visits) WHERE g IS NOT NULL)"""


def _hist(x: str, where: str) -> str:
    return f"WITH {GAPS}, x AS (SELECT band, {x} AS x FROM gp WHERE {where}), e AS (SELECT band, min(x) AS lo, max(x) AS hi FROM x GROUP BY band) SELECT band, least(19, floor((x - lo) / ((hi - lo) / 20)))::INT AS bin_index, count(*) AS n, round(any_value(lo), 6) + 0.0 AS x_min, round(any_value(hi), 6) + 0.0 AS x_max FROM x JOIN e USING (band) GROUP BY 1, 2"


@query("revisit_gap_histogram", "G21", _hist("g", "true"))
def _(spark, sf):
    return tidy(V.gap_histogram(V.revisit_gaps(R.visits(spark, sf)), 20))


@query("revisit_gap_log_histogram", "G21", _hist("log10(g)", "g > 0"))
def _(spark, sf):
    return tidy(V.gap_histogram(V.revisit_gaps(R.visits(spark, sf)), 20, logarithmic=True))


@query("field_summary", "G24", f"WITH {S.OBS}, o AS (SELECT *, floor(dec0_deg)::INT AS zone FROM obs, (SELECT 0e0 AS dec0_deg)) SELECT floor(fieldDec)::INT AS zone, round(median(fieldRA), 6) + 0.0 AS fieldRA, round(median(fieldDec), 6) + 0.0 AS fieldDec, arg_min(target_name, (observationStartMJD, target_name)) AS target_name, count(*) AS n_visits FROM obs GROUP BY 1")
def _(spark, sf):
    o = R.observations(spark, sf).withColumn("zone", F.floor("fieldDec").cast("int"))
    return tidy(V.field_summary(o, ("zone",)))


@query("sky_area_of_fields", "O10", f"""WITH {S.FIELDS}, c AS (SELECT r.i AS ir, z.i AS iz, (r.i + 5e-1) * 5e-1 AS fieldRA, degrees(asin((z.i + 5e-1) * (2e0 / 360) - 1)) AS fieldDec FROM range(720) r(i), range(360) z(i)),
 k AS (SELECT DISTINCT ir, iz FROM fields JOIN c ON fieldDec BETWEEN dec0_deg - 2 AND dec0_deg + 2 AND {SEP} <= 175e-2) SELECT count(*) AS n_cells, round(count(*) * (4 * pi() * pow(180 / pi(), 2) / (720 * 360)), 6) + 0.0 AS area_deg2, round(count(*) * (4 * pi() * pow(180 / pi(), 2) / (720 * 360)) / 41253, 6) + 0.0 AS f_sky FROM k""")
def _(spark, sf):
    return tidy(V.sky_area(R.fields(spark, sf), RADIUS))


@query("depth_draw_summary", "G23", f"WITH {S.VISITS} SELECT band, count(*) AS n, round(avg(m5), 6) + 0.0 AS mean, round(stddev_samp(m5), 6) + 0.0 AS std, {', '.join(f'round(quantile_cont(m5, {p}e-2), 6) + 0.0 AS p{p}' for p in (1, 5, 16, 25, 50, 75, 84, 95, 99))} FROM visits GROUP BY band")
def _(spark, sf):
    return tidy(V.draw_summary(R.visits(spark, sf)))


@query("external_depths", "O6", f"WITH {S.VISITS}, d AS (SELECT band, median(m5) AS m5 FROM visits GROUP BY band) SELECT source, band, round(m5, 6) + 0.0 AS m5 FROM (SELECT 'table' AS source, band, m5 FROM d UNION ALL SELECT 'manual', band, m5 FROM (VALUES ('g', 207e-1), ('r', 205e-1), ('i', 203e-1)) v(band, m5))")
def _(spark, sf):
    t = V.band_medians(R.visits(spark, sf)).where("m5_median IS NOT NULL").select("band", F.col("m5_median").alias("m5"))
    a = V.external_depths(spark, ["g", "r", "i"], table=t).withColumn("source", F.lit("table"))
    b = V.external_depths(spark, ["g", "r", "i"], manual={"g": 20.7, "r": 20.5, "i": 20.3}).withColumn("source", F.lit("manual"))
    return tidy(a.unionByName(b))


@query("object_distances", "O9 E4", f"""WITH {S.OBJ}, zt AS (SELECT i * 2e-2 AS z, 4283749173e-6 * (i * 2e-2) * (1 + 75e-2 * (i * 2e-2)) AS d FROM range(1, 11) r(i)), sg AS (SELECT z, d, lead(z) OVER (ORDER BY z) AS z1, lead(d) OVER (ORDER BY z) AS d1 FROM zt)
 SELECT event_id, round(CASE WHEN redshift = z THEN d ELSE d + (d1 - d) * (redshift - z) / (z1 - z) END, 6) + 0.0 AS distance_mpc FROM obj LEFT JOIN sg ON redshift >= z AND (redshift < z1 OR (z1 IS NULL AND redshift = z))""")
def _(spark, sf):
    zt = spark.range(1, 11).select((F.col("id") * 0.02).alias("z"), (F.lit(4283749173e-6) * (F.col("id") * 0.02) * (1 + F.lit(0.75) * (F.col("id") * 0.02))).alias("d"))
    return tidy(V.distances(R.objects(spark, sf), zt), "event_id", "distance_mpc")
