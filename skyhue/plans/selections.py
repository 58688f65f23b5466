"""Queries over row and object selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyhue.functions import checks, columns as C, validation
from skyhue.operators import broker, curves, ranks, selection, series, survey
from skyhue.plans import roles as R, shared_sql as S
from skyhue.plans.output import tidy
from skyhue.plans.registry import query

ALLOWED = ("u", "g", "r", "i", "z", "y")


@query("snia_row_validity", "D1", f"WITH {S.SNIA} SELECT count(*) AS n_rows, count(*) FILTER (magerr > 0) AS n_kept, count(*) FILTER (NOT magerr > 0) AS n_rejected, 0::BIGINT AS n_bad_band, count(*) FILTER (NOT magerr > 0) AS n_bad_error, 0::BIGINT AS n_bad_id, 0::BIGINT AS n_bad_magnitude, 0::BIGINT AS n_bad_time FROM sn")
def _(spark, sf):
    return selection.snia_quality(R.snia(spark, sf), ALLOWED)


@query("latitude_selection", "D2", f"""WITH {S.OBJ} SELECT mode, count(*) AS n, round(avg(abs_b_deg), 6) + 0.0 AS mean_b FROM obj, (VALUES ('all'), ('high'), ('low'), ('bin'), ('top')) m(mode)
 WHERE mode = 'all' OR (mode = 'high' AND abs_b_deg >= 20) OR (mode = 'low' AND abs_b_deg < 20) OR (mode = 'bin' AND abs_b_deg >= 30 AND abs_b_deg < 45) OR (mode = 'top' AND abs_b_deg >= 85 AND abs_b_deg <= 90) GROUP BY mode""")
def _(spark, sf):
    cuts = {"all": ("all", 0, 0), "high": ("high", 20, 90), "low": ("low", 20, 90), "bin": ("bin", 30, 45), "top": ("bin", 85, 90)}
    labels = F.array_compact(F.array(*[F.when(selection.latitude_cut(m, float(lo), float(hi)), F.lit(n)) for n, (m, lo, hi) in cuts.items()]))
    d = R.objects(spark, sf).select("abs_b_deg", F.explode(labels).alias("mode"))
    return tidy(d.groupBy("mode").agg(F.count("*").alias("n"), F.avg("abs_b_deg").alias("mean_b")))


@query("detected_or_limit", "D4", f"""WITH {S.PHOT}, d(band, m5) AS (VALUES ('g', 30e0), ('r', 40e0), ('i', 50e0), ('z', 60e0), ('y', 20e0))
 SELECT row_id, CASE WHEN mag <= m5 THEN mag END AS mag, round(CASE WHEN mag <= m5 THEN mag_err ELSE m5 END, 6) + 0.0 AS mag_err, mag <= m5 AS detected FROM phot JOIN d USING (band)""")
def _(spark, sf):
    d = selection.detect_or_limit(R.photometry(spark, sf), {"g": 30, "r": 40, "i": 50, "z": 60, "y": 20})
    return tidy(d, "row_id", "mag", "mag_err", "detected")


@query("within_band_depth", "D5", f"""WITH {S.LC}, d(band, m5) AS (VALUES ('g', 30e0), ('r', 40e0)), k AS (SELECT event_id, row_id, t_days, mag FROM lc JOIN d USING (band) WHERE mag <= m5)
 SELECT row_id, round(mag, 6) + 0.0 AS mag, lpad(CAST(event_id AS VARCHAR), greatest(4, length(CAST(event_id AS VARCHAR)))::INTEGER, '0') || '_' || CAST(row_number() OVER (PARTITION BY event_id ORDER BY t_days, row_id) AS VARCHAR) AS candidate_id FROM k""")
def _(spark, sf):
    depths = spark.createDataFrame([("g", 30.0), ("r", 40.0)], "band string, m5 double")
    d = selection.within_band_depth(R.lightcurves(spark, sf), depths)
    d = series.row_numbers(d, ["event_id"], ["t_days", "row_id"], series.chunk_by("t_days", 1.0), "k")
    return tidy(d.select("row_id", "mag", C.candidate_id("event_id", "k").alias("candidate_id")))


@query("export_modes", "D6", f"""WITH {S.LC}, d(band, m5) AS (VALUES ('g', 30e0), ('r', 40e0), ('i', 50e0), ('z', 60e0), ('y', 20e0)) SELECT mode, band, count(*) AS n FROM lc JOIN d USING (band),
 (VALUES ('complete'), ('m5-detected')) m(mode) WHERE mode = 'complete' OR mag <= m5 GROUP BY ALL""")
def _(spark, sf):
    m5 = F.create_map(*[F.lit(x) for kv in {"g": 30.0, "r": 40.0, "i": 50.0, "z": 60.0, "y": 20.0}.items() for x in kv])[F.col("band")]
    d = R.lightcurves(spark, sf).withColumn("m5", m5)
    one = lambda m: selection.export_mode(d, m).groupBy("band").agg(F.count("*").alias("n")).withColumn("mode", F.lit(m))
    return one("complete").unionByName(one("m5-detected"))


TARGET_MODES = {"ALL_SURVEY": None, "ALL_DDF": None, "ALL_NON_DDF": None, "LOWDUST": None, "ONE_DDF": "nation_1", "TARGET": "NATION_2"}


@query("target_selections", "D7", f"""WITH {S.OBS}, o AS (SELECT CASE WHEN target_name < 'NATION_15' THEN 'ddf_' || target_name WHEN target_name < 'NATION_17' THEN 'lowdust' ELSE target_name END AS target_name FROM obs)
 SELECT mode, count(*) AS n FROM o, (VALUES ('ALL_SURVEY'), ('ALL_DDF'), ('ALL_NON_DDF'), ('LOWDUST'), ('ONE_DDF'), ('TARGET')) m(mode)
 WHERE mode = 'ALL_SURVEY' OR (mode = 'ALL_DDF' AND instr(upper(target_name), 'DDF') > 0) OR (mode = 'ALL_NON_DDF' AND instr(upper(target_name), 'DDF') = 0)
 OR (mode = 'LOWDUST' AND target_name = 'lowdust') OR (mode = 'ONE_DDF' AND instr(upper(target_name), 'DDF') > 0 AND instr(upper(target_name), 'NATION_1') > 0) OR (mode = 'TARGET' AND target_name = 'NATION_2') GROUP BY mode""")
def _(spark, sf):
    name = F.col("target_name")
    d = R.observations(spark, sf).select(
        F.when(name < "NATION_15", F.concat(F.lit("ddf_"), name)).when(name < "NATION_17", F.lit("lowdust")).otherwise(name).alias("target_name")
    )
    labels = F.array_compact(F.array(*[F.when(survey.selection(m, n)[0], F.lit(m)) for m, n in TARGET_MODES.items()]))
    return d.select(F.explode(labels).alias("mode")).groupBy("mode").agg(F.count("*").alias("n"))


@query("trim_after_last_detection", "D9", f"""WITH {S.LC}, l AS (SELECT event_id, max(t_days) FILTER (mag > 150) AS last FROM lc GROUP BY event_id) SELECT row_id, round(t_days, 6) + 0.0 AS t_days FROM lc JOIN l USING (event_id) WHERE last IS NULL OR t_days <= last + 3""")
def _(spark, sf):
    return tidy(selection.trim_after_last(R.lightcurves(spark, sf), ["event_id"], "t_days", F.col("mag") > 150, 3.0), "row_id", "t_days")


@query("support_floor_mask", "D10", f"""WITH {S.LC}, f AS (SELECT event_id, band, min(t_days) FILTER (mag >= 120) AS first FROM lc GROUP BY ALL) SELECT row_id FROM lc JOIN f USING (event_id, band) WHERE first IS NULL OR t_days < first""")
def _(spark, sf):
    return curves.mask_from_first(R.lightcurves(spark, sf), ["event_id", "band"], "t_days", F.col("mag") >= 120).select("row_id")


@query("inclusive_id_range", "D11", "SELECT doc_id, n_chars FROM documents WHERE doc_id BETWEEN 100 AND 899")
def _(spark, sf):
    return R.table(spark, sf, "documents").select("doc_id", "n_chars").where(F.col("doc_id").between(100, 899))


@query("objects_with_curves", "D12 F4", f"WITH {S.LC}, {S.OBJ} SELECT event_id, population FROM obj WHERE event_id IN (SELECT event_id FROM lc)")
def _(spark, sf):
    return R.objects(spark, sf).join(R.lightcurves(spark, sf).select("event_id"), "event_id", "left_semi").select("event_id", "population")


@query("objects_without_curves", "F5 K19", f"WITH {S.LC}, {S.OBJ} SELECT event_id, population FROM obj WHERE event_id NOT IN (SELECT event_id FROM lc WHERE band IN ('g', 'r'))")
def _(spark, sf):
    from skyhue.operators.envelope import without_colour_rows
    return without_colour_rows(R.objects(spark, sf), R.lightcurves(spark, sf, ("g", "r")), ["g", "r"]).select("event_id", "population")


@query("usable_photometry_rows", "D13", f"WITH {S.SNIA} SELECT band, count(*) AS n_rows, count(*) FILTER (magerr > 0) AS n_usable, count(*) FILTER (mag > 50) AS n_flux FROM sn GROUP BY band")
def _(spark, sf):
    d = R.snia(spark, sf)
    a = d.withColumnsRenamed({"mjd": "time_mjd", "magerr": "mag_err"})
    mag_ok = selection.usable_photometry(a.columns)
    b = a.withColumn("flux", F.when(F.col("mag") > 50, F.col("mag")).otherwise(F.lit(float("nan"))))
    flux_ok = selection.usable_photometry(["time_mjd", "band", "flux"])
    return b.groupBy("band").agg(F.count("*").alias("n_rows"), F.count_if(mag_ok).alias("n_usable"), F.count_if(flux_ok).alias("n_flux"))


@query("sky_position_quality", "D14", f"WITH {S.FIELDS} SELECT count(*) AS n_rows, 0::BIGINT AS n_not_finite, count(*) FILTER (abs(dec0_deg * 4) > 90) AS n_bad_dec, count(*) FILTER (ebv_mw - 2e-1 < 0) AS n_bad_ebv FROM fields")
def _(spark, sf):
    f = R.fields(spark, sf).withColumns({"dec0_deg": F.col("dec0_deg") * 4, "ebv_mw": F.col("ebv_mw") - 0.2})
    return selection.sky_quality(f, "ra0_deg", "dec0_deg", "ebv_mw")


@query("checked_sky_positions", "D14", f"WITH {S.FIELDS} SELECT field_index, {S.r6('ra0_deg dec0_deg ebv_mw')} FROM fields")
def _(spark, sf):
    f = R.fields(spark, sf)
    return tidy(selection.checked_sky(f.withColumn("ra0_deg", F.col("ra0_deg") - 720), "ra0_deg", "dec0_deg", "ebv_mw"), "field_index", "ra0_deg", "dec0_deg", "ebv_mw")


@query("required_parameters", "D15 G11", """SELECT o_custkey AS event_id, round(min_by(o_totalprice, o_orderkey), 6) + 0.0 AS distance, CAST(NULL AS DOUBLE) AS beta FROM orders
 GROUP BY o_custkey HAVING min_by(o_orderstatus, o_orderkey) <> 'P'""")
def _(spark, sf):
    d = R.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("event_id"), "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("distance"))
    return tidy(selection.with_parameters(d, ["distance"], ["beta"], tie=["o_orderkey"]), "event_id", "distance", "beta")


@query("objects_in_every_band", "D16", f"WITH {S.LC} SELECT event_id FROM lc WHERE band IN ('g', 'r', 'i') GROUP BY event_id HAVING count(DISTINCT band) = 3")
def _(spark, sf):
    return selection.in_every_band(R.lightcurves(spark, sf), "event_id", ["g", "r", "i"])


@query("objects_per_band", "G26", f"WITH {S.LC} SELECT band, count(DISTINCT event_id) AS n_objects FROM lc GROUP BY band")
def _(spark, sf):
    return R.lightcurves(spark, sf).groupBy("band").agg(F.count_distinct("event_id").alias("n_objects"))


@query("band_counts_as_columns", "G12", f"WITH {S.LC} SELECT event_id, {', '.join(f'''count(*) FILTER (band = '{b}') AS {b}''' for b in ALLOWED)} FROM lc GROUP BY event_id")
def _(spark, sf):
    d = R.lightcurves(spark, sf).groupBy("event_id").pivot("band", list(ALLOWED)).count().na.fill(0)
    return d.select("event_id", *ALLOWED)


@query("detection_summary", "G25", f"""WITH {S.LC} SELECT event_id, count(*) AS n_rows, count(*) FILTER (mag <= 22) AS n_detected, true AS any_detected, round(min(t_days) FILTER (mag <= 22), 6) + 0.0 AS first_detection_days,
 round(max(t_days) FILTER (mag <= 22), 6) + 0.0 AS last_detection_days, round(min(t_days) FILTER (mag > 22), 6) + 0.0 AS first_non_detection_days FROM lc GROUP BY event_id HAVING count(*) FILTER (mag <= 22) >= 10""")
def _(spark, sf):
    return tidy(selection.per_event_detections(R.lightcurves(spark, sf), F.col("mag") <= 22, 10))


@query("first_events_in_order", "I3", f"WITH {S.OBJ} SELECT event_id, population FROM obj ORDER BY event_id LIMIT 40")
def _(spark, sf):
    return ranks.subset(R.objects(spark, sf), "event_id", 40, None).select("event_id", "population")


@query("seeded_sample", "I4", f"WITH {S.OBJ} SELECT event_id, population FROM obj ORDER BY md5('11:' || event_id), event_id LIMIT 40")
def _(spark, sf):
    return ranks.subset(R.objects(spark, sf), "event_id", 40, 11).select("event_id", "population")


@query("nested_subset_ranks", "H12 I10", f"""WITH {S.OBJ}, r AS (SELECT event_id, seed, row_number() OVER (PARTITION BY seed ORDER BY md5(seed || ':' || event_id), event_id) AS rank FROM obj, (VALUES (1), (2)) s(seed))
 SELECT seed, event_id, rank, rank <= 10 AS in_10, rank <= 100 AS in_100 FROM r""")
def _(spark, sf):
    o = R.objects(spark, sf).select("event_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("seed"))
    r = ranks.hash_rank(o, "event_id", F.col("seed"), "rank", ("seed",))
    return r.select("seed", "event_id", "rank", (F.col("rank") <= 10).alias("in_10"), (F.col("rank") <= 100).alias("in_100"))


@query("evenly_spaced_picks", "I5", f"""WITH {S.OBJ}, r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS rank, count(*) OVER () AS n FROM obj),
 p AS (SELECT DISTINCT round_even(i * (n - 1)::DOUBLE / 6, 0)::BIGINT + 1 AS rank FROM r, range(7) t(i)) SELECT event_id, rank FROM r JOIN p USING (rank)""")
def _(spark, sf):
    ranked = ranks.id_rank(R.objects(spark, sf).select("event_id"), "event_id", "rank")
    return ranks.evenly_spaced(ranked, ["rank"], 7).select("event_id", "rank")


@query("curves_of_given_events", "I5 F5", f"WITH {S.LC}, {S.OBJ} SELECT event_id, count(*) AS n, round(min(mag), 6) + 0.0 AS mag_min FROM lc WHERE event_id IN (SELECT event_id FROM obj WHERE population = 'BUILDING' AND event_id IN (SELECT event_id FROM lc)) GROUP BY event_id")
def _(spark, sf):
    lc = R.lightcurves(spark, sf)
    ids = R.objects(spark, sf).where("population = 'BUILDING'").join(lc.select("event_id"), "event_id", "left_semi")
    return tidy(ranks.given(lc, ids, "event_id").groupBy("event_id").agg(F.count("*").alias("n"), F.min("mag").alias("mag_min")))


@query("stable_sorted_rows", "I1", f"WITH {S.SNIA} SELECT sn_id, round(mjd, 6) + 0.0 AS mjd, band, row_id FROM sn WHERE magerr > 0 ORDER BY sn_id, mjd, band, row_id")
def _(spark, sf):
    return tidy(R.snia(spark, sf).where("magerr > 0").orderBy("sn_id", "mjd", "band", "row_id"), "sn_id", "mjd", "band", "row_id")


@query("brightest_point", "I2", f"WITH {S.LC} SELECT event_id, band, round(arg_min(t_days, (mag, t_days)), 6) + 0.0 AS t_days, round(min(mag), 6) + 0.0 AS mag FROM lc GROUP BY ALL")
def _(spark, sf):
    d = R.lightcurves(spark, sf).groupBy("event_id", "band").agg(F.min_by("t_days", F.struct("mag", "t_days")).alias("t_days"), F.min("mag").alias("mag"))
    return tidy(d)


@query("id_set_operations", "I9", """SELECT 'except' AS op, doc_id FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'intersect', doc_id FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)""")
def _(spark, sf):
    a, b = R.table(spark, sf, "documents").select("doc_id"), R.table(spark, sf, "labels").select("doc_id")
    return a.exceptAll(b).distinct().select(F.lit("except").alias("op"), "doc_id").unionByName(a.intersect(b).select(F.lit("intersect").alias("op"), "doc_id"))


@query("equal_key_sets", "F14", f"WITH {S.LC}, {S.OBJ} SELECT count(*) FILTER (b.event_id IS NULL) AS n_left_only, count(*) FILTER (a.event_id IS NULL) AS n_right_only, count(*) FILTER (a.event_id IS NOT NULL AND b.event_id IS NOT NULL) AS n_both FROM obj a FULL JOIN (SELECT DISTINCT event_id FROM lc) b ON a.event_id = b.event_id")
def _(spark, sf):
    return checks.unmatched_keys(R.objects(spark, sf), R.lightcurves(spark, sf), "event_id")


@query("object_curve_one_to_one", "F3", f"WITH {S.LC}, {S.OBJ} SELECT event_id, population, n, round(mag_min, 6) + 0.0 AS mag_min FROM obj JOIN (SELECT event_id, count(*) AS n, min(mag) AS mag_min FROM lc GROUP BY event_id) USING (event_id)")
def _(spark, sf):
    per = R.lightcurves(spark, sf).groupBy("event_id").agg(F.count("*").alias("n"), F.min("mag").alias("mag_min"))
    return tidy(checks.one_to_one(R.objects(spark, sf).select("event_id", "population"), per, "event_id"))


@query("curves_of_known_objects", "F14 F5", f"WITH {S.LC}, {S.OBJ} SELECT event_id, count(*) AS n FROM lc WHERE event_id IN (SELECT event_id FROM obj) GROUP BY event_id")
def _(spark, sf):
    known = R.objects(spark, sf).select("event_id").join(R.lightcurves(spark, sf).select("event_id"), "event_id", "left_semi")
    lc = R.lightcurves(spark, sf).select("event_id").join(R.objects(spark, sf).select("event_id"), "event_id", "left_semi")
    return checks.guard_same_keys(lc, known, "event_id").groupBy("event_id").agg(F.count("*").alias("n"))


@query("object_metadata_join", "F2", f"WITH {S.LC}, {S.OBJ} SELECT population, count(*) AS n, round(avg(mag * ebv_mw), 6) + 0.0 AS m FROM lc LEFT JOIN obj USING (event_id) GROUP BY population")
def _(spark, sf):
    o = checks.require_unique(R.objects(spark, sf).select("event_id", "population", "ebv_mw"), "event_id")
    d = R.lightcurves(spark, sf).join(o, "event_id", "left")
    return tidy(d.groupBy("population").agg(F.count("*").alias("n"), F.avg(F.col("mag") * F.col("ebv_mw")).alias("m")))


@query("catalogue_validation", "O7 G14", f"WITH {S.OBJ} SELECT count(*) AS n_rows, min(event_id) AS first_index, max(event_id) AS last_index, count(DISTINCT event_id) AS n_distinct_index, 0::BIGINT AS n_bad_numbers, count(DISTINCT population) AS n_population, max(event_id) = count(*) - 1 AS index_is_dense FROM obj")
def _(spark, sf):
    return validation.catalogue_report(R.objects(spark, sf), "event_id", ["population"], ["redshift", "luminosity_distance"])


@query("run_validation", "O8", f"WITH {S.OBJ} SELECT count(*) AS n_rows, count(*) FILTER (abs_b_deg < 5 - 1e-8) AS n_below, count(*) FILTER (abs_b_deg >= 85 + 1e-8) AS n_above, false AS run_ok FROM obj")
def _(spark, sf):
    return validation.run_report(R.objects(spark, sf), 1500, 5.0, 85.0)


@query("redshift_consistency", "G14", "SELECT o_custkey, count(DISTINCT o_orderstatus) AS n_values, count(DISTINCT o_orderstatus) <= 1 AS consistent FROM orders GROUP BY o_custkey")
def _(spark, sf):
    d = R.table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_distinct("o_orderstatus").alias("n_values"))
    return d.withColumn("consistent", F.col("n_values") <= 1)


@query("object_phase_ranges", "G15", f"""WITH {S.LC}, {S.OBJ} SELECT event_id, round(min(t_days), 6) + 0.0 AS t_first, round(max(t_days), 6) + 0.0 AS t_last, count(*) FILTER (band = 'g') AS n_g, count(*) FILTER (band = 'r') AS n_r,
 round(any_value(redshift), 6) + 0.0 AS redshift FROM lc JOIN obj USING (event_id) GROUP BY event_id""")
def _(spark, sf):
    s = R.lightcurves(spark, sf).groupBy("event_id").agg(
        F.min("t_days").alias("t_first"), F.max("t_days").alias("t_last"), F.count_if(F.col("band") == "g").alias("n_g"), F.count_if(F.col("band") == "r").alias("n_r"))
    return tidy(s.join(R.objects(spark, sf).select("event_id", "redshift"), "event_id"))


@query("distance_summary", "G13", f"""WITH {S.OBJ}, l AS (UNPIVOT (SELECT redshift, luminosity_distance FROM obj) ON redshift, luminosity_distance INTO NAME quantity VALUE v),
 a AS (SELECT quantity, count(*)::DOUBLE AS n, avg(v) AS mean, {', '.join(f'quantile_cont(v, {p}e-2) AS p{p}' for p in (1, 5, 16, 25, 50, 75, 84, 95, 99))} FROM l GROUP BY quantity)
 SELECT quantity, statistic, round(value, 6) + 0.0 AS value, CASE quantity WHEN 'redshift' THEN '' ELSE 'Mpc' END AS unit FROM (UNPIVOT a ON n, mean, p1, p5, p16, p25, p50, p75, p84, p95, p99 INTO NAME statistic VALUE value)""")
def _(spark, sf):
    return tidy(survey.distance_summary(R.objects(spark, sf)))
