"""Queries over the readers and writers."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyhue.functions import columns as C
from skyhue.operators import survey
from skyhue.plans import roles as R, shared_sql as S
from skyhue.plans.output import tidy
from skyhue.plans.registry import query
from skyhue.sources import readers, staging, survey_db, writers


@query("lightcurve_scan", "A1", f"WITH {S.LC} SELECT event_id, band, round(t_days, 6) + 0.0 AS t_days, round(mag, 6) + 0.0 AS mag FROM lc WHERE band IN ('g', 'r')")
def _(spark, sf):
    return tidy(R.lightcurves(spark, sf, ("g", "r")), "event_id", "band", "t_days", "mag")


@query("summary_scan_id_alias", "A3", "SELECT CAST(c_custkey AS VARCHAR) AS event_id, c_mktsegment FROM customer")
def _(spark, sf):
    d = R.table(spark, sf, "customer").withColumn("objectid", F.lpad(F.col("c_custkey").cast("string"), 9, "0"))
    return readers.objects(d).select("event_id", "c_mktsegment")


@query("visit_scan_normalised", "A4 C2", f"""WITH {S.VISITS} SELECT band, count(*) AS n, {S.r6("m5_mean mjd_first")}
 FROM (SELECT band, m5, avg(m5) OVER (PARTITION BY band) AS m5_mean, min(MJD) OVER (PARTITION BY band) AS mjd_first FROM visits) GROUP BY band, m5_mean, mjd_first""")
def _(spark, sf):
    raw = R.visits(spark, sf).select(
        "field_index", F.col("MJD").alias("observationStartMJD"), F.col("m5").alias("fiveSigmaDepth"),
        F.concat(F.lit(" LSST"), F.upper("band"), F.lit(" ")).alias("filter"),
    )
    d = readers.visits(raw).groupBy("band").agg(F.count("*").alias("n"), F.avg("m5").alias("m5_mean"), F.min("MJD").alias("mjd_first"))
    return tidy(d)


@query("visit_field_metadata", "A5 C5", f"""WITH {S.VISITS}, {S.FIELDS} SELECT field_index, count(*) AS n, round(max(ra0_deg), 6) + 0.0 AS fieldRA,
 round(max(coalesce(CASE WHEN ebv_mw < 1e-1 THEN NULL ELSE ebv_mw END, dec0_deg)), 6) + 0.0 AS ebv FROM visits LEFT JOIN fields USING (field_index) GROUP BY field_index""")
def _(spark, sf):
    named = R.visits(spark, sf).withColumn("file", F.format_string("visits_field%03d.csv", "field_index"))
    v = named.withColumn("field_index", F.regexp_extract("file", "field(\\d+)", 1).cast("bigint"))
    f = R.fields(spark, sf).withColumn("E_BV", F.when(F.col("ebv_mw") < 0.1, F.lit(float("nan"))).otherwise(F.col("ebv_mw")))
    d = readers.with_field_metadata(v, f, {"fieldRA": ("RA", "ra0_deg"), "ebv": ("E_BV", "dec0_deg")})
    return tidy(d.groupBy("field_index").agg(F.count("*").alias("n"), F.max("fieldRA").alias("fieldRA"), F.max("ebv").alias("ebv")))


@query("survey_targets", "A6 G1", f"WITH {S.OBS} SELECT target_name, count(*) AS n FROM obs GROUP BY target_name ORDER BY n DESC, target_name LIMIT 30")
def _(spark, sf):
    return survey.target_counts(R.observations(spark, sf), 30)


@query("survey_database_targets", "A6 G1 G2", f"WITH {S.OBS} SELECT target_name, band, count(*) AS n, round(max(fiveSigmaDepth), 6) + 0.0 AS deepest FROM obs WHERE fieldDec >= -10 AND band IN ('g', 'r') GROUP BY ALL")
def _(spark, sf):
    """Visits put into a survey database, and read back by ranges of rows with the filters running there."""
    path = staging.folder(spark)
    survey_db.write(R.observations(spark, sf), path)
    d = survey_db.read(spark, path, rows=100_000, columns=["band", "fiveSigmaDepth", "fieldDec", "target_name"]).where(F.col("band").isin("g", "r") & (F.col("fieldDec") >= -10))
    return tidy(d.groupBy("target_name", "band").agg(F.count("*").alias("n"), F.max("fiveSigmaDepth").alias("deepest")))


@query("shards_of_a_manifest", "A11", f"WITH {S.LC} SELECT event_id, band, count(*) AS n FROM lc WHERE event_id % 8 IN (1, 4, 6) GROUP BY ALL")
def _(spark, sf):
    """Only the shards that a manifest table names are listed and read."""
    path = staging.folder(spark)
    R.lightcurves(spark, sf).withColumn("shard", F.pmod("event_id", F.lit(8))).write.partitionBy("shard").parquet(path)
    manifest = spark.range(8).where("id IN (1, 4, 6)").select(F.format_string("shard=%d", "id").alias("file"))
    return readers.shards(spark, path, manifest).groupBy("event_id", "band").agg(F.count("*").alias("n"))


LAT = S.VISITS + ", " + S.FIELDS + """, fl AS (SELECT field_index, CASE WHEN abs(b) >= 20 THEN 'high' ELSE 'low' END AS latitude_group, b FROM (SELECT field_index,
 degrees(asin(greatest(-1e0, least(1e0, -0.8676661490::DOUBLE * cos(radians(dec0_deg)) * cos(radians(ra0_deg)) - 0.1980763734::DOUBLE * cos(radians(dec0_deg)) * sin(radians(ra0_deg))
 + 0.4559837762::DOUBLE * sin(radians(dec0_deg)))))) AS b FROM fields))"""
DEPTH_TABLE = LAT + """, sv AS (SELECT 'common_global' AS threshold_scope, 'both' AS threshold_latitude_group, band, m5 FROM visits
 UNION ALL SELECT 'latitude_conditioned', latitude_group, band, m5 FROM visits JOIN fl USING (field_index)),
 qs AS (SELECT threshold_scope, threshold_latitude_group, band, count(*) AS N_visits, quantile_cont(m5, 25e-2) AS a, quantile_cont(m5, 5e-1) AS b,
 quantile_cont(m5, 75e-2) AS c FROM sv GROUP BY ALL),
 dt AS (SELECT threshold_scope, threshold_latitude_group, band, scenario, quantile, CASE scenario WHEN 'worst_p25' THEN a WHEN 'median_p50' THEN b ELSE c END AS m5, N_visits
 FROM qs, (VALUES ('worst_p25', 25e-2), ('median_p50', 5e-1), ('best_p75', 75e-2)) s(scenario, quantile))"""


def depth_table(spark, sf):
    groups = R.fields(spark, sf).select("field_index", C.latitude_group(C.galactic_latitude("ra0_deg", "dec0_deg"), 20.0).alias("latitude_group"))
    return survey.depth_quantiles(R.visits(spark, sf), groups, 20.0)


@query("depth_quantile_table", "G4 C21", f"WITH {DEPTH_TABLE} SELECT threshold_scope, threshold_latitude_group, band, scenario, round(quantile, 6) + 0.0 AS quantile, round(m5, 6) + 0.0 AS m5, N_visits FROM dt")
def _(spark, sf):
    return tidy(depth_table(spark, sf), "threshold_scope", "threshold_latitude_group", "band", "scenario", "quantile", "m5", "N_visits")


@query("depth_table_reader", "A7 C6", f"""WITH {DEPTH_TABLE} SELECT 'long' AS layout, band, round(m5, 6) + 0.0 AS m5 FROM dt WHERE threshold_scope = 'common_global' AND quantile = 75e-2
 UNION ALL SELECT 'long_latitude', band, round(m5, 6) + 0.0 FROM dt WHERE threshold_latitude_group = 'high' AND quantile = 5e-1
 UNION ALL SELECT 'wide', band, round(m5, 6) + 0.0 FROM dt WHERE threshold_scope = 'common_global' AND quantile = 25e-2
 UNION ALL SELECT 'legacy', band, round(m5, 6) + 0.0 FROM dt WHERE threshold_scope = 'common_global' AND quantile = 5e-1""")
def _(spark, sf):
    t = depth_table(spark, sf)
    pick = lambda q: F.max(F.when(F.abs(F.col("quantile") - q) < 1e-9, F.col("m5")))
    wide = t.groupBy("threshold_scope", "threshold_latitude_group", "band").agg(pick(0.25).alias("m5_p25"), pick(0.5).alias("m5_median"))
    percent_form = t.withColumn("quantile", F.col("quantile") * 100)
    parts = {
        "long": readers.depth_table(percent_form, 75.0), "long_latitude": readers.depth_table(t, 50.0, "latitude_conditioned"),
        "wide": readers.depth_table(wide, 25.0), "legacy": readers.depth_table(wide.select("threshold_scope", "threshold_latitude_group", "band", "m5_median"), 50.0),
    }
    out = None
    for name, d in parts.items():
        d = d.select(F.lit(name).alias("layout"), "band", "m5")
        out = d if out is None else out.unionByName(d)
    return tidy(out)


@query("depth_scenario_lookup", "A15", f"WITH {DEPTH_TABLE} SELECT band, round(m5, 6) + 0.0 AS m5 FROM dt WHERE threshold_scope = 'common_global' AND scenario = 'best_p75' AND band IN ('g', 'r')")
def _(spark, sf):
    return tidy(readers.scenario(depth_table(spark, sf), "best_p75", ["g", "r"]))


@query("depth_from_table", "O5 A7", f"WITH {DEPTH_TABLE} SELECT band, round(m5, 6) + 0.0 AS m5 FROM dt WHERE threshold_scope = 'common_global' AND quantile = 25e-2 AND band IN ('g', 'r')")
def _(spark, sf):
    return tidy(survey.resolve_depths(staging.materialize(depth_table(spark, sf)), R.visits(spark, sf), 25.0, ["g", "r"]))


@query("depth_falls_back_to_visits", "O5 A14", f"WITH {S.VISITS} SELECT band, round(quantile_cont(m5, 4e-1), 6) + 0.0 AS m5 FROM visits WHERE band IN ('g', 'r') GROUP BY band")
def _(spark, sf):
    return tidy(survey.resolve_depths(staging.materialize(depth_table(spark, sf)), R.visits(spark, sf), 40.0, ["g", "r"]))


@query("depth_from_raw_visits", "A14 O5", f"WITH {S.VISITS} SELECT band, round(quantile_cont(m5, 9e-1), 6) + 0.0 AS m5 FROM visits WHERE band IN ('i', 'r') GROUP BY band")
def _(spark, sf):
    return tidy(survey.resolve_depths(None, R.visits(spark, sf), 90.0, ["i", "r"]))


@query("snia_scan_optional_columns", "A8", "SELECT event_type AS band, count(*) AS n, count(props) AS n_props FROM events GROUP BY event_type")
def _(spark, sf):
    d = readers.present_columns(R.table(spark, sf, "events"), ["event_type", "value"], ["props", "redshift"])
    return d.groupBy(F.col("event_type").alias("band")).agg(F.count("*").alias("n"), F.count("props").alias("n_props"))


@query("realization_manifest_union", "A10 I8", """SELECT realization, count(*) AS n, count(DISTINCT user_id) AS n_events FROM (SELECT user_id % 3 AS realization, user_id FROM events)
 GROUP BY realization""")
def _(spark, sf):
    """Runs written apart, and read as one table by their manifest."""
    path = staging.folder(spark)
    runs = [(k, f"{path}-run{k}") for k in range(3)]
    for k, where in runs:
        R.table(spark, sf, "events").where(F.pmod("user_id", F.lit(3)) == k).write.parquet(where)
    d = readers.realization_manifest(spark, runs).withColumn("realization", F.col("realization").cast("bigint"))
    return d.groupBy("realization").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_events"))


@query("one_event_lookup", "A13", f"WITH {S.LC} SELECT event_id, band, round(t_days, 6) + 0.0 AS t_days, round(mag, 6) + 0.0 AS mag FROM lc WHERE event_id = 7")
def _(spark, sf):
    return tidy(readers.one_event(R.lightcurves(spark, sf), 7), "event_id", "band", "t_days", "mag")


@query("population_parts_manifest", "B1 A11", "SELECT count(*) AS n_rows, min(user_id) AS first_event, max(user_id) AS last_event, count(DISTINCT user_id) AS n_events FROM events")
def _(spark, sf):
    path = staging.folder(spark)
    writers.population(R.lightcurves(spark, sf), path)
    written = readers.shards(spark, path)
    parts = writers.population_manifest(written).agg(F.sum("n_rows").alias("n_rows"), F.min("first_event").alias("first_event"), F.max("last_event").alias("last_event"))
    return parts.crossJoin(written.agg(F.count_distinct("event_id").alias("n_events")))


@query("per_object_csv_round_trip", "A2 B2", f"WITH {S.LC} SELECT CAST(event_id AS VARCHAR) AS event_id, count(*) AS n, round(sum(mag), 4) + 0.0 AS mag_sum FROM lc GROUP BY event_id")
def _(spark, sf):
    path = staging.folder(spark)
    writers.per_object(R.photometry(spark, sf).select("event_id", "t_days", "band", "mag"), path, "event_id")
    back = readers.lightcurve_csvs(spark, path)
    return back.groupBy("event_id").agg(F.count("*").alias("n"), (F.round(F.sum("mag"), 4) + 0.0).alias("mag_sum"))


@query("compressed_table_round_trip", "B3", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def _(spark, sf):
    path = staging.folder(spark)
    writers.table(R.table(spark, sf, "customer"), path, compress=True)
    return spark.read.option("header", True).csv(path).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("summary_json_round_trip", "B4", "SELECT count(*) AS n, round(max(value), 6) + 0.0 AS top FROM events")
def _(spark, sf):
    path = staging.folder(spark)
    writers.summary_json(R.table(spark, sf, "events").agg(F.count("*").alias("n"), F.max("value").alias("top")), path)
    return tidy(spark.read.schema("n bigint, top double").json(path))


@query("adapted_snia_parquet", "B5", f"WITH {S.SNIA} SELECT band, count(*) AS n, round(min(mjd), 6) + 0.0 AS first_mjd FROM sn GROUP BY band")
def _(spark, sf):
    path = staging.folder(spark)
    writers.adapted_snia(R.snia(spark, sf), path, {"mjd": "time_mjd", "sn_id": "event_id"})
    return tidy(spark.read.parquet(path).groupBy("band").agg(F.count("*").alias("n"), F.min("time_mjd").alias("first_mjd")))


@query("commented_text_points", "A9 C16", f"WITH {S.LC} SELECT band, count(*) AS n, round(min(t_days) + 6031e1, 6) + 0.0 AS first_mjd FROM lc GROUP BY band")
def _(spark, sf):
    path = staging.folder(spark)
    ev = R.table(spark, sf, "events")
    lc = R.lightcurves(spark, sf).select("row_id", "band")
    text = ev.join(lc, ev["event_id"] == lc["row_id"]).select(F.explode(F.array(
        F.lit("# date filter magnitude"),
        F.concat_ws("  ", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")), "band", F.col("value").cast("string")),
    )).alias("value"))
    text.write.mode("overwrite").text(path)
    d = readers.commented_text(spark, path, ["date_utc", "band", "magnitude"]).withColumn("mjd", C.utc_to_mjd("date_utc"))
    return tidy(d.groupBy("band").agg(F.count("*").alias("n"), F.min("mjd").alias("first_mjd")))
