"""Queries over alert-broker exports and filter audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyhue.functions import columns as C
from skyhue.operators import broker as B
from skyhue.plans import roles as R, shared_sql as S
from skyhue.plans.output import tidy
from skyhue.plans.registry import query

D = {"g": 30.0, "r": 40.0, "i": 50.0, "z": 60.0, "y": 20.0}
_D = ", ".join(f"('{b}', {v!r}::DOUBLE)" for b, v in D.items())
ID4 = "lpad(CAST({0} AS VARCHAR), greatest(4, length(CAST({0} AS VARCHAR)))::INTEGER, '0')"
SNX = S.SNIA + f""", d(band, m5) AS (VALUES {_D}), ok AS (SELECT sn.*, m5, list_position(['u', 'g', 'r', 'i', 'z', 'y'], band) AS place FROM sn JOIN d USING (band) WHERE magerr > 0), x AS (SELECT *, row_number() OVER (PARTITION BY sn_id, mjd ORDER BY place, row_id) - 1 AS i, row_number() OVER (PARTITION BY sn_id ORDER BY mjd, place, row_id) AS k,
 min(mjd) OVER (PARTITION BY sn_id) AS f, max(sn_id) OVER () AS top FROM ok), ex AS (SELECT sn_id AS objectid, lpad(CAST(sn_id AS VARCHAR), greatest(4, length(CAST(top AS VARCHAR)))::INTEGER, '0') || '_' || CAST(k AS VARCHAR) AS candidate_id, mjd + i * (3e1 / 86400) AS time_mjd, mjd + i * (3e1 / 86400) - f AS t_days, band,
 CASE WHEN mag <= m5 THEN mag END AS mag, CASE WHEN mag <= m5 THEN magerr ELSE m5 END AS mag_err, mag <= m5 AS detected, i > 0 AS was_shifted FROM x)"""


def snia_export(spark, sf):
    return B.export_snia(R.snia(spark, sf), D, 30.0)


@query("snia_broker_export", "O1 D1 D4 E11 C15", f"WITH {SNX} SELECT objectid, candidate_id, {S.r6('time_mjd t_days')}, band, {S.r6('mag mag_err')}, detected, was_shifted FROM ex")
def _(spark, sf):
    return tidy(snia_export(spark, sf))


@query("snia_export_report", "O1", f"WITH {SNX} SELECT count(*) AS n_rows, count(DISTINCT objectid) AS n_objects, count(*) FILTER (detected) AS n_detections, count(*) FILTER (NOT detected) AS n_limits, count(*) FILTER (was_shifted) AS n_shifted FROM ex")
def _(spark, sf):
    return B.export_report(snia_export(spark, sf))


@query("snia_object_summary", "G16 G11", f"WITH {SNX} SELECT sn_id, arg_min(magerr, (mjd, place, row_id)) AS magerr, count(*) AS n_rows, count(*) FILTER (mag <= m5) AS n_detected FROM ok GROUP BY sn_id")
def _(spark, sf):
    return B.snia_objects(R.snia(spark, sf), D, ["magerr"])


DD = ", ".join(f"('{b}', {v!r}::DOUBLE)" for b, v in D.items())
MDX = S.LC + f""", d(band, m5) AS (VALUES {DD}), p AS (SELECT event_id, band, mag, row_id, t_days, 6031e1 + floor(t_days * 3) / 3 AS time_mjd, m5, pow(10, 4e-1 * (mag - m5)) AS x FROM lc JOIN d USING (band) WHERE mag <= m5),
 e AS (SELECT event_id, time_mjd, count(*) AS n, lead(time_mjd) OVER (PARTITION BY event_id ORDER BY time_mjd) AS nx FROM p GROUP BY event_id, time_mjd), r AS (SELECT p.*, row_number() OVER (PARTITION BY event_id, time_mjd ORDER BY row_id) - 1 AS i, row_number() OVER (PARTITION BY event_id ORDER BY time_mjd, row_id) AS k FROM p),
 ex AS (SELECT event_id, CASE WHEN k = 1 THEN event_id END AS objectid, {ID4.format('event_id')} || '_' || CAST(k AS VARCHAR) AS candidate_id, time_mjd + i * st AS time_mjd, t_days + (time_mjd + i * st) - time_mjd AS t_days, band, mag, sqrt(25e-6 + (4e-2 - 39e-3) * x + 39e-3 * x * x) AS mag_err, row_id
 FROM (SELECT r.*, least(3e1 / 86400, coalesce((nx - time_mjd) / n, 3e1 / 86400)) AS st FROM r JOIN e USING (event_id, time_mjd)))"""


def model_export(spark, sf):
    d = R.lightcurves(spark, sf).withColumn("time_mjd", F.lit(60310.0) + F.floor(F.col("t_days") * 3) / 3)
    return B.export_model(d, D, "m5-detected", 30.0)


@query("model_broker_export", "O2 D6 C13 E12", f"WITH {MDX} SELECT event_id, objectid, candidate_id, {S.r6('time_mjd t_days')}, band, {S.r6('mag mag_err')}, row_id FROM ex")
def _(spark, sf):
    return tidy(model_export(spark, sf))


@query("broker_export_statistics", "O3 F10", f"WITH {MDX}, {S.OBJ} SELECT event_id, count(row_id) AS n_rows, round(min(time_mjd), 6) + 0.0 AS first_mjd, round(max(time_mjd), 6) + 0.0 AS last_mjd, count(row_id) = 0 AS is_empty FROM obj LEFT JOIN ex USING (event_id) GROUP BY event_id")
def _(spark, sf):
    return tidy(B.export_stats(model_export(spark, sf), R.objects(spark, sf)))


def accepted(spark, sf):
    t = R.table(spark, sf, "labels").select(F.concat(F.col("doc_id").cast("string"), F.lit(".0")).alias("objectid"), F.col("quality").cast("string").alias("n_passed_filter"))
    return B.filter_statistics(t, "objectid")


ACC = "ac AS (SELECT CAST(doc_id AS VARCHAR) AS stats_object_id, sum(quality)::BIGINT AS n_passed_filter FROM labels WHERE quality > 0 GROUP BY doc_id)"


@query("filter_pass_statistics", "A12", f"WITH {ACC} SELECT * FROM ac")
def _(spark, sf):
    return accepted(spark, sf)


def audit(spark, sf):
    docs = R.table(spark, sf, "documents").select(
        F.col("doc_id").alias("file_index"), F.col("doc_id").alias("object_id"), F.lit(1).alias("n_rows"),
        (F.col("n_chars") > 300).cast("int").alias("n_valid_points"))
    top = docs.agg(F.max("file_index")).first()[0]
    passes = accepted(spark, sf)
    return B.guard_matched(B.efficiency_audit(docs, passes, 0, top + 50), passes)


AUD = ACC + """, ix AS (SELECT unnest(range(0, (SELECT max(doc_id) + 51 FROM documents))) AS file_index), au AS (SELECT file_index, CAST(file_index AS VARCHAR) AS object_id, stats_object_id, CASE WHEN doc_id IS NULL THEN 0 ELSE 1 END::BIGINT AS n_rows, coalesce(n_chars > 300, false)::INT::BIGINT AS n_valid_points, coalesce(n_passed_filter, 0) AS n_passed_filter,
 CASE WHEN doc_id IS NULL THEN 'missing_input_file' WHEN n_chars <= 300 THEN 'no_valid_photometry' WHEN stats_object_id IS NOT NULL THEN 'passed_filter' ELSE 'rejected_filter' END AS status FROM ix LEFT JOIN documents ON doc_id = file_index LEFT JOIN ac ON stats_object_id = CAST(file_index AS VARCHAR))"""


@query("efficiency_audit", "O4 F10 F11 D11", f"WITH {AUD} SELECT * FROM au")
def _(spark, sf):
    return audit(spark, sf)


@query("efficiency_summary", "O4 B4", f"""WITH {AUD}, c AS (SELECT count(*) AS expected_events, count(*) FILTER (status = 'passed_filter') AS passed_filter, count(*) FILTER (status = 'rejected_filter') AS rejected_filter, count(*) FILTER (status = 'no_valid_photometry') AS without_valid_points, count(*) FILTER (status = 'missing_input_file') AS missing_input_files FROM au)
 SELECT *, passed_filter + rejected_filter AS evaluable, round(100e0 * passed_filter / nullif(passed_filter + rejected_filter, 0), 6) + 0.0 AS conditional_efficiency_percent, round(100e0 * passed_filter / expected_events, 6) + 0.0 AS global_efficiency_percent FROM c""")
def _(spark, sf):
    return tidy(B.audit_summary(audit(spark, sf)))


@query("alias_matched_passes", "F11", f"WITH {ACC} SELECT doc_id AS file_index, CASE WHEN doc_id % 5 = 0 THEN (SELECT stats_object_id FROM ac WHERE stats_object_id = CAST(doc_id AS VARCHAR)) ELSE coalesce((SELECT stats_object_id FROM ac WHERE stats_object_id = CAST(doc_id + 1 AS VARCHAR)), (SELECT stats_object_id FROM ac WHERE stats_object_id = CAST(doc_id AS VARCHAR))) END AS stats_object_id FROM documents")
def _(spark, sf):
    shown = F.when(F.col("doc_id") % 5 == 0, F.lit("none")).otherwise((F.col("doc_id") + 1).cast("string"))
    d = R.table(spark, sf, "documents").select(F.col("doc_id").alias("file_index"), shown.alias("object_id"))
    return B.match_statistics(d, accepted(spark, sf)).select("file_index", "stats_object_id")
