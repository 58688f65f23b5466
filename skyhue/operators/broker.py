"""Alert-broker exports and the audit of what a broker's filter accepted."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skyhue.functions import checks, columns as C
from skyhue.operators import curves, selection, series


def _depth(band: str, depths: dict[str, float]):
    m5 = F.lit(None).cast("double")
    for b, value in depths.items():
        m5 = F.when(F.col(band) == b, F.lit(float(value))).otherwise(m5)
    return m5


#: Bands in the survey's order.
BAND_ORDER = ("u", "g", "r", "i", "z", "y")


def survey_order(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """Rows with their band's place in the survey's order, and the columns that order simultaneous ones."""
    place = F.array_position(F.array(*map(F.lit, BAND_ORDER)), F.col("band"))
    tie = ["row_id"] if "row_id" in rows.columns else ["mag", "magerr"]
    return rows.withColumn("__band_place", place), ["__band_place", *tie]


def export_snia(rows: DataFrame, depths: dict[str, float] = C.DEFAULT_DEPTH, seconds: float = 30.0, chunk_days: float = 1.0) -> DataFrame:
    """Valid rows of sn_id, mjd, band, mag, magerr as broker rows: simultaneous bands moved apart, limits coded, ids given.

    Simultaneous rows stand in the survey's band order, then as row_id says where the table has it, else by magnitude. t_days counts from the phase that
    the table gives (phase_since_reference, else from reference_mjd), else from the object's first row.
    """
    ok, order = survey_order(selection.usable_snia(rows, list(depths)).withColumn("band", C.norm_text("band")))
    d = curves.stagger_fixed(ok, "sn_id", "mjd", order, seconds, chunk_days)
    bad = F.raise_error(F.lit("a shifted time reaches the next epoch; use a shorter step")).cast("double")
    d = d.withColumn("time_mjd", F.when(F.col("shift_ok"), F.col("t_shifted")).otherwise(bad))
    shift = F.col("time_mjd") - F.col("mjd")
    if "phase_since_reference" in d.columns:
        d = d.withColumn("t_days", C.to_double("phase_since_reference") + shift)
    elif "reference_mjd" in d.columns:
        d = d.withColumn("t_days", F.col("mjd") - C.to_double("reference_mjd") + shift)
    else:
        d = d.withColumn("t_days", F.col("time_mjd") - F.col("scan.first"))
    d = d.withColumn("sequence", F.col("scan.number"))
    d = selection.detect_or_limit(d.withColumn("mag_err", F.col("magerr")), depths)
    width = F.greatest(F.lit(4), F.length(F.col("__max_id").cast("string")))
    d = d.crossJoin(F.broadcast(ok.agg(F.max("sn_id").alias("__max_id"))))
    return d.select(
        F.col("sn_id").alias("objectid"),
        F.concat(F.lpad(F.col("sn_id").cast("string"), width, F.lit("0")), F.lit("_"), F.col("sequence").cast("string")).alias("candidate_id"),
        "time_mjd", "t_days", "band", "mag", "mag_err", "detected", (F.col("time_mjd") > F.col("mjd")).alias("was_shifted"),
    )


def snia_objects(rows: DataFrame, depths: dict[str, float] = C.DEFAULT_DEPTH, metadata: list[str] = ()) -> DataFrame:
    """One row per exported object: first metadata in time order, detections."""
    ok, names = survey_order(selection.usable_snia(rows, list(depths)).withColumn("band", C.norm_text("band")))
    order = F.struct("mjd", *names)
    return ok.groupBy("sn_id").agg(
        *[F.min_by(c, order).alias(c) for c in metadata],
        F.count("*").alias("n_rows"), F.count_if(F.col("mag") <= _depth("band", depths)).alias("n_detected"),
    )


def export_report(exported: DataFrame) -> DataFrame:
    return exported.agg(
        F.count("*").alias("n_rows"), F.count_distinct("objectid").alias("n_objects"), F.count_if("detected").alias("n_detections"),
        F.count_if(~F.col("detected")).alias("n_limits"), F.count_if("was_shifted").alias("n_shifted"),
    )


def export_model(
    rows: DataFrame, depths: dict[str, float] = C.DEFAULT_DEPTH, mode: str = "complete", seconds: float = 30.0,
    systematic: float = C.SYSTEMATIC_ERROR_MAG, chunk_days: float = 1.0,
) -> DataFrame:
    """Model curves (event_id, time_mjd, t_days, band, mag, row_id) as broker rows with photometric errors.

    Where the table names photometric systems, only the survey's own is exported.
    """
    if "photometric_system" in rows.columns:
        rows = rows.where(C.norm_text("photometric_system") == "lsst")
    d = rows.where("time_mjd IS NOT NULL AND t_days IS NOT NULL AND mag IS NOT NULL")
    m5 = F.coalesce(_depth("band", depths), F.raise_error(F.concat(F.lit("no depth for band "), F.col("band"))).cast("double"))
    d = selection.export_mode(d.withColumn("m5", m5), mode)
    d = d.withColumn("mag_err", C.magnitude_error("mag", "m5", "band", systematic))
    if seconds > 0:
        d = curves.stagger_fit(d, "event_id", "time_mjd", ["row_id"], seconds, chunk_days)
    else:
        d = series.scan(d, ["event_id"], "time_mjd", ["row_id"], series.chunk_by("time_mjd", chunk_days)).withColumn("t_shifted", F.col("time_mjd"))
    d = d.withColumn("sequence", F.col("scan.number"))
    return d.select(
        "event_id", F.when(F.col("sequence") == 1, F.col("event_id")).alias("objectid"), C.candidate_id("event_id", "sequence").alias("candidate_id"),
        F.col("t_shifted").alias("time_mjd"), (F.col("t_days") + F.col("t_shifted") - F.col("time_mjd")).alias("t_days"),
        "band", "mag", "mag_err", "row_id",
    )


def export_stats(exported: DataFrame, objects: DataFrame, key: str = "event_id") -> DataFrame:
    """Rows, first and last time and an empty flag per object, objects without rows included."""
    s = exported.groupBy(key).agg(F.count("*").alias("n_rows"), F.min("time_mjd").alias("first_mjd"), F.max("time_mjd").alias("last_mjd"))
    d = objects.select(key).join(s, key, "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0).cast("bigint")))
    return d.withColumn("is_empty", F.col("n_rows") == 0)


def filter_statistics(rows: DataFrame, id_column: str, passed: str | None = "n_passed_filter") -> DataFrame:
    """object id -> passes, objects with at least one; without a pass column each row counts once."""
    n = F.coalesce(F.col(passed).try_cast("double").cast("bigint"), F.lit(0)) if passed in rows.columns else F.lit(1)
    d = rows.select(C.id_float_like(id_column).alias("stats_object_id"), n.cast("bigint").alias("n")).where("stats_object_id IS NOT NULL AND n > 0")
    return d.groupBy("stats_object_id").agg(F.sum("n").alias("n_passed_filter"))


def match_statistics(records: DataFrame, accepted: DataFrame) -> DataFrame:
    """Each record with the first of its ids that was accepted: its object id, its file index, 1000000 standing for 0."""
    oid, idx = C.id_float_like("object_id"), C.id_float_like("file_index")
    candidates = F.array_compact(F.array(oid, idx, F.when((oid == "0") | (idx == "0"), F.lit("1000000"))))
    keyed = records.select("file_index", F.posexplode_outer(F.array_distinct(candidates)).alias("pos", "stats_object_id"))
    hits = keyed.join(accepted, "stats_object_id").groupBy("file_index").agg(
        F.min_by("stats_object_id", "pos").alias("stats_object_id"), F.min_by("n_passed_filter", "pos").alias("n_passed_filter")
    )
    return records.join(hits, "file_index", "left").withColumn("n_passed_filter", F.coalesce("n_passed_filter", F.lit(0).cast("bigint")))


def efficiency_audit(inputs: DataFrame, accepted: DataFrame, start: int, stop: int) -> DataFrame:
    """One row per expected index: passed, rejected, without photometry, or missing.

    inputs: file_index (whole number), object_id, n_rows, n_valid_points. The expected range is generated, not collected.
    """
    spark = inputs.sparkSession
    expected = spark.range(start, stop + 1).withColumnRenamed("id", "file_index")
    here = inputs.where(F.col("file_index").between(start, stop)).withColumn("present", F.lit(True))
    d = expected.join(here, "file_index", "left")
    d = d.withColumns({
        "object_id": F.coalesce(F.col("object_id").cast("string"), F.col("file_index").cast("string")),
        "n_rows": F.coalesce("n_rows", F.lit(0)).cast("bigint"), "n_valid_points": F.coalesce("n_valid_points", F.lit(0)).cast("bigint"),
    })
    m = match_statistics(d, accepted)
    present = F.coalesce("present", F.lit(False))
    return m.select(
        "file_index", "object_id", "stats_object_id", "n_rows", "n_valid_points", "n_passed_filter",
        F.when(~present, "missing_input_file").when(F.col("n_valid_points") == 0, "no_valid_photometry")
        .when(F.col("stats_object_id").isNotNull(), "passed_filter").otherwise("rejected_filter").alias("status"),
    )


def unmatched_passes(audit: DataFrame, accepted: DataFrame) -> DataFrame:
    """Accepted ids that no record matched; any is an error of the caller's inputs."""
    return accepted.join(audit.where("stats_object_id IS NOT NULL").select("stats_object_id"), "stats_object_id", "left_anti")


def require_matched(audit: DataFrame, accepted: DataFrame) -> DataFrame:
    """Action: fails where the filter passed an id that no record has; else the audit itself."""
    lost = unmatched_passes(audit, accepted).agg(F.count("*").alias("n"), F.min("stats_object_id").alias("one")).first()
    if lost["n"]:
        raise ValueError(f"{lost['n']} passed ids match no record, such as {lost['one']}")
    return audit


def guard_matched(audit: DataFrame, accepted: DataFrame) -> DataFrame:
    """The same as part of the query, which stops when it runs."""
    lost = unmatched_passes(audit, accepted).agg(F.count("*").alias("n"), F.min("stats_object_id").alias("one"))
    text = F.format_string("%s passed ids match no record, such as %s", "n", "one")
    return checks.guard_with(audit, lost.select(F.when(F.col("n") > 0, text).alias("message")))


def audit_summary(audit: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    d = audit.agg(
        F.count("*").alias("expected_events"), n("passed_filter").alias("passed_filter"), n("rejected_filter").alias("rejected_filter"),
        n("no_valid_photometry").alias("without_valid_points"), n("missing_input_file").alias("missing_input_files"),
    )
    d = d.withColumn("evaluable", F.col("passed_filter") + F.col("rejected_filter"))
    return d.withColumns({
        "conditional_efficiency_percent": 100 * F.try_divide("passed_filter", "evaluable"),
        "global_efficiency_percent": 100 * F.try_divide("passed_filter", "expected_events"),
    })
