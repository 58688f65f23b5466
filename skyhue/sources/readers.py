"""Readers: each gives a lazy DataFrame with the library's column names; filters reach the files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from skyhue.functions import checks, columns as C
from skyhue.functions.checks import require_columns

LIGHTCURVE_CSV = T.StructType([
    T.StructField("t_days", T.StringType()), T.StructField("band", T.StringType()), T.StructField("mag", T.StringType()),
])
VISIT_ALIASES = {
    "MJD": ("MJD", "mjd", "observationStartMJD"), "m5": ("m5", "fiveSigmaDepth"), "band": ("band", "filter"),
}
ID_ALIASES = ("event_id", "objectid", "i")


def lightcurves(spark: SparkSession, path: str, bands=None, systems=None, event_ids: DataFrame | None = None, source: bool = False) -> DataFrame:
    """Long light curves from Parquet. Band and system are stored normalised, so both filters are pushed to the scan.

    A file set without a photometric system is lsst. ``source`` adds the path of each row's file (see ``population``).
    """
    d = spark.read.parquet(path)
    if source:
        d = d.select("*", F.col("_metadata.file_path").alias("source_file"))
    require_columns(d, "event_id", "t_days", "band", "mag")
    if "photometric_system" not in d.columns:
        d = d.withColumn("photometric_system", F.lit("lsst"))
    if bands:
        d = d.where(F.col("band").isin(list(bands)))
    if systems:
        d = d.where(F.col("photometric_system").isin(list(systems)))
    if event_ids is not None:
        d = d.join(event_ids.select("event_id"), "event_id", "left_semi")
    optional = [c for c in ("objectid", "candidate_id", "time_mjd", "source_file") if c in d.columns]
    return d.select("event_id", "photometric_system", "band", C.to_double("t_days").alias("t_days"), C.to_double("mag").alias("mag"), *optional)


def lightcurve_csvs(spark: SparkSession, path: str, exclude: str = "lsstlike") -> DataFrame:
    """One CSV per event, the id in the file name; survey-like files are left out."""
    d = spark.read.schema(LIGHTCURVE_CSV).option("header", True).option("enforceSchema", False).csv(path)
    name = F.col("_metadata.file_name")
    d = d.select("*", name.alias("file_name"))
    return d.where(~F.lower("file_name").contains(exclude)).select(
        C.id_plain(F.regexp_extract("file_name", "(\\d+)\\.csv", 1)).alias("event_id"), F.lit("lsst").alias("photometric_system"),
        C.norm_text("band").alias("band"), C.to_double("t_days").alias("t_days"), C.to_double("mag").alias("mag"),
    )


def objects(df: DataFrame) -> DataFrame:
    """Object summary with its id under event_id, whichever alias the table uses."""
    for name in ID_ALIASES:
        if name in df.columns:
            return df.withColumn("event_id", C.id_plain(name))
    raise ValueError(f"no id column among {ID_ALIASES}")


def visits(df: DataFrame) -> DataFrame:
    """Visit table with its aliases renamed; a required column that is absent is an error."""
    out = {}
    for name, aliases in VISIT_ALIASES.items():
        have = [a for a in aliases if a in df.columns]
        if not have:
            raise ValueError(f"visits need one of {aliases}")
        out[name] = F.coalesce(*[F.col(a).cast("string") for a in have]) if name == "band" else C.first_finite(*have)
    keep = [c for c in df.columns if not any(c in a for a in VISIT_ALIASES.values())]
    return df.select(*keep, out["MJD"].alias("MJD"), C.norm_visit_band(out["band"]).alias("band"), out["m5"].alias("m5"))


def visit_csvs(spark: SparkSession, path: str) -> DataFrame:
    """Visit CSVs of one field each; the field number comes from the file name."""
    d = spark.read.option("header", True).csv(path)
    number = F.regexp_extract(F.col("_metadata.file_name"), "field(\\d+)", 1)
    return visits(d.select("*", number.try_cast("int").alias("field_index")))


def with_field_metadata(visit_rows: DataFrame, fields: DataFrame, wanted: dict[str, tuple[str, ...]]) -> DataFrame:
    """Field columns joined to visits, each the first usable of its aliases; what a visit has of its own stays. A field that has more rows than one
    stops the query."""
    have = set(fields.columns)
    cols = []
    for name, aliases in wanted.items():
        usable = [a for a in aliases if a in have]
        cols.append(C.first_finite(*usable).alias(f"__{name}") if usable else F.lit(None).cast("double").alias(f"__{name}"))
    one = fields.select("field_index", *cols).groupBy("field_index").agg(F.count("*").alias("__n"), *(F.first(f"__{name}").alias(f"__{name}") for name in wanted))
    d = visit_rows.join(one, "field_index", "left")
    repeated = F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("several rows for field "), F.col("field_index").cast("string"))).cast("double"))
    values = {name: F.coalesce(repeated, *([C.to_double(name)] if name in visit_rows.columns else []), F.col(f"__{name}")) for name in wanted}
    return d.withColumns(values).drop("__n", *(f"__{name}" for name in wanted))


def depth_table(df: DataFrame, percentile: float, scope: str | None = None) -> DataFrame:
    """band, m5 at a percentile from a long (quantile, m5), wide (m5_p50, p50, m5_q50) or legacy (m5_median) table."""
    d = df.withColumn("band", C.norm_text("band"))
    wanted = {
        "threshold_scope": scope or "common_global",
        "threshold_latitude_group": "high" if scope not in (None, "common_global") else "both",
    }
    for name, value in wanted.items():
        if name not in d.columns:
            continue
        hit = F.col(name) == value
        if scope is None:  # without a scope the global rows are preferred, if the table (a few dozen rows) has any
            d = d.withColumn("__any", F.max(hit).over(W.partitionBy(F.lit(0)))).where(hit | ~F.col("__any")).drop("__any")
        else:
            d = d.where(hit)
    if {"quantile", "m5"} <= set(d.columns):
        return d.where(F.abs(C.percent(C.to_double("quantile")) - percentile) <= 1e-9).select("band", C.to_double("m5").alias("m5"))
    label = f"{percentile:g}"
    names = [f"m5_p{label}", f"p{label}", f"m5_q{label}"] + (["m5_median", "median_m5"] if percentile == 50 else [])
    column = next((n for n in names if n in d.columns), None)
    if column is None:
        raise ValueError(f"no depth column for percentile {percentile}")
    return d.select("band", C.to_double(column).alias("m5"))


def scenario(df: DataFrame, name: str, bands, scope: str = "common_global") -> DataFrame:
    """Depths of a named scenario for the requested bands. A band that is missing, repeated or without a finite depth is an error."""
    group = "both" if scope == "common_global" else "high"
    d = df.withColumn("band", C.norm_text("band")).where((F.col("scenario") == name) & F.col("band").isin(list(bands)))
    if "threshold_scope" in df.columns:
        d = d.where((F.col("threshold_scope") == scope) & (F.col("threshold_latitude_group") == group))
    d = d.select("band", C.to_double("m5").alias("m5"))
    checks.require_bands(d, bands)
    return d


def snia(spark: SparkSession, path: str, wanted: list[str]) -> DataFrame:
    """SN Ia photometry: required columns, and those of the optional ones that the file has."""
    return present_columns(spark.read.parquet(path), ["sn_id", "mjd", "band", "mag", "magerr"], wanted)


def commented_text(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Whitespace-separated text, ``#`` starts a comment line."""
    line = F.trim("value")
    d = spark.read.text(path).where((line != "") & ~line.startswith("#"))
    parts = F.split(line, "\\s+")
    return d.select(*[parts[i].alias(n) for i, n in enumerate(names)])


def realizations(runs: list[DataFrame]) -> DataFrame:
    """Runs of a manifest as one table with a realization number."""
    return reduce(DataFrame.unionByName, [r.withColumn("realization", F.lit(i)) for i, r in enumerate(runs)])


def realization_manifest(spark: SparkSession, manifest: list[tuple[int, str]]) -> DataFrame:
    """(number, path) rows of a manifest -> union with the number as key."""
    return reduce(DataFrame.unionByName, [spark.read.parquet(p).withColumn("realization", F.lit(int(n))) for n, p in manifest])


def shards(spark: SparkSession, directory: str, files: list[str] | DataFrame | None = None) -> DataFrame:
    """A run's Parquet parts; a shard manifest (names, or a table of them in ``file``) limits them to those it names, otherwise Spark lists the directory.

    Names of files pass through the driver, as those of a listing do. A manifest without names is an error.
    """
    if files is None:
        return spark.read.parquet(directory)
    names = [r["file"] for r in files.select("file").distinct().toLocalIterator()] if isinstance(files, DataFrame) else list(files)
    if not names:
        raise ValueError("the shard manifest names no file")
    return spark.read.parquet(*[f"{directory}/{f}" for f in sorted(names)])


def one_event(df: DataFrame, event_id) -> DataFrame:
    """All rows of an event; files written in id order let the scan skip the rest."""
    return df.where(F.col("event_id") == event_id)


def require_event(df: DataFrame, event_id) -> DataFrame:
    d = one_event(df, event_id)
    if not d.limit(1).count():
        raise KeyError(event_id)
    return d


def survey_table(spark: SparkSession, url: str, table: str, properties: dict | None = None, **partitioning) -> DataFrame:
    """Relational survey source; filters on it run in the database. Give column, bounds and numPartitions to split the read."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**(properties or {}))
    return reader.options(**partitioning).load()


def present_columns(df: DataFrame, required: list[str], optional: list[str]) -> DataFrame:
    """Required columns, and those of the optional ones that exist; the scan reads no others."""
    require_columns(df, *required)
    return df.select(*required, *[c for c in optional if c in df.columns])
