"""Queries over the scalar functions, each on a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyhue.functions import columns as C
from skyhue.operators import curves, series
from skyhue.plans import roles as R, shared_sql as S
from skyhue.plans.output import tidy
from skyhue.plans.registry import query


@query("numeric_coercion", "C1", """SELECT p_partkey, TRY_CAST(split_part(p_brand, '#', 2) AS DOUBLE) AS brand_number, CAST(NULL AS DOUBLE) AS type_number,
 CASE WHEN p_size % 2 = 0 THEN p_retailprice END AS price FROM part""")
def _(spark, sf):
    p = R.table(spark, sf, "part")
    shown = F.when(F.col("p_size") % 2 == 0, F.col("p_retailprice").cast("string")).when(F.col("p_size") % 3 == 0, F.lit("NaN")).otherwise(F.lit("Infinity"))
    return p.select("p_partkey", C.to_double(F.split("p_brand", "#")[1]).alias("brand_number"), C.to_double("p_type").alias("type_number"), C.to_double(shown).alias("price"))


@query("identifier_forms", "C3", """SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS plain, lpad(CAST(c_custkey AS VARCHAR), greatest(6, length(CAST(c_custkey AS VARCHAR)))::INTEGER, '0') AS padded,
 CAST(c_custkey AS VARCHAR) AS from_float, c_name AS kept, CAST(NULL AS VARCHAR) AS missing FROM customer""")
def _(spark, sf):
    key = F.col("c_custkey").cast("string")
    return R.table(spark, sf, "customer").select(
        "c_custkey", C.id_plain(F.concat(F.lit(" 00"), key)).alias("plain"), C.id_padded(F.concat(key, F.lit(".0"))).alias("padded"),
        C.id_float_like(F.concat(key, F.lit(".0"))).alias("from_float"), C.id_plain(F.concat(F.col("c_name"), F.lit(" "))).alias("kept"),
        C.id_float_like(F.lit(" None ")).alias("missing"),
    )


@query("flag_parsing", "C4", """SELECT o_orderstatus, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS n_text, count(*) FILTER (o_totalprice > 100000) AS n_number
 FROM orders GROUP BY o_orderstatus""")
def _(spark, sf):
    text = F.when(F.col("o_orderstatus") == "F", " Yes").when(F.col("o_orderstatus") == "O", "no")
    number = F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).otherwise(F.lit(0.0))
    return R.table(spark, sf, "orders").groupBy("o_orderstatus").agg(
        F.count("*").alias("n"), F.count_if(C.to_bool(text)).alias("n_text"), F.count_if(C.number_to_bool(number)).alias("n_number")
    )


@query("first_finite_alias", "C5", "SELECT p_partkey, round(CASE WHEN p_size % 3 = 0 THEN p_retailprice ELSE p_size END, 6) + 0.0 AS value FROM part")
def _(spark, sf):
    first = F.when(F.col("p_size") % 3 == 0, F.col("p_retailprice")).when(F.col("p_size") % 3 == 1, F.lit(float("nan")))
    return tidy(R.table(spark, sf, "part").select("p_partkey", C.first_finite(first, "p_size").alias("value")))


@query("quantile_as_percent", "C6", "SELECT l_discount, l_quantity, round(l_discount * 100, 6) + 0.0 AS a, round(CASE WHEN l_quantity <= 1 THEN 100 * l_quantity ELSE l_quantity END, 6) + 0.0 AS b, count(*) AS n FROM lineitem GROUP BY ALL")
def _(spark, sf):
    d = R.table(spark, sf, "lineitem").select("l_discount", "l_quantity", C.percent("l_discount").alias("a"), C.percent("l_quantity").alias("b"))
    return tidy(d.groupBy("l_discount", "l_quantity", "a", "b").agg(F.count("*").alias("n")), "l_discount", "l_quantity", "a", "b", "n")


ALL_PAIRS = f"""WITH {S.LC}, {S.GRID}, {S.at_centres("lc")}, rk AS (SELECT * FROM (VALUES ('g', 1), ('r', 2), ('i', 3), ('z', 4), ('y', 5)) v(band, k))
 SELECT a.band || '_' || b.band AS pair, a.bin_index, count(*) AS n, round(avg(a.mag - b.mag), 6) + 0.0 AS mean_color
 FROM atc a JOIN rk ra USING (band) JOIN atc b ON a.event_id = b.event_id AND a.bin_index = b.bin_index JOIN rk rb ON b.band = rb.band AND ra.k < rb.k GROUP BY ALL"""


@query("all_colour_pairs", "C7", ALL_PAIRS)
def _(spark, sf):
    pairs = C.colour_pairs("all", C.BANDS[1:])
    at = curves.interpolate(R.lightcurves(spark, sf), R.GRID, event_keys=["event_id"])
    wide = curves.wide_bands(at, {b: b for b in C.BANDS[1:]}, ["event_id"])
    rows = F.explode(F.array(*[F.struct(F.lit(f"{a}_{b}").alias("pair"), (F.col(a) - F.col(b)).alias("color")) for a, b in pairs])).alias("p")
    d = wide.select("bin_index", rows).select("bin_index", "p.*").where("color IS NOT NULL")
    return tidy(d.groupBy("pair", "bin_index").agg(F.count("*").alias("n"), F.avg("color").alias("mean_color")))


@query("derived_parameters", "C8", f"""WITH {S.OBJ} SELECT event_id, round(pow(10, log10_mej_dyn), 6) + 0.0 AS mej_dyn, round(pow(10, log10_mej_wind), 6) + 0.0 AS mej_wind,
 round(degrees(inclination_EM), 6) + 0.0 AS inclination_deg, round(cos(inclination_EM), 6) + 0.0 AS cos_inclination, phi FROM obj""")
def _(spark, sf):
    from skyhue.operators import cells
    o = R.objects(spark, sf)
    return tidy(o.select("event_id", *[cells.parameter(o, n).alias(n) for n in ("mej_dyn", "mej_wind", "inclination_deg", "cos_inclination", "phi")]))


@query("galactic_latitude", "C9 C21", """WITH {} SELECT field_index, round(b, 6) + 0.0 AS b_deg, latitude_group FROM fl""".format(
    __import__("skyhue.plans.scans", fromlist=["LAT"]).LAT))
def _(spark, sf):
    b = C.galactic_latitude("ra0_deg", "dec0_deg")
    return tidy(R.fields(spark, sf).select("field_index", b.alias("b_deg"), C.latitude_group(b, 20.0).alias("latitude_group")))


@query("distance_modulus_and_times", "C10 C11", f"""WITH {S.OBJ}, {S.LC} SELECT row_id, round(5 * log10(luminosity_distance) + 25, 6) + 0.0 AS mu, round(-10 + 5 * log10(luminosity_distance) + 25, 6) + 0.0 AS edge,
 round(t_days / (1 + redshift), 6) + 0.0 AS t_source, round(t_days * (1 + redshift), 6) + 0.0 AS t_observed FROM lc JOIN obj USING (event_id)""")
def _(spark, sf):
    d = R.lightcurves(spark, sf).join(R.objects(spark, sf), "event_id")
    mu = C.distance_modulus("luminosity_distance")
    return tidy(d.select("row_id", mu.alias("mu"), (F.lit(-10.0) + mu).alias("edge"), C.source_time("t_days", "redshift").alias("t_source"), C.observer_time("t_days", "redshift").alias("t_observed")))


def _coefficient_rows():
    return ", ".join(f"('{s}', '{b}', {v!r}::DOUBLE)" for s, t in C.ATTENUATION.items() for b, v in t.items())


@query("attenuation", "C12", f"""WITH {S.DUAL}, {S.OBJ}, k(photometric_system, band, r) AS (VALUES {_coefficient_rows()})
 SELECT row_id, photometric_system, round(CASE WHEN band = 'z' THEN 5e-1 ELSE ebv_mw * r END, 6) + 0.0 AS a_mag FROM dual JOIN obj USING (event_id) JOIN k USING (photometric_system, band)""")
def _(spark, sf):
    d = R.dual_lightcurves(spark, sf).join(R.objects(spark, sf).select("event_id", "ebv_mw"), "event_id")
    d = d.withColumn("A_saved", F.when(F.col("band") == "z", F.lit(0.5)))
    return tidy(d.select("row_id", "photometric_system", C.attenuation("ebv_mw", "photometric_system", "band", "A_saved").alias("a_mag")))


@query("magnitude_error_law", "C13 C14", f"""WITH {S.LC}, q AS (SELECT row_id, band, 18 + mag / 100 AS m, CASE WHEN band = 'u' THEN 38e-3 ELSE 39e-3 END AS g FROM lc),
 d(band, m5) AS (VALUES ('u', 237e-1), ('g', 248e-1), ('r', 244e-1), ('i', 239e-1), ('z', 233e-1), ('y', 223e-1)), x AS (SELECT *, pow(10, 4e-1 * (m - m5)) AS x FROM q JOIN d USING (band))
 SELECT row_id, round(sqrt(25e-6 + (4e-2 - g) * x + g * x * x), 6) + 0.0 AS mag_err, round(5 * pow(10, -4e-1 * (m - m5)), 6) + 0.0 AS snr, round(-25e-1 * log10(pow(10, -4e-1 * m)), 6) + 0.0 AS back FROM x""")
def _(spark, sf):
    m5 = F.create_map(*[x for b, v in C.DEFAULT_DEPTH.items() for x in (F.lit(b), F.lit(v))])[F.col("band")]
    d = R.lightcurves(spark, sf).withColumns({"m": 18 + F.col("mag") / 100, "m5": m5})
    return tidy(d.select("row_id", C.magnitude_error("m", "m5", "band").alias("mag_err"), C.signal_to_noise("m", "m5").alias("snr"), C.magnitude_of_flux(C.relative_flux("m")).alias("back")))


@query("candidate_identifiers", "C15 C19 H1", f"""WITH {S.LC}, r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY t_days, row_id) AS k FROM lc)
 SELECT row_id, lpad(CAST(event_id AS VARCHAR), greatest(4, length(CAST(event_id AS VARCHAR)))::INTEGER, '0') || '_' || CAST(k AS VARCHAR) AS candidate_id,
 lpad(CAST(event_id AS VARCHAR), greatest(4, length(CAST(event_id AS VARCHAR)))::INTEGER, '0') || '_LSST_' || lpad(CAST(k AS VARCHAR), 6, '0') AS survey_id, CASE WHEN k = 1 THEN event_id END AS objectid FROM r""")
def _(spark, sf):
    d = series.row_numbers(R.lightcurves(spark, sf), ["event_id"], ["t_days", "row_id"], series.chunk_by("t_days", 1.0), "k")
    return d.select("row_id", C.candidate_id("event_id", "k").alias("candidate_id"), C.survey_candidate_id("event_id", "k").alias("survey_id"), F.when(F.col("k") == 1, F.col("event_id")).alias("objectid"))


@query("utc_text_to_mjd", "C16", "SELECT event_id AS row_id, round(40587 + epoch_us(ts) / 86400e6, 6) + 0.0 AS mjd FROM events")
def _(spark, sf):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    return tidy(R.table(spark, sf, "events").select(F.col("event_id").alias("row_id"), C.utc_to_mjd(text).alias("mjd")))


@query("native_colour_and_error", "C17 E7", f"""WITH {S.LC}, p AS (SELECT event_id, floor(t_days) AS t_days, band, median(mag) AS mag FROM lc WHERE band IN ('g', 'r') GROUP BY ALL)
 SELECT a.event_id, a.t_days, round(a.mag - b.mag, 6) + 0.0 AS color, round(sqrt(pow(a.mag / 100, 2) + pow(b.mag / 100, 2)), 6) + 0.0 AS color_error
 FROM p a JOIN p b ON a.event_id = b.event_id AND a.t_days = b.t_days AND a.band = 'g' AND b.band = 'r'""")
def _(spark, sf):
    d = R.lightcurves(spark, sf, ("g", "r")).withColumn("t_days", F.floor("t_days").cast("double"))
    p = curves.native_pairs(d, "g", "r")
    return tidy(p.select("event_id", "t_days", "color", C.colour_error(F.col("mag1") / 100, F.col("mag2") / 100).alias("color_error")))


@query("percentile_labels", "C18", """SELECT l_quantity, 'p' || replace(regexp_replace(regexp_replace(printf('%.6f', l_quantity / 4), '0+$', ''), '\\.$', ''), '.', 'p') AS label, count(*) AS n FROM lineitem GROUP BY ALL""")
def _(spark, sf):
    d = R.table(spark, sf, "lineitem").select("l_quantity", C.percentile_label(F.col("l_quantity") / 4).alias("label"))
    return d.groupBy("l_quantity", "label").agg(F.count("*").alias("n"))


@query("target_slugs", "C20", """SELECT p_partkey, regexp_replace(regexp_replace(lower(trim('  ' || p_name || ' (' || p_brand || ') ')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part""")
def _(spark, sf):
    return R.table(spark, sf, "part").select("p_partkey", C.slug(F.concat(F.lit("  "), F.col("p_name"), F.lit(" ("), F.col("p_brand"), F.lit(") "))).alias("slug"))


@query("text_normalisation", "C2", """SELECT event_type, count(*) AS n, 'g' AS visit_band FROM events GROUP BY event_type""")
def _(spark, sf):
    raw = F.concat(F.lit("  "), F.initcap("event_type"), F.lit(" "))
    d = R.table(spark, sf, "events").select(C.norm_text(raw).alias("event_type"), C.norm_visit_band(F.lit(" LSSTg ")).alias("visit_band"))
    return d.groupBy("event_type", "visit_band").agg(F.count("*").alias("n"))
