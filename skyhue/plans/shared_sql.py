"""SQL text shared by the oracles: the same roles of the driver's tables, as common table expressions."""

LC = """lc AS (SELECT user_id AS event_id, 'lsst' AS photometric_system,
 CASE event_type WHEN 'view' THEN 'g' WHEN 'click' THEN 'r' WHEN 'purchase' THEN 'i' WHEN 'signup' THEN 'z' ELSE 'y' END AS band,
 (epoch_us(ts) - 1704067200000000) / 86400e6 AS t_days, value AS mag, event_id AS row_id FROM events)"""

DUAL = LC + """, dual AS (SELECT * FROM lc UNION ALL SELECT event_id, 'ps1', band, t_days,
 mag + CASE WHEN band = 'g' THEN 25e-2 ELSE 1e-1 END, row_id FROM lc)"""

OBJ = """obj AS (SELECT c_custkey AS event_id, c_mktsegment AS population, 1e-2 + (c_acctbal + 1000) / 110000 AS redshift,
 4e1 + c_acctbal / 50 + 20 AS luminosity_distance, ((c_custkey * 37) % 91)::DOUBLE AS abs_b_deg,
 ((c_custkey * 13) % 50) / 1e2 AS ebv_mw, -3e0 + ((c_custkey * 7) % 200) / 1e2 AS log10_mej_dyn,
 -25e-1 + c_acctbal / 8000 AS log10_mej_wind, ((c_custkey * 11) % 157) / 1e2 AS inclination_EM,
 ((c_custkey * 17) % 90)::DOUBLE AS phi FROM customer)"""

VISITS = """visits AS (SELECT l_suppkey AS field_index, 40587e0 + epoch_us(l_shipdate) / 86400e6 + l_linenumber / 16e0 AS MJD,
 CASE l_returnflag WHEN 'A' THEN 'g' WHEN 'N' THEN 'r' ELSE 'i' END AS band, 20e0 + l_discount * 50 + l_tax AS m5 FROM lineitem)"""

FIELDS = """fields AS (SELECT s_suppkey AS field_index, ((s_suppkey * 7) % 360)::DOUBLE AS ra0_deg, s_acctbal / 200 - 20 AS dec0_deg,
 n_name AS target_name, ((s_suppkey * 3) % 40) / 1e2 AS ebv_mw FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

OBS = FIELDS + """, obs AS (SELECT 40587e0 + epoch_us(l_shipdate) / 86400e6 AS observationStartMJD,
 CASE l_returnflag WHEN 'A' THEN 'g' WHEN 'N' THEN 'r' ELSE 'i' END AS band, 20e0 + l_discount * 50 + l_tax AS fiveSigmaDepth,
 (ra0_deg + l_linenumber / 4e0) % 36e1 AS fieldRA, dec0_deg + l_quantity / 4e1 AS fieldDec, target_name
 FROM lineitem JOIN fields ON l_suppkey = field_index)"""

SNIA = LC + """, sn AS (SELECT event_id AS sn_id, 6031e1 + floor(t_days * 3) / 3 AS mjd, band, mag, (row_id % 10) / 1e1 AS magerr, row_id FROM lc)"""

PHOT = LC + """, phot AS (SELECT *, 2e-2 + (row_id % 7) / 1e2 AS mag_err, 6031e1 + t_days AS time_mjd FROM lc)"""

GRID = """grid AS (SELECT i::INTEGER AS bin_index, 4e-1 + i * 4e-1 AS t_min_days, 4e-1 + (i + 1) * 4e-1 AS t_max_days,
 4e-1 + (i + 5e-1) * 4e-1 AS t_center_days FROM range(64) r(i))"""


def at_centres(source: str, how: str = "log", min_knots: int = 1, name: str = "atc", keys: str = "event_id, photometric_system, band") -> str:
    """Magnitudes of (keys, t_days, mag) rows at the grid centres, by a range join on segments."""
    positive = " AND t_days > 0" if how == "log" else ""
    w = {
        "log": "(log10(t_center_days) - log10(t_days)) / (log10(t1) - log10(t_days))",
        "linear": "(t_center_days - t_days) / (t1 - t_days)",
    }[how]
    return f"""{name}_p AS (SELECT {keys}, t_days, median(mag) AS mag FROM {source} WHERE mag IS NOT NULL AND t_days IS NOT NULL{positive} GROUP BY ALL),
 {name}_s AS (SELECT *, lead(t_days) OVER w AS t1, lead(mag) OVER w AS m1, count(*) OVER (PARTITION BY {keys}) AS k
  FROM {name}_p WINDOW w AS (PARTITION BY {keys} ORDER BY t_days)),
 {name} AS (SELECT {keys}, bin_index, CASE WHEN t_center_days = t_days THEN mag ELSE mag + (m1 - mag) * {w} END AS mag
  FROM {name}_s JOIN grid ON t_center_days >= t_days AND (t_center_days < t1 OR (t1 IS NULL AND t_center_days = t_days)) WHERE k >= {min_knots})"""


COL = LC + ", " + GRID + ", " + at_centres("lc") + """, col AS (SELECT event_id, bin_index, mag1, mag2, mag1 AS sel1, mag2 AS sel2, mag1 - mag2 AS color FROM (
 SELECT event_id, bin_index, max(mag) FILTER (band = 'g') AS mag1, max(mag) FILTER (band = 'r') AS mag2 FROM atc WHERE band IN ('g', 'r') GROUP BY ALL))"""

DEPTH = VISITS + """, dep AS (SELECT quantile_cont(m5, 5e-1) FILTER (band = 'g') AS m5_1, quantile_cont(m5, 5e-1) FILTER (band = 'r') AS m5_2 FROM visits)"""

STAGED = COL + ", " + DEPTH + """, staged AS (SELECT 'no_m5' AS stage, col.* FROM col WHERE color IS NOT NULL
 UNION ALL SELECT 'm5', col.* FROM col, dep WHERE color IS NOT NULL AND sel1 <= m5_1 AND sel2 <= m5_2)"""

RULES = STAGED + """, rules AS (SELECT stage, bin_index, t_min_days, t_max_days, t_center_days, count(*) AS n, quantile_cont(color, 1e-2) AS color_min,
 quantile_cont(color, 5e-1) AS color_median, quantile_cont(color, 99e-2) AS color_max,
 row_number() OVER (PARTITION BY stage ORDER BY bin_index) - 1 = bin_index AS consecutive
 FROM staged JOIN grid USING (bin_index) GROUP BY stage, bin_index, t_min_days, t_max_days, t_center_days)"""


def r6(names: str) -> str:
    """Rounded columns under their own names."""
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names.split())
