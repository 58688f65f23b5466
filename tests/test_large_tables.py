"""Faults that show on larger tables only: sketches that are evaluated again, rows dealt by their group, long keys, values that tie."""

import datetime
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skyhue.operators import convergence as V, curves, quantiles
from skyhue.operators.grid import TimeGrid
from skyhue.plans import catalog
from skyhue.plans.output import tidy
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


def against_sql(spark, path, name, **tables):
    con = duckdb.connect()
    for table, df in tables.items():
        df.write.parquet(f"{path}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet/*.parquet'")
    return compare(catalog.QUERIES[name](spark, str(path)), con, catalog.SQL[name])


def shuffled(spark, n=40_000):
    return spark.range(n).select((F.col("id") % 2).alias("k"), F.randn(7).alias("v"))


@pytest.mark.parametrize("keys", [["k"], []])
def test_brackets_may_differ_when_they_are_evaluated_again(spark, monkeypatch, keys):
    """As on several machines, where parts of a sketch meet in any order and no exchange is sure to be used again."""
    real = quantiles._brackets
    shift = F.udf(lambda: random.random() * 0.05, "double").asNondeterministic()

    def shaky(*args):
        got, wanted, order = real(*args)
        got = got.withColumn("__j", shift())
        return got.withColumns({"__lo": F.transform("__lo", lambda e: e - F.col("__j")), "__hi": F.transform("__hi", lambda e: e + F.col("__j"))}).drop("__j"), wanted, order

    monkeypatch.setattr(quantiles, "_brackets", shaky)
    values = shuffled(spark).toPandas()
    reuse = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = quantiles.exact_quantiles(shuffled(spark), keys, "v", [1.0, 50.0, 99.0], accuracy=500).collect()
    finally:
        spark.conf.set("spark.sql.exchange.reuse", reuse)
    assert len(got) == (2 if keys else 1)
    for r in got:
        own = values[values.k == r.k].v if keys else values.v
        assert r.n == len(own) and np.allclose(r.quantiles, np.percentile(own, [1, 50, 99]), rtol=0, atol=1e-12)


def test_rows_are_not_dealt_by_their_group(spark, monkeypatch):
    """Few groups of many rows: no group's rows meet in one task before equal ones are folded."""
    plans = []
    real = quantiles.materialize
    monkeypatch.setattr(quantiles, "materialize", lambda d: (plans.append(d._jdf.queryExecution().executedPlan().toString()), real(d))[1])
    quantiles.exact_quantiles(shuffled(spark), ["k"], "v", [50.0], accuracy=500).collect()
    assert len(plans) == 1 and "SortMergeJoin" not in plans[0] and "BroadcastHashJoin" in plans[0]


def test_field_numbers_of_four_digits(spark, tmp_path):
    far = lambda table, key: spark.read.parquet(f"{SF}/{table}.parquet").withColumn(key, F.col(key) + 1234)
    nation = spark.read.parquet(f"{SF}/nation.parquet")
    assert not against_sql(spark, tmp_path, "visit_field_metadata", nation=nation, supplier=far("supplier", "s_suppkey"), lineitem=far("lineitem", "l_suppkey"))


def test_one_of_the_largest_values_becomes_infinite(spark, tmp_path):
    """Most objects have several values at the largest, 20; only one of them becomes infinite."""
    events = spark.read.parquet(f"{SF}/events.parquet")
    tied = events.where("event_type = 'view'").withColumn("value", F.least("value", F.lit(20.0)))
    assert not against_sql(spark, tmp_path, "small_sample_quantiles", events=tied)


def test_interpolation_multiplies_before_it_divides(spark):
    """To the last digit the values of the SQL, so that a limit doesn't tell them apart."""
    grid, r = TimeGrid(0.4, 26.0, 0.4), np.random.default_rng(2)
    rows = {i: (r.integers(0, 5) / 3, r.integers(2000, 4000) / 100, r.integers(60, 75) / 3, r.integers(2000, 4000) / 100) for i in range(50)}
    points = [(i, "lsst", "g", float(t), float(m)) for i, (t0, m0, t1, m1) in rows.items() for t, m in ((t0, m0), (t1, m1))]
    d = spark.createDataFrame(points, "event_id int, photometric_system string, band string, t_days double, mag double")
    got = curves.interpolate(d, grid, "linear").withColumn("c", grid.centre(F.col("bin_index"))).collect()
    assert len(got) > 2000
    for x in got:
        t0, m0, t1, m1 = map(float, rows[x.event_id])
        assert x.mag == (m1 if x.c == t1 else m0 + (m1 - m0) * (x.c - t0) / (t1 - t0))


def test_a_repetition_without_extent_comes_last(spark):
    rows = [("a", 20, r, t, 26.0, None if t is None else abs(t - 26.0), t == 26.0) for r, t in enumerate((8.0, None, 26.0))] + [("b", 20, r, None, 26.0, None, False) for r in range(3)]
    d = spark.createDataFrame(rows, "group_id string, sample_size int, repetition int, last_valid_time_days double, reference_last_valid_time_days double, absolute_extent_error_days double, extent_within_tolerance boolean")
    times = [f"last_valid_time_days_{x}" for x in ("p16", "median", "p84")]
    counted = {r.group_id: r for r in V.aggregate_extent(d, 0.6, skip_missing=False).collect()}
    assert [counted["a"][c] for c in times] == [8.0, 26.0, None] and [counted["b"][c] for c in times] == [None] * 3
    assert counted["a"].absolute_extent_error_days_p84 == 18.0 and counted["a"].repetitions == 3
    left_out = {r.group_id: r for r in V.aggregate_extent(d, 0.6).collect()}
    assert [left_out["a"][c] for c in times] == [8.0, 8.0, 26.0] and [left_out["b"][c] for c in times] == [None] * 3


def test_some_repetitions_without_extent(spark, tmp_path):
    """60 events of which two have an early point, so that some subsets of 20 lack the first bin."""
    copies = spark.range(4).withColumnRenamed("id", "k")
    events = spark.read.parquet(f"{SF}/events.parquet").crossJoin(copies)
    own = F.col("user_id") + F.col("k") * 15
    events = events.withColumns({"event_id": F.col("event_id") + F.col("k") * 1000, "user_id": own}).drop("k")
    events = events.where("ts > TIMESTAMP_NTZ '2024-01-02 12:00:00' OR user_id % 30 = 6").withColumn("ts", F.expr("ts - INTERVAL 8 HOURS"))
    assert not against_sql(spark, tmp_path, "extent_stability", events=events, customer=spark.read.parquet(f"{SF}/customer.parquet"))
    got = catalog.QUERIES["extent_stability"](spark, str(tmp_path)).collect()
    assert {r.sample_size for r in got if r.last_valid_time_days_median is None} == {20} and all(r.last_valid_time_days_p16 == 26.0 for r in got)


def test_rounding_as_in_the_sql(spark, tmp_path):
    """Halves of the sixth place and their neighbours, which a last binary digit tells apart."""
    r = np.random.default_rng(4)
    halves = (r.integers(0, 60_000_000, 20_000) * 2 + 1) / 2e6
    x = np.concatenate([halves, np.nextafter(halves, 0), np.nextafter(halves, 100), -halves, r.normal(0, 1e3, 5000), r.normal(0, 1e12, 500)])
    x = np.concatenate([x, [0.0, -0.0, -1e-9, 4.9999999999999994e-7, 5e-7, -5e-7, 1e300, 1e305, -1e305, np.inf, -np.inf, np.nan]])
    d = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, v double").unionByName(spark.createDataFrame([(len(x), None)], "i int, v double"))
    d.write.parquet(f"{tmp_path}/v.parquet")
    con = duckdb.connect()
    want = con.execute(f"SELECT round(v, 6) + 0.0 FROM '{tmp_path}/v.parquet/*.parquet' ORDER BY i").fetchall()
    got = [q.v for q in tidy(d).orderBy("i").collect()]
    assert [repr(a) for a in got] == [repr(b) for (b,) in want]


def test_linear_colours_at_a_half_of_the_last_place(spark, tmp_path):
    """Knots 32 steps of eight hours apart give values that end in a half of the sixth place."""
    start = datetime.datetime(2024, 1, 1, 1)
    knots = [("view", 0, 22.11), ("view", 32, 20.15), ("click", 0, 5.66), ("click", 32, 3.71)]
    rows = [(k, start + datetime.timedelta(hours=8 * step), 1, kind, mag) for k, (kind, step, mag) in enumerate(knots)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    assert not against_sql(spark, tmp_path, "second_population_adaptation", events=events, customer=spark.read.parquet(f"{SF}/customer.parquet"))
