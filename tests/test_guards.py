"""Loads and contracts that stop a query, and percentiles that differ by group."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyhue.functions import checks
from skyhue.operators import convergence as V, latitude as L, quantiles, selection
from skyhue.operators.grid import TimeGrid
from skyhue.sources import population, readers


def stops(df, text):
    with pytest.raises(Exception, match=text):
        df.collect()


# loading


def write_shards(spark, path, shards):
    for k, rows in enumerate(shards):
        spark.createDataFrame([(e, "lsst", "g", float(t), 20.0) for e, t in rows], "event_id string, photometric_system string, band string, t_days double, mag double").coalesce(1).write.mode("append").parquet(path)
    return readers.lightcurves(spark, path, source=True)


def test_report_of_two_shards(spark, tmp_path):
    curves = write_shards(spark, str(tmp_path / "p"), [[("a", 1), ("a", 2), ("b", 1)], [("b", 2), ("c", 1)]])
    expected = spark.createDataFrame([("a",), ("b",), ("d",), ("d",)], "event_id string")
    got = {r.event_id: r for r in population.load_report(curves, expected).collect()}
    assert {k: (r.status, r.n_rows) for k, r in got.items()} == {"a": ("loaded", 2), "b": ("in_several_files", 2), "c": ("not_expected", 1), "d": ("missing", 0)}
    assert got["a"].first_file == got["a"].last_file and got["b"].first_file != got["b"].last_file and got["d"].first_file is None
    assert population.report_counts(population.load_report(curves, expected)).first() == (1, 1, 1, 1)
    assert [r.event_id for r in population.missing_events(curves, expected).collect()] == ["d"]


def test_an_event_in_two_shards_stops_the_load(spark, tmp_path):
    curves = write_shards(spark, str(tmp_path / "p"), [[("a", 1), ("b", 1)], [("b", 2), ("c", 1)]])
    stops(population.load(curves), "event b lies in")
    stops(population.load(curves).select("mag"), "event b lies in")


def test_load_keeps_expected_events(spark, tmp_path):
    curves = write_shards(spark, str(tmp_path / "p"), [[("a", 1), ("a", 2)], [("c", 1)]])
    d = population.load(curves, spark.createDataFrame([("a",), ("d",)], "event_id string"))
    assert "source_file" not in d.columns and sorted((r.event_id, r.t_days) for r in d.collect()) == [("a", 1.0), ("a", 2.0)]
    assert population.load(curves.where("false")).count() == 0


def test_no_job_runs_while_a_guarded_query_is_built(spark, tmp_path):
    curves = write_shards(spark, str(tmp_path / "p"), [[("a", 1)], [("b", 2)]])
    spark.sparkContext.setJobGroup("built", "built")
    try:
        population.load(curves)
        checks.one_to_one(curves, curves, "event_id")
        checks.guard_same_keys(curves, curves, "event_id")
        selection.checked_sky(curves, "t_days", "mag")
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("built")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


# joins and keys


def test_one_to_one(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "n")], "k int, a string")
    b = spark.createDataFrame([(2, 5.0), (3, 6.0)], "k int, b double")
    assert checks.one_to_one(a, b, "k").collect() == [(2, "y", 5.0)]
    left = {r.k: r.b for r in checks.one_to_one(a, b, "k", how="left").collect()}
    assert left == {1: None, 2: 5.0, None: None}
    stops(checks.one_to_one(a, b.union(b), "k"), 'right table repeats .*"k"')
    stops(checks.one_to_one(a.union(a), b, "k").select("k"), "left table repeats")


def test_same_keys(spark):
    a, b = spark.range(5).toDF("k"), spark.range(5).union(spark.range(5)).toDF("k")
    assert checks.guard_same_keys(a, b, "k").count() == 5
    stops(checks.guard_same_keys(a, b.where("k > 1"), "k"), "2 only left, 0 only right")


def test_measures_come_along(spark):
    d, seen = checks.observed(spark.range(10), rows=F.count("*"), high=F.count_if(F.col("id") > 6))
    assert d.count() == 10 and seen.get == {"rows": 10, "high": 3}


@pytest.mark.parametrize(("row", "text"), [((10.0, -90.5, 0.1), "outside"), ((None, 5.0, 0.1), "finite"), ((1.0, math.inf, 0.1), "finite"), ((1.0, 2.0, -0.1), "not negative"), ((1.0, 2.0, None), "not negative")])
def test_sky_positions(spark, row, text):
    fine = [(-10.0, -90.0, 0.0), (370.0, 90.0, 0.3)]
    schema = "ra double, dec double, ebv double"
    got = selection.checked_sky(spark.createDataFrame(fine, schema), "ra", "dec", "ebv").collect()
    assert [tuple(r) for r in got] == [(350.0, -90.0, 0.0), (10.0, 90.0, 0.3)]
    stops(selection.checked_sky(spark.createDataFrame([*fine, row], schema), "ra", "dec", "ebv"), text)


# paired latitude tables


def bin_table(spark, b, ids="abcd", counts=(2, 1, 0)):
    return spark.createDataFrame([(i, float(b), *map(float, counts)) for i in ids], ", ".join([f"{L.PAIRED_COLUMNS[0]} string", *(f"{c} double" for c in L.PAIRED_COLUMNS[1:])]))


def four(spark, **change):
    tables = {lo: (float(lo), float(lo + 20 if lo < 60 else 90), bin_table(spark, lo + 1)) for lo in (0, 20, 40, 60)}
    return [*(tables | {int(k[1:]): v for k, v in change.items()}).values()]


def test_paired_tables(spark):
    got = L.paired_outcomes(four(spark, b60=(60.0, 90.0, bin_table(spark, 90, "dcba", (2, 0, 0)))))
    rows = {(r.event_id, r.bin_index): (r.lower_deg, r.baseline, r.m5_loss, r.mw_loss) for r in got.collect()}
    assert len(rows) == 16 and rows["a", 0] == (0.0, True, False, True) and rows["d", 3] == (60.0, True, True, False)
    table = {r.bin_index: r for r in L.paired_bins(got, "bin_index", "lower_deg").collect()}
    assert table[0].n_mw_loss == 4 and table[3].n_m5_loss == 4 and table[3].ratio_mw_loss == 0


def test_paired_tables_that_break_the_contract(spark):
    t = lambda *a, **k: bin_table(spark, *a, **k)
    with pytest.raises(ValueError, match="at least 4"):
        L.paired_outcomes(four(spark)[:3])
    with pytest.raises(ValueError, match="must join"):
        L.paired_outcomes(four(spark, b20=(21.0, 40.0, t(25))))
    with pytest.raises(ValueError, match="no latitude interval"):
        L.paired_outcomes(four(spark, b60=(60.0, 91.0, t(65))))
    with pytest.raises(ValueError, match="missing columns"):
        L.paired_outcomes(four(spark, b20=(20.0, 40.0, t(25).drop("abs_b_deg"))))
    stops(L.paired_outcomes(four(spark, b20=(20.0, 40.0, t(25, "abc")))), r"event d is missing from \[20, 40")
    stops(L.paired_outcomes(four(spark, b20=(20.0, 40.0, t(25, "abcde")))), "event e is missing from")
    stops(L.paired_outcomes(four(spark, b20=(20.0, 40.0, t(25, "abcdd")))), r"event d is repeated in \[20, 40")
    stops(L.paired_outcomes(four(spark, b20=(20.0, 40.0, t(45)))), r"an object of \[20, 40 lies at 45")
    stops(L.paired_outcomes(four(spark, b20=(20.0, 40.0, t(25, counts=(1, 2, 0))))), "expected N_bins_m5_with_mw")
    stops(L.paired_outcomes(four(spark, b20=(20.0, 40.0, t(25).withColumn("N_bins_baseline", F.lit("x"))))), "empty event_id or number")


# percentiles


@pytest.mark.parametrize("accuracy", [20, 500, 10_000])
def test_percentiles_by_group(spark, accuracy):
    d = spark.range(6000).select((F.col("id") % 3).cast("int").alias("k"), F.when(F.col("id") % 7 == 0, F.lit(0.5)).otherwise(F.randn(5)).alias("v")).cache()
    asked = {0: [50.0, 1.0, 99.0], 1: [16.0, 50.0], 2: [0.0, 100.0, 33.3]}
    table = spark.createDataFrame(list(asked.items()), "k int, percents array<double>")
    got = {r.k: (r.n, list(r.quantiles)) for r in quantiles.exact_quantiles(d, ["k"], "v", table, accuracy=accuracy).collect()}
    for k, ps in asked.items():
        values = [r.v for r in d.where(F.col("k") == k).collect()]
        assert got[k][0] == len(values) and np.allclose(got[k][1], np.percentile(values, ps), rtol=0, atol=1e-12)


@pytest.mark.parametrize("accuracy", [50, 10_000])
def test_order_statistics_with_infinities(spark, accuracy):
    r = np.random.default_rng(4)
    values = np.concatenate([r.normal(size=900), [np.inf] * 300, [-np.inf] * 50, [0.25] * 500])
    d = spark.createDataFrame([(float(v),) for v in values], "v double")
    s, n = np.sort(values), len(values)
    ps = [0.0, 2.0, 40.0, 50.0, 82.83, 90.0, 100.0]
    sample = list(quantiles.exact_quantiles(d, [], "v", ps, accuracy=accuracy, rule="sample").first()["quantiles"])
    assert sample == [s[int(np.rint((n - 1) * (p / 100)))] for p in ps]
    linear = list(quantiles.exact_quantiles(d, [], "v", ps, accuracy=accuracy).first()["quantiles"])
    assert all(a == b for a, b in zip(linear, np.quantile(s, np.array(ps) / 100)) if np.isfinite(b) or np.isinf(b)) or np.allclose(
        [x for x in linear if np.isfinite(x)], [x for x in np.quantile(s, np.array(ps) / 100) if np.isfinite(x)])
    assert linear[0] == -np.inf and linear[-2] == np.inf and not any(map(math.isnan, linear))


def test_only_needed_buckets_are_put_in_order(spark):
    """Of 200,000 values, all kept by a wide bracket, at most a few thousand reach the ordering."""
    d = spark.range(200_000).select(F.randn(3).alias("__v"))
    brackets, *_ = quantiles._brackets(d, [], [50.0], 200_001)
    counted = d.crossJoin(brackets).select("__n", F.lit(1).alias("__r"), F.col("__v").alias("__x")).groupBy("__n", "__r", "__x").agg(F.count("*").alias("__c"))
    got = quantiles._needed_values(counted, [], "__start <= 100000 AND 99999 < __end", None).cache()
    assert got.count() == 2 and {(r["__start"], r["__end"]) for r in got.collect()} == {(99_999, 100_000), (100_000, 100_001)}


def profile_values(spark, n=120):
    rows = [(i, b, lo + i / (n - 1)) for i in range(n) for b, lo in ((0, 1.0), (1, 2.0))]
    return spark.createDataFrame(rows, "event_id int, bin_index int, color double"), spark.range(n).select(F.col("id").cast("int").alias("event_id"))


def test_profiles_at_reference_percentiles(spark):
    values, events = profile_values(spark)
    grid = TimeGrid(0.4, 1.2, 0.4)
    reference = V.envelope_profiles(values, events, grid, [1], [], low=16.0)
    other = V.envelope_profiles(values, events, grid, [1], [], low=5.0, bounds=reference.select("bin_index", "valid", "low_percentile"))
    assert reference.where("valid").count() == 2 and sorted(map(tuple, reference.collect())) == sorted(map(tuple, other.collect()))
    mixed = spark.createDataFrame([(0, True, 25.0), (1, False, 10.0)], "bin_index int, valid boolean, low_percentile double")
    got = {r.bin_index: r for r in V.envelope_profiles(values, events, grid, [1], [], low=5.0, bounds=mixed).collect()}
    assert (got[0].low_percentile, got[0].high_percentile) == (25.0, 75.0) and (got[1].low_percentile, got[1].high_percentile) == (5.0, 95.0)
    assert abs(got[0].color_min - 1.25) < 1e-12 and abs(got[1].color_max - 2.95) < 1e-12
    only_median = spark.createDataFrame([(0, True, 50.0)], "bin_index int, valid boolean, low_percentile double")
    status = {r.bin_index: r.status for r in V.envelope_profiles(values, events, grid, [1], [], low=5.0, bounds=only_median).collect()}
    assert status == {0: "degenerate_p50_p50_excluded", 1: "after_first_invalid_bin"}
