"""Sources and sinks of many small files and of databases, samples and joins of crowded keys."""

import os
import random

import pytest
from pyspark.sql import functions as F

from skyhue.operators import curves, grid, ranks, skew, survey
from skyhue.sources import readers, survey_db, writers


def test_one_file_for_each_object(spark, tmp_path):
    path = str(tmp_path / "objects")
    rows = [(e, float(t), "gr"[t % 2], 20.0 + t) for e in (7, 12, 300) for t in range(5)] + [(7, 9.0, None, None)]
    d = spark.createDataFrame(rows, "event_id long, t_days double, band string, mag double").repartition(4)
    writers.per_object(d, path, "event_id")
    assert sorted(os.listdir(path)) == ["12.csv", "300.csv", "7.csv"]
    with open(os.path.join(path, "7.csv")) as f:
        lines = f.read().splitlines()
    assert lines[0].replace('"', "") == "t_days,band,mag" and len(lines) == 7 and [x.split(",")[0] for x in lines[1:]] == ["0", "1", "2", "3", "4", "9"]
    back = readers.lightcurve_csvs(spark, path)
    assert sorted((r.event_id, r.t_days, r.mag) for r in back.where("mag IS NOT NULL").collect()) == sorted((str(e), t, m) for e, t, _, m in rows if m is not None)
    writers.per_object(d, path, "event_id")  # again: the same files
    assert sorted(os.listdir(path)) == ["12.csv", "300.csv", "7.csv"]
    writers.per_object(d.where("false"), str(tmp_path / "none"), "event_id")


def test_only_the_manifests_shards_are_read(spark, tmp_path):
    path = str(tmp_path / "run")
    for k in range(4):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.parquet(f"{path}/shard-{k}.parquet")
    manifest = spark.createDataFrame([("shard-1.parquet",), ("shard-3.parquet",), ("shard-3.parquet",)], "file string")
    for files in (manifest, ["shard-1.parquet", "shard-3.parquet"]):
        d = readers.shards(spark, path, files)
        assert sorted(r.id for r in d.collect()) == [*range(10, 20), *range(30, 40)] and all("shard-1" in f or "shard-3" in f for f in d.inputFiles())
    with pytest.raises(ValueError, match="names no file"):
        readers.shards(spark, path, manifest.where("false"))


def test_survey_database(spark, tmp_path):
    path = str(tmp_path / "survey")
    rows = [(i, i / 3, "gri"[i % 3] if i % 10 else None, f"DDF:{i % 4}") for i in range(5000)]
    survey_db.write(spark.createDataFrame(rows, "id long, depth double, band string, target string").repartition(3), path)
    assert len(survey_db.files(path)) == 3
    d = survey_db.read(spark, path, rows=500)
    assert d.schema.simpleString() == "struct<id:bigint,depth:double,band:string,target:string>" and d.rdd.getNumPartitions() >= 9
    assert sorted(map(tuple, d.collect()), key=repr) == sorted(rows, key=repr)
    some = survey_db.read(spark, path, columns=["band", "id"]).where((F.col("band") == "g") & (F.col("id") >= 100) & F.col("id").isin(*range(0, 5000, 3)))
    assert some.columns == ["band", "id"] and sorted(r.id for r in some.collect()) == [i for i, _, b, _ in rows if b == "g" and i >= 100]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("RuntimeFilters", ""), plan  # the database applies them
    assert survey_db.read(spark, path).where("band IS NULL AND NOT id = 10").count() == 499
    assert survey_db.read(spark, path).where("target LIKE '%:1'").count() == 1250
    with pytest.raises(ValueError, match="mounted folder"):
        survey_db.local("s3://bucket/survey.db")


def test_relational_source_by_bounds(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/survey;create=true"
    rows = spark.range(1000).select(F.col("id").cast("int").alias("OBSERVATIONID"), (F.col("id") % 7).cast("double").alias("FIELDDEC"))
    rows.coalesce(1).write.format("jdbc").option("url", url).option("dbtable", "OBSERVATIONS").save()
    d = readers.survey_table(spark, url, "OBSERVATIONS", partitionColumn="OBSERVATIONID", lowerBound=0, upperBound=1000, numPartitions=4)
    low = d.where("FIELDDEC < 3 AND OBSERVATIONID >= 500")
    assert d.rdd.getNumPartitions() == 4 and low.count() == sum(i % 7 < 3 for i in range(500, 1000))
    plan = low._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*" in plan and "LessThan(FIELDDEC,3.0)" in plan


# samples


def test_smallest_rows_without_a_sort(spark):
    r = random.Random(2)
    ids = r.sample(range(-10**6, 10**12, 977), 3000)
    d = spark.createDataFrame([(i,) for i in ids], "event_id long").repartition(5)
    for size in (1, 40, 2999, 3000, 5000):
        assert sorted(x.event_id for x in ranks.subset(d, "event_id", size, None).collect()) == sorted(ids)[:size]
    few, more = ({x.event_id for x in ranks.subset(d, "event_id", n, 11).collect()} for n in (40, 400))
    assert len(few) == 40 and len(more) == 400 and few < more
    got = {x.event_id: x["rank"] for x in ranks.id_rank(d, "event_id").collect()}
    assert got == {i: k + 1 for k, i in enumerate(sorted(ids))}
    assert ranks.subset(d.where("false"), "event_id", 5, None).count() == 0


def test_given_ids(spark):
    d = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "event_id long, v string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "event_id long")
    assert sorted(r.v for r in ranks.given(d, ids(1, 1), "event_id").collect()) == ["a", "b"]
    with pytest.raises(Exception, match="2 event_id not found, the first is 7"):
        ranks.given(d, ids(1, 7, 9), "event_id").collect()


def test_validation_sample_with_parameters(spark):
    peaks = spark.createDataFrame([(i, i % 5 != 0) for i in range(50)], "event_id int, peak_used boolean")
    bins = spark.createDataFrame([(i, i % 4) for i in range(50)], "event_id int, n_bins int")
    p = spark.createDataFrame([(i, i / 10) for i in range(40)], "event_id int, z double")
    got = curves.validation_sample(peaks, bins, 10, 3, p).collect()
    assert len(got) == 10 and sorted(r.random_order for r in got) == list(range(1, 11))
    assert all(r.event_id % 5 and r.event_id % 4 and r.z == (r.event_id / 10 if r.event_id < 40 else None) for r in got)
    with pytest.raises(Exception, match="repeats"):
        curves.validation_sample(peaks, bins.union(bins), 10, 3, p).collect()


# joins


def test_a_crowded_key_is_dealt_out(spark):
    many = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).alias("k"), "id").repartition(6)
    few = spark.range(600).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    d = skew.split_join(many, few, ["k"], 500)
    assert sorted(map(tuple, d.select("k", "id", "v").collect())) == sorted((r.k, r.id, r.k * 10) for r in many.collect())
    # the parts of the hot key, as the join sees them
    parts = many.where("k = 0").withColumn("part", F.pmod(F.xxhash64("k", "id"), F.lit(-(-many.where("k = 0").count() // 500))))
    sizes = [r["count"] for r in parts.groupBy("part").count().collect()]
    assert max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]


def test_cone_join_of_a_deep_field(spark):
    """A third of the visits in one field."""
    f = spark.createDataFrame([(k, float(k * 12 % 360), float(k * 5 - 60)) for k in range(24)], "field_index int, ra0_deg double, dec0_deg double")
    v = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit(36.0)).otherwise(F.rand(1) * 360).alias("fieldRA"), F.when(F.col("id") % 3 == 0, F.lit(-45.0)).otherwise(F.rand(2) * 120 - 60).alias("fieldDec")).cache()
    whole = sorted(map(tuple, survey.cone_join(f, v, 4.0).select("field_index", "id").collect()))
    assert len(whole) >= 1000 and whole == sorted(map(tuple, survey.cone_join(f, v, 4.0, rows_per_part=50).select("field_index", "id").collect()))


@pytest.mark.parametrize("rule", ["left_open", "right_open", "closed"])
def test_points_in_overlapping_intervals(spark, rule):
    r = random.Random(6)
    rules = [(k, a, a + r.choice([0.0, 0.5, 3.0, 40.0])) for k, a in enumerate(round(r.uniform(-20, 20), 1) for _ in range(60))]
    points = [(i, round(r.uniform(-25, 60), 1)) for i in range(300)] + [(300, None)]
    p = spark.createDataFrame(points, "i int, t double")
    table = spark.createDataFrame(rules, "k int, t_min_days double, t_max_days double")
    holds = {"left_open": lambda t, a, b: a < t <= b, "right_open": lambda t, a, b: a <= t < b, "closed": lambda t, a, b: a <= t <= b}[rule]
    want = [(i, k) for i, t in points for k in ([k for k, a, b in rules if t is not None and holds(t, a, b)] or [None])]
    got = grid.match_interval(p, "t", table, rule)
    assert sorted(((x.i, x.k) for x in got.collect()), key=repr) == sorted(want, key=repr)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
