"""Contracts of readers, selections, exports and depths: what stops a query, and what is kept, in rows made by hand."""

import pytest
from pyspark.errors import PySparkException

from skyhue.functions import columns as C
from skyhue.operators import broker, curves, latitude, selection, survey
from skyhue.operators.grid import TimeGrid
from skyhue.sources import readers, staging

PHOTOMETRY = "sn_id double, mjd double, band string, mag double, magerr double, ra double, dec double"


def test_simultaneous_bands_leave_in_survey_order(spark):
    rows = [(1.0, 60000.0, b, 20.0, 0.1, 1.0, 2.0) for b in ("i", "y", "g", " R ", "z", "u")] + [(1.0, 60000.0, "g", 19.0, 0.1, 1.0, 2.0)]
    got = broker.export_snia(spark.createDataFrame(rows, PHOTOMETRY), dict.fromkeys("ugrizy", 25.0)).orderBy("time_mjd").collect()
    assert [r.band for r in got] == ["u", "g", "g", "r", "i", "z", "y"] and [r.mag for r in got][1:3] == [19.0, 20.0]
    assert [r.candidate_id for r in got] == [f"0001_{k}" for k in range(1, 8)]


def test_source_row_breaks_ties_before_magnitude(spark):
    rows = [(1, 60000.0, "g", 20.0, 0.1, 1), (1, 60000.0, "g", 19.0, 0.1, 2)]
    got = broker.export_snia(spark.createDataFrame(rows, "sn_id int, mjd double, band string, mag double, magerr double, row_id int"), {"g": 25.0}).orderBy("time_mjd").collect()
    assert [r.mag for r in got] == [20.0, 19.0]


@pytest.mark.parametrize(("column", "value", "first"), [("phase_since_reference", -3.0, -3.0), ("reference_mjd", 59990.0, 10.0)])
def test_phase_of_the_table_goes_before_the_first_row(spark, column, value, first):
    rows = [(1, 60000.0, b, 20.0, 0.1, value) for b in ("g", "r")]
    got = broker.export_snia(spark.createDataFrame(rows, f"sn_id int, mjd double, band string, mag double, magerr double, {column} double"), {"g": 25.0, "r": 25.0}, 30.0).orderBy("time_mjd").collect()
    assert got[0].t_days == first and abs(got[1].t_days - first - 30 / 86400) < 1e-6


def test_rows_without_place_are_rejected_and_counted(spark):
    nan = float("nan")
    rows = [(1.0, 1.0, "g", 20.0, 0.1, nan, 2.0), (1.0, 1.0, "g", 20.0, 0.1, 1.0, None), (1.0, 1.0, "x", 20.0, -1.0, 1.0, 2.0), (1.0, 1.0, "G", 20.0, 0.1, 1.0, 2.0), (None, 1.0, "g", float("inf"), 0.1, 1.0, 2.0)]
    df = spark.createDataFrame(rows, PHOTOMETRY)
    assert selection.usable_snia(df, ["g"]).count() == 1
    r = selection.snia_quality(df, ["g"]).first()
    assert (r.n_rows, r.n_kept, r.n_rejected, r.n_bad_position, r.n_bad_band, r.n_bad_error, r.n_bad_id, r.n_bad_magnitude) == (5, 1, 4, 2, 1, 1, 1, 1)


def test_ids_that_are_not_whole_stop_the_query(spark):
    df = spark.createDataFrame([(1.5, 1.0, "g", 20.0, 0.1, 1.0, 2.0)], PHOTOMETRY)
    with pytest.raises(PySparkException, match="whole numbers"):
        selection.usable_snia(df, ["g"]).collect()


def test_only_the_surveys_own_system_is_exported(spark):
    rows = [(1, 60000.0, 1.0, "g", 20.0, 1, "LSST"), (1, 60001.0, 2.0, "g", 20.0, 2, "ps1")]
    df = spark.createDataFrame(rows, "event_id bigint, time_mjd double, t_days double, band string, mag double, row_id bigint, photometric_system string")
    assert [r.row_id for r in broker.export_model(df).collect()] == [1]


@pytest.mark.parametrize(("away", "bins"), [(0.0, [2]), (5e-11, [2]), (-5e-11, [2]), (2e-10, []), (-2e-10, [])])
def test_lone_knot(spark, away, bins):
    grid = TimeGrid(0.4, 4.4, 0.4)
    t = 0.4 + 2.5 * 0.4 + away
    df = spark.createDataFrame([("a", "g", t, 20.0)], "event_id string, band string, t_days double, mag double")
    assert [r.bin_index for r in curves.interpolate(df, grid, keys=["event_id", "band"]).collect()] == bins
    two = spark.createDataFrame([("a", "g", t, 20.0), ("a", "g", t + 1e-3, 21.0)], "event_id string, band string, t_days double, mag double")
    assert [r.bin_index for r in curves.interpolate(two, grid, keys=["event_id", "band"]).collect()] == ([2] if away <= 0 else [])


def test_lone_knot_just_past_the_last_centre(spark):
    grid = TimeGrid(0.0, 1.0, 0.5)
    df = spark.createDataFrame([("a", "g", 0.75 + 5e-11, 20.0)], "event_id string, band string, t_days double, mag double")
    assert [r.bin_index for r in curves.interpolate(df, grid, keys=["event_id", "band"]).collect()] == [1]


def test_visits_keep_their_own_metadata(spark):
    v = spark.createDataFrame([(1, 5.0), (2, None)], "field_index int, fieldRA double")
    f = spark.createDataFrame([(1, 7.0), (2, 8.0)], "field_index int, RA double")
    got = readers.with_field_metadata(v, f, {"fieldRA": ("RA",)})
    assert got.columns.count("fieldRA") == 1 and {r.field_index: r.fieldRA for r in got.collect()} == {1: 5.0, 2: 8.0}
    with pytest.raises(PySparkException, match="several rows"):
        readers.with_field_metadata(v, f.union(f), {"fieldRA": ("RA",)}).collect()


DEPTHS = [("common_global", "both", "g", "median_p50", 50.0, 24.0), ("common_global", "both", "R", "median_p50", 50.0, 23.0), ("latitude_conditioned", "high", "g", "median_p50", 50.0, 24.5)]
DEPTH = "threshold_scope string, threshold_latitude_group string, band string, scenario string, quantile double, m5 double"


def test_scenario_needs_every_band_once(spark):
    t = spark.createDataFrame(DEPTHS, DEPTH)
    assert {r.band: r.m5 for r in readers.scenario(t, "median_p50", ["g", "r"]).collect()} == {"g": 24.0, "r": 23.0}
    for broken, bands in ((t, ["g", "r", "i"]), (t.union(t), ["g"])):
        with pytest.raises(ValueError, match="depth"):
            readers.scenario(broken, "median_p50", bands)


def test_depths_come_from_the_table_or_else_from_visits(spark):
    t = spark.createDataFrame(DEPTHS, DEPTH)
    v = spark.createDataFrame([("g", 20.0), ("g", 21.0), ("r", 22.0)], "band string, m5 double")
    depth = lambda *a: {r.band: r.m5 for r in survey.resolve_depths(t, v, *a).collect()}
    assert depth(50.0, ["g", "r"]) == {"g": 24.0, "r": 23.0}
    assert depth(50.0, ["g"], "latitude_conditioned") == {"g": 24.5}
    assert depth(40.0, ["g", "r"]) == {"g": 20.4, "r": 22.0}
    with pytest.raises(ValueError, match="depth"):
        depth(50.0, ["g", "r"], "latitude_conditioned")


def test_ids_beyond_double_precision_lose_only_their_zeros(spark):
    texts = ["1234567890123456789.0", "9007199254740993.00", "7.", "007.0", "-0.0", "1e3", "7.5", "nan"]
    got = spark.createDataFrame([(x,) for x in texts], "x string").select(C.id_float_like("x").alias("y")).collect()
    assert [r.y for r in got] == ["1234567890123456789", "9007199254740993", "7", "7", "0", "1000", "7.5", None]


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "local-cluster[2,1,1024]"

            class _Conf:
                get = staticmethod(lambda *a: None)

            getConf = staticmethod(lambda: Session.sparkContext._Conf)

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        staging.folder(Session)
    Session.sparkContext.master = "local[8]"
    assert staging.folder(Session)


def test_objects_without_dust_or_latitude_are_left_out_and_counted(spark):
    nan = float("nan")
    o = spark.createDataFrame([(1, 10.0, 0.1), (2, nan, 0.1), (3, 10.0, None), (4, 95.0, 0.1)], "event_id int, abs_b_deg double, ebv_mw double")
    c = spark.createDataFrame([(i, 20.0, 20.0, 0.0, 25.0, 25.0) for i in (1, 2, 3, 4)], "event_id int, sel1 double, sel2 double, color double, m5_1 double, m5_2 double")
    got = latitude.loss_counts(c, o, c, "g", "r").collect()
    assert [(r.event_id, r.N_bins_baseline, r.N_bins_m5_with_mw) for r in got] == [(1, 1, 1)]
    assert tuple(latitude.excluded_objects(o).first()) == (4, 1, 3)
    with pytest.raises(PySparkException, match="invalid attenuation"):
        latitude.loss_counts(c, o.where("event_id = 1").selectExpr("event_id", "abs_b_deg", "-ebv_mw AS ebv_mw"), c, "g", "r").collect()


def test_passes_that_match_no_record_are_an_error(spark):
    files = spark.createDataFrame([(1, "1", 1, 1)], "file_index bigint, object_id string, n_rows int, n_valid_points int")
    known = broker.filter_statistics(spark.createDataFrame([("1", "3")], "objectid string, n_passed_filter string"), "objectid")
    more = broker.filter_statistics(spark.createDataFrame([("1", "3"), ("77", "1")], "objectid string, n_passed_filter string"), "objectid")
    assert broker.require_matched(broker.efficiency_audit(files, known, 0, 3), known).count() == 4
    with pytest.raises(ValueError, match="77"):
        broker.require_matched(broker.efficiency_audit(files, more, 0, 3), more)
    with pytest.raises(PySparkException, match="77"):
        broker.guard_matched(broker.efficiency_audit(files, more, 0, 3), more).count()
