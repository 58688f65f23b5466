"""Every registered query against SQL on an independent engine, at the smallest scale.

Small queries spend their time waiting for each other's steps, so a few run side by side. SOME_QUERIES=1 takes one of each kind.
"""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest

import __spark_entry__ as entry
from skyhue.plans import catalog
from tests.oracle import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SOME = (
    "lightcurve_scan", "identifier_forms", "attenuation", "latitude_selection", "nested_subset_ranks", "interpolate_log_time", "interpolate_at_visits",
    "peak_search", "greedy_colour_pairs", "stagger_fixed_step", "envelope_rules", "permanent_exits", "population_overlap", "selection_criteria",
    "identification_intervals", "shape_stability", "smoothed_parameter_grid", "latitude_cut_scan", "plateau_assessment", "cone_search_visits",
    "stratified_field_sample", "snia_broker_export", "efficiency_audit",
)
NAMES = SOME if os.environ.get("SOME_QUERIES") else sorted(catalog.QUERIES)
MAY_BE_EMPTY = {"no rows"}
TOGETHER = 4


@pytest.fixture(scope="module")
def outcomes(spark, request):
    """Comparisons of the queries that are asked for, begun in the order in which their tests come."""
    engine = connect(SF)

    def problems(name):
        return compare(catalog.QUERIES[name](spark, SF), engine.cursor(), catalog.SQL[name])

    wanted = [x.callspec.params["name"] for x in request.session.items if getattr(x, "originalname", "") == "test_query" and x.module is request.module]
    with ThreadPoolExecutor(TOGETHER) as pool:
        yield {name: pool.submit(problems, name) for name in wanted}
        pool.shutdown(cancel_futures=True)


@pytest.mark.parametrize("name", NAMES)
def test_query(outcomes, name):
    assert not [p for p in outcomes[name].result() if p not in MAY_BE_EMPTY]


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
