"""Every registered query runs; those with SQL give DuckDB's rows, the others have a named test of their numbers."""

import pathlib

import pytest

from quillon.plans import catalog
from tests.compare import connect, rows

#: Queries that SQL can't express, with the test that holds their operator against brute force or hand-made cases.
TESTED = {
    "k1_link": "test_linking.py::test_links_by_enumeration",
    "j43_match_nuclei": "test_pieces.py::test_nuclei_by_serial_choice",
    "k9_k10_p_values": "test_operators.py::test_t_tails_by_integration",
    "k8_fit_decay": "test_curves.py::test_decay_fit_by_plain_grid",
    "k7_bootstrap": "test_curves.py::test_bootstrap_by_its_draws",
    "k4_pcf": "test_curves.py::test_pair_correlation_by_counting",
    "k5_pcf_polygon": "test_curves.py::test_polygon_pair_correlation_by_counting",
    "k6_rdf_lsq": "test_curves.py::test_profile_by_least_squares",
    "k14_design_probes": "test_curves.py::test_probe_tiling_by_plain_python",
}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, sf, con, name):
    got = catalog.QUERIES[name](spark, sf).toPandas()
    if name in catalog.ORACLE:
        want = con.sql(catalog.ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got) and name in TESTED


def test_queries_without_sql_have_a_test_of_their_own():
    assert TESTED.keys() == catalog.QUERIES.keys() - catalog.ORACLE.keys()
    for name, where in TESTED.items():
        file, _, test = where.partition("::")
        assert f"def {test}(" in (pathlib.Path(__file__).parent / file).read_text(), name
