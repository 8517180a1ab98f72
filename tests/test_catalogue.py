import pytest

import __spark_entry__ as entry
from gridloom.plans import catalogue
from tests.compare import connection, difference

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(DATA)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, con, name):
    assert difference(catalogue.QUERIES[name](spark, DATA), con, catalogue.ORACLES[name]) is None


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


def test_entry(spark):
    assert entry.entry(spark).columns == ["baseline", "channel", "flag"]
    assert set(catalogue.QUERIES) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark):
    from gridloom.operators import basic
    from gridloom.plans.compose import explained
    from gridloom.sources import grids

    lines = grids.table(spark, DATA, "lineitem").selectExpr("cast(l_orderkey as int) row", "l_linenumber col", "l_quantity value")
    plan = explained(basic.region(lines, {"col": (2, 4)}, {"row": 10**6, "col": 8}))
    assert "GreaterThanOrEqual(l_linenumber,2)" in plan
    assert "l_comment" not in plan
    flagged = explained(catalogue.QUERIES["rfi_flag_simple"](spark, DATA))
    assert flagged.count("Exchange (") <= 2  # the node and its detail: one exchange for background and noise
