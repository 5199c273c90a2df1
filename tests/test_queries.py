"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from faultline import plans
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
ORACLES = plans.ORACLES


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_a_twin():
    assert set(ORACLES) == set(plans.QUERIES)
    assert set(plans.QUERIES) <= set(entry.queries())


def test_entry_has_rows_and_columns(spark):
    result = entry.entry(spark)
    assert result.columns == ["src_id", "winner", "request_count", "error_count"]
    assert result.count() > 0


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_equals_its_twin(spark, con, name):
    problem = compare(entry.queries()[name](spark, SF), con, ORACLES[name])
    assert problem is None, problem
