import pytest
from conftest import rows

import __spark_entry__ as driver
from paperloom.plans.oracles import ORACLES
from paperloom.plans.registry import QUERIES
from tools import check

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    ok, detail = check.compare(spark, con, SF, name)
    assert ok, detail


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(driver.queries())
    assert set(ORACLES) <= set(driver.oracle_sql())


def test_entry(spark):
    assert len(rows(driver.entry(spark))) == 10
