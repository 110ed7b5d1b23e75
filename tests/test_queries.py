import check_queries
import pytest

import __spark_entry__ as entry
from tagloom.plans.oracles import ORACLES
from tagloom.plans.queries import registered

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check_queries.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_its_sql_twin(spark, con, name):
    problem = check_queries.compare(spark, con, FOLDER, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert problem is None, problem


def test_every_query_has_a_twin():
    assert set(ORACLES) == set(registered())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["image_id", "consistency"] and df.count() == 1500
