"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle import DATA, compare, connect

from rankfold.plans import REGISTRY, SQL

SF = DATA / "sf0.001"
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(str(SF))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    assert compare(spark, duck, REGISTRY[name], SQL[name], str(SF)) is None


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - set(SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert REGISTRY[name](spark, str(SF)).count() > 0
