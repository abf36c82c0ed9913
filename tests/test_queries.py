"""Every registered query against its SQL, over the smallest tables."""

import pytest

from lorefield.plans import registry

from .compare import differences, views

SF = "/root/testdata/sf0.001"
ROWS_ONLY = sorted(set(registry.queries()) - set(registry.oracle_sql()))


@pytest.fixture(scope="module")
def con():
    return views(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, con, name):
    assert differences(spark, con, registry.queries()[name], registry.oracle_sql()[name], SF) == ""


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).columns
