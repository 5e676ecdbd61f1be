"""Every query of the catalogue against its SQL, on the smallest data."""

import pytest

from cairn.plans import catalog
from tests.comparing import DATA, assert_same

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    assert_same(catalog.queries()[name](spark, DATA), SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_runs_without_sql(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0


def test_entry_finds_documents(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_sql_has_a_query():
    assert set(SQL) <= set(catalog.queries())
