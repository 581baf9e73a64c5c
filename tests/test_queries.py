"""Every named query against its SQL."""

import pytest
from oracle import compare, database

from tidemark.plans import catalog


@pytest.fixture(scope="module")
def db(data):
    return database(data)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_rows_equal_sql(spark, data, db, name):
    assert compare(catalog.queries()[name](spark, data), catalog.oracle_sql()[name], db) == ""
