"""Every registered query of the library against DuckDB on the smallest tables."""

import pytest
from oracle import compare

from postmill.plans import registry as catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, name):
    compare(catalog.QUERIES[name](spark, FOLDER), catalog.SQL[name], FOLDER)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)
