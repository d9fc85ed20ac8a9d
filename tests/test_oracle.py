"""Every registered query beside its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tools.check_oracle import compare, connect


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, sf, duck, name):
    good, note = compare(spark, duck, sf, name)
    assert good, note


def test_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "product_id", "score", "rank"]
