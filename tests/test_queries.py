"""Every registered query of the engine against its SQL."""

import __spark_entry__
import pytest

from wayfarer.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_rows_as_sql(spark, sf_dir, same, name):
    same(catalogue.QUERIES[name](spark, sf_dir), catalogue.SQL[name])


def test_entry_has_a_schema(spark):
    assert __spark_entry__.entry(spark).columns


def test_all_queries_are_listed():
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
