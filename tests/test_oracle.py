"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check import compare

from .conftest import SMALL


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    ok, note = compare(spark, duck, name, SMALL)
    assert ok or (name not in entry.oracle_sql() and note.startswith("0 rows")), note


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() >= 0


def test_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
