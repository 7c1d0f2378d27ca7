"""Every query against the SQL that is to give the same rows."""

import pytest

import __spark_entry__ as entry
from graphloom import catalogue
from tests.oracle import both

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_same_rows(spark, name):
    assert name in catalogue.ORACLE_SQL
    (cols, ours), (names, theirs) = both(spark, SF, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])
    assert cols == names
    assert ours == theirs


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
