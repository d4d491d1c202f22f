"""Every registered query with SQL gives the same columns, types and rows as DuckDB."""

import oracle
import pytest

import __spark_entry__ as entry
from inkgauge.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_same_rows(spark, sf_dir, con, name):
    difference = oracle.difference(con, SQL[name], QUERIES[name](spark, sf_dir))
    assert difference is None, difference


def test_all_have_sql():
    assert set(QUERIES) == set(SQL)


def test_entry_is_not_empty(spark):
    df = entry.entry(spark)
    assert df.columns == ["source", "samples", "accuracy", "precision", "recall", "f1", "roc_auc"]
    assert df.count() > 0
