"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
import check
from workload.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return check.connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, sf, name):
    state, note = check.compare(spark, con, sf, name)
    assert state == "ok" and "types" not in note, note


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["rubric", "kind", "value", "n_pairs"] and df.count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
