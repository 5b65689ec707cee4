"""Every registered query against its SQL."""

import pytest

from tests import compare

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
NEEDS_ALL_MODELS = {"pivot_predictions", "scorecard", "accuracy_tally", "missing_sources"}


def test_registry_is_complete():
    without_sql = set(compare.driver.queries()) - set(compare.driver.oracle_sql())
    assert set(compare.driver.oracle_sql()) <= set(compare.driver.queries())
    assert all(name.startswith("op") or name == "pipeline" for name in without_sql)


@pytest.mark.parametrize("name", list(compare.driver.oracle_sql()))
def test_query_equals_sql(spark, name):
    sf_dir = MEDIUM if name in NEEDS_ALL_MODELS else SMALL
    assert compare.compare(spark, compare.duck(sf_dir), name, sf_dir) == []


def test_entry(spark):
    df = compare.driver.entry(spark)
    assert "inst_hash" in df.columns and not df.isEmpty()
