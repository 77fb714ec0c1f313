"""Every registered query against its SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, con, name):
    got, want, missing, extra = compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])
    assert (got, missing, extra) == (want, [], [])


@pytest.mark.parametrize("name", ["resolve_chain_priority", "synth_overrides", "callers_d2"])
def test_hot_keys_change_nothing(spark, con, name):
    """The paths for hot keys and large frontiers, forced by low limits."""
    spark.conf.set("spark.codeloom.hotKeyRows", "100")
    spark.conf.set("spark.codeloom.broadcastRows", "0")
    try:
        got, want, missing, extra = compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])
    finally:
        spark.conf.unset("spark.codeloom.hotKeyRows")
        spark.conf.unset("spark.codeloom.broadcastRows")
    assert (got, missing, extra) == (want, [], [])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
