"""A sample of registered queries against their SQL on the smallest tables; the full list is
checked by tests/oracle_check.py."""

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["dynamics_weekly", "season_keys", "percentile_kinds", "rolling_statistics", "choose_profile_buckets", "kpss_test", "label_by_windows", "stream_resample"]


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, con, name):
    line, ok = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], FOLDER)
    assert ok, line


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
