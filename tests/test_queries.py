"""Every named query on the smallest tables, next to its SQL counterpart."""

import pytest

import __spark_entry__ as entry
from guichet.plans import registered
from tests.check_queries import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(registered.queries()))
def test_query_matches_its_sql(spark, name):
    verdict = compare(spark, SF, name)
    assert verdict.startswith(("ok", "rows-only")), verdict


def test_entry_runs_and_oracles_have_queries(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
