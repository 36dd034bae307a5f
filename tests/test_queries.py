"""Every registered query against its SQL twin, on the smallest tables."""

import pytest
from conftest import DATA

import __spark_entry__ as entry
import oracle
from runlens.plans import all_queries
from runlens.plans.registry import ORACLES

QUERIES = dict(all_queries())
# these need more rows than the smallest tables hold to give any row
SPARSE = {"chk11_budget", "win11_loop_collapse", "win11_loop_summaries", "agg14_loop_effect", "jn9_links"}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(DATA)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, name):
    found = oracle.differences(con, QUERIES[name](spark, DATA), ORACLES[name])
    if name in SPARSE:
        found = [x for x in found if x != "no rows"]
    assert not found, "\n".join(found)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql())
