"""Every registered query against its SQL twin, and the shape of its plan."""

import re

import pytest

from checks.compare import connect, difference
from checks.queries import ORACLES, QUERIES
from checks import world as check_world
from popatlas.plans import ranking, sizing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", QUERIES)
def test_matches_sql_and_stays_distributed(spark, duck, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|EvalPython|InPandas", plan)
    if name in ORACLES:
        assert difference(df, duck, ORACLES[name]) in (None, "no rows")
    else:
        assert df.count() > 0


LARGE = """geo_closure geo_preorder geo_family unit_stats_categories people_profile venue_profile
    venue_member_pages unit_venue_pages locate_people locate_venues size_budget people_page
    located_events event_frames offset_lists first_people people_by_hash unit_venue_page""".split()


@pytest.fixture
def nothing_fits(spark, monkeypatch):
    """The plans of a world too large to broadcast anything, cut into tiny slices."""
    monkeypatch.setattr(sizing, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(ranking, "BUCKET_WIDTH", 16)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    check_world.world.cache_clear()
    check_world.event_log.cache_clear()
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    check_world.world.cache_clear()
    check_world.event_log.cache_clear()


@pytest.mark.parametrize("name", LARGE)
def test_same_answers_without_broadcast(spark, duck, nothing_fits, name):
    assert difference(QUERIES[name](spark, SF), duck, ORACLES[name]) is None


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
