"""Venue, person and locate operators."""

import pytest

from popatlas.functions.classify import utm_epsg, utm_zone_number
from popatlas.operators import extent, locate, people, profile, venues
from popatlas.plans import nesting
from pyspark.sql import functions as F
from tests.conftest import rows


@pytest.fixture
def club(build):
    """A parent venue with two children; members are stored out of id order."""
    return build(
        geo=[(100, 0, "North", "area", -1, 1.0, 2.0)],
        people=[(2, 0, 25, "male", 100), (0, 1, 35, "female", 200), (1, 2, 45, "male", 100)],
        venues=[
            (0, 0, "Block", "building", 100, -1, 1.0, 2.0, False),
            (1, 1, "Flat 1", "household", 100, 0, None, None, True),
            (2, 2, "Flat 2", "household", 100, 0, None, None, True),
            (3, 3, "Lost", "household", 100, 77, None, None, True),
        ],
        subsets=[(1, 0, "adults", 2), (1, 1, "kids", 0), (2, 0, "adults", 1), (0, 0, "staff", 5)],
        memberships=[(1, 0, 0, 0), (1, 0, 1, 2), (2, 0, 0, 1)],
        activities=[
            (2, 0, "primary_activity", 2, 0), (2, 1, "residence", 1, 1),
            (2, 2, "primary_activity", 0, 0), (1, 0, "leisure", 3, 4),
        ],
    )


def test_members_in_stored_order_with_unit_or_id(club):
    got = venues.venue_members(club, venue=1, subset="adults").orderBy("seq").collect()
    assert [(m.person_id, m.age, m.sex, m.unit) for m in got] == [
        (0, 35, "female", "200"),
        (2, 25, "male", "North"),
    ]


def test_member_pages_per_subset(club):
    second = venues.venue_members(club, page=2, per_page=1)
    assert rows(second, "venue_id", "person_id") == [(1, 2)]
    lists = venues.member_lists(club, venue=1, page=9, per_page=1)
    assert rows(lists, "subset_name", "total", "total_pages") == [("adults", 2, 2), ("kids", 0, 1)]


def test_venue_detail(club):
    detail = venues.venue_detail(club, 1).first()
    assert [tuple(s) for s in detail.subsets] == [("adults", 2), ("kids", 0)]
    assert detail.coordinates is None and detail.unit == "North"
    assert venues.venue_detail(club, 99).count() == 0
    assert venues.venue_detail(club, 3).first().subsets == []


def test_venue_parents_and_children(club):
    assert rows(venues.venue_parents(club).where("parent_id IS NOT NULL"), "venue_id") == [
        (1,),
        (2,),
    ]
    totals = dict((v, (c, m)) for v, c, m in rows(venues.venue_child_totals(club)))
    assert totals == {0: (2, 3), 1: (0, 0), 2: (0, 0), 3: (0, 0)}
    assert rows(venues.venue_children(club, 0, 2, 1), "venue_id") == [(2,)]
    assert venues.venue_children(club, 1, 1, 5).count() == 0


def test_unit_listing_is_top_level_only(club, city):
    assert rows(venues.unit_venues(club, 100, page=1), "venue_id", "child_count") == [(0, 2)]
    assert rows(venues.unit_venues(city, 0, page=1), "name") == [("Pub",), ("School",)]
    assert rows(venues.unit_venues(city, 0, "bar", 1), "name") == [("Pub",)]
    assert rows(venues.unit_venues(city, 0, page=2, per_page=1), "name", "page") == [("School", 2)]
    assert rows(venues.venue_features(city), "name", "num_members") == [("Pub", 3)]


def test_unit_people(city):
    both = people.unit_people(city, 0, descendants=True, page=2, per_page=2)
    assert rows(both, "person_id", "rank", "page") == [(2, 2, 2)]
    assert rows(people.unit_people(city, 0, page=1), "person_id") == [(0,), (1,)]
    whole = people.unit_people(city, descendants=True, per_page=2)
    for unit in (0, 1):
        for page in (1, 2):
            one = people.unit_people(city, unit, True, page, 2)
            tile = whole.where(f"ancestor_id = {unit} AND page = {page}")
            assert rows(one, "person_id", "rank") == rows(tile, "person_id", "rank")
    assert rows(people.first_people(city, 1), "person_id") == [(0,), (2,)]


def test_person_profile(club):
    got = {r.person_id: r for r in people.person_profile(club).collect()}
    assert got[2].home_unit.name == "North" and got[0].home_unit is None
    assert people.person_profile(club, [999]).count() == 0
    assert people.person_profile(club, [1, 2]).count() == 2


def test_person_activities(club):
    got = rows(people.person_activities(club), "person_id", "seq", "venue_name", "subset_name")
    assert got == [
        (1, 0, "Lost", "4"),
        (2, 0, "Flat 2", "adults"),
        (2, 1, "Flat 1", "kids"),
        (2, 2, "Block", "staff"),
    ]
    assert people.person_activities(club, [0]).count() == 0


@pytest.mark.parametrize("part_size", [1, 2, 100])
def test_activity_map_in_parts(club, part_size):
    got = people.activity_map(club, [2], part_size).orderBy("part").collect()
    assert len(got) == -(-3 // part_size)
    visits = [
        (activity, kind, v.venue_name)
        for r in got
        for activity, kinds in r.activity_map.items()
        for kind, listed in kinds.items()
        for v in listed
    ]
    assert sorted(visits) == [
        ("primary_activity", "building", "Block"),
        ("primary_activity", "household", "Flat 2"),
        ("residence", "household", "Flat 1"),
    ]


def test_primary_activity_and_types(club):
    assert dict(rows(people.primary_activity(club), "person_id", "venue_name")) == {
        0: None, 1: None, 2: "Flat 2",
    }
    assert rows(people.activity_types(club)) == [
        (1, ["leisure"]),
        (2, ["primary_activity", "residence"]),
    ]


def test_nested_lists_continue_in_parts(spark):
    df = spark.range(7).selectExpr("1 AS k", "id AS pos", "id * id AS v")
    got = nesting.nest(df, ["k"], "pos", ["v"], "items", part_size=3).orderBy("part").collect()
    assert [[i.v for i in r["items"]] for r in got] == [[0, 1, 4], [9, 16, 25], [36]]


@pytest.mark.parametrize("per_page", [1, 2, 50])
def test_located_page_contains_the_person(city, per_page):
    pages = {
        (r.ancestor_id, r.person_id): r.page
        for r in people.unit_people(city, descendants=True, per_page=per_page).collect()
    }
    homes = dict(rows(city.people, "person_id", "geo_id"))
    for r in locate.locate_people(city, per_page).collect():
        assert r.page == pages[(homes[r.person_id], r.person_id)]


def test_locate_without_unit_and_for_children(club):
    got = {r.person_id: (r.unit, r.page) for r in locate.locate_people(club, 1).collect()}
    assert got == {2: ("North", 1), 0: (None, 1), 1: ("North", 2)}
    found = {r.venue_id: r.page for r in locate.locate_venues(club, 1).collect()}
    assert found == {0: 1, 1: 1, 2: 1, 3: 1}


def test_each_fact_is_located_once_whatever_its_id(build):
    """Repeated and missing ids, unknown units, missing orders and types: one row each."""
    w = build(
        geo=[(0, 0, "top", "l", -1, 1.0, 2.0), (1, 1, "sub", "m", 0, 1.0, 2.0)],
        people=[(5, 0, 1, "m", 1), (5, 1, 1, "m", 1), (None, 2, 1, "m", 0), (6, 3, 1, "m", 77),
                (7, 4, 1, "m", None), (8, None, 1, "m", 0)],
        venues=[(1, 0, "a", None, 0, -1, None, None, None), (1, 1, "b", None, 0, -1, None, None, None),
                (2, 2, "c", None, 0, 1, None, None, None), (3, 3, "d", "bar", None, -1, None, None, None),
                (None, 4, "e", "bar", 1, -1, None, None, None)],
    )
    got = sorted(map(tuple, locate.locate_people(w, 1).collect()), key=str)
    assert got == sorted([(5, "sub", 1), (5, "sub", 2), (None, "top", 4), (6, None, 1), (7, None, 1), (8, "top", 1)], key=str)
    got = sorted(map(tuple, locate.locate_venues(w, 1).collect()), key=str)
    want = [(1, "top", None, 1), (1, "top", None, 2), (2, "top", None, 1), (3, None, "bar", 1), (None, "sub", "bar", 1)]
    assert got == sorted(want, key=str)


def test_locating_scans_the_facts_once(spark):
    from checks import world as check_world

    w = check_world.world(spark, "/root/testdata/sf0.001")
    for located, table in ((locate.locate_people(w), "customer"), (locate.locate_venues(w), "supplier")):
        plan = located._jdf.queryExecution().executedPlan().toString()
        assert plan.count(f"/{table}.parquet") == 1


@pytest.mark.parametrize("listed", [0, 64])
def test_activities_with_names_listed_or_joined(club, monkeypatch, listed):
    monkeypatch.setattr(people, "LISTED_SUBSETS", listed)
    got = rows(people.person_activities(club), "person_id", "seq", "venue_id", "subset_name")
    assert got == [(1, 0, 3, "4"), (2, 0, 2, "adults"), (2, 1, 1, "kids"), (2, 2, 0, "staff")]


def test_repeated_subset_positions_list_every_name(club, spark):
    more = club.subsets.unionByName(spark.createDataFrame([(1, 1, "again", 1)], club.subsets.schema))
    w = type(club)(club.geo, club.people, club.venues, more, club.memberships, club.activities)
    assert club.most_subsets == 2 and w.most_subsets is None
    got = rows(people.person_activities(w, [2]).where("seq = 1"), "subset_name")
    assert got == [("again",), ("kids",)]


def test_activities_stored_in_buckets_are_not_shuffled(club, spark, tmp_path):
    from popatlas.sources.world import read_bucketed_world, write_bucketed_world

    write_bucketed_world(club, str(tmp_path / "w"), 4)
    w = read_bucketed_world(spark, str(tmp_path / "w"))
    assert rows(people.person_activities(w)) == rows(people.person_activities(club))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = people.person_activities(w)._jdf.queryExecution().executedPlan().toString()
        plain = people.person_activities(club)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    lines = plan.splitlines()
    (at,) = [i for i, line in enumerate(lines) if "FileScan" in line and "activit" in line and "seq" in line]
    # Upwards from the scan of the activities to the join: no exchange.
    join = max(i for i in range(at) if "SortMergeJoin" in lines[i])
    assert not any("Exchange" in line for line in lines[join:at])
    assert "Bucketed: true" in lines[at] and "Exchange" in plain
    again = read_bucketed_world(spark, str(tmp_path / "w"))
    assert rows(again.subsets) == rows(club.subsets)


def test_full_record(club):
    got = {r.person_id: r for r in people.person_record(club).collect()}
    assert set(got) == {0, 1, 2} and got[0].activity_map == {} and got[0].home_unit is None
    assert got[2].age == 25 and set(got[2].activity_map) == {"primary_activity", "residence"}
    assert got[2].part == got[0].part == 0
    assert [r.person_id for r in people.person_record(club, [1]).collect()] == [1]


def test_world_profile(club, build):
    summary = profile.population_summary(club).first()
    assert (summary.total_people, summary.mean_age, summary.min_age) == (3, 35.0, 25)
    empty = profile.population_summary(build()).first()
    assert empty.total_people == 0 and empty.mean_age is None
    sizes = profile.subset_sizes(club).first()
    assert (sizes.mean, sizes["median"], sizes.total_subsets, sizes.non_empty_subsets) == (
        2.67, 2.0, 4, 3,
    )
    activity = profile.activity_summary(club).first()
    assert activity.active_people == 2 and activity.mean_activity_types == 1.5
    assert activity.mean_assignments == 1.33
    assert activity.mean_contacts_estimate == 2.2
    assert rows(profile.people_per_activity(club, ["leisure", "none"])) == [
        ("leisure", 1),
        ("none", 0),
    ]
    households = profile.household_sizes(club)
    assert rows(households) == [(0, 1), (1, 1), (2, 1)]
    assert rows(profile.household_summary(households)) == [(3, 1.0)]
    assert rows(profile.household_summary(profile.household_sizes(club, "igloo"))) == [(0, 0.0)]
    assert rows(profile.world_totals(club)) == [(1, 1, 3, 4, 2)]


@pytest.mark.parametrize(
    "lon, lat, zone, epsg",
    [(-0.1, 51.5, 30, 32630), (3, -1, 31, 32731), (-180, 0, 1, 32601), (180, 1, 1, 32601)],
)
def test_utm(spark, lon, lat, zone, epsg):
    df = spark.createDataFrame([(float(lon), float(lat))], "lon double, lat double")
    got = df.select(utm_zone_number(F.col("lon")).alias("zone"), "lat")
    assert rows(got.select("zone", utm_epsg(F.col("zone"), F.col("lat")))) == [(zone, epsg)]


def test_extent_of_placed_units(city, build):
    assert rows(extent.extent(city.geo)) == [("city", 51.5, 51.5, -0.1, -0.1)]
    assert rows(extent.utm_zone(city.geo)) == [(30, 32630)]
    assert extent.utm_zone(build().geo).count() == 0
