import pytest
from pyspark.sql import functions as F

from popatlas.operators import people, profile
from popatlas.operators import unit_stats as us
from tests.conftest import rows


def unit(i, name, level, parent, lat=1.0):
    return (i, i, name, level, parent, lat, 2.0)


def test_parent_sums_child_and_ages(build):
    w = build(
        geo=[unit(0, "England", "country", -1, None), unit(1, "Norfolk", "county", 0, 52.6)],
        people=[(i, i, 30, "M", 1) for i in range(100)],
    )
    stats = {r.geo_id: r for r in us.unit_stats(w).collect()}
    assert stats[0].population == stats[1].population == 100
    assert stats[0].age_distribution == {
        "0-15": 0, "16-24": 0, "25-34": 100, "35-49": 0, "50-64": 0, "65+": 0,
    }
    assert stats[0].sex_distribution == {"M": 100}
    features = us.level_features(w, us.unit_stats(w), "county").collect()
    assert [(f.name, f.population, f.lon, f.lat) for f in features] == [("Norfolk", 100, 2.0, 52.6)]
    assert us.level_features(w, us.unit_stats(w), "country").count() == 0


def test_city_statistics(city):
    stats = {r.geo_id: r for r in us.unit_stats(city).collect()}
    assert stats[0].venue_types == {"bar": 1, "education": 1}
    assert stats[0].activity_counts == {"leisure": 1}
    assert stats[1].activity_counts == {}
    assert stats[1].age_distribution["0-15"] == 1
    assert stats[0].children_count == 1


def test_negative_ages_are_in_no_class_and_bounds_are_half_open(build):
    w = build(
        geo=[unit(0, "a", "l", -1)],
        people=[(i, i, age, "x", 0) for i, age in enumerate([-1, 0, 15, 16, 64, 65, 120])],
    )
    counts = dict(rows(us.age_buckets(w), "age_label", "n"))
    assert counts == {"0-15": 2, "16-24": 1, "25-34": 0, "35-49": 0, "50-64": 1, "65+": 2}
    assert rows(us.direct_population(w)) == [(0, 7)]


def test_unpopulated_units(build):
    """Venues of a unit without people vanish unless all units are asked for."""
    w = build(
        geo=[unit(0, "top", "l", -1), unit(1, "full", "m", 0), unit(2, "bare", "m", 0)],
        people=[(0, 0, 20, "male", 1), (1, 1, 20, "male", 77)],
        venues=[(i, i, "v", "bar", g, -1, None, None, False) for i, g in enumerate([1, 2, 2])],
    )
    gated = {r.geo_id: r for r in us.unit_stats(w).collect()}
    assert [gated[g].venues_count for g in range(3)] == [1, 1, 0]
    assert [gated[g].has_stats for g in range(3)] == [True, True, False]
    assert gated[0].population == 1
    every = {r.geo_id: r for r in us.unit_stats(w, populated_only=False).collect()}
    assert [every[g].venues_count for g in range(3)] == [3, 1, 2]
    assert all(r.has_stats for r in every.values())
    assert rows(us.unit_detail(w, us.unit_stats(w)), "geo_id") == [(0,), (1,)]


def test_measure_lookup_defaults_to_zero(city):
    got = us.unit_stats(city).select(
        "geo_id", us.people_aged("0-15"), us.people_aged("nope"), us.venues_of_type("bar")
    )
    assert rows(got) == [(0, 1, 0, 1), (1, 1, 0, 0)]


def test_same_name_units_are_kept_apart(build):
    w = build(
        geo=[unit(0, "same", "l", -1), unit(1, "same", "l", -1)],
        people=[(0, 0, 20, "male", 0), (1, 1, 20, "male", 1), (2, 2, 20, "male", 1)],
    )
    assert rows(us.unit_stats(w), "geo_id", "population") == [(0, 1), (1, 2)]


def test_shares_and_zero_denominator(spark):
    dist = spark.createDataFrame(
        [(0, "a", 3), (0, "b", 1), (1, "a", 0)], "geo_id bigint, category string, n bigint"
    )
    assert rows(us.shares(dist), "category", "percent") == [("a", 75.0), ("b", 25.0)]
    population = spark.createDataFrame([(0, 10), (1, 0)], "geo_id bigint, total bigint")
    assert rows(us.shares(dist, population), "category", "percent") == [("a", 30.0), ("b", 10.0)]


def test_top_breakdown(spark):
    dist = spark.createDataFrame(
        [(0, "a", 2), (0, "b", 8), (0, "c", 2), (0, "d", 1)],
        "geo_id bigint, category string, n bigint",
    )
    kept = us.top_breakdown(dist, n=2).orderBy("place").collect()
    assert [(r.category, r.relative) for r in kept] == [("b", 100.0), ("a", 25.0)]
    by_name = us.top_breakdown(dist, n=2, by="name", desc=True).orderBy("place").collect()
    assert [(r.category, r.relative) for r in by_name] == [("d", 50.0), ("c", 100.0)]


def test_many_activity_names_give_the_same_counts(city, build, monkeypatch):
    """Past the mask size the counts come from distinct pairs."""
    w = build(
        geo=[unit(0, "top", "l", -1)],
        people=[(i, i, 20, "male", 0) for i in range(3)],
        activities=[(i % 3, i, f"a{i % 5}", 0, 0) for i in range(30)]
        + [(0, 30, None, 0, 0), (2, 31, None, 0, 0)],
    )
    masked, summary = rows(us.activity_counts(w)), rows(profile.activity_summary(w))
    monkeypatch.setattr("popatlas.plans.sets.MAX_NAMES", 2)
    other = type(w)(w.geo, w.people, w.venues, w.subsets, w.memberships, w.activities)
    assert other.activity_names is None
    assert rows(profile.activity_summary(other)) == summary
    assert rows(us.activity_counts(other)) == masked == [(0, f"a{i}", 3) for i in range(5)]


def test_detail_with_display_names(city, spark):
    names = spark.createDataFrame([("Camden", "Camden Town")], "id string, display_name string")
    detail = us.unit_detail(city, us.unit_stats(city), names)
    assert rows(detail.select("geo_id", F.coalesce("display_name", F.lit("-")))) == [
        (0, "-"),
        (1, "Camden Town"),
    ]


@pytest.mark.parametrize("populated_only", [True, False])
def test_root_population_is_people_with_a_known_unit(city, populated_only):
    stats = us.unit_stats(city, populated_only)
    assert stats.where("geo_id = 0").first().population == city.people.count()


def test_missing_labels_count_as_unknown(build):
    """One NULL sex, venue type and activity each; stored unknowns share their entry."""
    w = build(
        geo=[unit(0, "top", "l", -1), unit(1, "sub", "m", 0)],
        people=[(0, 0, 20, None, 1), (1, 1, 20, "unknown", 1), (2, 2, None, "male", 0)],
        venues=[
            (0, 0, "a", None, 1, -1, None, None, False),
            (1, 1, "b", "unknown", 0, -1, None, None, False),
            (2, 2, "c", "bar", 0, -1, None, None, False),
        ],
        activities=[(0, 0, None, 0, 0), (0, 1, "unknown", 1, 0), (1, 0, "leisure", 2, 0)],
    )
    stats = {r.geo_id: r for r in us.unit_stats(w).collect()}
    assert stats[0].sex_distribution == {"male": 1, "unknown": 2}
    assert stats[0].venue_types == {"bar": 1, "unknown": 2}
    assert stats[1].venue_types == {"unknown": 1}
    assert stats[0].activity_counts == {"leisure": 1, "unknown": 1}
    assert stats[0].population == 3 and sum(stats[0].age_distribution.values()) == 2
    assert us.level_features(w, us.unit_stats(w)).count() == 2
    detail = {r.geo_id: r for r in us.unit_detail(w, us.unit_stats(w)).collect()}
    assert detail[1].sex_distribution == {"unknown": 2}
    maps = {r.person_id: r.activity_map for r in people.activity_map(w).collect()}
    assert set(maps[0]) == {"unknown"} and set(maps[1]) == {"leisure"}
    assert [v.venue_id for v in maps[0]["unknown"]["unknown"]] == [0, 1]
    assert [v.venue_id for v in maps[1]["leisure"]["bar"]] == [2]


def test_all_labels_missing(build):
    w = build(
        geo=[unit(0, "top", "l", -1)],
        people=[(0, 0, None, None, 0)],
        venues=[(0, 0, None, None, 0, -1, None, None, None)],
        activities=[(0, 0, None, 0, 0)],
    )
    r = us.unit_stats(w).first()
    assert r.sex_distribution == {"unknown": 1} and r.venue_types == {"unknown": 1}
    assert r.activity_counts == {}
