import json

import pytest
from pyspark.sql import functions as F

from popatlas.functions.decode import sex_label
from popatlas.operators import hierarchy
from popatlas.sources import events, geojson, lookups, names, world
from popatlas.sources.offsets import expand_offsets
from tests.conftest import SCHEMAS, rows


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv"])
def test_world_round_trip(spark, city, tmp_path, fmt):
    world.write_world(city, str(tmp_path), fmt)
    back = world.read_world(spark, str(tmp_path), fmt)
    for name in SCHEMAS:
        given, read = getattr(city, name), getattr(back, name)
        columns = [c for c in given.columns]
        as_text = [F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in columns]
        assert rows(read.select(as_text)) == rows(given.select(as_text)), name
    assert hierarchy.closure(back).count() == 3


def test_optional_columns_are_filled_and_required_ones_demanded(spark, tmp_path):
    path = str(tmp_path / "venues")
    spark.createDataFrame(
        [(4, "Pub", "bar", 0, float("nan"), 2.0, 30)],
        "venue_id int, name string, venue_type string, geo_id int, lat double, lon double, "
        "capacity int",
    ).write.parquet(path)
    got = world.read_table(spark, path, "venues").first().asDict()
    assert got["lat"] is None and got["lon"] == 2.0 and got["is_residence"] is None
    assert got["parent_id"] == -1 and got["ordinal"] == 4 and got["capacity"] == 30
    with pytest.raises(ValueError, match="person_id, age"):
        world.read_table(spark, path, "people")


def test_registry_decode(spark):
    registry = spark.createDataFrame([(0, "city"), (1, "borough")], "code int, label string")
    coded = spark.createDataFrame([(0,), (1,), (9,), (None,)], "c int")
    got = rows(lookups.decode(coded, "c", registry, "level").select("level"))
    assert got == [("borough",), ("city",), ("unknown",), ("unknown",)]


def test_sex_codes(spark):
    codes = spark.createDataFrame([(c,) for c in (0, 1, 2, -1, 9, None)], "c int")
    got = [r[0] for r in codes.select(sex_label(F.col("c"))).collect()]
    assert got == ["male", "female", "unknown", "unknown", "unknown", "unknown"]


@pytest.mark.parametrize("block", [1, 4, 1 << 16])
def test_offset_lists(spark, block):
    """Empty lists anywhere, one list with most values, the last one open-ended."""
    lists = {"a": [], "b": [5, 6], "c": [], "d": list(range(40)), "e": [], "f": [1], "g": []}
    starts, values = [], []
    for i, (owner, members) in enumerate(lists.items()):
        starts.append((i, owner, len(values)))
        values += members
    got = expand_offsets(
        spark.createDataFrame(starts, "idx bigint, owner string, start bigint"),
        spark.createDataFrame(list(enumerate(values)), "pos bigint, value bigint"),
        block,
    )
    want = [(o, s, v) for o, members in lists.items() for s, v in enumerate(members)]
    assert rows(got, "owner", "seq", "value") == sorted(want)


def test_properties_fold_without_nulls_and_exclusions(spark):
    df = spark.createDataFrame(
        [(1, "x", None, 7), (2, None, None, 8)], "id int, a string, b string, secret int"
    )
    got = world.with_properties(df, ["a", "b", "secret"], exclude=["secret"])
    assert {r.id: r.properties for r in got.collect()} == {1: {"a": "x"}, 2: {}}


def test_properties_by_type(spark):
    df = spark.createDataFrame(
        [(1, "school", "5", "9"), (2, "bar", "5", "9"), (3, "park", "5", "9")],
        "id int, venue_type string, grade string, stars string",
    )
    sets = {"school": ["grade"], "bar": ["stars", "grade"]}
    got = world.with_typed_properties(df, sets, "venue_type", exclude=["secret"])
    assert {r.id: r.properties for r in got.collect()} == {
        1: {"grade": "5"},
        2: {"grade": "5", "stars": "9"},
        3: {},
    }


def test_display_names(spark, city, tmp_path):
    path = tmp_path / "names.csv"
    path.write_text("ID,Name\n Camden ,Old\nCamden, Camden Town \n ,blank\nParis,Paris\n")
    shown = names.read_display_names(spark, str(path), "ID", "Name")
    assert rows(shown) == [("Camden", "Camden Town"), ("Paris", "Paris")]
    got = names.with_display_names(city.geo, shown).orderBy("geo_id").collect()
    assert [r.display_name for r in got] == [None, "Camden Town"]


def test_last_lookup_row_wins(spark):
    df = spark.createDataFrame(
        [(1, 10, 0), (1, 11, 2), (1, 12, 1), (2, 20, 0)], "id int, geo_id int, o int"
    )
    assert rows(lookups.latest_lookup(df, "id", "geo_id", "o")) == [(1, 11), (2, 20)]


def test_events_of_different_shapes(spark, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([(1.5, 7, 3)], "time double, person_id int, venue_id int").write.parquet(
        f"{path}/event_type=infections"
    )
    spark.createDataFrame([(2.5, 8)], "time double, person_id int").write.parquet(
        f"{path}/event_type=deaths"
    )
    spark.createDataFrame(
        [(3.5, 9, 4)], "time double, person_id int, hospital_id int"
    ).write.parquet(f"{path}/event_type=admissions")
    read = events.read_events(spark, path)
    got = sorted(read.select("event_type", "time", "venue_id").collect())
    assert [tuple(r) for r in got] == [
        ("admissions", 3.5, 4), ("deaths", 2.5, None), ("infections", 1.5, 3),
    ]
    one = read.where("event_type = 'deaths' AND time <= 2")
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(event_type" in plan
    assert "LessThanOrEqual(time,2.0)" in plan


def test_missing_event_path_gives_no_events(spark, tmp_path):
    missing = events.read_events(spark, str(tmp_path / "none"))
    assert missing.count() == 0 and missing.columns == list(events.EVENT_COLUMNS)


def test_stored_events_are_ordered_within_files(spark, build_log, tmp_path):
    log = build_log([("a", float(9 - i), i, 0) for i in range(9)])
    events.write_events(log.events, str(tmp_path / "e"))
    assert rows(events.read_events(spark, str(tmp_path / "e"))) == rows(log.events)


def test_geojson_lines(spark, city, tmp_path):
    geojson.write_geojson(city.geo, str(tmp_path / "g"), ["geo_id", "name"], by=["level"])
    lines = [r[0] for r in spark.read.text(str(tmp_path / "g" / "level=city")).collect()]
    assert [json.loads(x) for x in lines] == [
        {
            "type": "Feature",
            "properties": {"geo_id": 0, "name": "London"},
            "geometry": {"type": "Point", "coordinates": [-0.1, 51.5]},
        }
    ]
    assert not (tmp_path / "g" / "level=borough").exists()


def test_null_parents_are_roots(spark):
    units = spark.createDataFrame(
        [(0, "top", "l", None), (1, "below", "l", 0)],
        "geo_id bigint, name string, level string, parent_id bigint",
    )
    assert [r.parent_id for r in world.conform(units, "geo_units").orderBy("geo_id").collect()] == [-1, 0]
