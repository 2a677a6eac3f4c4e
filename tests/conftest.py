import pytest

from checks.session import local_session
from popatlas.model import EventLog, World

SCHEMAS = {
    "geo": "geo_id bigint, ordinal bigint, name string, level string, parent_id bigint, "
    "lat double, lon double",
    "people": "person_id bigint, ordinal bigint, age int, sex string, geo_id bigint",
    "venues": "venue_id bigint, ordinal bigint, name string, venue_type string, geo_id bigint, "
    "parent_id bigint, lat double, lon double, is_residence boolean",
    "subsets": "venue_id bigint, subset_pos int, subset_name string, member_count bigint",
    "memberships": "venue_id bigint, subset_pos int, seq bigint, person_id bigint",
    "activities": "person_id bigint, seq bigint, activity string, venue_id bigint, "
    "subset_pos int",
}


@pytest.fixture(scope="session")
def spark():
    session = local_session(4)
    yield session
    session.stop()


@pytest.fixture
def build(spark):
    """A world from rows; tables not given are empty."""

    def make(max_depth=None, **rows):
        tables = {
            name: spark.createDataFrame(rows.get(name, []), schema)
            for name, schema in SCHEMAS.items()
        }
        return World(max_depth=max_depth, **tables)

    return make


@pytest.fixture
def build_log(spark):
    def make(events, venues=(), people=()):
        return EventLog(
            spark.createDataFrame(
                events, "event_type string, time double, person_id bigint, venue_id bigint"
            ),
            spark.createDataFrame(list(venues), "venue_id bigint, geo_id bigint"),
            spark.createDataFrame(list(people), "person_id bigint, geo_id bigint"),
        )

    return make


@pytest.fixture
def city(build):
    """A city with one borough, three people and two venues."""
    return build(
        geo=[(0, 0, "London", "city", -1, 51.5, -0.1), (1, 1, "Camden", "borough", 0, None, None)],
        people=[(0, 0, 30, "male", 0), (1, 1, 40, "female", 0), (2, 2, 5, "male", 1)],
        venues=[
            (0, 0, "Pub", "bar", 0, -1, 51.5, -0.1, False),
            (1, 1, "School", "education", 1, -1, None, None, False),
        ],
        subsets=[(0, 0, "regulars", 3)],
        memberships=[(0, 0, 0, 0), (0, 0, 1, 1), (0, 0, 2, 2)],
        activities=[(0, 0, "leisure", 0, 0)],
    )


def rows(df, *columns):
    """Sorted tuples of the given columns (all, without any)."""
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())
