"""The data model: table schemas and the two bundles the operators take.

Identifiers are BIGINT throughout, so a world may outgrow 2^31 people or memberships.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Age classes, half-open [lower, upper), the last one unbounded.
AGE_LABELS = ("0-15", "16-24", "25-34", "35-49", "50-64", "65+")
AGE_BREAKS = (0, 16, 25, 35, 50, 65)

# Sex codes in stored worlds.
SEX_CODES = {0: "male", 1: "female", 2: "unknown"}

NO_PARENT = -1
UNKNOWN = "unknown"


# Required columns first, then those a stored world may leave out.
CORE_COLUMNS = {
    "geo_units": (
        {"geo_id": "bigint", "name": "string", "level": "string", "parent_id": "bigint"},
        {"ordinal": "bigint", "lat": "double", "lon": "double"},
    ),
    "people": (
        {"person_id": "bigint", "age": "int", "sex": "string", "geo_id": "bigint"},
        {"ordinal": "bigint"},
    ),
    "venues": (
        {"venue_id": "bigint", "name": "string", "venue_type": "string", "geo_id": "bigint"},
        {
            "ordinal": "bigint",
            "parent_id": "bigint",
            "lat": "double",
            "lon": "double",
            "is_residence": "boolean",
        },
    ),
    "subsets": (
        {
            "venue_id": "bigint",
            "subset_pos": "int",
            "subset_name": "string",
            "member_count": "bigint",
        },
        {},
    ),
    "memberships": (
        {"venue_id": "bigint", "subset_pos": "int", "seq": "bigint", "person_id": "bigint"},
        {},
    ),
    "activities": (
        {
            "person_id": "bigint",
            "seq": "bigint",
            "activity": "string",
            "venue_id": "bigint",
            "subset_pos": "int",
        },
        {},
    ),
}


def property_columns(df: DataFrame, table: str) -> list[str]:
    """Columns of a world table beyond its core ones: the dynamic properties."""
    required, optional = CORE_COLUMNS[table]
    return [c for c in df.columns if c not in required and c not in optional]


@dataclass
class World:
    """The world tables. With ``max_depth`` a deeper tree fails instead of being read."""

    geo: DataFrame
    people: DataFrame
    venues: DataFrame
    subsets: DataFrame
    memberships: DataFrame
    activities: DataFrame
    max_depth: int | None = None

    @cached_property
    def paths(self) -> DataFrame:
        """``geo_id, path``: the unit followed by its ancestors, nearest first.

        Nearly every operator climbs the tree, so the paths are worked out once and stored.
        """
        from popatlas.plans.paths import unit_paths
        from popatlas.plans.sizing import sized_broadcast
        from popatlas.plans.storage import stored

        paths = stored(unit_paths(self.geo, self.max_depth), "unit-paths")
        return sized_broadcast(paths, self.unit_count)

    @cached_property
    def closure_rows(self) -> int:
        """How many (unit, ancestor) pairs there are, units with themselves included."""
        from pyspark.sql import functions as F

        return self.paths.agg(F.sum(F.size("path").cast("bigint"))).first()[0] or 0

    @cached_property
    def activity_names(self) -> list[str] | None:
        """The activity names in use, or None when they are no short list."""
        from popatlas.plans.sets import short_list

        return short_list(self.activities, "activity")

    @cached_property
    def most_subsets(self) -> int | None:
        """The largest number of subsets of one venue, or None where a position repeats."""
        from pyspark.sql import functions as F

        per_place = self.subsets.groupBy("venue_id", "subset_pos").agg(F.count("*").alias("_rows"))
        per_venue = per_place.groupBy("venue_id").agg(
            F.count("*").alias("_places"), F.max("_rows").alias("_rows")
        )
        most, rows = per_venue.agg(F.max("_places"), F.max("_rows")).first()
        return None if (rows or 0) > 1 else most or 0

    @cached_property
    def unit_count(self) -> int:
        return self.geo.count()

    @cached_property
    def units(self) -> DataFrame:
        """The unit table, hinted for broadcast when its counted size allows."""
        from popatlas.plans.sizing import sized_broadcast

        return sized_broadcast(self.geo, self.unit_count)


@dataclass
class EventLog:
    """Events ``(event_type, time, person_id, venue_id, …)`` and the id → unit lookups.

    The entries that can locate an event are picked once, counted and stored. The events of
    a ``located`` log carry their ``geo_id`` already and need no lookup.
    """

    events: DataFrame
    venue_geo: DataFrame
    person_geo: DataFrame
    located: bool = False

    @cached_property
    def venue_lookup(self) -> DataFrame:
        """``venue_id, geo_id`` to join. Stored columns are nullable again; with that
        restated, all joins share one build side."""
        from popatlas.plans.storage import stored

        lookup = stored(_usable(self.venue_geo, "venue_id"), "venue-units")
        return lookup.where("venue_id IS NOT NULL AND geo_id IS NOT NULL")

    @cached_property
    def venue_count(self) -> int:
        return self.venue_lookup.count()

    @cached_property
    def venue_side(self) -> DataFrame:
        """:attr:`venue_lookup`, broadcast when small."""
        from popatlas.plans.sizing import sized_broadcast

        return sized_broadcast(self.venue_lookup, self.venue_count)

    @cached_property
    def person_lookup(self) -> DataFrame:
        """``person_id, geo_id`` to join."""
        from popatlas.plans.storage import stored

        return stored(_usable(self.person_geo, "person_id"), "person-units")

    @cached_property
    def person_count(self) -> int:
        return self.person_lookup.count()

    @cached_property
    def person_side(self) -> DataFrame:
        """:attr:`person_lookup`, broadcast when small."""
        from popatlas.plans.sizing import sized_broadcast

        return sized_broadcast(self.person_lookup, self.person_count)


def _usable(lookup: DataFrame, key: str) -> DataFrame:
    """Entries that can locate an event: neither id may be negative."""
    return lookup.select(key, "geo_id").where((F.col(key) >= 0) & (F.col("geo_id") >= 0))
