"""People, their activities and unit listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from popatlas.functions.decode import has_coordinates, text_or_id
from popatlas.functions.paging import DEFAULT_PER_PAGE, clamp_page
from popatlas.model import UNKNOWN, World, property_columns
from popatlas.operators.hierarchy import subtree_rows
from popatlas.operators.paging import all_pages, paginate
from popatlas.plans.nesting import PART_SIZE, labelled, map_of
from popatlas.plans.sizing import sized_broadcast
from popatlas.plans.sets import mask_of, names_in

# Subsets of one venue that its assignments may look up by position.
LISTED_SUBSETS = 64


def _chosen(df: DataFrame, ids: Sequence[int] | DataFrame | None) -> DataFrame:
    if ids is None:
        return df
    if isinstance(ids, DataFrame):
        return df.join(ids.select("person_id"), "person_id", "left_semi")
    return df.where(F.col("person_id").isin(list(ids)))


def person_profile(w: World, ids: Sequence[int] | DataFrame | None = None) -> DataFrame:
    """Age, sex, properties and home unit (NULL when unknown) per person."""
    home = w.units.select(
        "geo_id",
        F.struct(
            F.col("geo_id").alias("id"),
            "name",
            "level",
            F.when(has_coordinates(), F.array("lat", "lon")).alias("coordinates"),
        ).alias("home_unit"),
    )
    properties = property_columns(w.people, "people")
    return (
        _chosen(w.people, ids)
        .join(home, "geo_id", "left")
        .select("person_id", "age", "sex", *properties, "home_unit")
    )


def person_activities(w: World, ids: Sequence[int] | DataFrame | None = None) -> DataFrame:
    """Activities in stored order (``seq``) with venue, its type and unit, and subset.

    The subset name is the one at that position of the venue; a venue without subsets
    shows the position instead, and a unit that is not known shows its id.

    Assignments join once, by venue: while no venue has more than ``LISTED_SUBSETS`` subsets
    (counted once per world) a venue carries its names by position. They are shuffled once
    then, and not at all where they are stored in buckets of venues. Past that bound, and
    where positions repeat, the names are joined by venue and position.
    """
    units = w.units.select(F.col("geo_id"), F.col("name").alias("venue_unit"))
    venues = (
        w.venues.select(
            "venue_id", F.col("name").alias("venue_name"), "venue_type", "geo_id"
        )
        .join(units, "geo_id", "left")
        .select(
            "venue_id",
            "venue_name",
            F.coalesce("venue_type", F.lit(UNKNOWN)).alias("venue_type"),
            text_or_id(F.col("venue_unit"), F.col("geo_id")).alias("venue_unit"),
        )
    )
    places = w.subsets.select("venue_id", "subset_pos", "subset_name")
    chosen = _chosen(w.activities, ids)
    if w.most_subsets is not None and w.most_subsets <= LISTED_SUBSETS:
        entry = F.struct("subset_pos", "subset_name")
        names = (
            places.where("venue_id is not null and subset_pos is not null")
            .groupBy("venue_id")
            .agg(F.map_from_entries(F.collect_list(entry)).alias("_names"))
        )
        found = chosen.join(venues.join(names, "venue_id", "left"), "venue_id").withColumn(
            "subset_name", F.try_element_at("_names", F.col("subset_pos"))
        )
    else:
        found = chosen.join(venues, "venue_id").join(places, ["venue_id", "subset_pos"], "left")
    return (
        found.select(
            "person_id",
            "seq",
            "activity",
            "venue_id",
            "venue_name",
            "venue_type",
            "venue_unit",
            text_or_id(F.col("subset_name"), F.col("subset_pos")).alias("subset_name"),
        )
    )


def person_record(
    w: World, ids: Sequence[int] | DataFrame | None = None, part_size: int = PART_SIZE
) -> DataFrame:
    """A person's full record: profile, home unit and activities, ``part`` by part.

    Someone without activities has one row, with an empty map.
    """
    maps = activity_map(w, ids, part_size)
    kind = maps.schema["activity_map"].dataType.simpleString()
    return (
        person_profile(w, ids)
        .join(maps, "person_id", "left")
        .withColumn("part", F.coalesce("part", F.lit(0).cast("bigint")))
        .withColumn("activity_map", F.coalesce("activity_map", F.expr(f"cast(map() as {kind})")))
    )


def activity_map(
    w: World, ids: Sequence[int] | DataFrame | None = None, part_size: int = PART_SIZE
) -> DataFrame:
    """``person_id, part, activity_map``: activity → venue type → visits in stored order.

    A person with more than ``part_size`` assignments continues in further parts. An
    assignment without an activity is listed under ``UNKNOWN``.
    """
    visit = F.struct("seq", "subset_name", "venue_id", "venue_name", "venue_type")
    # One shuffle, by what all three groupings share.
    by_type = (
        person_activities(w, ids)
        .withColumn("part", F.expr(f"seq div {int(part_size)}"))
        .withColumn("activity", labelled("activity"))
        .repartition("person_id", "part")
        .groupBy("person_id", "part", "activity", "venue_type")
        .agg(F.array_sort(F.collect_list(visit)).alias("visits"))
        .withColumn(
            "visits",
            F.transform(
                "visits",
                lambda v: F.struct(
                    v["subset_name"].alias("subset_name"),
                    v["venue_id"].alias("venue_id"),
                    v["venue_name"].alias("venue_name"),
                    v["venue_type"].alias("venue_type"),
                ),
            ),
        )
    )
    by_activity = by_type.groupBy("person_id", "part", "activity").agg(
        map_of("venue_type", "visits").alias("venues")
    )
    return by_activity.groupBy("person_id", "part").agg(
        map_of("activity", "venues").alias("activity_map")
    )


def primary_activity(w: World, name: str = "primary_activity") -> DataFrame:
    """``person_id, venue_type, venue_name`` of the first venue of an activity; NULLs for
    people without it."""
    first = (
        w.activities.where(F.col("activity") == name)
        .groupBy("person_id")
        .agg(F.min_by("venue_id", "seq").alias("venue_id"))
        .join(w.venues.select("venue_id", "venue_type", F.col("name").alias("venue_name")), "venue_id")
    )
    return (
        w.people.select("person_id")
        .join(first, "person_id", "left")
        .select("person_id", "venue_type", "venue_name")
    )


def activity_masks(w: World) -> DataFrame:
    """``person_id, mask, assignments``: the activities of each person as bits of
    ``w.activity_names``, which must be a short list.

    A mask is a plain long, so rows shrink to one per person before the shuffle.
    """
    return w.activities.groupBy("person_id").agg(
        F.bit_or(mask_of("activity", w.activity_names)).alias("mask"),
        F.count("*").alias("assignments"),
    )


def activity_types(w: World) -> DataFrame:
    """``person_id, activities``: sorted activity names; a set no longer than the names."""
    if w.activity_names is not None:
        return activity_masks(w).select(
            "person_id", names_in("mask", w.activity_names).alias("activities")
        )
    return w.activities.groupBy("person_id").agg(
        F.array_sort(F.collect_set("activity")).alias("activities")
    )


def unit_people(
    w: World,
    unit: int | None = None,
    descendants: bool = False,
    page: int | None = None,
    per_page: int = DEFAULT_PER_PAGE,
) -> DataFrame:
    """People of a unit in file order, direct ones or its whole subtree.

    With ``unit`` and ``page`` one page; otherwise every listed row with rank and page,
    of one unit or of all units (``ancestor_id``).
    """
    def listing(people: DataFrame) -> DataFrame:
        if descendants:
            return subtree_rows(people, w, unit)
        direct = people if unit is None else people.where(F.col("geo_id") == unit)
        return direct.join(w.units.select("geo_id"), "geo_id", "left_semi").withColumn(
            "ancestor_id", F.col("geo_id")
        )

    shown = ["ancestor_id", "person_id", "age", "sex", "rank", "page"]
    if unit is None or page is None:
        listed = listing(w.people.select("person_id", "geo_id", "ordinal", "age", "sex"))
        rows = all_pages(listed, per_page=per_page, keys=["ancestor_id"], ties=["person_id"])
        return rows.select(*shown)
    # One page: rank the ids alone, then look up the attributes of that page.
    listed = listing(w.people.select("person_id", "geo_id", "ordinal"))
    rows = paginate(listed, page=page, per_page=per_page, ties=["person_id"])
    rows = rows.select("ancestor_id", "person_id", "rank").withColumn(
        "page", F.lit(clamp_page(page)).cast("bigint")
    )
    attributes = w.people.select("person_id", "age", "sex")
    return attributes.join(sized_broadcast(rows, per_page), "person_id").select(*shown)


def first_people(w: World, n: int = DEFAULT_PER_PAGE) -> DataFrame:
    """The first ``n`` direct people of every unit, with their place."""
    direct = w.people.select("person_id", "geo_id", "ordinal", "age", "sex").join(
        w.units.select("geo_id"), "geo_id", "left_semi"
    )
    # The limit on the place reaches the map side: n rows per unit and task are shuffled.
    order = Window.partitionBy("geo_id").orderBy("ordinal", "person_id")
    first = direct.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= n)
    return first.withColumn("rank", (F.col("_place") - 1).cast("bigint")).drop("ordinal", "_place")
