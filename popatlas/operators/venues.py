"""Venues, their subsets and members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popatlas.functions.decode import has_coordinates, text_or_id
from popatlas.functions.paging import (
    DEFAULT_PER_PAGE,
    clamp_page,
    clamp_per_page,
    page_of,
    total_pages,
)
from popatlas.model import NO_PARENT, World
from popatlas.operators.hierarchy import subtree_rows
from popatlas.operators.paging import all_pages, paginate
from popatlas.plans.sizing import sized_broadcast
from popatlas.plans.nesting import nest


def _unit_names(w: World) -> DataFrame:
    return w.units.select("geo_id", F.col("name").alias("unit"))


def venue_types(w: World) -> DataFrame:
    """``venue_type, venues``."""
    return w.venues.groupBy("venue_type").agg(F.count("*").alias("venues"))


def venue_members_total(w: World) -> DataFrame:
    """``venue_id, num_members`` over the subsets of each venue."""
    return _member_totals(w.subsets)


def _member_totals(subsets: DataFrame) -> DataFrame:
    return subsets.groupBy("venue_id").agg(F.sum("member_count").alias("num_members"))


def venue_features(w: World, venue_type: str | None = None) -> DataFrame:
    """Map features of one type (or all): only venues with coordinates."""
    shown = w.venues.where(has_coordinates())
    if venue_type is not None:
        shown = shown.where(F.col("venue_type") == venue_type)
    return (
        shown.join(venue_members_total(w), "venue_id", "left")
        .join(_unit_names(w), "geo_id", "left")
        .select(
            "venue_id",
            "name",
            "venue_type",
            "unit",
            F.coalesce("num_members", F.lit(0)).cast("bigint").alias("num_members"),
            "is_residence",
            "lat",
            "lon",
        )
    )


def venue_subsets(w: World) -> DataFrame:
    """Venue attributes with one row per subset (one row with NULLs when it has none)."""
    units = w.units.select(
        "geo_id", F.col("name").alias("unit"), F.col("level").alias("unit_level")
    )
    coordinates = F.when(has_coordinates(), F.array("lat", "lon"))
    return (
        w.venues.select(
            "venue_id", "name", "venue_type", "geo_id", coordinates.alias("coordinates")
        )
        .join(units, "geo_id", "left")
        .join(w.subsets, "venue_id", "left")
    )


def venue_detail(w: World, venue_id: int | None = None) -> DataFrame:
    """Each venue (or one) with its ordered subset list, keyed by ``venue_id, part``.

    An unknown id gives no row. Nearly every venue has part 0 only; one whose subset list
    exceeds a part continues in further rows, see :func:`popatlas.plans.nesting.nest`.
    """
    venues, subsets = w.venues, w.subsets
    if venue_id is not None:
        venues = venues.where(F.col("venue_id") == venue_id)
        subsets = subsets.where(F.col("venue_id") == venue_id)
    lists = nest(
        subsets, ["venue_id"], "subset_pos", ["subset_name", "member_count"], "subsets"
    )
    units = w.units.select(
        "geo_id", F.col("name").alias("unit"), F.col("level").alias("unit_level")
    )
    empty = F.array().cast("array<struct<subset_name:string,member_count:bigint>>")
    return (
        venues.join(lists, "venue_id", "left")
        .join(units, "geo_id", "left")
        .select(
            "venue_id",
            F.coalesce("part", F.lit(0)).alias("part"),
            "name",
            "venue_type",
            "geo_id",
            "unit",
            "unit_level",
            F.when(has_coordinates(), F.array("lat", "lon")).alias("coordinates"),
            F.coalesce("subsets", empty).alias("subsets"),
        )
    )


def venue_parents(w: World) -> DataFrame:
    """``venue_id, parent_id, parent_name``; a missing parent counts as none."""
    parents = w.venues.select(
        F.col("venue_id").alias("_parent"), F.col("name").alias("parent_name")
    )
    return w.venues.join(parents, F.col("parent_id") == F.col("_parent"), "left").select(
        "venue_id", F.col("_parent").alias("parent_id"), "parent_name"
    )


def venue_child_totals(w: World, among: DataFrame | None = None) -> DataFrame:
    """``venue_id, child_count, total_child_members`` for every venue (or those ``among``,
    by ``venue_id``), own members excluded."""
    venues = w.venues
    below = venues.where(F.col("parent_id") != NO_PARENT).select(
        "venue_id", F.col("parent_id").alias("_parent")
    )
    subsets = w.subsets
    if among is not None:
        wanted = among.select("venue_id")
        venues = venues.join(wanted, "venue_id", "left_semi")
        below = below.join(
            wanted.withColumnRenamed("venue_id", "_wanted"),
            F.col("_parent") == F.col("_wanted"),
            "left_semi",
        )
        subsets = subsets.join(below.select("venue_id"), "venue_id", "left_semi")
    children = (
        below.join(_member_totals(subsets), "venue_id", "left")
        .groupBy("_parent")
        .agg(
            F.count("*").alias("child_count"), F.sum("num_members").alias("total_child_members")
        )
    )
    zero = F.lit(0).cast("bigint")
    return venues.join(children, F.col("venue_id") == F.col("_parent"), "left").select(
        "venue_id",
        F.coalesce("child_count", zero).alias("child_count"),
        F.coalesce("total_child_members", zero).alias("total_child_members"),
    )


def _top_level(w: World, venue_type: str | None) -> DataFrame:
    venues = w.venues.where(F.coalesce("parent_id", F.lit(NO_PARENT)) == NO_PARENT)
    return venues if venue_type is None else venues.where(F.col("venue_type") == venue_type)


def with_subsets(listed: DataFrame, w: World) -> DataFrame:
    """Listed venues with one row per subset: ``subset_pos, subset_name, member_count``,
    NULL for a venue without any. A venue on several listings has its rows on each."""
    return listed.join(
        w.subsets.select("venue_id", "subset_pos", "subset_name", "member_count"),
        "venue_id",
        "left",
    )


def unit_venues(
    w: World,
    unit: int | None = None,
    venue_type: str | None = None,
    page: int | None = None,
    per_page: int = DEFAULT_PER_PAGE,
) -> DataFrame:
    """Top-level venues of a unit's subtree in file order.

    With ``unit`` and ``page``: that page, attributes and child totals looked up for its
    rows only. :func:`with_subsets` adds the subsets of the listed venues. Without ``unit``: the listing of every unit (``ancestor_id``), each row
    with its rank and page.
    """
    def attributed(venues: DataFrame, among: DataFrame | None = None) -> DataFrame:
        return venues.join(venue_child_totals(w, among), "venue_id").join(
            _unit_names(w), "geo_id", "left"
        )

    venues = _top_level(w, venue_type)
    columns = ["venue_id", "name", "venue_type", "geo_id", "lat", "lon"]
    totals = ["child_count", "total_child_members", "unit"]
    shown = [*columns, *totals, "ancestor_id", "rank", "page"]
    if unit is None or page is None:
        listed = subtree_rows(attributed(venues.select(*columns, "ordinal")), w, unit)
        rows = all_pages(listed, per_page=per_page, keys=["ancestor_id"], ties=["venue_id"])
        return rows.select(*shown)
    # One page: rank the ids alone, then look up the attributes of that page.
    listed = subtree_rows(venues.select("venue_id", "geo_id", "ordinal"), w, unit)
    rows = paginate(listed, page=page, per_page=per_page, ties=["venue_id"])
    rows = rows.select("ancestor_id", "venue_id", "rank").withColumn(
        "page", F.lit(clamp_page(page)).cast("bigint")
    )
    wanted = w.venues.select(*columns).join(sized_broadcast(rows, per_page), "venue_id")
    return attributed(wanted, rows).select(*shown)


def venue_children(
    w: World,
    parent: int | None = None,
    page: int | None = None,
    per_page: int = DEFAULT_PER_PAGE,
) -> DataFrame:
    """Child venues of one parent, a page of them, or of all parents with their pages.
    :func:`with_subsets` adds their subsets."""
    children = w.venues.where(F.col("parent_id") != NO_PARENT)
    if parent is not None:
        children = children.where(F.col("parent_id") == parent)
    columns = ["parent_id", "venue_id", "name", "venue_type", "geo_id", "lat", "lon", "ordinal"]
    children = children.select(*columns)
    if parent is None or page is None:
        rows = all_pages(children, per_page=per_page, keys=["parent_id"], ties=["venue_id"])
    else:
        rows = paginate(children, page=page, per_page=per_page, ties=["venue_id"]).withColumn(
            "page", F.lit(clamp_page(page)).cast("bigint")
        )
    return rows.join(_unit_names(w), "geo_id", "left")


def member_lists(
    w: World, venue: int | None = None, subset: str | None = None,
    page: int = 1, per_page: int = DEFAULT_PER_PAGE,
) -> DataFrame:
    """One row per listed subset: name, member total, page count. A page past the end
    still has its row here while :func:`venue_members` has none for it."""
    subsets, memberships = w.subsets, w.memberships.select("venue_id", "subset_pos")
    if venue is not None:
        subsets = subsets.where(F.col("venue_id") == venue)
        memberships = memberships.where(F.col("venue_id") == venue)
    if subset is not None:
        subsets = subsets.where(F.col("subset_name") == subset)
    totals = memberships.groupBy("venue_id", "subset_pos").agg(F.count("*").alias("total"))
    return (
        subsets.select("venue_id", "subset_pos", "subset_name")
        .join(totals, ["venue_id", "subset_pos"], "left")
        .select(
            "venue_id",
            "subset_pos",
            "subset_name",
            F.coalesce("total", F.lit(0)).cast("bigint").alias("total"),
            total_pages(F.coalesce("total", F.lit(0)), per_page).alias("total_pages"),
            F.lit(clamp_page(page)).alias("page"),
        )
    )


def venue_members(
    w: World,
    venue: int | None = None,
    subset: str | None = None,
    page: int | None = None,
    per_page: int = DEFAULT_PER_PAGE,
) -> DataFrame:
    """Members per subset in stored order, paged per subset.

    ``seq`` is the stored position of a member, so its page needs no ranking and a huge
    subset no window.
    """
    size = clamp_per_page(per_page)
    members, subsets = w.memberships, w.subsets.select("venue_id", "subset_pos", "subset_name")
    if venue is not None:
        members = members.where(F.col("venue_id") == venue)
        subsets = subsets.where(F.col("venue_id") == venue)
    if page is not None:
        first = (clamp_page(page) - 1) * size
        members = members.where((F.col("seq") >= first) & (F.col("seq") < first + size))
    if subset is not None:
        subsets = subsets.where(F.col("subset_name") == subset)
    return (
        members.join(subsets, ["venue_id", "subset_pos"])
        .join(w.people.select("person_id", "age", "sex", "geo_id"), "person_id")
        .join(_unit_names(w), "geo_id", "left")
        .select(
            "venue_id",
            "subset_pos",
            "subset_name",
            "seq",
            page_of(F.col("seq"), size).alias("page"),
            "person_id",
            "age",
            "sex",
            text_or_id(F.col("unit"), F.col("geo_id")).alias("unit"),
        )
    )
