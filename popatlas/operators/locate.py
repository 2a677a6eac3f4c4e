"""On which page of its unit's listing a person or venue appears."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popatlas.functions.paging import DEFAULT_PER_PAGE, page_of
from popatlas.model import NO_PARENT, World
from popatlas.plans import ranking
from popatlas.plans.joins import join_on_keys
from popatlas.plans.ranking import prefix_sum, slice_offsets
from popatlas.plans.sizing import sized_broadcast
from popatlas.plans.storage import stored


def _located(
    facts: DataFrame,
    w: World,
    identifier: str,
    per_page: int,
    extra: Sequence[str] = (),
    listed: Column | None = None,
) -> DataFrame:
    """``facts`` with the name of their ``unit`` and the ``page`` of its subtree listing (of
    the same ``extra`` values) they are on; one row for each fact.

    Facts are counted per unit and slice of the order first. Those counts climb to the
    listings, not the facts, and give the rank each slice starts with. The facts then pass
    once: each is repeated for the ancestors that hold facts themselves, since nobody is
    located in another unit's listing, and ranked within its slice. Facts that are not
    ``listed`` or live in an unknown unit take the same way without a listing, so no second
    join by id brings them back; they are on page 1.
    """
    width = ranking.BUCKET_WIDTH
    at_home = F.col("geo_id") if listed is None else F.when(listed, F.col("geo_id"))
    rows = facts.withColumn("_home", at_home)
    slices = stored(
        rows.where("_home is not null")
        .groupBy("_home", *extra, F.expr(f"ordinal div {width}").alias("_bucket"))
        .agg(F.count("*").alias("_sum")),
        "facts-per-slice",
    )
    holders = slices.select("_home", *extra).distinct()
    climbed = holders.join(
        w.paths.select(F.col("geo_id").alias("_home"), "path"), "_home"
    ).select("_home", *extra, F.explode("path").alias("_listing"))
    keys = ["_listing", *extra]
    listings = join_on_keys(
        climbed, holders.withColumnRenamed("_home", "_listing").withColumn("_held", F.lit(1)), keys
    ).drop("_held")
    if not extra:
        # A unit is in the listings of its path only, which bounds their number.
        listings = sized_broadcast(listings, w.closure_rows)
    sums = (
        join_on_keys(slices, listings, ["_home", *extra])
        .groupBy(*keys, "_bucket")
        .agg(F.sum("_sum").alias("_sum"))
    )
    ranked = prefix_sum(
        join_on_keys(rows, listings, ["_home", *extra], "left"),
        "ordinal",
        keys=keys,
        ties=[identifier],
        width=width,
        offsets=slice_offsets(sums, keys),
    )
    return (
        ranked.where("_listing is null or _listing = _home")
        .join(w.units.select("geo_id", F.col("name").alias("unit")), "geo_id", "left")
        .withColumn("page", page_of(F.coalesce("rank", F.lit(0)), per_page))
    )


def locate_people(w: World, per_page: int = DEFAULT_PER_PAGE) -> DataFrame:
    """``person_id, unit, page``; people of unknown units are on page 1 of no unit."""
    people = w.people.select("person_id", "geo_id", "ordinal")
    return _located(people, w, "person_id", per_page).select("person_id", "unit", "page")


def locate_venues(w: World, per_page: int = DEFAULT_PER_PAGE) -> DataFrame:
    """``venue_id, unit, venue_type, page`` in the type's top-level listing of the unit.

    Child venues are not in that listing; they report page 1.
    """
    venues = w.venues.select("venue_id", "geo_id", "venue_type", "ordinal", "parent_id")
    top_level = F.col("parent_id") == NO_PARENT
    located = _located(venues, w, "venue_id", per_page, ["venue_type"], top_level)
    return located.select("venue_id", "unit", "venue_type", "page")
