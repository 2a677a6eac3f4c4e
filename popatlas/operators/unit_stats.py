"""Demographic statistics per unit, rolled up the geography.

Every measure is kept long, ``geo_id, kind, category, n``: facts are counted per unit
first, and only those counts climb the tree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from popatlas.functions.decode import has_coordinates
from popatlas.model import AGE_BREAKS, AGE_LABELS, World
from popatlas.operators.hierarchy import child_counts, with_ancestors
from popatlas.operators.people import activity_masks
from popatlas.plans.nesting import labelled, map_of
from popatlas.plans.sets import count_names

ALL = "all"


def _measure(kind: str, category: Column, n: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        category.cast("string").alias("category"),
        n.cast("bigint").alias("n"),
    )


def _in_known_units(facts: DataFrame, w: World) -> DataFrame:
    return facts.join(w.units.select("geo_id"), "geo_id", "left_semi")


def direct_population(w: World) -> DataFrame:
    """``geo_id, population`` of the people living directly in a known unit."""
    return _in_known_units(w.people.groupBy("geo_id").agg(F.count("*").alias("population")), w)


def _people_counts(w: World, breaks: Sequence[float], labels: Sequence[str]) -> DataFrame:
    """One pass over people: counts per (unit, sex) with a column per age class."""
    uppers = [*breaks[1:], None]
    classes = [
        F.count_if(
            (F.col("age") >= lower) & (F.lit(True) if upper is None else F.col("age") < upper)
        ).alias(f"a{i}")
        for i, (lower, upper) in enumerate(zip(breaks, uppers, strict=True))
    ]
    counted = w.people.groupBy("geo_id", "sex").agg(F.count("*").alias("people"), *classes)
    return _in_known_units(counted, w).select(
        "geo_id",
        F.explode(
            F.array(
                _measure("population", F.lit(ALL), F.col("people")),
                _measure("sex", F.col("sex"), F.col("people")),
                *[
                    _measure("age", F.lit(text), F.col(f"a{i}"))
                    for i, text in enumerate(labels)
                ],
            )
        ).alias("m"),
    ).select("geo_id", "m.*")


def people_measures(
    w: World, breaks: Sequence[float] = AGE_BREAKS, labels: Sequence[str] = AGE_LABELS
) -> DataFrame:
    """Direct population, age and sex counts; every age class is present per unit."""
    return (
        _people_counts(w, breaks, labels)
        .groupBy("geo_id", "kind", "category")
        .agg(F.sum("n").alias("n"))
    )


def age_buckets(
    w: World, breaks: Sequence[float] = AGE_BREAKS, labels: Sequence[str] = AGE_LABELS
) -> DataFrame:
    """``geo_id, age_label, n`` of direct people, zero classes included."""
    return (
        people_measures(w, breaks, labels)
        .where("kind = 'age'")
        .select("geo_id", F.col("category").alias("age_label"), "n")
    )


def sex_counts(w: World) -> DataFrame:
    """``geo_id, sex, n`` of direct people."""
    return _in_known_units(w.people.groupBy("geo_id", "sex").agg(F.count("*").alias("n")), w)


def venue_type_counts(w: World, populated_only: bool = True) -> DataFrame:
    """``geo_id, venue_type, n``; optionally only for units with direct people."""
    counts = _in_known_units(
        w.venues.groupBy("geo_id", "venue_type").agg(F.count("*").alias("n")), w
    )
    if populated_only:
        populated = w.people.select("geo_id").distinct()
        counts = counts.join(populated, "geo_id", "left_semi")
    return counts


def activity_counts(w: World) -> DataFrame:
    """``geo_id, activity, n``: people of the unit taking part, each counted once. A NULL
    activity counts for nothing."""
    homes = w.people.select("person_id", "geo_id")
    if w.activity_names is not None:
        masks = activity_masks(w).select("person_id", "mask").join(homes, "person_id")
        counts = count_names(masks, "mask", w.activity_names, ["geo_id"], "activity", "n")
        return _in_known_units(counts.where("n > 0"), w)
    takes_part = w.activities.where("activity is not null").select("person_id", "activity").distinct()
    counts = (
        takes_part.join(homes, "person_id")
        .groupBy("geo_id", "activity")
        .agg(F.count("*").alias("n"))
    )
    return _in_known_units(counts, w)


def rollup(
    measure: DataFrame, w: World, by: Sequence[str], n: str = "n", counted: bool = False
) -> DataFrame:
    """Sum an additive per-unit measure over each unit's subtree.

    ``measure`` is aggregated per unit before it climbs (unless it is ``counted`` already),
    so the climb handles at most units × categories rows whatever the number of facts.
    """
    if not counted:
        measure = measure.groupBy("geo_id", *by).agg(F.sum(n).alias(n))
    return (
        with_ancestors(measure, w)
        .groupBy(F.col("ancestor_id").alias("geo_id"), *by)
        .agg(F.sum(n).cast("bigint").alias(n))
    )


def unit_measures(
    w: World, populated_only: bool = True, with_activities: bool = True
) -> DataFrame:
    """All direct measures of all units, long."""
    venues = venue_type_counts(w, populated_only).select(
        "geo_id", F.lit("venue").alias("kind"), F.col("venue_type").alias("category"), "n"
    )
    measures = _people_counts(w, AGE_BREAKS, AGE_LABELS).unionByName(venues)
    if with_activities:
        measures = measures.unionByName(
            activity_counts(w).select(
                "geo_id", F.lit("activity").alias("kind"), F.col("activity").alias("category"), "n"
            )
        )
    return measures


def unit_stats(
    w: World, populated_only: bool = True, with_activities: bool = True
) -> DataFrame:
    """The statistics record of every unit, subtree included.

    ``has_stats`` is false for childless units without people, whose counts are all zero;
    with ``populated_only=False`` every unit has statistics. People without a sex and venues
    without a type count under ``UNKNOWN``, with those that are stored so.
    """
    direct = unit_measures(w, populated_only, with_activities).withColumn(
        "category", labelled("category")
    )
    rolled = rollup(direct, w, ["kind", "category"], counted=True)

    def total(kind: str, category: str | None = None) -> Column:
        wanted = F.col("kind") == kind
        if category is not None:
            wanted &= F.col("category") == category
        return F.coalesce(F.sum(F.when(wanted, F.col("n"))), F.lit(0)).cast("bigint")

    def as_map(kind: str) -> Column:
        return map_of("category", "n", F.col("kind") == kind)

    records = rolled.groupBy("geo_id").agg(
        total("population").alias("population"),
        total("venue").alias("venues_count"),
        F.create_map(
            *[c for text in AGE_LABELS for c in (F.lit(text), total("age", text))]
        ).alias("age_distribution"),
        as_map("sex").alias("sex_distribution"),
        as_map("venue").alias("venue_types"),
        as_map("activity").alias("activity_counts"),
    )
    zero = F.lit(0).cast("bigint")
    no_ages = F.create_map(*[c for text in AGE_LABELS for c in (F.lit(text), zero)])
    empty = F.expr("cast(map() as map<string, bigint>)")
    present = (
        (F.coalesce("population", zero) > 0) | F.col("children_count").isNotNull()
        if populated_only
        else F.lit(True)
    )
    return (
        w.geo.select("geo_id")
        .join(records, "geo_id", "left")
        .join(child_counts(w), "geo_id", "left")
        .select(
            "geo_id",
            F.coalesce("population", zero).alias("population"),
            F.coalesce("venues_count", zero).alias("venues_count"),
            F.coalesce("age_distribution", no_ages).alias("age_distribution"),
            F.coalesce("sex_distribution", empty).alias("sex_distribution"),
            F.coalesce("venue_types", empty).alias("venue_types"),
            F.coalesce("activity_counts", empty).alias("activity_counts"),
            F.coalesce("children_count", zero).alias("children_count"),
            present.alias("has_stats"),
        )
    )


STAT_MAPS = {
    "age": "age_distribution",
    "sex": "sex_distribution",
    "venue": "venue_types",
    "activity": "activity_counts",
}


def stats_long(stats: DataFrame, kinds: Sequence[str] = tuple(STAT_MAPS)) -> DataFrame:
    """``geo_id, kind, category, n`` from statistics records that exist."""

    def entries_of(kind: str) -> Column:
        return F.transform(
            F.map_entries(STAT_MAPS[kind]),
            lambda e: F.struct(
                F.lit(kind).alias("kind"), e["key"].alias("category"), e["value"].alias("n")
            ),
        )

    entries = F.concat(*[entries_of(kind) for kind in kinds])
    return stats.where("has_stats").select("geo_id", F.explode(entries).alias("e")).select(
        "geo_id", "e.*"
    )


def _count_in(counts: str, key: str) -> Column:
    return F.coalesce(F.try_element_at(F.col(counts), F.lit(key)), F.lit(0)).cast("bigint")


def people_aged(label: str) -> Column:
    """People of an age class in a statistics record, 0 when absent."""
    return _count_in("age_distribution", label)


def venues_of_type(venue_type: str) -> Column:
    """Venues of a type in a statistics record, 0 when absent."""
    return _count_in("venue_types", str(venue_type))


def level_features(w: World, stats: DataFrame, level: str | None = None) -> DataFrame:
    """Map features of one level (or all): only units with coordinates."""
    shown = w.geo.where(has_coordinates())
    if level is not None:
        shown = shown.where(F.col("level") == level)
    known = w.units.select(F.col("geo_id").alias("_parent"))
    return (
        shown.join(known, F.col("parent_id") == F.col("_parent"), "left")
        .join(
            stats.select("geo_id", "population", "venues_count", "venue_types", "children_count"),
            "geo_id",
        )
        .select(
            "geo_id",
            "name",
            "level",
            "population",
            "venues_count",
            "venue_types",
            F.col("_parent").isNotNull().alias("has_parent"),
            "children_count",
            "lat",
            "lon",
        )
    )


def unit_detail(w: World, stats: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Everything known about each unit that has statistics, with its parent and, when
    ``names`` (``id, display_name``) is given, its display name. Children are listed by
    :func:`popatlas.operators.hierarchy.family`."""
    parents = w.units.select(
        F.col("geo_id").alias("_parent"),
        F.col("name").alias("_parent_name"),
        F.col("level").alias("_parent_level"),
    )
    detail = (
        w.geo.join(stats.where("has_stats"), "geo_id")
        .join(parents, F.col("parent_id") == F.col("_parent"), "left")
        .select(
            *[c for c in w.geo.columns if c != "parent_id"],
            *[c for c in stats.columns if c not in ("geo_id", "has_stats")],
            F.when(
                F.col("_parent").isNotNull(),
                F.struct(
                    F.col("_parent").alias("id"),
                    F.col("_parent_name").alias("name"),
                    F.col("_parent_level").alias("level"),
                ),
            ).alias("parent"),
        )
    )
    if names is None:
        return detail.withColumn("display_name", F.lit(None).cast("string"))
    from popatlas.sources.names import with_display_names

    return with_display_names(detail, names)


def shares(
    dist: DataFrame, denominator: DataFrame | None = None, by: Sequence[str] = ("geo_id",)
) -> DataFrame:
    """Percent of each category in its distribution, or of ``denominator``
    (``geo_id, total``). A zero denominator gives no rows."""
    if denominator is None:
        # One row per category: these groups are as small as the category list.
        totals = dist.withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    else:
        totals = dist.join(denominator, list(by))
    return totals.where("total > 0").withColumn("percent", F.col("n") / F.col("total") * 100)


def top_breakdown(
    dist: DataFrame,
    n: int = 20,
    by: str = "count",
    desc: bool = True,
    keys: Sequence[str] = ("geo_id",),
) -> DataFrame:
    """The first ``n`` categories per unit by count or name (count ties by name), with
    their percentage of the largest count kept."""
    column = "n" if by == "count" else "category"
    order = [F.col(column).desc() if desc else F.col(column).asc()]
    if by == "count":
        order.append(F.col("category").asc())
    kept = dist.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = kept.where(F.col("place") <= n)
    largest = F.max("n").over(Window.partitionBy(*keys))
    return kept.withColumn("relative", F.col("n") / largest * 100)
