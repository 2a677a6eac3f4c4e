"""Whole-world column profiles and totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from popatlas.functions.decode import literal_rows
from popatlas.functions.rounding import round_to
from popatlas.model import World, property_columns
from popatlas.operators.people import activity_masks
from popatlas.plans.joins import join_on_keys
from popatlas.plans.quantiles import exact_quantiles
from popatlas.plans.sets import count_names

TOP_VALUES = 25
QUARTILES = {0.25: "p25", 0.5: "median", 0.75: "p75"}


def population_summary(w: World) -> DataFrame:
    """One row: people, mean (2 decimals), min and max age; NULL ages when empty."""
    return w.people.agg(
        F.count("*").alias("total_people"),
        round_to(F.avg("age"), 2).alias("mean_age"),
        F.min("age").alias("min_age"),
        F.max("age").alias("max_age"),
    )


def sex_distribution(w: World) -> DataFrame:
    return w.people.groupBy("sex").agg(F.count("*").alias("n"))


def population_by_level(w: World) -> DataFrame:
    """``level, people`` living directly in units of the level."""
    per_unit = w.people.groupBy("geo_id").agg(F.count("*").alias("_n"))
    return (
        per_unit.join(w.units.select("geo_id", "level"), "geo_id")
        .groupBy("level")
        .agg(F.sum("_n").alias("people"))
    )


def _unpivoted(df: DataFrame, cols: Sequence[str], kind: str, by: Sequence[str]) -> DataFrame:
    """``by, property, value``: one row per record and column, columns of one type."""
    cell = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("property"), F.col(c).cast(kind).alias("value"))
                for c in cols
            ]
        )
    )
    return df.select(*by, cell.alias("_cell")).select(*by, "_cell.*")


def profile_numeric(
    df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Per property: finite count, mean and population std (4 decimals), min, max and the
    quartiles (linear interpolation). Without finite values: count 0 and NULLs."""
    keys = [*by, "property"]
    value = F.col("value")
    finite = (~F.isnan(value)) & (F.abs(value) != F.lit(float("inf")))
    cells = _unpivoted(df, cols, "double", by).withColumn("value", F.when(finite, value))
    moments = cells.groupBy(*keys).agg(
        F.count("value").alias("count"),
        round_to(F.avg("value"), 4).alias("mean"),
        round_to(F.stddev_pop("value"), 4).alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quantiles = exact_quantiles(
        cells, "value", list(QUARTILES), keys, groups=len(cols) if not by else None
    )
    wide = quantiles.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("prob") == F.lit(p), F.col("quantile"))).alias(name)
            for p, name in QUARTILES.items()
        ]
    )
    return join_on_keys(moments, wide, keys, "left")


def profile_categorical(
    df: DataFrame, cols: Sequence[str], k: int = TOP_VALUES, by: Sequence[str] = ()
) -> DataFrame:
    """Per property its ``k`` most frequent values with count and percent (2 decimals),
    ties by value, beside the value total and the number of distinct values."""
    keys = [*by, "property"]
    counts = (
        _unpivoted(df, cols, "string", by)
        .groupBy(*keys, "value")
        .agg(F.count("*").alias("n"))
    )
    totals = counts.groupBy(*keys).agg(
        F.sum("n").alias("count"), F.count("*").alias("unique_count")
    )
    # The rank limit reaches the map side, so k values per task travel, not all of them.
    order = Window.partitionBy(*keys).orderBy(F.col("n").desc(), F.col("value").asc())
    top = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return join_on_keys(top, totals, keys).withColumn(
        "percent", round_to(F.lit(100.0) * F.col("n") / F.col("count"), 2)
    )


def split_by_type(df: DataFrame, cols: Sequence[str]) -> tuple[list[str], list[str]]:
    """(numeric, categorical) columns; booleans and text are categorical."""
    numeric = [c for c in cols if isinstance(df.schema[c].dataType, T.NumericType)]
    return numeric, [c for c in cols if c not in numeric]


def _profile(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame | None:
    """Numeric and categorical profiles in one long shape:
    ``by, property, kind, measure, category, amount``."""
    numeric, categorical = split_by_type(df, cols)
    parts = []

    def long(profile: DataFrame, kind: str, cells: dict[str, tuple[Column, Column]]):
        entries = [
            F.struct(
                F.lit(kind).alias("kind"),
                F.lit(measure).alias("measure"),
                category.cast("string").alias("category"),
                amount.cast("double").alias("amount"),
            )
            for measure, (category, amount) in cells.items()
        ]
        parts.append(
            profile.select(*by, "property", F.explode(F.array(*entries)).alias("e")).select(
                *by, "property", "e.*"
            )
        )

    none = F.lit(None)
    if numeric:
        measures = ("count", "mean", "std", "min", "max", *QUARTILES.values())
        long(
            profile_numeric(df, numeric, by),
            "numeric",
            {m: (none, F.col(m)) for m in measures},
        )
    if categorical:
        top = profile_categorical(df, categorical, by=by)
        long(
            top,
            "categorical",
            {"n": (F.col("value"), F.col("n")), "percent": (F.col("value"), F.col("percent"))},
        )
        long(
            top.where("place = 1"),
            "categorical",
            {"count": (none, F.col("count")), "unique_count": (none, F.col("unique_count"))},
        )
    if not parts:
        return None
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


def profile_people(w: World) -> DataFrame:
    """Profile of age, sex and every person property."""
    return _profile(w.people, ["age", "sex", *property_columns(w.people, "people")])


def profile_venues(w: World) -> DataFrame | None:
    """Profile of every venue property within each venue type; None without properties."""
    return _profile(w.venues, property_columns(w.venues, "venues"), by=["venue_type"])


def subset_sizes(w: World) -> DataFrame:
    """One row: mean (2 decimals), median, min, max of the non-empty subset sizes, and the
    number of all and of non-empty subsets."""
    filled = F.when(F.col("member_count") > 0, F.col("member_count"))
    median = exact_quantiles(
        w.subsets.where("member_count > 0").select("member_count"), "member_count", [0.5]
    )
    return w.subsets.agg(
        round_to(F.avg(filled), 2).alias("mean"),
        F.min(filled).alias("min"),
        F.max(filled).alias("max"),
        F.count("*").alias("total_subsets"),
        F.count(filled).alias("non_empty_subsets"),
    ).withColumn("median", median.select("quantile").scalar())


def people_per_activity(w: World, names: Sequence[str]) -> DataFrame:
    """``activity, people``: 0 for names that nobody uses."""
    if w.activity_names is not None:
        used = count_names(activity_masks(w), "mask", w.activity_names, [], "activity", "_n")
    else:
        used = (
            w.activities.select("person_id", "activity")
            .distinct()
            .groupBy("activity")
            .agg(F.count("*").alias("_n"))
        )
    listed = w.activities.sparkSession.range(1).select(literal_rows(names).alias("activity"))
    return listed.join(used, "activity", "left").select(
        "activity", F.coalesce("_n", F.lit(0)).cast("bigint").alias("people")
    )


def _types_per_person(w: World) -> DataFrame:
    """``person_id, types, rows``: distinct activities (NULL is none) and assignments."""
    if w.activity_names is not None:
        return activity_masks(w).select(
            "person_id", F.bit_count("mask").alias("types"), F.col("assignments").alias("rows")
        )
    per_pair = w.activities.groupBy("person_id", "activity").agg(F.count("*").alias("rows"))
    return per_pair.groupBy("person_id").agg(
        F.count("activity").alias("types"), F.sum("rows").alias("rows")
    )


def activity_summary(w: World) -> DataFrame:
    """One row: people with any activity, mean distinct activities per active person, mean
    assignments per person, and the contacts estimate: the mean of (size − 1) over
    non-empty subsets, times the assignments per person."""
    per_person = _types_per_person(w)
    people = w.people.agg(F.count("*").alias("n")).select("n").scalar()
    others = (
        w.subsets.where("member_count > 0")
        .agg(F.avg(F.col("member_count") - 1).alias("others"))
        .select("others")
        .scalar()
    )
    zero = F.lit(0.0)
    return (
        per_person.agg(
            F.count("*").alias("active_people"),
            F.sum("types").alias("_types"),
            F.sum("rows").alias("_rows"),
        )
        .withColumn("_people", people)
        .withColumn("_others", others)
        .withColumn("_assignments", F.coalesce(F.col("_rows") / F.col("_people"), zero))
        .select(
            "active_people",
            round_to(F.coalesce(F.col("_types") / F.col("active_people"), zero), 2).alias(
                "mean_activity_types"
            ),
            round_to(F.col("_assignments"), 2).alias("mean_assignments"),
            round_to(F.coalesce(F.col("_others") * F.col("_assignments"), zero), 1).alias(
                "mean_contacts_estimate"
            ),
        )
    )


def household_sizes(w: World, venue_type: str = "household") -> DataFrame:
    """``size, households`` over the venues of a type, size = members of all subsets."""
    sizes = w.subsets.groupBy("venue_id").agg(F.sum("member_count").alias("_size"))
    return (
        w.venues.where(F.col("venue_type") == venue_type)
        .select("venue_id")
        .join(sizes, "venue_id", "left")
        .groupBy(F.coalesce("_size", F.lit(0)).cast("bigint").alias("size"))
        .agg(F.count("*").alias("households"))
    )


def household_summary(sizes: DataFrame) -> DataFrame:
    """One row over :func:`household_sizes`: households and average size (0 if none)."""
    return sizes.agg(
        F.coalesce(F.sum("households"), F.lit(0)).cast("bigint").alias("total_households"),
        F.coalesce(
            F.sum(F.col("size") * F.col("households")) / F.sum("households"), F.lit(0.0)
        ).alias("average_size"),
    )


def world_totals(w: World) -> DataFrame:
    """One row: units, levels, people, venues, venue types."""
    people = w.people.agg(F.count("*").alias("n"))
    venues = w.venues.groupBy("venue_type").agg(F.count("*").alias("_n"))
    venue_counts = venues.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.count("*").alias("types")
    )
    by_level = w.geo.groupBy("level").agg(F.count("*").alias("_n"))
    return by_level.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("units"),
        F.count("*").alias("levels"),
    ).select(
        "units",
        "levels",
        people.select("n").scalar().alias("people"),
        venue_counts.select("n").scalar().alias("venues"),
        venue_counts.select("types").scalar().alias("venue_types"),
    )
