"""Map classes over counts and populations. Classes are numbered from 0."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds of the count classes (None = the rest), the population
# thresholds, and the cuts of the relative classes.
COUNT_LIMITS = (2, 5, 10, 20, None)
POPULATION_THRESHOLDS = (100, 500, 1000, 5000, 10000, None)
RELATIVE_CUTS = (0.25, 0.5, 0.75)


def count_class(count: Column, limits: Sequence[int | None] = COUNT_LIMITS) -> Column:
    """First class whose upper bound is not exceeded; past the last bound, the last."""
    chosen = F.lit(len(limits) - 1)
    for number in reversed(range(len(limits))):
        limit = limits[number]
        chosen = (
            F.lit(number)
            if limit is None
            else F.when(count <= limit, F.lit(number)).otherwise(chosen)
        )
    return chosen.cast("int")


def relative_class(count: Column, largest: Column, cuts: Sequence[float] = RELATIVE_CUTS) -> Column:
    """Class of the share of the largest count, which is taken as at least 1."""
    share = count / F.greatest(largest, F.lit(1))
    passed = [F.when(share >= cut, F.lit(1)).otherwise(F.lit(0)) for cut in cuts]
    return sum(passed[1:], passed[0]).cast("int")


def magnitude(count: Column, largest: Column, method: str = "sqrt") -> Column:
    """Size relative to the largest count (at least 1): sqrt, log or linear."""
    top = F.greatest(largest, F.lit(1))
    if method == "log":
        return F.log10(count + 1) / F.log10(top + 1)
    if method == "linear":
        return count / top
    return F.sqrt(count) / F.sqrt(top)


def population_class(
    population: Column,
    thresholds: Sequence[int | None] = POPULATION_THRESHOLDS,
    strict: bool = False,
) -> Column:
    """Highest threshold that the population exceeds; none exceeded → class 0.

    An open (None) threshold is ignored, unless ``strict``, where it always matches.
    """
    chosen = F.lit(0)
    for number, threshold in enumerate(thresholds):
        if threshold is not None:
            chosen = F.when(population > threshold, F.lit(number)).otherwise(chosen)
        elif strict:
            chosen = F.lit(number)
    return chosen.cast("int")


def utm_zone_number(lon: Column) -> Column:
    """UTM zone of a longitude; the quotient is cut towards zero."""
    return (((lon + 180) / 6).cast("bigint") % 60 + 1).cast("int")


def utm_epsg(zone: Column, lat: Column) -> Column:
    """EPSG code of a UTM zone: 326xx north, 327xx south of the equator."""
    return (F.lit(32600) + zone + F.when(lat < 0, F.lit(100)).otherwise(F.lit(0))).cast("int")
