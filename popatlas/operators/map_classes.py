"""Map classes and magnitudes relative to the largest count of a frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popatlas.functions import classify
from popatlas.plans.joins import join_on_keys


def _with_largest(df: DataFrame, by: Sequence[str], count: str) -> DataFrame:
    """Join the maximum per group: a group may hold every unit, so it is aggregated
    map-side and joined back, not windowed."""
    largest = df.groupBy(*by).agg(F.max(count).alias("largest"))
    return join_on_keys(df, largest, list(by))


def relative_classes(df: DataFrame, by: Sequence[str], count: str = "n") -> DataFrame:
    return _with_largest(df, by, count).withColumn(
        "class", classify.relative_class(F.col(count), F.col("largest"))
    )


def magnitudes(
    df: DataFrame, by: Sequence[str], method: str = "sqrt", count: str = "n"
) -> DataFrame:
    return _with_largest(df, by, count).withColumn(
        "magnitude", classify.magnitude(F.col(count), F.col("largest"), method)
    )


def count_classes(
    df: DataFrame, limits: Sequence[int | None] = classify.COUNT_LIMITS, count: str = "n"
) -> DataFrame:
    return df.withColumn("class", classify.count_class(F.col(count), limits))


def population_classes(
    df: DataFrame,
    thresholds: Sequence[int | None] = classify.POPULATION_THRESHOLDS,
    strict: bool = False,
) -> DataFrame:
    return df.withColumn(
        "class", classify.population_class(F.col("population"), thresholds, strict)
    )
