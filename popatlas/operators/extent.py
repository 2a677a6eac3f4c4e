"""Spatial extent of units."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popatlas.functions.classify import utm_epsg, utm_zone_number
from popatlas.functions.decode import has_coordinates
from popatlas.plans.quantiles import exact_quantiles


def extent(geo: DataFrame, by: Sequence[str] = ("level",)) -> DataFrame:
    """Bounding box of the units with coordinates."""
    return (
        geo.where(has_coordinates())
        .groupBy(*by)
        .agg(
            F.min("lat").alias("south"),
            F.max("lat").alias("north"),
            F.min("lon").alias("west"),
            F.max("lon").alias("east"),
        )
    )


def utm_zone(geo: DataFrame) -> DataFrame:
    """One row ``zone, epsg``: zone of the median longitude, hemisphere of the median
    latitude. No row when no unit has coordinates."""
    shown = geo.where(has_coordinates()).select(
        F.explode(
            F.array(
                F.struct(F.lit("lat").alias("axis"), F.col("lat").alias("degrees")),
                F.struct(F.lit("lon").alias("axis"), F.col("lon").alias("degrees")),
            )
        ).alias("c")
    )
    medians = (
        exact_quantiles(shown.select("c.*"), "degrees", [0.5], ["axis"], groups=2)
        .agg(
            F.max(F.when(F.col("axis") == "lat", F.col("quantile"))).alias("lat"),
            F.max(F.when(F.col("axis") == "lon", F.col("quantile"))).alias("lon"),
        )
        .where(F.col("lat").isNotNull())
    )
    return medians.withColumn("zone", utm_zone_number(F.col("lon"))).select(
        "zone", utm_epsg(F.col("zone"), F.col("lat")).alias("epsg")
    )
