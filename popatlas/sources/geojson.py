"""Map features as GeoJSON text, one feature per line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def geojson_features(
    df: DataFrame, props: Sequence[str], lat: str = "lat", lon: str = "lon"
) -> DataFrame:
    """Add ``feature``: a GeoJSON point feature, coordinates as [lon, lat].

    Rows without coordinates have no feature and are left out.
    """
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(*props).alias("properties"),
        F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias(
            "geometry"
        ),
    )
    shown = df.where(F.col(lat).isNotNull() & ~F.isnan(lat))
    return shown.withColumn("feature", F.to_json(feature, {"ignoreNullFields": "false"}))


def write_geojson(
    df: DataFrame,
    path: str,
    props: Sequence[str],
    by: Sequence[str] = (),
    mode: str = "error",
) -> None:
    """One feature per line, in a directory per ``by`` value (level, event type, …)."""
    features = geojson_features(df, props)
    features.select(*by, F.col("feature").alias("value")).write.partitionBy(*by).mode(mode).text(
        path
    )
