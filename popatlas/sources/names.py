"""Display names of units from a CSV file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popatlas.plans.sizing import sized_broadcast


def read_display_names(
    spark: SparkSession, path: str, id_column: str, name_column: str
) -> DataFrame:
    """``id, display_name``: both trimmed, blank ids dropped, the last duplicate kept.

    "Last" is by file and position in it, so the order is that of the stored rows.
    """
    raw = spark.read.csv(path, header=True)
    place = F.struct(
        F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
    )
    rows = raw.select(
        F.trim(F.coalesce(id_column, F.lit(""))).alias("id"),
        F.trim(F.coalesce(name_column, F.lit(""))).alias("display_name"),
        place.alias("_place"),
    )
    return (
        rows.where(F.col("id") != "")
        .groupBy("id")
        .agg(F.max_by("display_name", "_place").alias("display_name"))
    )


def with_display_names(geo: DataFrame, names: DataFrame) -> DataFrame:
    """Add ``display_name`` by unit name, NULL where the file has none."""
    side = names.select(F.col("id").alias("_named"), "display_name")
    return geo.join(sized_broadcast(side), F.col("name") == F.col("_named"), "left").drop("_named")
