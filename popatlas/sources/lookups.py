"""Lookup tables and code registries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popatlas.functions.decode import sex_label
from popatlas.model import UNKNOWN
from popatlas.plans.sizing import sized_broadcast


def latest_lookup(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """``key, value``: of several rows for one key the last one by ``order`` counts."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def decode(
    df: DataFrame, code: str, registry: DataFrame, name: str, default: str = UNKNOWN
) -> DataFrame:
    """Add ``name``: the registry label (``code, label``) of ``code``, else ``default``."""
    side = registry.select(F.col("code").alias("_code"), F.col("label").alias("_label"))
    return (
        df.join(sized_broadcast(side), F.col(code) == F.col("_code"), "left")
        .withColumn(name, F.coalesce("_label", F.lit(default)))
        .drop("_code", "_label")
    )


def decode_sex(df: DataFrame, code: str, name: str = "sex") -> DataFrame:
    return df.withColumn(name, sex_label(F.col(code)))
