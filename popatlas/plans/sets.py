"""Sets over a short list of names, one bit per name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_NAMES = 62


def short_list(df: DataFrame, column: str) -> list[str] | None:
    """The distinct values in order, or None when there are more than fit one mask."""
    found = df.where(F.col(column).isNotNull()).select(column).distinct().limit(MAX_NAMES + 1)
    names = sorted(row[0] for row in found.collect())
    return names if len(names) <= MAX_NAMES else None


def mask_of(column: str, names: Sequence[str]) -> Column:
    """The bit of a row's name."""
    bit = F.lit(0).cast("bigint")
    for number, name in enumerate(names):
        bit = F.when(F.col(column) == name, F.lit(1 << number).cast("bigint")).otherwise(bit)
    return bit


def has_bit(mask: str, number: int) -> Column:
    return F.col(mask).bitwiseAND(F.lit(1 << number).cast("bigint")) != 0


def names_in(mask: str, names: Sequence[str]) -> Column:
    """The names whose bits are set, as an array."""
    chosen = [F.when(has_bit(mask, i), F.lit(name)) for i, name in enumerate(names)]
    return F.array_compact(F.array(*chosen)) if chosen else F.array().cast("array<string>")


def count_names(
    df: DataFrame, mask: str, names: Sequence[str], by: Sequence[str], name: str, n: str
) -> DataFrame:
    """``by, name, n``: rows per group that have each bit, in one aggregation."""
    if not names:
        none = F.lit(None).cast("string").alias(name), F.lit(None).cast("bigint").alias(n)
        return df.select(*by, *none).where(F.lit(False))
    counts = df.groupBy(*by).agg(
        *[F.count_if(has_bit(mask, i)).alias(f"_c{i}") for i in range(len(names))]
    )
    entries = [
        F.struct(F.lit(text).alias(name), F.col(f"_c{i}").alias(n))
        for i, text in enumerate(names)
    ]
    return counts.select(*by, F.explode(F.array(*entries)).alias("_e")).select(*by, "_e.*")
