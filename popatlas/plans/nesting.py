"""Ordered nested lists of bounded size, and maps by category."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popatlas.model import UNKNOWN

PART_SIZE = 100_000


def nest(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    fields: Sequence[str],
    name: str,
    part_size: int = PART_SIZE,
) -> DataFrame:
    """``keys, part, <name>``: rows as struct lists in ``position`` order (0-based, dense).

    A group longer than ``part_size`` continues in parts 1, 2, …, each its own row, so no
    task ever holds more than one part. Almost every group has part 0 only.
    """
    entry = F.struct(F.col(position).alias("_pos"), *[F.col(f) for f in fields])
    grouped = df.groupBy(*keys, F.expr(f"`{position}` div {int(part_size)}").alias("part")).agg(
        F.array_sort(F.collect_list(entry)).alias("_list")
    )
    return grouped.select(
        *keys,
        "part",
        F.transform("_list", lambda e: F.struct(*[e[f].alias(f) for f in fields])).alias(name),
    )


def labelled(category: str | Column) -> Column:
    """A category as the key of a map: text, ``UNKNOWN`` where it is missing.

    Map keys cannot be NULL. Rows must be grouped by this key, not by the bare category, so
    that missing ones and those stored as ``UNKNOWN`` make one entry.
    """
    column = F.col(category) if isinstance(category, str) else category
    return F.coalesce(column.cast("string"), F.lit(UNKNOWN))


def map_of(key: str, value: str, where: Column | None = None) -> Column:
    """Aggregates the rows of a group (those ``where``) to a map in the order of its keys,
    which must be :func:`labelled` and distinct. A group has as many rows as categories."""
    entry = F.struct(F.col(key), F.col(value))
    if where is not None:
        entry = F.when(where, entry)
    return F.map_from_entries(
        F.array_sort(F.collect_list(entry), lambda a, b: _compare(a[key], b[key]))
    )


def _compare(a: Column, b: Column) -> Column:
    return F.when(a < b, F.lit(-1)).when(a > b, F.lit(1)).otherwise(F.lit(0))
