"""Joins on keys that may be NULL."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TIMES = ("date", "timestamp", "timestamp_ntz")


def join_on_keys(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """``left`` with the other columns of ``right``, NULL keys equal to each other, as
    ``groupBy`` takes them. Still an equality join, so it shuffles or broadcasts as usual.
    """
    renamed = right.withColumnsRenamed({k: f"_on_{k}" for k in keys})
    same = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in keys], F.lit(True)
    )
    return left.join(renamed, same, how).drop(*[f"_on_{k}" for k in keys])


def plain_names(keys: Sequence[str]) -> list[str]:
    """The columns that :func:`plain_keys` adds."""
    return [f"_{part}_{k}" for k in keys for part in ("plain", "null")]


def plain_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with a value and a mark for each key that tell NULL keys apart and are never NULL.

    Unlike keys compared as in :func:`join_on_keys` they may serve a window and a plain join
    alike, which then share one shuffle and one sort.
    """
    types = dict(df.dtypes)
    added = {}
    for k in keys:
        zero = "" if types[k] == "string" else "1970-01-01" if types[k] in _TIMES else 0
        added[f"_plain_{k}"] = F.coalesce(F.col(k), F.lit(zero).cast(types[k]))
        added[f"_null_{k}"] = F.col(k).isNull()
    return df.withColumns(added)
