"""Decoding of stored codes and values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from popatlas.model import AGE_BREAKS, AGE_LABELS, SEX_CODES, UNKNOWN


def sex_label(code: Column) -> Column:
    """Sex code → label; any other value, NULL included, is ``unknown``."""
    label = F.lit(UNKNOWN)
    for number, text in SEX_CODES.items():
        label = F.when(code == number, F.lit(text)).otherwise(label)
    return label


def age_label(
    age: Column, breaks: Sequence[float] = AGE_BREAKS, labels: Sequence[str] = AGE_LABELS
) -> Column:
    """Half-open age class; NULL below the first break."""
    label = F.lit(None).cast("string")
    for lower, text in zip(breaks, labels, strict=True):
        label = F.when(age >= lower, F.lit(text)).otherwise(label)
    return label


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def has_coordinates() -> Column:
    """A record is on the map iff its latitude is a number."""
    return F.col("lat").isNotNull() & ~F.isnan("lat")


def text_or_id(text: Column, identifier: Column) -> Column:
    """A looked-up name, or the id as text when the lookup found nothing."""
    return F.coalesce(text, identifier.cast("string"))


def literal_rows(values: Sequence[str]) -> Column:
    """One row per literal, for ``select`` over a one-row frame."""
    return F.explode(F.array(*[F.lit(v) for v in values]))
