"""Rounding of the binary value, as display figures are rounded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_to(value: Column, digits: int) -> Column:
    """Nearest multiple of 10^-digits, ties to even. ``round(value, digits)`` would round
    the decimal text, so 1.035, stored slightly below that, would become 1.04; it is also
    far slower, going through decimals."""
    scale = 10.0**digits
    return F.rint(value * scale) / F.lit(scale)
