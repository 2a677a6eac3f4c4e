"""Page arithmetic. Pages are 1-based, an empty listing has one page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_PER_PAGE = 50


def clamp_page(page: int) -> int:
    return max(1, int(page))


def clamp_per_page(per_page: int) -> int:
    return max(1, int(per_page))


def page_of(rank: Column, per_page: int) -> Column:
    """Page holding the row with this 0-based rank."""
    return F.floor(rank / F.lit(clamp_per_page(per_page))) + 1


def total_pages(total: Column, per_page: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(total / F.lit(clamp_per_page(per_page)))).cast("bigint")
