"""Pages of an ordered listing, and the size report of a budgeted selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popatlas.functions.paging import (
    DEFAULT_PER_PAGE,
    clamp_page,
    clamp_per_page,
    page_of,
    total_pages,
)
from popatlas.plans.ranking import prefix_sum, rank_slice


def paginate(
    df: DataFrame,
    order: str = "ordinal",
    page: int = 1,
    per_page: int = DEFAULT_PER_PAGE,
    ties: Sequence[str] = (),
) -> DataFrame:
    """The rows of one page, with their 0-based ``rank``. Past the end: no rows.

    A deep page costs no more than the first one: see :func:`rank_slice`.
    """
    page, per_page = clamp_page(page), clamp_per_page(per_page)
    return rank_slice(df, order, (page - 1) * per_page, page * per_page, ties=ties)


def page_info(df: DataFrame, page: int = 1, per_page: int = DEFAULT_PER_PAGE) -> DataFrame:
    """One row: total, total_pages (at least 1), page, per_page."""
    return df.agg(F.count("*").alias("total")).select(
        "total",
        total_pages(F.col("total"), per_page).alias("total_pages"),
        F.lit(clamp_page(page)).alias("page"),
        F.lit(clamp_per_page(per_page)).alias("per_page"),
    )


def all_pages(
    df: DataFrame,
    order: str = "ordinal",
    per_page: int = DEFAULT_PER_PAGE,
    keys: Sequence[str] = (),
    ties: Sequence[str] = (),
) -> DataFrame:
    """Every row with its ``rank`` and ``page`` in the listing of its ``keys``."""
    ranked = prefix_sum(df, order, keys=keys, ties=ties)
    return ranked.withColumn("page", page_of(F.col("rank"), per_page))


def take_within_bytes(
    df: DataFrame, order: str, size: str, budget: int, start: int = 0
) -> DataFrame:
    """Mark what fits a size budget when records are written in ``order``.

    Adds ``bytes_before`` (``start`` included) and ``kept``. Writing goes on while the
    bytes written so far are within the budget, so the record that crosses it is kept.
    Nothing is kept when ``start`` has used up the budget.
    """
    running = prefix_sum(df, order, value=size, name="_before")
    return (
        running.withColumn("bytes_before", F.col("_before") + F.lit(start))
        .withColumn("kept", (F.col("bytes_before") <= budget) & F.lit(start < budget))
        .drop("_before")
    )


def budget_report(marked: DataFrame, size: str) -> DataFrame:
    """One row: kept and dropped record counts and the bytes kept."""
    return marked.agg(
        F.count_if("kept").alias("kept"),
        F.count_if(~F.col("kept")).alias("dropped"),
        F.coalesce(F.sum(F.when(F.col("kept"), F.col(size))), F.lit(0))
        .cast("bigint")
        .alias("kept_bytes"),
    )
