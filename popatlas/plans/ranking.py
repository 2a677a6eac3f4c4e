"""Running sums and ranks that never put one group, or the whole table, in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from popatlas.plans.joins import join_on_keys, plain_keys, plain_names
from popatlas.plans.sizing import fits

BUCKET_WIDTH = 1 << 20
# Slices in one run of the running sum over slices. A 64-bit order has at most 2^44 slices,
# so neither a run nor the list of runs exceeds 2^22 rows per group, however sparse it is.
RUN = 1 << 22


def _bucket(order: str, width: int) -> Column:
    return F.expr(f"`{order}` div {int(width)}")


def bucket_offsets(
    df: DataFrame, order: str, keys: Sequence[str], value: Column, width: int
) -> DataFrame:
    """``keys, _bucket, _sum, _offset``: sum per slice of the order and the sum before it.

    The slices are pre-aggregated, so the running sum sees one row per ``width`` ordinals.
    """
    sums = df.groupBy(*keys, _bucket(order, width).alias("_bucket")).agg(
        F.sum(value).alias("_sum")
    )
    return slice_offsets(sums, keys)


def slice_offsets(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``_offset``, the sum before it, to each slice ``keys, _bucket, _sum``.

    The running sum is taken in runs of ``RUN`` slices and shifted by the total of the runs
    before, so spread-out orders (hashed ids), where every row is a slice, do not meet in
    one task.
    """
    sums = sums.withColumn("_run", F.expr(f"_bucket div {int(RUN)}"))

    def before(by: Sequence[str], order: str) -> Column:
        earlier = (
            Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        )
        return F.coalesce(F.sum("_sum").over(earlier), F.lit(0))

    runs = sums.groupBy(*keys, "_run").agg(F.sum("_sum").alias("_sum"))
    starts = runs.withColumn("_start", before(keys, "_run")).drop("_sum")
    placed = sums.withColumn("_within", before([*keys, "_run"], "_bucket"))
    return (
        join_on_keys(placed, starts, [*keys, "_run"])
        .withColumn("_offset", F.col("_start") + F.col("_within"))
        .drop("_run", "_start", "_within")
    )


def prefix_sum(
    df: DataFrame,
    order: str,
    *,
    value: str | None = None,
    keys: Sequence[str] = (),
    ties: Sequence[str] = (),
    width: int | None = None,
    name: str = "rank",
    offsets: DataFrame | None = None,
) -> DataFrame:
    """Add the sum of ``value`` over the earlier rows of the group; without ``value``, the
    0-based rank.

    ``order`` is an integer position (file order), NULL before all others; ``ties`` break
    equal positions. NULL keys form a group. The
    order is cut into slices of ``width``; each slice of each group is sorted on its own
    and shifted by the total of the slices before it, so a group with a third of all rows
    is spread over as many tasks as it has slices.

    ``offsets`` (:func:`slice_offsets`) may be handed in where they are known already; rows
    of groups that they do not list get NULL.
    """
    keys, width = list(keys), width or BUCKET_WIDTH
    amount = F.lit(1) if value is None else F.col(value)
    how = "inner" if offsets is None else "left"
    if offsets is None:
        offsets = bucket_offsets(df, order, keys, amount, width)
    # The window and the join ask for the same columns, so the rows are shuffled and sorted once.
    slices = [*keys, "_bucket"]
    plain = plain_names(slices)
    within = Window.partitionBy(*plain).orderBy(order, *ties)
    if value is None:
        local = F.row_number().over(within) - 1
    else:
        before = within.rowsBetween(Window.unboundedPreceding, -1)
        local = F.coalesce(F.sum(amount).over(before), F.lit(0))
    sliced = plain_keys(df.withColumn("_bucket", _bucket(order, width)), slices)
    return (
        sliced.withColumn("_local", local)
        .join(plain_keys(offsets.select(*slices, "_offset"), slices).drop(*slices), plain, how)
        .withColumn(name, F.col("_offset") + F.col("_local"))
        .drop(*plain, "_bucket", "_local", "_offset")
    )


def rank_slice(
    df: DataFrame,
    order: str,
    start: int,
    stop: int,
    *,
    ties: Sequence[str] = (),
    width: int | None = None,
    name: str = "rank",
) -> DataFrame:
    """The rows ranked ``[start, stop)`` by ``order``, with their rank.

    Only the order slices that overlap the range are sorted. Each of them holds at least
    one wanted row, so there are at most ``stop - start`` of them, which decides whether
    their list may be broadcast.
    """
    width = width or BUCKET_WIDTH
    touched = (
        bucket_offsets(df, order, [], F.lit(1), width)
        .where((F.col("_offset") < stop) & (F.col("_offset") + F.col("_sum") > start))
        .select("_bucket", "_offset")
    )
    within = Window.partitionBy("_bucket").orderBy(order, *ties)
    sliced = df.withColumn("_bucket", _bucket(order, width))
    if fits(stop - start):
        touched = F.broadcast(touched)
    return (
        join_on_keys(sliced, touched, ["_bucket"])
        .withColumn(name, F.col("_offset") + F.row_number().over(within) - 1)
        .where((F.col(name) >= start) & (F.col(name) < stop))
        .drop("_bucket", "_offset")
    )
