"""Broadcast only after counting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A few narrow columns at this many rows stay near 100 MB on each executor.
BROADCAST_ROWS = 2_000_000
# Rows that one task sorts or groups at once, and from how many tasks on they are told apart.
TASK_ROWS = 1 << 19
SPREAD_TASKS = 8


def fits(rows: int) -> bool:
    """Whether a counted number of rows may be broadcast."""
    return rows <= BROADCAST_ROWS


def sized_broadcast(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Hint ``df`` for broadcast when its row count (counted unless known) is small, else
    leave the choice of a shuffle join, with skew splitting, to the optimizer."""
    return F.broadcast(df) if fits(df.count() if rows is None else rows) else df


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """A large ``df`` (of a counted number of ``rows``) dealt by ``keys`` so that a task's share
    stays the same however large it is; the optimizer, left alone, merges compressed shares
    without regard to the memory their rows take. A small one is left as it is."""
    tasks = rows // TASK_ROWS
    return df if tasks < SPREAD_TASKS else df.repartition(tasks, *keys)
