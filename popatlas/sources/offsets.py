"""Offset-encoded lists: every owner has a start position in one long value array."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16


def expand_offsets(offsets: DataFrame, values: DataFrame, block: int = BLOCK) -> DataFrame:
    """``owner, seq, value`` from ``offsets (idx, owner, start)`` and ``values (pos, value)``.

    An owner's list runs to the start of the next owner (by ``idx``, dense), the last one
    to the end of the array; an empty list gives no rows.

    Positions are cut into blocks. Each owner places one marker at its start and one at
    the head of every further block it reaches, and each value takes the latest marker
    before it in its block. No join key exists, so one owner with most of the values
    spreads over all of its blocks like any other.
    """
    length = values.agg(F.coalesce(F.max("pos") + 1, F.lit(0)).alias("n")).select("n").scalar()
    following = offsets.select(
        (F.col("idx") - 1).alias("idx"), F.col("start").alias("_next")
    )
    lists = (
        offsets.join(following, "idx", "left")
        .withColumn("_end", F.coalesce("_next", length))
        .where(F.col("start") < F.col("_end"))
    )
    blocks = F.sequence(F.expr(f"start div {block}"), F.expr(f"(_end - 1) div {block}"))
    markers = lists.select("owner", "start", F.explode(blocks).alias("_block")).select(
        "_block",
        F.greatest(F.col("start"), F.col("_block") * block).alias("_pos"),
        F.lit(0).alias("_is_value"),
        F.struct("owner", "start").alias("_list"),
        F.lit(None).cast(values.schema["value"].dataType).alias("value"),
    )
    cells = values.select(
        F.expr(f"pos div {block}").alias("_block"),
        F.col("pos").alias("_pos"),
        F.lit(1).alias("_is_value"),
        F.lit(None).cast(markers.schema["_list"].dataType).alias("_list"),
        "value",
    )
    earlier = (
        Window.partitionBy("_block")
        .orderBy("_pos", "_is_value")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    owned = markers.unionByName(cells).withColumn(
        "_list", F.last("_list", ignorenulls=True).over(earlier)
    )
    return owned.where((F.col("_is_value") == 1) & F.col("_list").isNotNull()).select(
        F.col("_list.owner").alias("owner"),
        (F.col("_pos") - F.col("_list.start")).alias("seq"),
        "value",
    )
