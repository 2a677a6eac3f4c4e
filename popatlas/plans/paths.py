"""Ancestor paths of a parent-linked tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popatlas.model import NO_PARENT
from popatlas.plans.sizing import sized_broadcast
from popatlas.plans.storage import stored


def _parent_links(geo: DataFrame) -> DataFrame:
    """``geo_id, path, _next``: each unit alone and its parent, NULL where it is missing."""
    parent = F.when(F.col("parent_id") != NO_PARENT, F.col("parent_id"))
    links = geo.select("geo_id", parent.alias("_up"))
    known = links.select(F.col("geo_id").alias("_known"))
    return links.join(sized_broadcast(known), F.col("_up") == F.col("_known"), "left").select(
        "geo_id", F.array("geo_id").alias("path"), F.col("_known").alias("_next")
    )


def unit_paths(geo: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``geo_id, path`` with the unit itself first and its root last.

    Every round appends to each unfinished path that of the unit it leads to, which doubles
    its length, so a tree of any depth takes log2(depth) rounds. A round is stored, or its
    lineage would double too. A missing parent ends the path. Cycles fail the query, as do
    paths of more than ``max_depth`` links where that is given.
    """
    climbing = stored(_parent_links(geo), "climbing")
    while True:
        leads_on = climbing.where(F.col("_next").isNotNull())
        if leads_on.isEmpty():
            break
        # Few units are led to: leaves never are, so this side stays far below the table.
        targets = leads_on.select(F.col("_next").alias("geo_id")).distinct()
        onward = sized_broadcast(climbing.join(targets, "geo_id", "left_semi")).select(
            F.col("geo_id").alias("_id"), F.col("path").alias("_more"), F.col("_next").alias("_then")
        )
        longer = leads_on.join(onward, F.col("_next") == F.col("_id")).select(
            "geo_id", F.concat("path", "_more").alias("path"), F.col("_then").alias("_next")
        )
        grown = _checked(longer, max_depth)
        climbing = stored(
            climbing.where(F.col("_next").isNull()).unionByName(grown), "climbing"
        )
    return climbing.select("geo_id", "path")


def _checked(paths: DataFrame, max_depth: int | None) -> DataFrame:
    fault = F.when(F.size(F.array_distinct("path")) < F.size("path"), "geography is cyclic")
    if max_depth is not None:
        deeper = f"geography is cyclic or deeper than {max_depth} links"
        fault = F.when(F.size("path") > max_depth + 1, deeper).otherwise(fault)
    return paths.withColumn(
        "path",
        F.when(fault.isNotNull(), F.raise_error(fault).cast("array<bigint>")).otherwise(
            F.col("path")
        ),
    )
