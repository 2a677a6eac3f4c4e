"""The geography tree: closure, levels, pre-order, subtree rows, relatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popatlas.model import NO_PARENT, World
from popatlas.plans.ranking import prefix_sum


def closure(w: World, max_depth: int | None = None) -> DataFrame:
    """``ancestor_id, descendant_id, depth``; every unit is its own ancestor at depth 0."""
    pairs = w.paths.select(
        F.col("geo_id").alias("descendant_id"), F.posexplode("path").alias("depth", "ancestor_id")
    ).select("ancestor_id", "descendant_id", "depth")
    return pairs if max_depth is None else pairs.where(F.col("depth") <= max_depth)


def descendants(w: World) -> DataFrame:
    """``geo_id, descendant_id, depth``, the unit itself excluded."""
    return (
        closure(w)
        .where("depth > 0")
        .select(F.col("ancestor_id").alias("geo_id"), "descendant_id", "depth")
    )


def levels(w: World) -> DataFrame:
    """Levels with their unit count; ``level_order`` sorts by first appearance."""
    return w.geo.groupBy("level").agg(
        F.min("ordinal").alias("level_order"), F.count("*").alias("units")
    )


def with_ancestors(facts: DataFrame, w: World, unit: str = "geo_id") -> DataFrame:
    """Repeat each fact row for its unit and every ancestor of it, as ``ancestor_id``."""
    paths = w.paths.select(F.col("geo_id").alias("_unit"), "path")
    return facts.join(paths, F.col(unit) == F.col("_unit")).select(
        *facts.columns, F.explode("path").alias("ancestor_id")
    )


def subtree_rows(facts: DataFrame, w: World, unit: int | None = None) -> DataFrame:
    """Facts in the subtree of ``unit``, or of every unit (``ancestor_id``) when None."""
    if unit is None:
        return with_ancestors(facts, w)
    inside = w.paths.where(F.array_contains("path", F.lit(unit).cast("bigint"))).select("geo_id")
    return facts.join(inside, "geo_id", "left_semi").withColumn(
        "ancestor_id", F.lit(unit).cast("bigint")
    )


def roots(w: World) -> DataFrame:
    """Units without a parent, and orphans, whose parent is absent (``is_orphan``)."""
    known = w.units.select(F.col("geo_id").alias("_known"))
    parent = F.coalesce("parent_id", F.lit(NO_PARENT)).alias("parent_id")
    units = w.geo.select("geo_id", "name", "level", parent)
    top = units.where(F.col("parent_id") == NO_PARENT).withColumn("is_orphan", F.lit(False))
    orphans = (
        units.where(F.col("parent_id") != NO_PARENT)
        .join(known, F.col("parent_id") == F.col("_known"), "left_anti")
        .withColumn("is_orphan", F.lit(True))
    )
    return top.unionByName(orphans)


def subtree_sizes(w: World) -> DataFrame:
    """``geo_id, size``: units in the subtree, the unit included."""
    return closure(w).groupBy(F.col("ancestor_id").alias("geo_id")).agg(F.count("*").alias("size"))


def preorder(w: World) -> DataFrame:
    """``geo_id, preorder, size``: the subtree of a unit is [preorder, preorder + size).

    A unit starts one after its parent, past the subtrees of its earlier siblings. That
    step is a running sum of subtree sizes among siblings, and a unit's number is the sum
    of the steps on its path, so no global sort is needed.
    """
    known = w.units.select(F.col("geo_id").alias("_parent"))
    siblings = (
        w.geo.select("geo_id", "ordinal", "parent_id")
        .join(known, F.col("parent_id") == F.col("_parent"), "left")
        .select("geo_id", "ordinal", F.coalesce("_parent", F.lit(NO_PARENT)).alias("parent"))
        .join(subtree_sizes(w), "geo_id")
    )
    steps = prefix_sum(
        siblings, "ordinal", value="size", keys=["parent"], ties=["geo_id"], name="earlier"
    ).select(
        F.col("geo_id").alias("ancestor_id"),
        "size",
        F.when(F.col("parent") == NO_PARENT, F.col("earlier"))
        .otherwise(F.col("earlier") + 1)
        .alias("step"),
    )
    own_size = F.when(F.col("ancestor_id") == F.col("descendant_id"), F.col("size"))
    return (
        closure(w)
        .join(steps, "ancestor_id")
        .groupBy(F.col("descendant_id").alias("geo_id"))
        .agg(F.sum("step").alias("preorder"), F.max(own_size).alias("size"))
    )


def child_counts(w: World) -> DataFrame:
    """``geo_id, children_count`` for units that have children."""
    return (
        w.geo.where(F.col("parent_id") != NO_PARENT)
        .groupBy(F.col("parent_id").alias("geo_id"))
        .agg(F.count("*").alias("children_count"))
    )


def family(w: World, population: DataFrame) -> DataFrame:
    """Parents and children of every unit, one relative per row.

    ``population`` is ``geo_id, population``; a relative without one counts 0.
    """
    relative = w.geo.select(
        F.col("geo_id").alias("relative_id"),
        F.col("name").alias("relative_name"),
        F.col("level").alias("relative_level"),
        F.col("parent_id").alias("_up"),
        F.col("ordinal").alias("position"),
    ).join(population.select(F.col("geo_id").alias("relative_id"), "population"), "relative_id", "left")
    # Every parent link is seen from both ends: the parent's child and the child's parent.
    known = w.units.select(F.col("geo_id").alias("_parent"), *_prefixed(w.units, "p_"))
    with_parent = relative.join(
        known.join(
            population.select(F.col("geo_id").alias("_parent"), F.col("population").alias("p_pop")),
            "_parent",
            "left",
        ),
        F.col("_up") == F.col("_parent"),
    )

    def side(unit: str, relation: str, *fields: Column):
        names = ["relative_id", "relative_name", "relative_level", "population", "position"]
        return F.struct(
            F.col(unit).alias("geo_id"),
            F.lit(relation).alias("relation"),
            *[f.alias(n) for f, n in zip(fields, names, strict=True)],
        )

    zero = F.lit(0).cast("bigint")
    both = F.array(
        side(
            "_parent",
            "child",
            F.col("relative_id"),
            F.col("relative_name"),
            F.col("relative_level"),
            F.coalesce("population", zero),
            F.col("position"),
        ),
        side(
            "relative_id",
            "parent",
            F.col("_parent"),
            F.col("p_name"),
            F.col("p_level"),
            F.coalesce("p_pop", zero),
            F.col("p_ordinal"),
        ),
    )
    return with_parent.select(F.explode(both).alias("r")).select("r.*")


def _prefixed(df: DataFrame, prefix: str) -> list[Column]:
    return [F.col(c).alias(prefix + c) for c in ("name", "level", "ordinal")]


def tree_nodes(w: World, stats: DataFrame) -> DataFrame:
    """One row per unit with population and venue count; root parents are NULL."""
    known = w.units.select(F.col("geo_id").alias("_parent"))
    return (
        w.geo.join(known, F.col("parent_id") == F.col("_parent"), "left")
        .join(stats.select("geo_id", "population", "venues_count"), "geo_id", "left")
        .select(
            "geo_id",
            "name",
            "level",
            F.col("_parent").alias("parent_id"),
            F.coalesce("population", F.lit(0)).cast("bigint").alias("population"),
            F.coalesce("venues_count", F.lit(0)).cast("bigint").alias("venues_count"),
        )
    )


def tree_totals(w: World, stats: DataFrame) -> DataFrame:
    """One row: units in the tree, and people as the sum of the root populations."""
    return tree_nodes(w, stats).agg(
        F.count("*").alias("units"),
        F.coalesce(F.sum(F.when(F.col("parent_id").isNull(), F.col("population"))), F.lit(0))
        .cast("bigint")
        .alias("people"),
    )
