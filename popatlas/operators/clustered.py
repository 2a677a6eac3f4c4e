"""Facts stored in the order of the tree, so that a subtree is a range of the files.

Pre-order numbers make a subtree the interval ``[preorder, preorder + size)``. Facts tagged
with the number of their unit and written sorted by it keep a subtree together: a unit's
listing reads the row groups that its interval meets, found by their statistics, instead of
testing the unit of every fact against a list of paths. Facts of one unit lie in file order,
so a hot unit fills row groups of its own and its listing comes sorted within each.

The range partitioning samples the numbers once and cuts by (preorder, ordinal), so a unit
with a third of all facts is spread over many files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popatlas.functions.paging import DEFAULT_PER_PAGE, clamp_page
from popatlas.model import World
from popatlas.operators.hierarchy import preorder
from popatlas.operators.paging import all_pages, paginate
from popatlas.plans.ranking import prefix_sum
from popatlas.plans.sizing import sized_broadcast
from popatlas.plans.storage import stored

ROW_GROUP_BYTES = 16 << 20


def write_clustered(
    w: World,
    facts: DataFrame,
    path: str,
    files: int | None = None,
    row_group_bytes: int = ROW_GROUP_BYTES,
) -> None:
    """Write ``facts`` (with ``geo_id`` and ``ordinal``) and the intervals of the units.

    Facts of units that the tree does not know have no number; they are stored last and are
    in no subtree. ``files`` sets how many parts there are, else the session does.
    """
    intervals = stored(preorder(w), "intervals")
    intervals.write.mode("overwrite").parquet(f"{path}/units")
    numbers = sized_broadcast(intervals.select("geo_id", "preorder"), w.unit_count)
    tagged = facts.join(numbers, "geo_id", "left")
    order = [F.asc_nulls_last("preorder"), F.asc("ordinal")]
    dealt = tagged.repartitionByRange(*([files] if files else []), *order)
    (
        dealt.sortWithinPartitions(*order)
        .write.mode("overwrite")
        .option("parquet.block.size", row_group_bytes)
        .parquet(f"{path}/facts")
    )


class ClusteredFacts:
    """Facts written by :func:`write_clustered`."""

    def __init__(self, spark: SparkSession, path: str):
        self.facts = spark.read.parquet(f"{path}/facts")
        self.units = spark.read.parquet(f"{path}/units")

    def interval(self, unit: int) -> tuple[int, int]:
        """The numbers ``[first, last]`` of a subtree; none (1, 0) for an unknown unit."""
        found = self.units.where(F.col("geo_id") == unit).first()
        return (found["preorder"], found["preorder"] + found["size"] - 1) if found else (1, 0)

    def subtree(self, unit: int) -> DataFrame:
        """The facts in the subtree of a unit: a range filter that the scan prunes by."""
        first, last = self.interval(unit)
        return self.facts.where(F.col("preorder").between(first, last)).drop("preorder")

    def page(
        self, unit: int, page: int = 1, per_page: int = DEFAULT_PER_PAGE, ties: Sequence[str] = ()
    ) -> DataFrame:
        """One page of a unit's subtree in file order, with ``rank`` and ``page``."""
        rows = paginate(self.subtree(unit), page=page, per_page=per_page, ties=list(ties))
        return rows.withColumn("page", F.lit(clamp_page(page)).cast("bigint"))

    def pages(
        self, units: DataFrame, per_page: int = DEFAULT_PER_PAGE, ties: Sequence[str] = ()
    ) -> DataFrame:
        """The listings of many subtrees: ``ancestor_id``, the fact's columns, rank, page.

        The number of a fact's unit is looked up among the numbers that each wanted
        interval covers, an equality join over units alone; facts join once by number.
        """
        wanted = self.units.join(units.select("geo_id").distinct(), "geo_id", "left_semi")
        covered = wanted.select(
            F.col("geo_id").alias("ancestor_id"),
            F.explode(F.expr("sequence(preorder, preorder + size - 1)")).alias("preorder"),
        )
        listed = self.facts.join(sized_broadcast(covered), "preorder").drop("preorder")
        return all_pages(listed, per_page=per_page, keys=["ancestor_id"], ties=list(ties))

    def counts(self) -> DataFrame:
        """``geo_id, n`` of every subtree that has facts: the running count at the end of its
        interval less that at its start.

        Facts are counted per number first. Both ends of each interval are marks on the
        line of numbers, beside those counts; one running sum over the line, taken in slices,
        answers them all, so nothing climbs the tree, however deep it is.
        """
        per_number = (
            self.facts.where("preorder is not null")
            .groupBy(F.col("preorder").alias("at"))
            .agg(F.count("*").alias("_c"))
        )
        ends = F.array(
            F.struct(F.col("preorder").alias("at"), F.lit(-1).alias("sign")),
            F.struct((F.col("preorder") + F.col("size")).alias("at"), F.lit(1).alias("sign")),
        )
        marks = self.units.select("geo_id", F.explode(ends).alias("e")).select(
            "geo_id", "e.*", F.lit(0).cast("bigint").alias("_c")
        )
        # A mark stands before the count of its own number, which begins there.
        line = marks.unionByName(per_number, allowMissingColumns=True).withColumn(
            "_counted", F.col("geo_id").isNull()
        )
        summed = prefix_sum(line, "at", value="_c", ties=["_counted"], name="_before")
        return (
            summed.where("geo_id is not null")
            .groupBy("geo_id")
            .agg(F.sum(F.col("sign") * F.col("_before")).cast("bigint").alias("n"))
            .where("n > 0")
        )
