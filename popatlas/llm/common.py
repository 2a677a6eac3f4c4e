"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from popatlas.plans.storage import new_folder, shared_folder, stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


BATCH_ROWS = 1000


def long_rows(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on hands rows to Python in batches of ``BATCH_ROWS`` at
    most: whole texts are long, and a batch takes memory in the executor and its worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def whole_text(column: str) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores added as keep them apart from the columns of
    ``df`` (and of each other's case), so that no column passed through is overwritten."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` stored, as it must be where rows are numbered: a lineage that is run twice may
    number them differently. Without a shared folder this fails instead."""
    if shared_folder(df.sparkSession) is None:
        new_folder(df.sparkSession, name)  # says which setting is missing
    return stored(df, name)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, unlike ``lower`` which folds every script."""
    return F.translate(text, UPPER, UPPER.lower())


def utf8(text: Column) -> Column:
    return text.cast("binary")


def number_rows(df: DataFrame, order: Sequence[str], name: str, at: str) -> DataFrame:
    """``df`` stored in ``order`` with its gapless 0-based row number in the column ``at``.

    The rows are dealt by range, sorted per partition and stored. One row per partition
    then gives what lies before each partition, so no task numbers more than its own rows.
    Rows that agree in all of ``order`` are told apart by where they were read, so many
    equal rows spread over many ranges too.
    """
    tie = "_read_at"
    dealt = (
        df.withColumn(tie, F.monotonically_increasing_id())
        .repartitionByRange(*order, tie)
        .sortWithinPartitions(*order, tie)
        .drop(tie)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    kept = settled(dealt, name)
    # The id is the partition's number times 2^33 plus the row's place in the partition.
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        kept.groupBy(part.alias("_part"))
        .count()
        .select("_part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
    )
    return (
        kept.withColumn("_part", part)
        .withColumn("_place", place)
        .join(F.broadcast(before), "_part")  # a row per partition
        .withColumn(at, F.col("_before") + F.col("_place"))
        .drop("_part", "_place", "_before", "_id")
    )
