"""Exact interpolated quantiles by histogram refinement, without sorting a column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from popatlas.plans.joins import join_on_keys
from popatlas.plans.sizing import sized_broadcast
from popatlas.plans.storage import stored

# Buckets of one round, and how many values are few enough to be told apart at once.
BUCKETS = 1 << 16
# Buckets for each doubling of the magnitude in the first round: at most 2 x 2098 doublings.
PER_DOUBLING = 8
_ZERO = 1 << 20

BRACKET = ["lo", "hi", "below", "inside", "ranks"]


def _magnitude(value: Column) -> Column:
    """A bucket that grows with the value: by sign, then by the logarithm of its size.

    A rounded logarithm still never falls while its argument grows, so buckets are in the
    order of the values, whatever side of a border a value falls on.
    """
    size = F.floor(F.log2(F.abs(value)) * PER_DOUBLING)
    return (
        F.when(value > 0, F.lit(_ZERO) + size).when(value < 0, -F.lit(_ZERO) - size).otherwise(F.lit(0))
    ).cast("double")


def _within(value: Column, buckets: int) -> Column:
    """A bucket of the value in its bracket: the value itself where the bracket holds few,
    else its place between the ends, which also never falls while the value grows."""
    lo, hi = F.col("_b.lo"), F.col("_b.hi")
    place = F.floor((value - lo) / (hi - lo) * buckets).cast("double")
    return F.when(F.col("_b.inside") <= buckets, value).otherwise(place)


def _narrowed(tally: DataFrame, keys: Sequence[str], by: Sequence[str], ranks: Column) -> DataFrame:
    """The buckets that hold a wanted rank, as brackets. ``tally`` has a row per bucket."""
    upto = Window.partitionBy(*keys, *by).orderBy("_bucket")
    before = F.coalesce(
        F.sum("_c").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    return (
        tally.withColumn("below", F.col("_below") + before)
        .withColumn(
            "ranks",
            F.filter(
                ranks, lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("_c"))
            ),
        )
        .where(F.size("ranks") > 0)
        .select(
            *keys,
            "_n",
            F.col("_min").alias("lo"),
            F.col("_max").alias("hi"),
            "below",
            F.col("_c").alias("inside"),
            "ranks",
        )
    )


def _rank(prob: Column, n: Column, above: bool) -> Column:
    low = F.floor(prob * (n - 1))
    return F.least(low + 1, n - 1) if above else low


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    keys: Sequence[str] = (),
    *,
    groups: int | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """``keys, prob, quantile`` by linear interpolation over the finite values; NULL keys
    form a group.

    A round counts values by bucket, map-side first, with the smallest and the largest
    value of each bucket. Counts tell which buckets hold the wanted ranks; only their values
    go on to the next round, in finer buckets between those two values. A bracket of at
    most ``buckets`` values takes the values themselves as buckets, so the round after is
    its last; otherwise a round divides its width by ``buckets``, and it ends in any case
    when its smallest and largest value agree. Nothing is estimated: buckets follow the
    order of the values and ranks are counts. No task gets more rows than buckets times
    brackets of a group.

    Rounds run when this is called. ``groups`` is the number of key groups when the caller
    knows it; it decides whether brackets may be broadcast, and is counted otherwise.
    """
    keys = list(keys)
    raw = F.col(value).cast("double")
    finite = raw.isNotNull() & ~F.isnan(raw) & (F.abs(raw) != F.lit(float("inf")))
    rows = df.where(finite).select(*keys, raw.alias("_v"))
    counts = [F.count("*").alias("_c"), F.min("_v").alias("_min"), F.max("_v").alias("_max")]
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    ranks = F.array_distinct(
        F.flatten(
            F.transform(
                wanted,
                lambda p: F.array(_rank(p, F.col("_n"), False), _rank(p, F.col("_n"), True)),
            )
        )
    )
    tally = rows.groupBy(*keys, _magnitude(F.col("_v")).alias("_bucket")).agg(*counts)
    totalled = tally.withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys)))
    found = stored(
        _narrowed(totalled.withColumn("_below", F.lit(0).cast("bigint")), keys, [], ranks),
        "brackets",
    )
    done = [found.where("lo = hi")]
    active = found.where("lo < hi")
    while not active.isEmpty():
        bracket = F.struct(*BRACKET)
        packed = active.groupBy(*keys, "_n").agg(F.collect_list(bracket).alias("_brackets"))
        if keys:
            if groups is None:
                groups = packed.count()
            paired = join_on_keys(rows, sized_broadcast(packed, groups), keys)
        else:
            only = packed.select(F.struct("_n", "_brackets").alias("only")).scalar()
            paired = rows.withColumn("_only", only).select("_v", "_only.*")
        held = paired.withColumn("_b", F.explode("_brackets")).where(
            (F.col("_v") >= F.col("_b.lo")) & (F.col("_v") <= F.col("_b.hi"))
        )
        tally = (
            held.groupBy(*keys, "_n", "_b", _within(F.col("_v"), buckets).alias("_bucket"))
            .agg(*counts)
            .withColumn("_below", F.col("_b.below"))
        )
        found = stored(_narrowed(tally, keys, ["_b"], F.col("_b.ranks")), "brackets")
        done.append(found.where("lo = hi"))
        active = found.where("lo < hi")
    values = done[0]
    for more in done[1:]:
        values = values.unionByName(more)
    by_rank = values.select(*keys, "_n", F.explode("ranks").alias("_rank"), F.col("lo").alias("_v"))
    at = by_rank.groupBy(*keys, "_n").agg(
        F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at")
    )
    n, prob = F.col("_n"), F.col("prob")
    position = prob * (n - 1)
    low = F.element_at("_at", _rank(prob, n, False))
    high = F.element_at("_at", _rank(prob, n, True))
    return (
        at.select(*keys, "_n", "_at", F.explode(wanted).alias("prob"))
        .withColumn("quantile", low + (high - low) * (position - F.floor(position)))
        .select(*keys, "prob", "quantile")
    )
