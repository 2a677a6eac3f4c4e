"""Playback frames: rolling-window counts at every step of a time grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from popatlas.functions.decode import has_coordinates
from popatlas.functions.rounding import round_to
from popatlas.model import EventLog, World
from popatlas.operators.events import (
    PER,
    count_by_unit,
    of_types,
    rate_population,
    resolve_geo,
)

# Windows wider than this many steps are counted by differences.
MANY_FRAMES = 2


def _grid(log: EventLog, step: float) -> DataFrame:
    """One row: the first event time ``t0``, and the index ``last`` of the last frame.

    Frames stand at t0 + k·step up to the last event, with a hundredth of a step of grace;
    events after the last frame are in no frame.
    """
    ends = log.events.agg(F.min("time").alias("t0"), F.max("time").alias("t1"))
    steps = F.floor((F.col("t1") + step * 0.01 - F.col("t0")) / step)
    # The quotient may round across a whole number; the sum decides.
    fits = F.col("t0") + (steps + 1) * step <= F.col("t1") + step * 0.01
    over = F.col("t0") + steps * step > F.col("t1") + step * 0.01
    last = F.when(fits, steps + 1).when(over, steps - 1).otherwise(steps)
    return ends.select("t0", last.cast("bigint").alias("last"))


def frame_time(t0: Column, frame: Column, step: float) -> Column:
    return round_to(t0 + frame * F.lit(float(step)), 6)


def _first_true(candidate: Column, holds) -> Column:
    """Of candidate − 1, candidate, candidate + 1 the first for which ``holds``."""
    return (
        F.when(holds(candidate - 1), candidate - 1)
        .when(holds(candidate), candidate)
        .otherwise(candidate + 1)
    )


def bake_frames(
    log: EventLog, step: float = 1.0, width: float = 1.0, types: Sequence[str] | None = None
) -> DataFrame:
    """``event_type, frame, geo_id, n``, only where n > 0: events within [t_k − width, t_k].

    Each event falls in one run of consecutive frames, found by arithmetic; the closed
    bounds are tested exactly, on the frame times rounded to 6 decimals. Where windows
    overlap a lot, counting works by differences: a run adds its events at its first frame
    and takes them away after its last, so at most two rows per run are shuffled however
    wide the windows are, and a running sum gives the counts. Otherwise an event has one or
    two frames and a single aggregation does.
    """
    grid = _grid(log, step)
    t0, last = grid.select("t0").scalar(), grid.select("last").scalar()
    timed = (
        of_types(log.events, types)
        .withColumn("_t0", t0)
        .withColumn("_last", last.cast("bigint"))
    )
    moment, start = F.col("time"), F.col("_t0")

    def at(frame: Column) -> Column:
        return frame_time(start, frame, step)

    lower = F.ceil((moment - start) / step)
    upper = F.floor((moment - start + width) / step)
    # First frame not before the event; last frame whose window still reaches it, found
    # as one before the first frame whose window does not.
    first = _first_true(lower, lambda k: at(k) >= moment)
    past = _first_true(upper + 1, lambda k: at(k) - F.lit(float(width)) > moment)
    runs = timed.withColumn("_first", F.greatest(first, F.lit(0).cast("bigint"))).withColumn(
        "_final", F.least(past - 1, F.col("_last"))
    )
    inside = runs.where(F.col("_first") <= F.col("_final")).drop("_t0", "_last")
    frame = F.explode(F.sequence("_first", "_final")).alias("frame")
    if width <= MANY_FRAMES * step:
        located = resolve_geo(inside.select("*", frame).drop("_first", "_final"), log)
        return located.groupBy("event_type", "frame", "geo_id").agg(F.count("*").alias("n"))
    counted = count_by_unit(inside, log, ["event_type", "_first", "_final"])
    return _summed_differences(counted)


def _summed_differences(runs: DataFrame) -> DataFrame:
    """``event_type, frame, geo_id, n`` from runs ``_first, _final`` of ``n`` events each.

    A (type, unit) has at most one difference a frame, so a window partition is as long as
    the time grid at most. Between two differences the count stays as it is.
    """
    ends = F.explode(
        F.array(
            F.struct(F.col("_first").alias("at"), F.col("n").alias("by")),
            F.struct((F.col("_final") + 1).alias("at"), (-F.col("n")).alias("by")),
        )
    )
    differences = (
        runs.select("event_type", "geo_id", ends.alias("d"))
        .groupBy("event_type", "geo_id", "d.at")
        .agg(F.sum("d.by").alias("by"))
        .where("by <> 0")
    )
    order = Window.partitionBy("event_type", "geo_id").orderBy("at")
    level = F.sum("by").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return (
        differences.withColumn("n", level.cast("bigint"))
        .withColumn("_until", F.lead("at").over(order) - 1)
        .where("n > 0")
        .select(
            "event_type", F.explode(F.sequence("at", "_until")).alias("frame"), "geo_id", "n"
        )
    )


def cumulate_frames(frames: DataFrame) -> DataFrame:
    """Add ``total``: the running sum over the frames of each (type, unit).

    A unit's total at frame k is that of its last row at or before k. Touching windows
    count border events twice, and so does this sum. A (type, unit) has at most one row
    per frame, so a window partition is as long as the time grid at most.
    """
    so_far = (
        Window.partitionBy("event_type", "geo_id")
        .orderBy("frame")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return frames.withColumn("total", F.sum("n").over(so_far))


def frame_index(log: EventLog, time: float, step: float = 1.0) -> DataFrame:
    """One row ``frame``: the grid index nearest to ``time`` (halves go up), clamped."""
    nearest = F.floor((F.lit(float(time)) - F.col("t0")) / F.lit(float(step)) + 0.5)
    return _grid(log, step).select(
        F.least(F.greatest(nearest, F.lit(0)), F.col("last")).cast("bigint").alias("frame")
    )


def frame_at(
    log: EventLog, frames: DataFrame, time: float, step: float = 1.0, cumulative: bool = False
) -> DataFrame:
    """Rows of the frame nearest to ``time``; cumulative: sums over all frames up to it."""
    wanted = frame_index(log, time, step).select("frame").scalar()
    if not cumulative:
        return frames.where(F.col("frame") == wanted)
    return (
        frames.where(F.col("frame") <= wanted)
        .groupBy("event_type", "geo_id")
        .agg(F.sum("n").cast("bigint").alias("n"))
    )


def geo_lookup(w: World) -> DataFrame:
    """Units with coordinates, and their population where a rate has a denominator."""
    return (
        w.geo.where(has_coordinates())
        .select("geo_id", "lat", "lon")
        .join(rate_population(w), "geo_id", "left")
    )


def frame_features(frames: DataFrame, lookup: DataFrame, per: int = PER) -> DataFrame:
    """Frame counts with place and rate; units missing from ``lookup`` are skipped."""
    rate = F.when(F.col("population") > 0, F.col("n") / F.col("population") * per)
    return frames.join(lookup, "geo_id").withColumn("rate", F.coalesce(rate, F.lit(0.0)))
