"""Counts and rates of located events per unit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popatlas.functions.decode import has_coordinates, literal_rows
from popatlas.model import EventLog, World
from popatlas.operators.unit_stats import direct_population, rollup
from popatlas.plans.sizing import fits

PER = 100_000
_SPREAD = 1 << 20


def event_summary(log: EventLog, types: Sequence[str]) -> DataFrame:
    """Rows per type, 0 for types without events, with the time range over all types."""
    counts = log.events.groupBy("event_type").agg(
        F.count("*").alias("n"), F.min("time").alias("_t0"), F.max("time").alias("_t1")
    )
    listed = log.events.sparkSession.range(1).select(literal_rows(types).alias("event_type"))
    # The counts have one row per type; the range is folded from the same rows.
    merged = counts.join(listed.withColumn("_listed", F.lit(True)), "event_type", "full")
    totals = merged.agg(F.min("_t0").alias("t0"), F.max("_t1").alias("t1"))
    zero = F.lit(0.0)
    return merged.select(
        "event_type",
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        F.coalesce(totals.select("t0").scalar(), zero).alias("time_min"),
        F.coalesce(totals.select("t1").scalar(), zero).alias("time_max"),
    )


def event_timeseries(events: DataFrame, event_type: str | None = None) -> DataFrame:
    """``event_type, day, n``: whole days that have events."""
    if event_type is not None:
        events = events.where(F.col("event_type") == event_type)
    return events.groupBy("event_type", F.floor("time").alias("day")).agg(F.count("*").alias("n"))


def available_types(events: DataFrame) -> DataFrame:
    return events.select("event_type").distinct()


def in_window(
    events: DataFrame, start: float | None = None, end: float | None = None
) -> DataFrame:
    """Events of the closed time window [start, end]; None leaves that side open.

    Both ends count, so two windows that touch both hold an event on their border.
    """
    if start is not None:
        events = events.where(F.col("time") >= F.lit(float(start)))
    if end is not None:
        events = events.where(F.col("time") <= F.lit(float(end)))
    return events


def of_types(events: DataFrame, types: Sequence[str] | None) -> DataFrame:
    return events if types is None else events.where(F.col("event_type").isin(list(types)))


def resolve_geo(events: DataFrame, log: EventLog, keep_unresolved: bool = False) -> DataFrame:
    """Add ``geo_id``: the unit of the venue, else of the person; neither → dropped.

    With a person lookup too large to broadcast, only the events that their venue did not
    place are shuffled to it; the others never leave their tasks for it. That reads the log
    once for either kind, so a log that is asked more than once is better stored located
    (:func:`popatlas.sources.events.write_located_events`): its events pass as they are.
    """
    if log.located:
        return events if keep_unresolved else events.where(F.col("geo_id").isNotNull())
    if not (fits(log.person_count) or keep_unresolved or events.isStreaming):
        return _resolve_apart(events, log)
    by_venue = _with_venue_unit(events, log)
    wanted = F.when(F.col("_venue_unit").isNull(), F.col("person_id"))
    located = (
        by_venue.withColumn("_key", _join_key(events, wanted, log.person_count))
        .join(_person_units(log), F.col("_key") == F.col("_person"), "left")
        .select(*events.columns, F.coalesce("_venue_unit", "_person_unit").alias("geo_id"))
    )
    return located if keep_unresolved else located.where(F.col("geo_id").isNotNull())


def _resolve_apart(events: DataFrame, log: EventLog) -> DataFrame:
    """Both branches join the same venue side, which is broadcast once if it is small."""
    by_venue = _with_venue_unit(events, log)
    placed = by_venue.where(F.col("_venue_unit").isNotNull()).select(
        *events.columns, F.col("_venue_unit").alias("geo_id")
    )
    unplaced = by_venue.where(F.col("_venue_unit").isNull() & (F.col("person_id") >= 0))
    by_person = unplaced.drop("_venue_unit").join(log.person_side, "person_id")
    return placed.unionByName(by_person.select(*events.columns, "geo_id"))


def _join_key(events: DataFrame, key: Column, lookup_rows: int) -> Column:
    """``key``, made fit for a shuffle join if the lookup is too large to broadcast.

    Many events may have no venue, and in one pass those that a venue placed need no
    person. Such rows would pile up under one key. They get a negative hash, which spreads
    them and matches nothing, since the ids of a lookup are not negative.
    """
    if fits(lookup_rows):
        return key
    about = [c for c in ("time", "ts", "person_id", "venue_id") if c in events.columns]
    spread = -1 - F.pmod(F.xxhash64(*about), F.lit(_SPREAD))
    return F.when(key >= 0, key).otherwise(spread)


def _with_venue_unit(events: DataFrame, log: EventLog) -> DataFrame:
    venue = log.venue_side.select(
        F.col("venue_id").alias("_venue"), F.col("geo_id").alias("_venue_unit")
    )
    key = _join_key(events, F.col("venue_id"), log.venue_count)
    keyed = events.withColumn("_venue_key", key)
    return keyed.join(venue, F.col("_venue_key") == F.col("_venue"), "left").drop(
        "_venue_key", "_venue"
    )


def _person_units(log: EventLog) -> DataFrame:
    return log.person_side.select(
        F.col("person_id").alias("_person"), F.col("geo_id").alias("_person_unit")
    )


def count_by_unit(events: DataFrame, log: EventLog, by: Sequence[str | Column]) -> DataFrame:
    """``by, geo_id, n``: located events, counted map-side before they are shuffled."""
    return resolve_geo(events, log).groupBy(*by, "geo_id").agg(F.count("*").alias("n"))


def geo_counts(
    log: EventLog,
    types: Sequence[str] | None = None,
    start: float | None = None,
    end: float | None = None,
) -> DataFrame:
    """``event_type, geo_id, n`` in a closed window, for any number of types in one pass."""
    return count_by_unit(in_window(of_types(log.events, types), start, end), log, ["event_type"])


def geo_cumulative(
    log: EventLog, types: Sequence[str] | None = None, end: float | None = None
) -> DataFrame:
    """``event_type, geo_id, n`` from the first event to ``end``, ``end`` included."""
    return geo_counts(log, types, None, end)


def rate_population(w: World) -> DataFrame:
    """``geo_id, population``: subtree populations, only of units with direct people."""
    direct = direct_population(w)
    return rollup(direct, w, [], n="population", counted=True).join(
        direct.select("geo_id"), "geo_id", "left_semi"
    )


def geo_rates(counts: DataFrame, population: DataFrame, per: int = PER) -> DataFrame:
    """Add ``rate`` per ``per`` people; an unknown or empty population gives 0."""
    return counts.join(population.select("geo_id", "population"), "geo_id", "left").withColumn(
        "rate",
        F.when(F.col("population") > 0, F.col("n") / F.col("population") * per).otherwise(
            F.lit(0.0)
        ),
    )


def event_features(
    log: EventLog,
    w: World,
    types: Sequence[str] | None = None,
    start: float | None = None,
    end: float | None = None,
    cumulative: bool = False,
    per: int = PER,
) -> DataFrame:
    """Map features of a window: units with coordinates, count and rate."""
    counts = geo_counts(log, types, None if cumulative else start, end)
    shown = w.units.where(has_coordinates()).select("geo_id", "lat", "lon")
    rated = geo_rates(counts.join(shown, "geo_id"), rate_population(w), per)
    return rated.select("event_type", "geo_id", "n", "rate", "lat", "lon")


def feature_totals(
    log: EventLog,
    w: World,
    types: Sequence[str] | None = None,
    start: float | None = None,
    end: float | None = None,
) -> DataFrame:
    """Per type: the count over all located events, and over units with coordinates."""
    shown = w.units.where(has_coordinates()).select("geo_id", F.lit(True).alias("_shown"))
    return (
        geo_counts(log, types, start, end)
        .join(shown, "geo_id", "left")
        .groupBy("event_type")
        .agg(
            F.sum("n").alias("total"),
            F.coalesce(F.sum(F.when(F.col("_shown"), F.col("n"))), F.lit(0))
            .cast("bigint")
            .alias("shown_total"),
        )
    )


def window_totals(
    log: EventLog, types: Sequence[str], time: float, width: float
) -> DataFrame:
    """``event_type, n`` over [time − width, time], 0 for types without events."""
    counts = (
        geo_counts(log, types, time - width, time)
        .groupBy("event_type")
        .agg(F.sum("n").alias("_n"))
    )
    listed = log.events.sparkSession.range(1).select(literal_rows(types).alias("event_type"))
    return listed.join(counts, "event_type", "left").select(
        "event_type", F.coalesce("_n", F.lit(0)).cast("bigint").alias("n")
    )


def unit_event_card(
    log: EventLog, types: Sequence[str], time: float, width: float, unit: int | None = None
) -> DataFrame:
    """Rolling and cumulative count per (unit, type) at one instant, in one pass.

    With ``unit`` every type is listed, 0 when it has no events there.
    """
    until = in_window(of_types(log.events, types), None, time)
    # Whether an event is in the rolling window is a key of the count, not a second pass.
    recent = (F.col("time") >= F.lit(float(time) - float(width))).alias("_recent")
    counts = count_by_unit(until, log, ["event_type", recent])
    card = counts.groupBy("geo_id", "event_type").agg(
        F.coalesce(F.sum(F.when(F.col("_recent"), F.col("n"))), F.lit(0))
        .cast("bigint")
        .alias("rolling"),
        F.sum("n").alias("cumulative"),
    )
    if unit is None:
        return card
    listed = log.events.sparkSession.range(1).select(literal_rows(types).alias("event_type"))
    zero = F.lit(0).cast("bigint")
    return listed.join(card.where(F.col("geo_id") == unit), "event_type", "left").select(
        F.lit(unit).cast("bigint").alias("geo_id"),
        "event_type",
        F.coalesce("rolling", zero).alias("rolling"),
        F.coalesce("cumulative", zero).alias("cumulative"),
    )
