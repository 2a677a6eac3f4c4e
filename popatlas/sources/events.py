"""Event logs: one dataset per event type below a common directory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from popatlas.model import EventLog
from popatlas.operators.events import resolve_geo
from popatlas.sources.lookups import latest_lookup

EVENT_COLUMNS = {
    "event_type": "string",
    "time": "double",
    "person_id": "bigint",
    "venue_id": "bigint",
}


def conform_events(df: DataFrame) -> DataFrame:
    """Core event columns, absent ones NULL, others kept. ``hospital_id`` is the venue of
    rows whose type has no ``venue_id``."""
    if "hospital_id" in df.columns:
        hospital = F.col("hospital_id").cast("bigint")
        if "venue_id" in df.columns:
            hospital = F.coalesce(F.col("venue_id").cast("bigint"), hospital)
        df = df.withColumn("venue_id", hospital)
    core = [
        (F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c)
        for c, kind in EVENT_COLUMNS.items()
    ]
    return df.select(*core, *[c for c in df.columns if c not in EVENT_COLUMNS])


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events stored as ``<path>/event_type=<type>/…`` parquet, types found on reading.

    Types may have different columns. The type is a partition column, so a query for some
    types reads only their files, and ``time`` filters reach the row groups. A path that
    does not exist gives no events.
    """
    try:
        raw = spark.read.option("mergeSchema", "true").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        schema = ", ".join(f"{c} {kind}" for c, kind in EVENT_COLUMNS.items())
        return spark.createDataFrame([], schema)
    return conform_events(raw)


def write_events(events: DataFrame, path: str, mode: str = "error") -> None:
    """Store events by type, ordered by time in each file so that a time window skips
    row groups. Range partitioning spreads a frequent type over many files."""
    (
        events.repartitionByRange("event_type", "time")
        .sortWithinPartitions("event_type", "time")
        .write.partitionBy("event_type")
        .mode(mode)
        .parquet(path)
    )


def event_log(
    events: DataFrame, venue_rows: DataFrame, person_rows: DataFrame, order: str = "row_order"
) -> EventLog:
    """An event log from events and raw lookup rows, the last row per id counting."""
    return EventLog(
        events,
        latest_lookup(venue_rows, "venue_id", "geo_id", order),
        latest_lookup(person_rows, "person_id", "geo_id", order),
    )


FIRST_BATCH = "first"


def write_located_events(log: EventLog, path: str, batch: str = FIRST_BATCH) -> None:
    """Store the events of a log with the unit they happened in, as one batch of many.

    Whatever the lookups cost, they are joined once per event: later batches are located on
    their own and lie beside the earlier ones, and every operator then reads a log without
    lookups. A batch that is written again replaces itself. Events that neither venue nor
    person places are kept without a unit: they count for the time range of the log. The
    log is read once for that, whatever fits a broadcast.
    """
    located = resolve_geo(log.events, log, keep_unresolved=True)
    write_events(located, f"{path}/batch={batch}", "overwrite")


def read_located_log(
    spark: SparkSession, path: str, batches: Sequence[str] | None = None
) -> EventLog:
    """The log that :func:`write_located_events` has stored, all of it or some batches (those
    added since the last run, say). Batch and type are partition columns, so only the files
    of what is asked for are read, and ``time`` filters reach the row groups."""
    stored = spark.read.option("mergeSchema", "true").parquet(path)
    if batches is not None:
        stored = stored.where(F.col("batch").cast("string").isin(list(batches)))
    events = stored.drop("batch")
    typed = events.withColumn("event_type", F.col("event_type").cast("string"))
    nothing = spark.createDataFrame([], "venue_id bigint, person_id bigint, geo_id bigint")
    return EventLog(
        typed, nothing.select("venue_id", "geo_id"), nothing.select("person_id", "geo_id"), located=True
    )
