"""The event counts kept up to date on a stream.

The stream carries ``event_type, ts, person_id, venue_id`` with ``ts`` a TIMESTAMP; the
lookups of the log are joined to it as static tables.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from popatlas.model import EventLog
from popatlas.operators.events import resolve_geo

SECONDS_PER_DAY = 86400


def _days(n: float) -> str:
    return f"{round(n * SECONDS_PER_DAY)} seconds"


def locate_stream(events: DataFrame, log: EventLog, lateness: str | None = None) -> DataFrame:
    """Streamed events with ``geo_id``, watermarked by ``lateness`` when given."""
    if lateness is not None:
        events = events.withWatermark("ts", lateness)
    return resolve_geo(events, log)


def _windowed(located: DataFrame, window: Column) -> DataFrame:
    counts = located.groupBy(window.alias("w"), "event_type", "geo_id").agg(
        F.count("*").alias("n")
    )
    return _spans(counts, "w")


def _spans(counts: DataFrame, window: str) -> DataFrame:
    return counts.select(
        F.col(f"{window}.start").alias("window_start"),
        F.col(f"{window}.end").alias("window_end"),
        "event_type",
        "geo_id",
        "n",
    )


def stream_daily(events: DataFrame, log: EventLog, lateness: str | None = None) -> DataFrame:
    """Counts per calendar day (UTC), type and unit."""
    return _windowed(locate_stream(events, log, lateness), F.window("ts", "1 day"))


def stream_rolling(
    events: DataFrame,
    log: EventLog,
    width: float = 1.0,
    step: float = 1.0,
    lateness: str | None = None,
) -> DataFrame:
    """Counts per sliding window of ``width`` days every ``step`` days. Windows are
    half-open here, where baked frames are closed.

    With ``lateness`` (for sinks that append) an event is counted once, in its pane, and a
    closed pane goes to all its windows as one row; both states are dropped as the watermark
    passes. Without, as complete results need it, every event goes to all its windows and
    all windows are kept; :func:`stream_panes` with :func:`windows_of` avoids that.
    """
    if lateness is None:
        return _windowed(locate_stream(events, log), F.window("ts", _days(width), _days(step)))
    panes = _pane_counts(locate_stream(events, log, lateness), width, step)
    # The time of a pane keeps the watermark, so the windows close with it too.
    spans = F.window(F.window_time("w"), _days(width), _days(step))
    counts = panes.groupBy(spans.alias("span"), "event_type", "geo_id").agg(F.sum("n").alias("n"))
    return _spans(counts, "span")


def pane_seconds(width: float, step: float) -> int:
    """The longest pane of which every window of ``width`` each ``step`` days is made up."""
    return math.gcd(round(width * SECONDS_PER_DAY), round(step * SECONDS_PER_DAY))


def _pane_counts(located: DataFrame, width: float, step: float) -> DataFrame:
    pane = F.window("ts", f"{pane_seconds(width, step)} seconds")
    return located.groupBy(pane.alias("w"), "event_type", "geo_id").agg(F.count("*").alias("n"))


def stream_panes(
    events: DataFrame,
    log: EventLog,
    width: float = 1.0,
    step: float = 1.0,
    lateness: str | None = None,
) -> DataFrame:
    """Counts per pane: one state row per event, whatever the width of the windows."""
    return _spans(_pane_counts(locate_stream(events, log, lateness), width, step), "w")


def windows_of(panes: DataFrame, width: float, step: float) -> DataFrame:
    """The sliding windows of ``width`` days every ``step`` days from stored pane counts."""
    spans = F.window("window_start", _days(width), _days(step))
    counts = panes.groupBy(spans.alias("span"), "event_type", "geo_id").agg(F.sum("n").alias("n"))
    return _spans(counts, "span")


def stream_cumulative(events: DataFrame, log: EventLog) -> DataFrame:
    """Running total per type and unit."""
    return locate_stream(events, log).groupBy("event_type", "geo_id").agg(F.count("*").alias("n"))


def frames_sink(
    windows: DataFrame, path: str, checkpoint: str, **trigger
) -> DataStreamWriter:
    """A writer that appends each window to parquet once the watermark has closed it.

    ``windows`` must carry a watermark; ``checkpoint`` is a folder all executors share.
    """
    writer = (
        windows.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    return writer.trigger(**trigger) if trigger else writer


def replay(
    counts: DataFrame,
    path: str,
    checkpoint: str,
    combine: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Drain all available input and leave the complete counts as parquet at ``path``, put
    together by ``combine`` (windows from panes, say) where it is given."""

    def keep(batch: DataFrame, _: int) -> None:
        (combine(batch) if combine else batch).write.mode("overwrite").parquet(path)

    query = (
        counts.writeStream.outputMode("complete")
        .foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
