import datetime as dt

from popatlas.streaming import events as streaming
from tests.conftest import rows

SCHEMA = "event_type string, ts timestamp, person_id bigint, venue_id bigint"


def batch(spark, path, events):
    data = [("e", dt.datetime(2024, 1, d, h), p, v) for d, h, p, v in events]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def source(spark, path):
    return spark.readStream.schema(SCHEMA).parquet(path)


def test_frames_sink_appends_closed_windows_and_drops_late_events(spark, build_log, tmp_path):
    path, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    log = build_log([], [(0, 5)], [(1, 6)])

    def drain():
        windows = streaming.stream_daily(source(spark, path), log, lateness="1 day")
        streaming.frames_sink(windows, out, checkpoint, availableNow=True).start().awaitTermination()
        return rows(spark.read.parquet(out).selectExpr("day(window_start)", "geo_id", "n"))

    batch(spark, path, [(1, 3, 1, 0), (1, 9, 1, 0), (2, 1, 1, 9)])
    batch(spark, path, [(5, 1, 1, 0)])
    closed = drain()
    assert closed == [(1, 5, 2), (2, 6, 1)]
    batch(spark, path, [(1, 4, 1, 0), (9, 1, 1, 0)])
    assert drain() == [*closed, (5, 5, 1)]


def test_replayed_streams(spark, build_log, tmp_path):
    path = str(tmp_path / "in")
    log = build_log([], [(0, 5)], [(1, 6)])
    batch(spark, path, [(1, 3, 1, 0), (1, 9, 1, 0), (2, 1, 1, 9), (2, 1, 7, 9)])

    def replayed(counts, name):
        streaming.replay(counts, str(tmp_path / name), str(tmp_path / f"{name}-checkpoint"))
        return spark.read.parquet(str(tmp_path / name))

    daily = replayed(streaming.stream_daily(source(spark, path), log), "daily")
    assert rows(daily.selectExpr("day(window_start)", "geo_id", "n")) == [(1, 5, 2), (2, 6, 1)]
    rolling = replayed(streaming.stream_rolling(source(spark, path), log, 2, 1), "rolling")
    assert rolling.groupBy().sum("n").first()[0] == 6
    total = replayed(streaming.stream_cumulative(source(spark, path), log), "total")
    assert rows(total) == [("e", 5, 2), ("e", 6, 1)]


def test_panes_make_up_every_window(spark, build_log, tmp_path):
    path = str(tmp_path / "in")
    log = build_log([], [(0, 5)], [(1, 6)])
    batch(spark, path, [(d, h, 1, v) for d in range(1, 9) for h in (0, 5, 23) for v in (0, 9)])
    assert streaming.pane_seconds(3, 1) == 86400 and streaming.pane_seconds(1.5, 1) == 43200
    for width, step in ((3, 1), (2, 2), (1.5, 1), (0.5, 0.25)):
        direct, paned = str(tmp_path / f"d{width}"), str(tmp_path / f"p{width}")
        streaming.replay(
            streaming.stream_rolling(source(spark, path), log, width, step), direct, f"{direct}-c"
        )
        streaming.replay(
            streaming.stream_panes(source(spark, path), log, width, step), paned, f"{paned}-c",
            lambda panes: streaming.windows_of(panes, width, step),
        )
        assert rows(spark.read.parquet(paned)) == rows(spark.read.parquet(direct))


def test_wide_windows_keep_one_state_row_per_pane(spark, build_log, tmp_path):
    """Thirty windows per event, yet the first state has a row per pane; both are dropped."""
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    log = build_log([], [(0, 5)], [])
    batch(spark, path, [(1 + i % 20, i % 24, 1, 0) for i in range(200)])
    windows = streaming.stream_rolling(source(spark, path), log, 30, 1, lateness="1 day")
    sink = streaming.frames_sink(windows, out, f"{out}-checkpoint", availableNow=True)
    query = sink.start()
    query.awaitTermination()
    # State operators are listed from the last one up; the panes' is the one below.
    updated = [[s["numRowsUpdated"] for s in p["stateOperators"]] for p in query.recentProgress]
    assert max(counts[-1] for counts in updated if counts) == 20
    batch(spark, path, [(31, 0, 1, 0)])
    windows = streaming.stream_rolling(source(spark, path), log, 30, 1, lateness="1 day")
    query = streaming.frames_sink(windows, out, f"{out}-checkpoint", availableNow=True).start()
    query.awaitTermination()
    left = query.recentProgress[-1]["stateOperators"][-1]["numRowsTotal"]
    assert left <= 2
    got = spark.read.parquet(out).selectExpr("date(window_end) AS d", "n").collect()
    assert {str(r.d): r.n for r in got}["2024-01-03"] == 20
