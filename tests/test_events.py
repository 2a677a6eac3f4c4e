import math
import random

import pytest

from popatlas.operators import events as ev
from popatlas.operators import frames as fr
from popatlas.operators import map_classes
from popatlas.plans import sizing
from tests.conftest import rows


@pytest.fixture
def two_infections(build_log):
    return build_log(
        [("infections", 1.0, 0, 0), ("infections", 5.0, 1, 0)], [(0, 0)], [(0, 0), (1, 0)]
    )


def test_window_and_cumulative(two_infections):
    assert rows(ev.geo_counts(two_infections, ["infections"], 0, 3)) == [("infections", 0, 1)]
    assert rows(ev.geo_cumulative(two_infections, end=5)) == [("infections", 0, 2)]
    assert rows(ev.geo_counts(two_infections, ["deaths"], 0, 10)) == []
    assert rows(ev.geo_counts(two_infections, None, 6, 3)) == []


def test_both_window_ends_count(two_infections):
    counts = [ev.geo_counts(two_infections, None, a, b).first() for a, b in [(0, 1), (1, 2)]]
    assert [c.n for c in counts] == [1, 1]


def test_rates(spark, two_infections):
    counts = ev.geo_counts(two_infections, None, 0, 10)
    population = spark.createDataFrame([(0, 100_000)], "geo_id bigint, population bigint")
    assert ev.geo_rates(counts, population).first().rate == pytest.approx(2.0)
    assert ev.geo_rates(counts, population.where("geo_id > 0")).first().rate == 0.0


def test_summary_lists_empty_types(two_infections, build_log):
    got = rows(ev.event_summary(two_infections, ["infections", "deaths"]))
    assert got == [("deaths", 0, 1.0, 5.0), ("infections", 2, 1.0, 5.0)]
    assert rows(ev.event_summary(build_log([]), ["deaths"])) == [("deaths", 0, 0.0, 0.0)]


def test_timeseries_skips_empty_days(two_infections):
    assert rows(ev.event_timeseries(two_infections.events)) == [
        ("infections", 1, 1),
        ("infections", 5, 1),
    ]


def place_cases(build_log):
    """(person, venue) and the unit expected: venue first, then person, else dropped."""
    cases = [
        ((1, 10), 100), ((1, 11), 201), ((1, -1), 201), ((1, None), 201), ((2, 99), None),
        ((None, 10), 100), ((None, None), None), ((-5, -1), None), ((3, 12), None),
    ]
    log = build_log(
        [("e", float(i), p, v) for i, ((p, v), _) in enumerate(cases)],
        [(10, 100), (11, -1), (-1, 55)],
        [(1, 201), (3, -7), (-5, 56)],
    )
    return log, sorted((float(i), unit) for i, (_, unit) in enumerate(cases) if unit is not None)


@pytest.mark.parametrize("limit", [0, 1000])
def test_locating_events(build_log, monkeypatch, limit):
    """The same units whether the lookups are broadcast or shuffled to."""
    monkeypatch.setattr(sizing, "BROADCAST_ROWS", limit)
    log, want = place_cases(build_log)
    assert rows(ev.resolve_geo(log.events, log), "time", "geo_id") == want
    kept = ev.resolve_geo(log.events, log, keep_unresolved=True)
    assert kept.count() == 9
    assert kept.where("geo_id IS NOT NULL").count() == len(want)


def test_a_located_log_needs_no_lookup(spark, build_log, tmp_path):
    from popatlas.sources.events import read_located_log, write_located_events

    log, want = place_cases(build_log)
    path = str(tmp_path / "located")
    for name, part in (("0", log.events.where("time < 4")), ("1", log.events.where("time >= 4"))):
        for _ in range(2):  # a batch that is written again replaces itself
            write_located_events(type(log)(part, log.venue_geo, log.person_geo), path, name)
    back = read_located_log(spark, path)
    assert rows(ev.resolve_geo(back.events, back), "time", "geo_id") == want
    assert rows(ev.geo_counts(back)) == rows(ev.geo_counts(log))
    assert rows(fr.bake_frames(back, 1, 3)) == rows(fr.bake_frames(log, 1, 3))
    plan = ev.geo_counts(back, ["e"], 2, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan
    late = read_located_log(spark, path, ["1"])
    assert rows(ev.resolve_geo(late.events, late), "time", "geo_id") == [(t, g) for t, g in want if t >= 4]
    assert late.events.count() == 5


def test_features_and_totals(city, build_log):
    log = build_log(
        [("a", 1.0, 0, 0), ("a", 1.0, 0, 0), ("a", 2.0, 2, 1)], [(0, 0), (1, 1)], []
    )
    features = ev.event_features(log, city, ["a"], 0, 9).collect()
    assert [(f.geo_id, f.n, f.rate) for f in features] == [(0, 2, pytest.approx(2 / 3 * 1e5))]
    assert rows(ev.feature_totals(log, city, ["a"], 0, 9)) == [("a", 3, 2)]
    assert rows(ev.window_totals(log, ["a", "b"], 2, 0.5)) == [("a", 1), ("b", 0)]


def test_unit_card_lists_all_types(two_infections):
    card = ev.unit_event_card(two_infections, ["infections", "deaths"], 5, 1, unit=0)
    assert rows(card) == [(0, "deaths", 0, 0), (0, "infections", 1, 2)]


def brute_frames(times, step, width):
    """Frame index → events, by testing every frame against every event."""
    first, last = min(times), max(times)
    grid, k = [], 0
    while first + k * step <= last + step * 0.01:
        grid.append(round(first + k * step, 6))
        k += 1
    counts = {i: sum(t - width <= x <= t for x in times) for i, t in enumerate(grid)}
    return {i: n for i, n in counts.items() if n}, len(grid)


@pytest.mark.parametrize("step, width", [(1, 1), (0.5, 2), (2, 0.7), (0.3, 0.9), (7, 30), (1, 0)])
def test_frames_match_brute_force(build_log, step, width):
    rng = random.Random(step * 31 + width)
    times = [round(rng.uniform(0.37, 20), rng.choice([0, 1, 3, 9])) for _ in range(150)]
    times = [0.25, *times, *(0.25 + k * step for k in range(5))]
    log = build_log([("e", t, 1, 0) for t in times], [(0, 4)])
    want, length = brute_frames(times, step, width)
    baked = fr.bake_frames(log, step, width)
    assert dict(rows(baked, "frame", "n")) == want
    running = [0, *(t for _, t in rows(fr.cumulate_frames(baked), "frame", "total"))]
    assert running[-1] == sum(want.values())
    assert fr.frame_index(log, 1e9, step).first()[0] == length - 1


def test_wide_frames_move_two_rows_a_run(build_log):
    """Thirty frames a run: the explode comes after the running sum."""
    events = [("a", float(i % 40), i % 3, -1) for i in range(400)]
    log = build_log(events, people=[(p, p) for p in range(3)])
    baked = fr.bake_frames(log, 1.0, 30.0)
    want = {}
    for _, time, person, _ in events:
        for k in range(40):
            if k - 30 <= time <= k:
                want[(k, person)] = want.get((k, person), 0) + 1
    assert {(r.frame, r.geo_id): r.n for r in baked.collect()} == want
    plan = baked._jdf.queryExecution().optimizedPlan().toString()
    sequence, window = plan.index("sequence("), plan.index("Window [")
    assert sequence < window and plan.count("sequence(") == 1


def test_events_past_the_last_whole_step_are_in_no_frame(build_log):
    log = build_log([("e", t, 1, 0) for t in (0.0, 1.0, 1.9)], [(0, 4)])
    assert rows(fr.bake_frames(log, 1, 0.5), "frame", "n") == [(0, 1), (1, 1)]


def test_frame_lookup_rounds_halves_up_and_clamps(build_log):
    log = build_log([("e", float(t), 1, 0) for t in range(5)], [(0, 4)])
    baked = fr.bake_frames(log, 1, 0)
    for time, frame in [(-9, 0), (0.49, 0), (0.5, 1), (2.5, 3), (99, 4)]:
        assert rows(fr.frame_at(log, baked, time), "frame") == [(frame,)]
    assert rows(fr.frame_at(log, baked, 2, cumulative=True), "n") == [(3,)]


def test_frame_features_skip_unplaced_units(city, build_log):
    log = build_log([("e", 0.0, 1, 0), ("e", 0.0, 1, 1)], [(0, 0), (1, 1)])
    features = fr.frame_features(fr.bake_frames(log), fr.geo_lookup(city)).collect()
    assert [(f.geo_id, f.n, f.population) for f in features] == [(0, 1, 3)]


def test_map_classes(spark):
    counts = spark.createDataFrame([(1, n) for n in (0, 2, 3, 10, 21, 40)], "f int, n bigint")
    got = rows(map_classes.count_classes(counts), "n", "class")
    assert got == [(0, 0), (2, 0), (3, 1), (10, 2), (21, 4), (40, 4)]
    bounded = map_classes.count_classes(counts, (2, 5))
    assert rows(bounded, "n", "class") == [(0, 0), (2, 0), (3, 1), (10, 1), (21, 1), (40, 1)]
    relative = map_classes.relative_classes(counts, ["f"])
    assert rows(relative, "n", "class") == [(0, 0), (2, 0), (3, 0), (10, 1), (21, 2), (40, 3)]
    sized = dict(rows(map_classes.magnitudes(counts, ["f"], "log"), "n", "magnitude"))
    assert sized[10] == pytest.approx(math.log10(11) / math.log10(41))
    people = spark.createDataFrame([(p,) for p in (5, 100, 101, 20_000)], "population bigint")
    assert rows(map_classes.population_classes(people), "population", "class") == [
        (5, 0), (100, 0), (101, 0), (20_000, 4),
    ]
    strict = map_classes.population_classes(people, strict=True)
    assert {r["class"] for r in strict.collect()} == {5}
