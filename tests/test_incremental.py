"""Roll-ups kept up to date from batches."""

import pytest

from popatlas.operators import incremental as inc
from popatlas.operators.unit_stats import direct_population, rollup
from popatlas.plans import sizing
from tests.conftest import rows

PEOPLE = "person_id bigint, ordinal bigint, age int, sex string, geo_id bigint"


@pytest.fixture
def tree(build):
    """Two branches below a root; unit 4 is an orphan's child."""
    return build(geo=[(i, i, f"u{i}", "l", p, 1.0, 2.0) for i, p in ((0, -1), (1, 0), (2, 0), (3, 1), (4, 99))])


def people(spark, pairs):
    return spark.createDataFrame([(i, i, 30, sex, unit) for i, sex, unit in pairs], PEOPLE)


def test_batches_equal_a_full_pass(spark, tree, tmp_path):
    first = people(spark, [(0, "f", 3), (1, "m", 3), (2, None, 2), (3, "f", 77), (4, "f", None)])
    more = people(spark, [(5, "f", 4), (6, None, 3), (7, "m", 1)])
    gone, moved = people(spark, [(1, "m", 3)]), people(spark, [(1, "m", 2)])
    store = inc.CountStore(spark, str(tmp_path / "counts"), ["sex"])
    store.write(inc.people_delta(tree, first, by=["sex"]))
    store.write(inc.people_delta(tree, more, by=["sex"]), "b1")
    store.write(inc.people_delta(tree, moved, gone, by=["sex"]), "b2")
    now = first.where("person_id <> 1").unionByName(more).unionByName(moved)
    want = {tuple(r) for r in inc.people_delta(tree, now, by=["sex"]).collect()}
    assert {tuple(r) for r in store.counts().collect()} == want
    assert (0, "m", 2) in want and (3, "m", 1) not in want
    # A batch that is written again replaces itself.
    store.write(inc.people_delta(tree, more, by=["sex"]), "b1")
    assert {tuple(r) for r in store.counts().collect()} == want
    store.compact()
    assert store.batches() == ["base-1"]
    assert {tuple(r) for r in store.counts().collect()} == want
    store.write(inc.people_delta(tree, None, now, by=["sex"]), "b3")
    assert store.counts().count() == 0
    store.compact()
    assert store.batches() == ["base-2"] and store.counts().count() == 0


def test_a_compaction_that_broke_off_counts_nothing_twice(spark, tree, tmp_path, monkeypatch):
    path = str(tmp_path / "counts")
    store = inc.CountStore(spark, path)
    store.write(inc.people_delta(tree, people(spark, [(0, "f", 3)])))
    store.write(inc.people_delta(tree, people(spark, [(1, "f", 2)])), "b1")
    want = rows(store.counts())

    def failing(*_):
        raise OSError("lost")

    # Broken off before the new base is complete: the parts count on.
    monkeypatch.setattr(inc, "summed", failing)
    with pytest.raises(OSError):
        store.compact()
    monkeypatch.undo()
    assert store.batches() == ["b1", "base"] and rows(store.counts()) == want
    # Broken off before the parts are deleted: the base counts alone.
    monkeypatch.setattr(store, "_files", lambda files=store._files: _Undeletable(*files()))
    with pytest.raises(OSError):
        store.compact()
    monkeypatch.undo()
    assert store.batches() == ["base-1"] and rows(store.counts()) == want


class _Undeletable(tuple):
    """A folder and a file system that does not delete."""

    def __new__(cls, path, files):
        class Files:
            exists, listStatus = staticmethod(files.exists), staticmethod(files.listStatus)

            @staticmethod
            def delete(*_):
                raise OSError("lost")

        return super().__new__(cls, (path, Files))


@pytest.mark.parametrize("fits", [True, False])
def test_merging_moves_no_row_of_the_base(spark, monkeypatch, fits):
    if not fits:
        monkeypatch.setattr(sizing, "BROADCAST_ROWS", 0)
    kinds = "geo_id bigint, sex string, n bigint"
    base = spark.createDataFrame([(0, "f", 5), (0, None, 2), (1, "m", 1)], kinds)
    delta = spark.createDataFrame([(0, None, 3), (1, "m", -1), (2, "f", 4)], kinds)
    got = inc.merged(base, delta, ["sex"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(0, "f", 5), (0, None, 5), (2, "f", 4)], key=str)


def test_an_empty_batch_and_no_batch(spark, tree, tmp_path):
    store = inc.CountStore(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        store.counts()
    with pytest.raises(ValueError):
        inc.people_delta(tree)
    store.write(inc.people_delta(tree, people(spark, [(0, "f", 3)])))
    store.write(inc.people_delta(tree, people(spark, [])), "b1")
    full = rollup(direct_population(_with(tree, people(spark, [(0, "f", 3)]))), tree, [], n="population", counted=True)
    assert rows(store.counts()) == rows(full)


def test_event_batches(spark, tree, build_log):
    log = build_log([("a", 1.0, 0, 0), ("a", 2.0, 1, -1), ("b", 9.0, 0, 0)], [(0, 3)], [(1, 2)])
    base = inc.event_delta(log, tree, log.events.where("time < 5"))
    late = inc.event_delta(log, tree, log.events.where("time >= 5"))
    whole = inc.event_delta(log, tree, log.events)
    assert rows(inc.merged(base, late, ["event_type"])) == rows(whole)
    assert (0, "a", 2) in rows(whole)


def _with(w, people):
    return type(w)(w.geo, people, w.venues, w.subsets, w.memberships, w.activities)
