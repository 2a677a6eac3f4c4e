"""What queries derive, shuffle and hold, beside what they return."""

from pyspark.sql import functions as F

from checks import queries
from checks import world as cw
from popatlas.operators import locate, venues
from popatlas.plans import ranking, sizing

from .conftest import rows


class Only:
    """A world in which some tables must not be asked for."""

    max_depth = None

    def __init__(self, world, *names):
        vars(self).update({n: getattr(world, n) for n in names})


def test_unlabelled_world_derives_only_what_is_read(spark, city, monkeypatch):
    given = Only(city, "geo", "people", "venues")
    monkeypatch.setattr(cw, "world", lambda *_: given)
    w = cw.unlabelled_world(spark, "no-subsets-no-activities")
    found = locate.locate_venues(w, per_page=2)
    assert rows(found, "venue_id", "unit", "page") == [(0, "London", 1), (1, "Camden", 1)]
    assert {r.venue_id: r.venue_type for r in found.collect()} == {0: "bar", 1: None}


def test_world_with_other_tables_derives_only_what_is_read(city):
    given = Only(city, "geo", "people", "venues", "subsets")
    changed = queries._with_tables(given, venues=city.venues.where("venue_id = 0"))
    assert rows(venues.venue_child_totals(changed)) == [(0, 0, 0)]


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange hashpartitioning" in line for line in plan.splitlines())


def test_rows_are_shuffled_once_for_their_rank(spark):
    data = [(k, o) for k in (None, "", "a") for o in (None, 0, 1, 5, 6)]
    df = spark.createDataFrame(data, "k string, ordinal long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        offsets = ranking.bucket_offsets(df, "ordinal", ["k"], F.lit(1), 4).localCheckpoint()
        ranked = ranking.prefix_sum(df, "ordinal", keys=["k"], width=4, offsets=offsets)
        # One for the rows, one for the offsets.
        assert _exchanges(ranked) == 2
        whole = ranking.prefix_sum(df, "ordinal", keys=["k"], width=4)
        for found in (ranked, whole):
            assert found.columns == ["k", "ordinal", "rank"]
            got = {(r.k, r.ordinal): r.rank for r in found.collect()}
            assert got == {(k, o): i % 5 for i, (k, o) in enumerate(data)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _visits(spark, folder):
    lines = [(o, n, o % 3, o % 2, "AR"[n % 2]) for o in range(40) for n in (1, 2)]
    spark.createDataFrame(
        lines, "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_returnflag string"
    ).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame(
        [(o, o % 5, "1-URGENT") for o in range(40)], "o_orderkey long, o_custkey long, o_orderpriority string"
    ).write.parquet(f"{folder}/orders.parquet")


def test_large_visits_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    _visits(spark, tmp_path)
    few = rows(cw.subsets(spark, str(tmp_path)))
    monkeypatch.setattr(sizing, "TASK_ROWS", 5)
    dealt = cw.members(spark, str(tmp_path))
    assert "REPARTITION_BY_NUM" in dealt._jdf.queryExecution().executedPlan().toString()
    assert rows(cw.subsets(spark, str(tmp_path))) == few


def test_positions_do_not_shuffle_the_visits(spark, tmp_path):
    _visits(spark, tmp_path)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = cw.activities(spark, str(tmp_path))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin [venue_id" in plan
        assert found.count() == 80
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
