import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from popatlas.operators import paging
from popatlas.plans.ranking import prefix_sum, rank_slice
from tests.conftest import rows


@settings(
    max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    st.lists(
        st.tuples(st.integers(0, 2), st.integers(-40, 60), st.integers(1, 9)),
        min_size=1,
        max_size=60,
        unique_by=lambda r: r[:2],
    ),
    st.integers(1, 25),
)
def test_prefix_sum_matches_a_loop(spark, data, width):
    df = spark.createDataFrame(data, "k bigint, o bigint, v bigint")
    got = rows(
        prefix_sum(
            prefix_sum(df, "o", keys=["k"], width=width), "o", value="v", keys=["k"],
            width=width, name="before",
        ),
        "k", "o", "v", "rank", "before",
    )
    want, seen = [], {}
    for k, o, v in sorted(data):
        rank, total = seen.get(k, (0, 0))
        want.append((k, o, v, rank, total))
        seen[k] = (rank + 1, total + v)
    assert got == want


@pytest.mark.parametrize("width", [3, 1000])
def test_ties_and_slices(spark, width):
    data = [(i // 2, random.Random(i).random()) for i in range(50)]
    df = spark.createDataFrame(data, "o bigint, t double")
    want = sorted(data)
    ranked = prefix_sum(df, "o", ties=["t"], width=width)
    assert [r[:2] for r in sorted(rows(ranked), key=lambda r: r[2])] == want
    got = rank_slice(df, "o", 7, 19, ties=["t"], width=width)
    assert [tuple(r)[:2] for r in got.orderBy("rank").collect()] == want[7:19]


def numbers(spark, n):
    return spark.range(n).selectExpr("id AS ordinal")


def test_paginate(spark):
    def page(n, number, size):
        return [r[0] for r in rows(paging.paginate(numbers(spark, n), page=number, per_page=size))]

    assert page(10, 2, 3) == [3, 4, 5]
    assert page(5, 1, 3) == [0, 1, 2]
    assert page(7, 3, 3) == [6]
    assert page(5, 99, 10) == []
    assert page(0, 1, 50) == []
    assert page(5, -4, 2) == [0, 1]


@pytest.mark.parametrize("n, size, pages", [(0, 50, 1), (100, 10, 10), (101, 10, 11), (10, 3, 4)])
def test_page_info(spark, n, size, pages):
    assert rows(paging.page_info(numbers(spark, n), 2, size)) == [(n, pages, 2, size)]


def test_pages_have_any_size(spark):
    assert paging.paginate(numbers(spark, 500), per_page=1000).count() == 500
    assert paging.paginate(numbers(spark, 500), page=2, per_page=300).count() == 200


def test_pages_tile_the_listing(spark):
    everything = paging.all_pages(numbers(spark, 23), per_page=5)
    tiles = [
        rows(paging.paginate(numbers(spark, 23), page=p, per_page=5), "ordinal")
        for p in range(1, 6)
    ]
    for number, tile in enumerate(tiles, 1):
        assert rows(everything.where(f"page = {number}"), "ordinal") == tile
    assert sum(map(len, tiles)) == 23


@pytest.mark.parametrize("budget, start, kept", [(10, 0, 3), (9, 0, 2), (100, 0, 5), (10, 10, 0)])
def test_size_budget_keeps_the_crossing_record(spark, budget, start, kept):
    df = spark.createDataFrame([(i, 5) for i in range(5)], "ordinal bigint, size bigint")
    marked = paging.take_within_bytes(df, "ordinal", "size", budget, start)
    assert rows(marked.where("kept"), "ordinal") == [(i,) for i in range(kept)]
    assert rows(paging.budget_report(marked, "size")) == [(kept, 5 - kept, 5 * kept)]


def test_null_positions_come_first_and_null_keys_form_a_group(spark):
    data = [(None, 5), (None, None), (1, 7), (1, None), (1, 2)]
    df = spark.createDataFrame(data, "k bigint, o bigint")
    got = {(r.k, r.o): r["rank"] for r in prefix_sum(df, "o", keys=["k"], width=2).collect()}
    assert got == {(None, None): 0, (None, 5): 1, (1, None): 0, (1, 2): 1, (1, 7): 2}
    first = rank_slice(df.where("k = 1"), "o", 0, 2, width=2)
    assert sorted(r.o is None for r in first.collect()) == [False, True]


def test_slices_of_a_spread_order_are_summed_in_runs(spark, monkeypatch):
    monkeypatch.setattr("popatlas.plans.ranking.RUN", 4)
    values = [random.Random(i).randrange(-(1 << 62), 1 << 62) for i in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "o bigint")
    ranked = prefix_sum(df, "o", width=16)
    assert [r.o for r in ranked.orderBy("rank").collect()] == sorted(values)
