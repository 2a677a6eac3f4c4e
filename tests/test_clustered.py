"""Facts stored in the order of the tree."""

import re

import pytest
from pyspark.sql import functions as F

from popatlas.operators import clustered
from popatlas.operators.hierarchy import subtree_rows
from popatlas.operators.people import unit_people
from popatlas.operators.unit_stats import direct_population, rollup
from tests.conftest import rows


@pytest.fixture
def country(build):
    """A root, 20 regions of 5 areas each, an orphan; every ninth person has no known unit."""
    regions = [(r, r, f"r{r}", "region", 0, 1.0, 2.0) for r in range(1, 21)]
    areas = [(100 + a, 100 + a, f"a{a}", "area", 1 + a % 20, 1.0, 2.0) for a in range(100)]
    people = [
        (i, i, i % 90, "m", 999 if i % 9 == 0 else None if i % 9 == 1 else 100 + i * 7 % 100)
        for i in range(20_000)
    ]
    return build(
        geo=[(0, 0, "root", "world", -1, 1.0, 2.0), *regions, *areas, (500, 500, "o", "area", 77, 1.0, 2.0)],
        people=people + [(30_000, 30_000, 5, "f", 500), (30_001, None, 5, "f", 3)],
    )


@pytest.fixture
def stored_people(spark, country, tmp_path):
    people = country.people.select("person_id", "geo_id", "ordinal")
    clustered.write_clustered(country, people, str(tmp_path), files=4, row_group_bytes=1024)
    return clustered.ClusteredFacts(spark, str(tmp_path))


def scanned(df):
    """Rows that the scans of an executed plan gave out."""
    found = []
    df.collect()

    def walk(node):
        if "Scan" in node.nodeName():
            found.append(node.metrics().apply("numOutputRows").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))
        if "AdaptiveSparkPlan" in node.nodeName():
            walk(node.executedPlan())

    walk(df._jdf.queryExecution().executedPlan())
    return found


@pytest.mark.parametrize("unit", [0, 3, 117, 500, 999, -5])
def test_a_subtree_is_a_range(country, stored_people, unit):
    want = subtree_rows(country.people.select("person_id", "geo_id"), country, unit)
    assert rows(stored_people.subtree(unit), "person_id") == rows(want, "person_id")


def test_a_small_subtree_reads_a_small_part(stored_people):
    total = stored_people.facts.count()
    found = stored_people.subtree(7)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(preorder", plan)
    (read,) = scanned(found)
    assert found.count() <= read <= total / 5


def test_pages_are_those_of_the_listing(country, stored_people):
    want = unit_people(country, 7, descendants=True, page=2, per_page=25)
    got = stored_people.page(7, page=2, per_page=25, ties=["person_id"])
    assert rows(got, "person_id", "rank") == rows(want, "person_id", "rank")
    listed = stored_people.pages(country.geo.where("geo_id in (3, 7)"), 25, ["person_id"])
    every = unit_people(country, descendants=True, per_page=25).where("ancestor_id in (3, 7)")
    columns = ["ancestor_id", "person_id", "rank", "page"]
    assert rows(listed, *columns) == rows(every, *columns)


def test_interval_counts_equal_the_roll_up(country, stored_people):
    want = rollup(direct_population(country), country, [], n="population", counted=True)
    assert rows(stored_people.counts()) == rows(want)


def test_no_facts(spark, country, tmp_path):
    none = country.people.select("person_id", "geo_id", "ordinal").where(F.lit(False))
    clustered.write_clustered(country, none, str(tmp_path))
    store = clustered.ClusteredFacts(spark, str(tmp_path))
    assert store.subtree(0).count() == store.counts().count() == store.page(0).count() == 0
