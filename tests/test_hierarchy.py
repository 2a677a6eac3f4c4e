import pytest

from popatlas.operators import hierarchy as h
from popatlas.operators import unit_stats as us
from tests.conftest import rows


def unit(i, parent, ordinal=None):
    return (i, i if ordinal is None else ordinal, f"u{i}", f"l{i % 3}", parent, None, None)


@pytest.fixture
def tree(build):
    #   1 ─ 2 ─ 4      7 ─ 8 (7's parent is missing)
    #    └─ 3 ─ 5, 6
    units = [unit(1, -1), unit(2, 1, 9), unit(3, 1, 3), unit(4, 2), unit(5, 3), unit(6, 3)]
    return build(geo=[*units, unit(7, 99), unit(8, 7)])


def test_closure_has_self_ancestors_and_depth(tree):
    got = rows(h.closure(tree), "descendant_id", "ancestor_id", "depth")
    assert [r for r in got if r[0] == 5] == [(5, 1, 2), (5, 3, 1), (5, 5, 0)]
    assert [r for r in got if r[0] == 8] == [(8, 7, 1), (8, 8, 0)]
    assert rows(h.closure(tree, max_depth=0), "descendant_id") == [(i,) for i in range(1, 9)]


def test_descendants_exclude_the_unit(tree):
    got = rows(h.descendants(tree), "geo_id", "descendant_id")
    assert [d for g, d in got if g == 1] == [2, 3, 4, 5, 6]


def test_cycle_and_depth_fail(build):
    with pytest.raises(Exception, match="cyclic"):
        h.closure(build(geo=[unit(1, 2), unit(2, 1)])).collect()
    chain = [unit(0, -1), *(unit(i, i - 1) for i in range(1, 5))]
    assert h.closure(build(geo=chain, max_depth=4)).count() == 15
    with pytest.raises(Exception, match="deeper than 3"):
        h.closure(build(geo=chain, max_depth=3)).collect()


def test_a_deep_tree_needs_no_declared_depth(build):
    chain = [unit(i, i - 1) for i in range(41)]
    assert h.closure(build(geo=chain)).count() == 41 * 42 // 2


def test_cycle_below_a_chain_fails(build):
    loop = [unit(10, 12), unit(11, 10), unit(12, 11), unit(1, 11), unit(2, 1), unit(3, -1)]
    with pytest.raises(Exception, match="cyclic"):
        h.closure(build(geo=loop)).collect()


def test_preorder_visits_siblings_in_file_order(tree):
    order = {g: (n, size) for g, n, size in rows(h.preorder(tree))}
    assert [g for g, _ in sorted(order.items(), key=lambda x: x[1])] == [1, 3, 5, 6, 2, 4, 7, 8]
    assert order[1] == (0, 6) and order[3] == (1, 3) and order[7] == (6, 2)


def test_roots_and_orphans(tree):
    assert rows(h.roots(tree), "geo_id", "is_orphan") == [(1, False), (7, True)]


def test_levels_in_first_appearance_order(tree):
    got = h.levels(tree).orderBy("level_order").collect()
    assert [(r.level, r.units) for r in got] == [("l1", 3), ("l0", 2), ("l2", 3)]


def test_subtree_rows(city):
    assert rows(h.subtree_rows(city.people, city, 0), "person_id") == [(0,), (1,), (2,)]
    assert rows(h.subtree_rows(city.people, city, 1), "person_id") == [(2,)]
    assert h.subtree_rows(city.people, city).count() == 4


def test_family_lists_both_directions(city):
    population = us.rollup(us.direct_population(city), city, [], n="population")
    got = rows(
        h.family(city, population), "geo_id", "relation", "relative_name", "population"
    )
    assert got == [(0, "child", "Camden", 1), (1, "parent", "London", 3)]


def test_tree_report_and_totals(city):
    stats = us.unit_stats(city)
    nodes = rows(h.tree_nodes(city, stats), "geo_id", "population", "venues_count")
    assert nodes == [(0, 3, 2), (1, 1, 1)]
    assert rows(h.tree_totals(city, stats)) == [(2, 3)]
