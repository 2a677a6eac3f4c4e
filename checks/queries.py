"""Registered queries: ``@query(sql)`` pairs a Spark query with its DuckDB twin."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import formulas as f
from checks import world as cw
from checks.sql import with_world
from popatlas.functions import classify
from popatlas.model import World
from popatlas.operators import (
    clustered,
    events,
    extent,
    frames,
    hierarchy,
    incremental,
    locate,
    map_classes,
    paging,
    people,
    profile,
    venues,
)
from popatlas.operators import unit_stats as us
from popatlas.plans import ranking, storage
from popatlas.sources import events as event_source
from popatlas.sources import geojson, lookups, offsets
from popatlas.sources import names as names_source
from popatlas.sources import world as world_source
from popatlas.streaming import events as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(build):
        name = build.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return build(spark, str(sf_dir).rstrip("/"))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_world(sql)
        return build

    return register


# --- geography ----------------------------------------------------------------------


@query("SELECT ancestor_id, descendant_id, CAST(depth AS INTEGER) AS depth FROM closure")
def geo_closure(spark, sf):
    return hierarchy.closure(cw.world(spark, sf))


@query(
    """SELECT ancestor_id AS geo_id, descendant_id, CAST(depth AS INTEGER) AS depth
       FROM closure WHERE depth > 0"""
)
def geo_descendants(spark, sf):
    return hierarchy.descendants(cw.world(spark, sf))


@query(
    """SELECT level, min(ordinal) AS level_order, count(*) AS units FROM geo_units
       GROUP BY level"""
)
def geo_levels(spark, sf):
    return hierarchy.levels(cw.world(spark, sf))


@query(
    """, paths AS (
         SELECT geo_id, [ordinal] AS path FROM geo_units
         WHERE parent_id NOT IN (SELECT geo_id FROM geo_units)
         UNION ALL SELECT g.geo_id, list_append(p.path, g.ordinal)
         FROM geo_units g JOIN paths p ON g.parent_id = p.geo_id)
       SELECT geo_id, row_number() OVER (ORDER BY path) - 1 AS preorder, size
       FROM paths JOIN (SELECT ancestor_id AS geo_id, count(*) AS size
                        FROM closure GROUP BY ancestor_id) USING (geo_id)"""
)
def geo_preorder(spark, sf):
    return hierarchy.preorder(cw.world(spark, sf))


def _clustered_people(spark, sf):
    w = cw.world(spark, sf)
    path = storage.new_folder(spark, "clustered")
    people = w.people.select("person_id", "geo_id", "ordinal", "age", "sex")
    clustered.write_clustered(w, people, path)
    return clustered.ClusteredFacts(spark, path)


@query(
    """SELECT person_id, geo_id, age, sex FROM people
       JOIN closure ON geo_id = descendant_id WHERE ancestor_id = 2"""
)
def subtree_people_clustered(spark, sf):
    """The people of a region from files in the order of the tree."""
    return _clustered_people(spark, sf).subtree(2).drop("ordinal")


@query(
    """SELECT person_id, age, sex, rank FROM (
         SELECT person_id, age, sex, row_number() OVER (ORDER BY ordinal) - 1 AS rank
         FROM people JOIN closure ON geo_id = descendant_id WHERE ancestor_id = 2)
       WHERE rank >= 20 AND rank < 30"""
)
def subtree_page_clustered(spark, sf):
    found = _clustered_people(spark, sf).page(2, page=3, per_page=10, ties=["person_id"])
    return found.select("person_id", "age", "sex", "rank")


@query(
    """SELECT ancestor_id, person_id, row_number() OVER w - 1 AS rank,
              (row_number() OVER w - 1) // 7 + 1 AS page
       FROM people JOIN closure ON geo_id = descendant_id
       JOIN geo_units a ON a.geo_id = ancestor_id AND a.level = 'nation'
       WINDOW w AS (PARTITION BY ancestor_id ORDER BY people.ordinal)"""
)
def nation_pages_clustered(spark, sf):
    nations = cw.world(spark, sf).geo.where("level = 'nation'")
    pages = _clustered_people(spark, sf).pages(nations, per_page=7, ties=["person_id"])
    return pages.select("ancestor_id", "person_id", "rank", "page")


@query("SELECT geo_id, population AS n FROM unit_population")
def population_by_intervals(spark, sf):
    return _clustered_people(spark, sf).counts()


@query("SELECT ancestor_id, person_id FROM people JOIN closure ON geo_id = descendant_id")
def geo_subtree_people(spark, sf):
    w = cw.world(spark, sf)
    return hierarchy.subtree_rows(w.people.select("geo_id", "person_id"), w).drop("geo_id")


@query("SELECT ancestor_id, venue_id FROM venues JOIN closure ON geo_id = descendant_id")
def geo_subtree_venues(spark, sf):
    w = cw.world(spark, sf)
    return hierarchy.subtree_rows(w.venues.select("geo_id", "venue_id"), w).drop("geo_id")


@query(
    """SELECT geo_id, name, level, parent_id, parent_id <> -1 AS is_orphan FROM geo_units
       WHERE parent_id NOT IN (SELECT geo_id FROM geo_units)"""
)
def geo_roots(spark, sf):
    return hierarchy.roots(cw.world(spark, sf))


@query(
    """, pop AS (SELECT geo_id, population FROM unit_population)
       SELECT p.geo_id, 'child' AS relation, c.geo_id AS relative_id, c.name AS relative_name,
              c.level AS relative_level, coalesce(s.population, 0) AS population,
              c.ordinal AS position
       FROM geo_units p JOIN geo_units c ON c.parent_id = p.geo_id
       LEFT JOIN pop s ON s.geo_id = c.geo_id
       UNION ALL
       SELECT c.geo_id, 'parent', p.geo_id, p.name, p.level, coalesce(s.population, 0), p.ordinal
       FROM geo_units p JOIN geo_units c ON c.parent_id = p.geo_id
       LEFT JOIN pop s ON s.geo_id = p.geo_id"""
)
def geo_family(spark, sf):
    w = cw.world(spark, sf)
    population = us.rollup(us.direct_population(w), w, [], n="population", counted=True)
    return hierarchy.family(w, population)


@query(
    """SELECT g.geo_id, g.name, g.level, p.geo_id AS parent_id, s.population, s.venues_count
       FROM geo_units g LEFT JOIN geo_units p ON g.parent_id = p.geo_id
       JOIN stats s ON s.geo_id = g.geo_id"""
)
def geo_tree_nodes(spark, sf):
    w = cw.world(spark, sf)
    return hierarchy.tree_nodes(w, us.unit_stats(w, with_activities=False))


@query(
    """SELECT count(*) AS units,
              CAST(sum(CASE WHEN parent_id NOT IN (SELECT geo_id FROM geo_units)
                            THEN population END) AS BIGINT) AS people
       FROM geo_units JOIN stats USING (geo_id)"""
)
def geo_tree_totals(spark, sf):
    w = cw.world(spark, sf)
    return hierarchy.tree_totals(w, us.unit_stats(w, with_activities=False))


# --- unit statistics ----------------------------------------------------------------


@query("SELECT geo_id, n AS population FROM direct_people")
def direct_population(spark, sf):
    return us.direct_population(cw.world(spark, sf))


@query("SELECT geo_id, category AS age_label, n FROM age_direct")
def age_buckets(spark, sf):
    return us.age_buckets(cw.world(spark, sf))


@query("SELECT geo_id, category AS sex, n FROM sex_direct")
def sex_counts(spark, sf):
    return us.sex_counts(cw.world(spark, sf))


@query("SELECT geo_id, category AS venue_type, n FROM venue_direct")
def venue_type_counts(spark, sf):
    return us.venue_type_counts(cw.world(spark, sf))


@query("SELECT geo_id, category AS venue_type, n FROM venue_direct_all")
def venue_type_counts_all_units(spark, sf):
    return us.venue_type_counts(cw.world(spark, sf), populated_only=False)


@query("SELECT geo_id, category AS activity, n FROM activity_direct")
def activity_counts(spark, sf):
    return us.activity_counts(cw.world(spark, sf))


@query("SELECT geo_id, population FROM unit_population")
def population_rollup(spark, sf):
    w = cw.world(spark, sf)
    return us.rollup(us.direct_population(w), w, [], n="population", counted=True)


@query(
    """SELECT geo_id, kind, category, n FROM rolled UNION ALL
       SELECT geo_id, 'age', label, CAST(0 AS BIGINT) FROM stats CROSS JOIN (VALUES
         ('0-15'), ('16-24'), ('25-34'), ('35-49'), ('50-64'), ('65+')) AS a(label)
       WHERE has_stats AND population = 0"""
)
def unit_stats_categories(spark, sf):
    return us.stats_long(us.unit_stats(cw.world(spark, sf)))


def _three_batches(w):
    """People in three batches: most live where they did, some come later, and every ninth
    was first counted in the unit of the next person's id and has moved since."""
    moved = w.people.where("person_id % 9 = 4")
    others = w.people.select((F.col("person_id") - 1).alias("person_id"), F.col("geo_id").alias("_old"))
    before = moved.join(others, "person_id").withColumn("geo_id", F.col("_old")).drop("_old")
    settled = w.people.where("person_id % 9 <> 4 and person_id % 5 <> 0")
    late = w.people.where("person_id % 9 <> 4 and person_id % 5 = 0")
    return settled, before, late, moved


@query(
    """SELECT ancestor_id AS geo_id, sex, count(*) AS n
       FROM people JOIN closure ON geo_id = descendant_id GROUP BY ancestor_id, sex"""
)
def rollup_incremental(spark, sf):
    """Counts by sex of whole subtrees, kept up to date from batches and compacted."""
    w = cw.world(spark, sf)
    settled, before, late, moved = _three_batches(w)
    store = incremental.CountStore(spark, storage.new_folder(spark, "counts"), ["sex"])
    store.write(incremental.people_delta(w, settled.unionByName(before), by=["sex"]))
    store.write(incremental.people_delta(w, late, by=["sex"]), "late")
    store.compact()
    store.write(incremental.people_delta(w, moved, before, by=["sex"]), "moves")
    return store.counts()


@query(
    """SELECT ancestor_id AS geo_id, event_type, count(*) AS n
       FROM located JOIN closure ON geo_id = descendant_id GROUP BY ancestor_id, event_type"""
)
def event_rollup_incremental(spark, sf):
    """Events per unit and type: the counts of the first weeks, merged with those after."""
    w, log = cw.world(spark, sf), cw.event_log(spark, sf)
    first = incremental.event_delta(log, w, log.events.where("time < 20"))
    later = incremental.event_delta(log, w, log.events.where("time >= 20"))
    base, delta = storage.stored(first, "event-base"), storage.stored(later, "event-delta")
    return incremental.merged(base, delta, ["event_type"])


@query("SELECT geo_id, kind, category, n FROM unlabelled_rolled")
def unit_stats_missing_labels(spark, sf):
    stats = us.unit_stats(cw.unlabelled_world(spark, sf))
    return us.stats_long(stats, ["sex", "venue", "activity"])


@query(
    """SELECT g.geo_id, category AS venue_type, n, s.population FROM geo_units g
       JOIN unlabelled_rolled r ON r.geo_id = g.geo_id AND kind = 'venue'
       JOIN stats s ON s.geo_id = g.geo_id WHERE g.lat IS NOT NULL"""
)
def level_features_missing_labels(spark, sf):
    w = cw.unlabelled_world(spark, sf)
    shown = us.level_features(w, us.unit_stats(w, with_activities=False))
    return shown.select("geo_id", "population", F.explode("venue_types").alias("venue_type", "n"))


@query(
    """SELECT d.geo_id, category AS sex, n, n / population * 100 AS percent
       FROM unlabelled_rolled d JOIN unit_population p ON p.geo_id = d.geo_id
       WHERE kind = 'sex'"""
)
def unit_detail_missing_labels(spark, sf):
    w = cw.unlabelled_world(spark, sf)
    detail = us.unit_detail(w, us.unit_stats(w))
    entries = detail.select("geo_id", "population", F.explode("sex_distribution").alias("sex", "n"))
    return entries.select(
        "geo_id", "sex", "n", (F.col("n") / F.col("population") * 100).alias("percent")
    )


@query("SELECT geo_id, population, venues_count, children_count, has_stats FROM stats")
def unit_stats_totals(spark, sf):
    return us.unit_stats(cw.world(spark, sf), with_activities=False).select(
        "geo_id", "population", "venues_count", "children_count", "has_stats"
    )


@query(
    """SELECT s.geo_id, CAST(coalesce(a.n, 0) AS BIGINT) AS people_65_plus,
              CAST(coalesce(v.n, 0) AS BIGINT) AS schools,
              CAST(0 AS BIGINT) AS cinemas
       FROM stats s
       LEFT JOIN rolled a ON a.geo_id = s.geo_id AND a.kind = 'age' AND a.category = '65+'
       LEFT JOIN rolled v ON v.geo_id = s.geo_id AND v.kind = 'venue' AND v.category = 'school'"""
)
def measure_lookup(spark, sf):
    stats = us.unit_stats(cw.world(spark, sf), with_activities=False)
    return stats.select(
        "geo_id",
        us.people_aged("65+").alias("people_65_plus"),
        us.venues_of_type("school").alias("schools"),
        us.venues_of_type("cinema").alias("cinemas"),
    )


@query(
    """SELECT g.geo_id, g.name, g.level, s.population, s.venues_count,
              g.parent_id IN (SELECT geo_id FROM geo_units) AS has_parent,
              s.children_count, g.lat, g.lon
       FROM geo_units g JOIN stats s ON s.geo_id = g.geo_id WHERE g.lat IS NOT NULL"""
)
def level_features(spark, sf):
    w = cw.world(spark, sf)
    stats = us.unit_stats(w, with_activities=False)
    return us.level_features(w, stats).drop("venue_types")


@query(
    """SELECT g.geo_id, g.name, g.level, g.lat, g.lon, s.population, s.venues_count,
              s.children_count, p.geo_id AS parent_id, p.name AS parent_name,
              p.level AS parent_level
       FROM geo_units g JOIN stats s ON s.geo_id = g.geo_id AND s.has_stats
       LEFT JOIN geo_units p ON p.geo_id = g.parent_id"""
)
def unit_detail(spark, sf):
    w = cw.world(spark, sf)
    return us.unit_detail(w, us.unit_stats(w)).select(
        "geo_id",
        "name",
        "level",
        "lat",
        "lon",
        "population",
        "venues_count",
        "children_count",
        F.col("parent.id").alias("parent_id"),
        F.col("parent.name").alias("parent_name"),
        F.col("parent.level").alias("parent_level"),
    )


@query(
    """SELECT geo_id, kind, category, n, total, n / total * 100 AS percent FROM (
         SELECT *, CAST(sum(n) OVER (PARTITION BY geo_id, kind) AS BIGINT) AS total
         FROM rolled WHERE kind IN ('age', 'sex')) WHERE total > 0"""
)
def distribution_shares(spark, sf):
    stats = us.unit_stats(cw.world(spark, sf), with_activities=False)
    return us.shares(us.stats_long(stats, ["age", "sex"]), by=["geo_id", "kind"])


@query(
    """SELECT r.geo_id, kind, category, n, population AS total, n / population * 100 AS percent
       FROM rolled r JOIN unit_population p ON r.geo_id = p.geo_id
       WHERE kind = 'activity' AND population > 0"""
)
def activity_shares(spark, sf):
    w = cw.world(spark, sf)
    activity = us.activity_counts(w).select(
        "geo_id", F.lit("activity").alias("kind"), F.col("activity").alias("category"), "n"
    )
    population = us.rollup(us.direct_population(w), w, [], n="population", counted=True)
    return us.shares(
        us.rollup(activity, w, ["kind", "category"], counted=True),
        population.withColumnRenamed("population", "total"),
    )


@query(
    """SELECT geo_id, category, n, place, n / max(n) OVER (PARTITION BY geo_id) * 100 AS relative
       FROM (SELECT geo_id, category, n, CAST(row_number() OVER
               (PARTITION BY geo_id ORDER BY n DESC, category) AS INTEGER) AS place
             FROM rolled WHERE kind = 'venue') WHERE place <= 3"""
)
def venue_type_breakdown(spark, sf):
    w = cw.world(spark, sf)
    venues = us.venue_type_counts(w).withColumnRenamed("venue_type", "category")
    return us.top_breakdown(us.rollup(venues, w, ["category"], counted=True), n=3)


# --- world profile ------------------------------------------------------------------


@query(
    """SELECT count(*) AS total_people, round_even((avg(age)) * 100.0e0, 0) / 100.0e0 AS mean_age, min(age) AS min_age,
              max(age) AS max_age FROM people"""
)
def population_summary(spark, sf):
    return profile.population_summary(cw.world(spark, sf))


@query("SELECT sex, count(*) AS n FROM people GROUP BY sex")
def sex_distribution(spark, sf):
    return profile.sex_distribution(cw.world(spark, sf))


@query(
    """SELECT level, count(*) AS people FROM people JOIN geo_units USING (geo_id)
       GROUP BY level"""
)
def population_by_level(spark, sf):
    return profile.population_by_level(cw.world(spark, sf))


_NUMERIC = """count(v) AS "count", round_even((avg(v)) * 10000.0e0, 0) / 10000.0e0 AS mean,
    round_even((stddev_pop(v)) * 10000.0e0, 0) / 10000.0e0 AS std,
    min(v) AS "min", max(v) AS "max", quantile_cont(v, 0.25e0) AS p25,
    quantile_cont(v, 0.5e0) AS median, quantile_cont(v, 0.75e0) AS p75"""


@query(
    f"""SELECT property, {_NUMERIC} FROM (
          SELECT 'age' AS property, CAST(age AS DOUBLE) AS v FROM people
          UNION ALL SELECT 'income', income FROM people)
        GROUP BY property"""
)
def numeric_profile(spark, sf):
    return profile.profile_numeric(cw.world(spark, sf).people, ["age", "income"])


@query(
    """SELECT property, value, n, total AS "count", unique_count, place,
              round_even((100.0e0 * n / total) * 100.0e0, 0) / 100.0e0 AS percent
       FROM (SELECT 'venue_id' AS property, CAST(venue_id AS VARCHAR) AS value, count(*) AS n,
                    CAST(sum(count(*)) OVER () AS BIGINT) AS total,
                    count(*) OVER () AS unique_count,
                    CAST(row_number() OVER (ORDER BY count(*) DESC, CAST(venue_id AS VARCHAR))
                         AS INTEGER) AS place
             FROM activities GROUP BY venue_id)
       WHERE place <= 25"""
)
def categorical_profile(spark, sf):
    return profile.profile_categorical(cw.world(spark, sf).activities, ["venue_id"])


_LONG_PROFILE = """
    numeric_long AS (
      SELECT grp, property, 'numeric' AS kind, measure, CAST(NULL AS VARCHAR) AS category, amount
      FROM (SELECT grp, property, CAST(count(v) AS DOUBLE) AS "count", round_even((avg(v)) * 10000.0e0, 0) / 10000.0e0 AS mean,
                   round_even((stddev_pop(v)) * 10000.0e0, 0) / 10000.0e0 AS std, min(v) AS "min", max(v) AS "max",
                   quantile_cont(v, 0.25e0) AS p25, quantile_cont(v, 0.5e0) AS median,
                   quantile_cont(v, 0.75e0) AS p75
            FROM numeric_cells GROUP BY grp, property)
      UNPIVOT (amount FOR measure IN ("count", mean, std, "min", "max", p25, median, p75))),
    category_counts AS (
      SELECT grp, property, v, count(*) AS n,
             row_number() OVER (PARTITION BY grp, property ORDER BY count(*) DESC, v) AS place,
             sum(count(*)) OVER (PARTITION BY grp, property) AS total,
             count(*) OVER (PARTITION BY grp, property) AS uniques
      FROM category_cells GROUP BY grp, property, v),
    long_profile AS (
      SELECT * FROM numeric_long
      UNION ALL SELECT grp, property, 'categorical', 'n', v, CAST(n AS DOUBLE)
        FROM category_counts WHERE place <= 25
      UNION ALL SELECT grp, property, 'categorical', 'percent', v,
                       round_even((100.0e0 * n / CAST(total AS BIGINT)) * 100.0e0, 0) / 100.0e0
        FROM category_counts WHERE place <= 25
      UNION ALL SELECT grp, property, 'categorical', 'count', NULL, CAST(total AS DOUBLE)
        FROM category_counts WHERE place = 1
      UNION ALL SELECT grp, property, 'categorical', 'unique_count', NULL, CAST(uniques AS DOUBLE)
        FROM category_counts WHERE place = 1)"""


@query(
    f""", numeric_cells AS (
         SELECT 0 AS grp, 'age' AS property, CAST(age AS DOUBLE) AS v FROM people
         UNION ALL SELECT 0, 'income', income FROM people),
       category_cells AS (
         SELECT 0 AS grp, 'sex' AS property, sex AS v FROM people
         UNION ALL SELECT 0, 'segment', segment FROM people),
       {_LONG_PROFILE}
       SELECT property, kind, measure, category, amount FROM long_profile"""
)
def people_profile(spark, sf):
    return profile.profile_people(cw.world(spark, sf))


@query(
    f""", numeric_cells AS (
         SELECT venue_type AS grp, 'balance' AS property, balance AS v FROM venues),
       category_cells AS (SELECT '' AS grp, '' AS property, '' AS v WHERE false),
       {_LONG_PROFILE}
       SELECT grp AS venue_type, property, kind, measure, category, amount FROM long_profile"""
)
def venue_profile(spark, sf):
    return profile.profile_venues(cw.world(spark, sf))


@query(
    """SELECT round_even((avg(f)) * 100.0e0, 0) / 100.0e0 AS mean, median(f) AS median, min(f) AS "min", max(f) AS "max",
              count(*) AS total_subsets, count(f) AS non_empty_subsets
       FROM (SELECT CASE WHEN member_count > 0 THEN member_count END AS f FROM subsets)"""
)
def subset_sizes(spark, sf):
    return profile.subset_sizes(cw.world(spark, sf))


@query(
    f"""SELECT name AS activity, count(DISTINCT person_id) AS people
        FROM (VALUES {', '.join(f"('{a}')" for a in f.ACTIVITY_NAMES)}) AS names(name)
        LEFT JOIN activities ON activity = name GROUP BY name"""
)
def people_per_activity(spark, sf):
    return profile.people_per_activity(cw.world(spark, sf), f.ACTIVITY_NAMES)


@query(
    """SELECT count(DISTINCT person_id) AS active_people,
              round_even((count(DISTINCT person_id || ' ' || activity)
                / count(DISTINCT person_id)) * 100.0e0, 0) / 100.0e0 AS mean_activity_types,
              round_even((count(*) / (SELECT count(*) FROM people)) * 100.0e0, 0) / 100.0e0 AS mean_assignments,
              round_even(((SELECT avg(member_count - 1) FROM subsets WHERE member_count > 0)
                * (count(*) / (SELECT count(*) FROM people))) * 10.0e0, 0) / 10.0e0 AS mean_contacts_estimate
       FROM activities"""
)
def activity_summary(spark, sf):
    return profile.activity_summary(cw.world(spark, sf))


_HOUSEHOLDS = """SELECT v.venue_id, CAST(coalesce(sum(member_count), 0) AS BIGINT) AS size
    FROM venues v LEFT JOIN subsets s ON v.venue_id = s.venue_id
    WHERE venue_type = 'household' GROUP BY v.venue_id"""


@query(f"SELECT size, count(*) AS households FROM ({_HOUSEHOLDS}) GROUP BY size")
def household_sizes(spark, sf):
    return profile.household_sizes(cw.world(spark, sf))


@query(
    f"""SELECT count(*) AS total_households, CAST(sum(size) AS BIGINT) / count(*) AS average_size
        FROM ({_HOUSEHOLDS})"""
)
def household_summary(spark, sf):
    return profile.household_summary(profile.household_sizes(cw.world(spark, sf)))


@query(
    """SELECT (SELECT count(*) FROM geo_units) AS units,
              (SELECT count(DISTINCT level) FROM geo_units) AS levels,
              (SELECT count(*) FROM people) AS people, (SELECT count(*) FROM venues) AS venues,
              (SELECT count(DISTINCT venue_type) FROM venues) AS venue_types"""
)
def world_totals(spark, sf):
    return profile.world_totals(cw.world(spark, sf))


# --- venues -------------------------------------------------------------------------


@query("SELECT venue_type, count(*) AS venues FROM venues GROUP BY venue_type")
def venue_types(spark, sf):
    return venues.venue_types(cw.world(spark, sf))


@query(
    """SELECT v.venue_id, v.name, v.venue_type, g.name AS unit,
              CAST(coalesce(m.n, 0) AS BIGINT) AS num_members, v.is_residence, v.lat, v.lon
       FROM venues v LEFT JOIN geo_units g ON v.geo_id = g.geo_id
       LEFT JOIN (SELECT venue_id, sum(member_count) AS n FROM subsets GROUP BY venue_id) m
         ON m.venue_id = v.venue_id
       WHERE v.lat IS NOT NULL"""
)
def venue_features(spark, sf):
    return venues.venue_features(cw.world(spark, sf))


@query(
    """SELECT v.venue_id, v.name, v.venue_type, v.geo_id, g.name AS unit, g.level AS unit_level,
              s.subset_pos, s.subset_name, s.member_count
       FROM venues v LEFT JOIN geo_units g ON v.geo_id = g.geo_id
       LEFT JOIN subsets s ON s.venue_id = v.venue_id"""
)
def venue_detail(spark, sf):
    return venues.venue_subsets(cw.world(spark, sf)).drop("coordinates")


@query(
    """SELECT v.venue_id, p.venue_id AS parent_id, p.name AS parent_name
       FROM venues v LEFT JOIN venues p ON v.parent_id = p.venue_id"""
)
def venue_parents(spark, sf):
    return venues.venue_parents(cw.world(spark, sf))


_CHILD_TOTALS = """SELECT v.venue_id, count(DISTINCT c.venue_id) AS child_count,
      CAST(coalesce(sum(s.member_count), 0) AS BIGINT) AS total_child_members
    FROM venues v LEFT JOIN venues c ON c.parent_id = v.venue_id
    LEFT JOIN subsets s ON s.venue_id = c.venue_id GROUP BY v.venue_id"""


@query(_CHILD_TOTALS)
def venue_child_totals(spark, sf):
    return venues.venue_child_totals(cw.world(spark, sf))


@query(
    f""", totals AS ({_CHILD_TOTALS}), listed AS (
         SELECT ancestor_id, venue_id, row_number() OVER
                  (PARTITION BY ancestor_id ORDER BY ordinal) - 1 AS rank
         FROM venues JOIN closure ON geo_id = descendant_id WHERE parent_id = -1)
       SELECT l.ancestor_id, l.venue_id, l.rank, l.rank // 20 + 1 AS page, v.name, v.venue_type,
              v.geo_id, v.lat, v.lon, t.child_count, t.total_child_members, g.name AS unit
       FROM listed l JOIN venues v ON l.venue_id = v.venue_id
       JOIN totals t ON t.venue_id = v.venue_id LEFT JOIN geo_units g ON g.geo_id = v.geo_id"""
)
def unit_venue_pages(spark, sf):
    return venues.unit_venues(cw.world(spark, sf), per_page=20)


@query(
    """, listed AS (
         SELECT ancestor_id, venue_id, row_number() OVER
                  (PARTITION BY ancestor_id ORDER BY ordinal) - 1 AS rank
         FROM venues JOIN closure ON geo_id = descendant_id WHERE parent_id = -1)
       SELECT l.ancestor_id, l.venue_id, l.rank, l.rank // 20 + 1 AS page,
              s.subset_pos, s.subset_name, s.member_count
       FROM listed l LEFT JOIN subsets s ON s.venue_id = l.venue_id"""
)
def unit_venue_subsets(spark, sf):
    """The subset lists of every unit's venue listing."""
    w = cw.world(spark, sf)
    listed = venues.unit_venues(w, per_page=20).select("ancestor_id", "venue_id", "rank", "page")
    return venues.with_subsets(listed, w)


@query(
    f""", totals AS ({_CHILD_TOTALS}), listed AS (
         SELECT venue_id, row_number() OVER (ORDER BY ordinal) - 1 AS rank
         FROM venues JOIN closure ON geo_id = descendant_id
         WHERE parent_id = -1 AND ancestor_id = 0 AND venue_type = 'household')
       SELECT CAST(0 AS BIGINT) AS ancestor_id, l.venue_id, l.rank, CAST(2 AS BIGINT) AS page,
              v.name, t.child_count, t.total_child_members, s.subset_pos, s.subset_name,
              s.member_count
       FROM listed l JOIN venues v ON l.venue_id = v.venue_id
       JOIN totals t ON t.venue_id = v.venue_id LEFT JOIN subsets s ON s.venue_id = v.venue_id
       WHERE l.rank = 1"""
)
def unit_venue_page(spark, sf):
    """One page of one type's venues below one unit, with subset lists."""
    w = cw.world(spark, sf)
    listed = venues.unit_venues(w, unit=0, venue_type="household", page=2, per_page=1)
    shown = ["ancestor_id", "venue_id", "rank", "page", "name", "child_count"]
    return venues.with_subsets(listed.select(*shown, "total_child_members"), w)


@query(
    """, listed AS (
         SELECT v.*, row_number() OVER (ORDER BY ordinal) - 1 AS rank
         FROM venues v WHERE parent_id = 0)
       SELECT l.parent_id, l.venue_id, l.rank, CAST(1 AS BIGINT) AS page, g.name AS unit,
              s.subset_pos, s.subset_name, s.member_count
       FROM listed l LEFT JOIN geo_units g ON g.geo_id = l.geo_id
       LEFT JOIN subsets s ON s.venue_id = l.venue_id WHERE l.rank // 2 = 0"""
)
def venue_children_page(spark, sf):
    w = cw.world(spark, sf)
    listed = venues.venue_children(w, parent=0, page=1, per_page=2)
    return venues.with_subsets(listed.select("parent_id", "venue_id", "rank", "page", "unit"), w)


@query(
    """, listed AS (
         SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY ordinal) - 1 AS rank
         FROM venues WHERE parent_id <> -1)
       SELECT l.parent_id, l.venue_id, l.rank, s.subset_pos, s.subset_name, s.member_count
       FROM listed l LEFT JOIN subsets s ON s.venue_id = l.venue_id"""
)
def venue_children_subsets(spark, sf):
    """The subset lists of every parent's child listing."""
    w = cw.world(spark, sf)
    listed = venues.venue_children(w).select("parent_id", "venue_id", "rank")
    return venues.with_subsets(listed, w)


@query(
    """SELECT v.parent_id, v.venue_id, v.name, v.venue_type, v.geo_id, v.lat, v.lon, v.ordinal,
              g.name AS unit, row_number() OVER w - 1 AS rank,
              (row_number() OVER w - 1) // 2 + 1 AS page
       FROM venues v LEFT JOIN geo_units g ON g.geo_id = v.geo_id WHERE v.parent_id <> -1
       WINDOW w AS (PARTITION BY v.parent_id ORDER BY v.ordinal)"""
)
def venue_children_pages(spark, sf):
    return venues.venue_children(cw.world(spark, sf), per_page=2)


@query(
    """SELECT m.venue_id, m.subset_pos, s.subset_name, m.seq, m.seq // 50 + 1 AS page,
              m.person_id, p.age, p.sex, coalesce(g.name, CAST(p.geo_id AS VARCHAR)) AS unit
       FROM memberships m
       JOIN subsets s ON m.venue_id = s.venue_id AND m.subset_pos = s.subset_pos
       JOIN people p ON p.person_id = m.person_id
       LEFT JOIN geo_units g ON g.geo_id = p.geo_id"""
)
def venue_member_pages(spark, sf):
    return venues.venue_members(cw.world(spark, sf))


@query(
    """SELECT s.venue_id, s.subset_pos, s.subset_name, count(m.person_id) AS total,
              CAST(greatest(1, ceil(count(m.person_id) / 50)) AS BIGINT) AS total_pages, 1 AS page
       FROM subsets s LEFT JOIN memberships m
         ON m.venue_id = s.venue_id AND m.subset_pos = s.subset_pos
       GROUP BY s.venue_id, s.subset_pos, s.subset_name"""
)
def venue_member_lists(spark, sf):
    return venues.member_lists(cw.world(spark, sf))


# --- people -------------------------------------------------------------------------


@query(
    """SELECT p.person_id, p.age, p.sex, p.income, p.segment, g.geo_id AS unit_id,
              g.name AS unit, g.level AS unit_level
       FROM people p LEFT JOIN geo_units g ON p.geo_id = g.geo_id"""
)
def person_profile(spark, sf):
    return people.person_profile(cw.world(spark, sf)).select(
        "person_id",
        "age",
        "sex",
        "income",
        "segment",
        F.col("home_unit.id").alias("unit_id"),
        F.col("home_unit.name").alias("unit"),
        F.col("home_unit.level").alias("unit_level"),
    )


@query(
    """SELECT a.person_id, a.seq, a.activity, a.venue_id, v.name AS venue_name, v.venue_type,
              coalesce(g.name, CAST(v.geo_id AS VARCHAR)) AS venue_unit,
              coalesce(s.subset_name, CAST(a.subset_pos AS VARCHAR)) AS subset_name
       FROM activities a JOIN venues v ON a.venue_id = v.venue_id
       LEFT JOIN geo_units g ON v.geo_id = g.geo_id
       LEFT JOIN subsets s ON s.venue_id = a.venue_id AND s.subset_pos = a.subset_pos"""
)
def person_activities(spark, sf):
    return people.person_activities(cw.world(spark, sf))


@query(
    """SELECT person_id, activity, venue_type, count(*) AS visits
       FROM activities JOIN venues USING (venue_id) GROUP BY person_id, activity, venue_type"""
)
def activity_map_sizes(spark, sf):
    nested = people.activity_map(cw.world(spark, sf))
    return (
        nested.select("person_id", F.explode("activity_map").alias("activity", "venues"))
        .select("person_id", "activity", F.explode("venues").alias("venue_type", "visits"))
        .groupBy("person_id", "activity", "venue_type")
        .agg(F.sum(F.size("visits")).alias("visits"))
    )


@query(
    """SELECT a.person_id, a.seq, a.activity, a.venue_id, v.name AS venue_name, v.venue_type,
              coalesce(g.name, CAST(v.geo_id AS VARCHAR)) AS venue_unit,
              coalesce(s.subset_name, CAST(a.subset_pos AS VARCHAR)) AS subset_name
       FROM activities a JOIN venues v ON a.venue_id = v.venue_id
       LEFT JOIN geo_units g ON v.geo_id = g.geo_id
       LEFT JOIN subsets s ON s.venue_id = a.venue_id AND s.subset_pos = a.subset_pos"""
)
def person_activities_bucketed(spark, sf):
    """Assignments, venues and subsets from a world stored in buckets of venues."""
    path = storage.new_folder(spark, "bucketed")
    world_source.write_bucketed_world(cw.world(spark, sf), path, 8)
    return people.person_activities(world_source.read_bucketed_world(spark, path))


@query(
    """SELECT p.person_id, p.age, p.sex, g.name AS unit, coalesce(n, 0) AS visits,
              coalesce(kinds, 0) AS activities
       FROM people p LEFT JOIN geo_units g ON g.geo_id = p.geo_id
       LEFT JOIN (SELECT person_id, count(*) AS n, count(DISTINCT activity) AS kinds
                  FROM activities JOIN venues USING (venue_id) GROUP BY person_id) a
         ON a.person_id = p.person_id"""
)
def person_record(spark, sf):
    """Profile and activities of everyone at once."""
    record = people.person_record(cw.world(spark, sf))
    visits = F.aggregate(
        F.flatten(F.flatten(F.transform(F.map_values("activity_map"), F.map_values))),
        F.lit(0).cast("bigint"),
        lambda n, _: n + 1,
    )
    return record.select(
        "person_id",
        "age",
        "sex",
        F.col("home_unit.name").alias("unit"),
        visits.alias("visits"),
        F.size("activity_map").cast("bigint").alias("activities"),
    )


@query(
    """SELECT venue_id, venue_type,
              CASE WHEN venue_type IN ('school', 'company') THEN CAST(balance AS VARCHAR) END
                AS balance,
              CASE WHEN venue_type = 'company' THEN CAST(is_residence AS VARCHAR) END AS residence,
              CASE venue_type WHEN 'company' THEN 2 WHEN 'school' THEN 1 ELSE 0 END AS n
       FROM venues"""
)
def venue_typed_properties(spark, sf):
    """Each venue type shows the properties that belong to it."""
    rows = cw.world(spark, sf).venues.select("venue_id", "venue_type", "balance", "is_residence")
    sets = {"school": ["balance"], "company": ["balance", "is_residence"]}
    folded = world_source.with_typed_properties(rows, sets, "venue_type")
    return folded.select(
        "venue_id",
        "venue_type",
        F.try_element_at("properties", F.lit("balance")).alias("balance"),
        F.try_element_at("properties", F.lit("is_residence")).alias("residence"),
        F.size("properties").alias("n"),
    )


@query(
    """SELECT person_id, coalesce(activity, 'unknown') AS activity,
              coalesce(venue_type, 'unknown') AS venue_type, count(*) AS visits
       FROM unlabelled_activities JOIN unlabelled_venues USING (venue_id)
       GROUP BY ALL"""
)
def activity_map_missing_labels(spark, sf):
    nested = people.activity_map(cw.unlabelled_world(spark, sf))
    return (
        nested.select("person_id", F.explode("activity_map").alias("activity", "venues"))
        .select("person_id", "activity", F.explode("venues").alias("venue_type", "visits"))
        .groupBy("person_id", "activity", "venue_type")
        .agg(F.sum(F.size("visits")).alias("visits"))
    )


@query(
    """SELECT p.person_id, v.venue_type, v.name AS venue_name FROM people p
       LEFT JOIN (SELECT person_id, arg_min(venue_id, seq) AS venue_id FROM activities
                  WHERE activity = 'primary_activity' GROUP BY person_id) a
         ON a.person_id = p.person_id
       LEFT JOIN venues v ON v.venue_id = a.venue_id"""
)
def primary_activity(spark, sf):
    return people.primary_activity(cw.world(spark, sf))


@query(
    """SELECT person_id, string_agg(activity, ',' ORDER BY activity) AS activities
       FROM (SELECT DISTINCT person_id, activity FROM activities) GROUP BY person_id"""
)
def activity_types(spark, sf):
    return people.activity_types(cw.world(spark, sf)).select(
        "person_id", F.array_join("activities", ",").alias("activities")
    )


@query(
    """SELECT ancestor_id, person_id, age, sex, row_number() OVER w - 1 AS rank,
              (row_number() OVER w - 1) // 50 + 1 AS page
       FROM people JOIN closure ON geo_id = descendant_id
       WINDOW w AS (PARTITION BY ancestor_id ORDER BY ordinal)"""
)
def unit_people_pages(spark, sf):
    return people.unit_people(cw.world(spark, sf), descendants=True)


@query(
    """SELECT geo_id AS ancestor_id, person_id, age, sex, row_number() OVER w - 1 AS rank,
              (row_number() OVER w - 1) // 50 + 1 AS page
       FROM people JOIN geo_units USING (geo_id)
       WINDOW w AS (PARTITION BY geo_id ORDER BY people.ordinal)"""
)
def unit_direct_people_pages(spark, sf):
    return people.unit_people(cw.world(spark, sf))


@query(
    """, listed AS (
         SELECT person_id, age, sex, row_number() OVER (ORDER BY ordinal) - 1 AS rank
         FROM people JOIN closure ON geo_id = descendant_id WHERE ancestor_id = 1)
       SELECT CAST(1 AS BIGINT) AS ancestor_id, *, CAST(2 AS BIGINT) AS page
       FROM listed WHERE rank // 10 = 1"""
)
def unit_people_page(spark, sf):
    """One page of the people below one unit."""
    return people.unit_people(cw.world(spark, sf), unit=1, descendants=True, page=2, per_page=10)


@query(
    """SELECT * FROM (
         SELECT geo_id, person_id, age, sex,
                row_number() OVER (PARTITION BY geo_id ORDER BY people.ordinal) - 1 AS rank
         FROM people JOIN geo_units USING (geo_id)) WHERE rank < 50"""
)
def first_people(spark, sf):
    return people.first_people(cw.world(spark, sf))


# --- paging and locating ------------------------------------------------------------


@query(
    """SELECT person_id, age, sex, row_number() OVER (ORDER BY ordinal) - 1 AS rank
       FROM people ORDER BY ordinal LIMIT 50 OFFSET 50"""
)
def people_page(spark, sf):
    rows = cw.world(spark, sf).people.select("person_id", "age", "sex", "ordinal")
    return paging.paginate(rows, page=2).drop("ordinal")


@query(
    """SELECT person_id, row_number() OVER (ORDER BY ordinal) - 1 AS rank,
              (row_number() OVER (ORDER BY ordinal) - 1) // 50 + 1 AS page FROM people"""
)
def people_all_pages(spark, sf):
    rows = cw.world(spark, sf).people.select("person_id", "ordinal")
    return paging.all_pages(rows).drop("ordinal")


@query(
    """SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 1000)) AS BIGINT) AS total_pages,
              1 AS page, 1000 AS per_page FROM people"""
)
def people_page_info(spark, sf):
    return paging.page_info(cw.world(spark, sf).people, page=-3, per_page=1000)


@query(
    """SELECT p.person_id, g.name AS unit, coalesce(r.rank, 0) // 50 + 1 AS page
       FROM people p LEFT JOIN geo_units g ON p.geo_id = g.geo_id
       LEFT JOIN (SELECT ancestor_id, person_id, row_number() OVER
                           (PARTITION BY ancestor_id ORDER BY ordinal) - 1 AS rank
                  FROM people JOIN closure ON geo_id = descendant_id) r
         ON r.person_id = p.person_id AND r.ancestor_id = p.geo_id"""
)
def locate_people(spark, sf):
    return locate.locate_people(cw.world(spark, sf))


@query(
    """SELECT p.person_id, g.name AS unit, coalesce(r.rank, 0) // 1000 + 1 AS page
       FROM people p LEFT JOIN geo_units g ON p.geo_id = g.geo_id
       LEFT JOIN (SELECT ancestor_id, person_id, row_number() OVER
                           (PARTITION BY ancestor_id ORDER BY ordinal) - 1 AS rank
                  FROM people JOIN closure ON geo_id = descendant_id) r
         ON r.person_id = p.person_id AND r.ancestor_id = p.geo_id"""
)
def locate_people_large(spark, sf):
    return locate.locate_people(cw.world(spark, sf), per_page=1000)


@query(
    """SELECT person_id, age, sex, row_number() OVER (ORDER BY ordinal) - 1 AS rank
       FROM people ORDER BY ordinal LIMIT 1000"""
)
def people_page_large(spark, sf):
    rows = cw.world(spark, sf).people.select("person_id", "age", "sex", "ordinal")
    return paging.paginate(rows, per_page=1000).drop("ordinal")


@query(
    """SELECT person_id, row_number() OVER (ORDER BY md5(CAST(person_id AS VARCHAR))) - 1 AS rank
       FROM people"""
)
def people_by_hash(spark, sf):
    """Pages of an order as spread out as hashes are."""
    digest = F.md5(F.col("person_id").cast("string").cast("binary"))
    rows = cw.world(spark, sf).people.select(
        "person_id", F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint").alias("ordinal")
    )
    return paging.all_pages(rows).drop("ordinal", "page")


@query(
    """SELECT v.venue_id, g.name AS unit, v.venue_type, coalesce(r.rank, 0) // 2 + 1 AS page
       FROM venues v LEFT JOIN geo_units g ON v.geo_id = g.geo_id
       LEFT JOIN (SELECT ancestor_id, venue_id, row_number() OVER
                           (PARTITION BY ancestor_id, venue_type ORDER BY ordinal) - 1 AS rank
                  FROM venues JOIN closure ON geo_id = descendant_id WHERE parent_id = -1) r
         ON r.venue_id = v.venue_id AND r.ancestor_id = v.geo_id"""
)
def locate_venues(spark, sf):
    return locate.locate_venues(cw.world(spark, sf), per_page=2)


_SIZED = "length(sex) + length(segment) + 24"


@query(
    """SELECT v.venue_id, g.name AS unit, t.venue_type, coalesce(r.rank, 0) // 2 + 1 AS page
       FROM venues v JOIN unlabelled_venues t ON t.venue_id = v.venue_id
       LEFT JOIN geo_units g ON v.geo_id = g.geo_id
       LEFT JOIN (SELECT ancestor_id, v.venue_id, row_number() OVER
                           (PARTITION BY ancestor_id, u.venue_type ORDER BY ordinal) - 1 AS rank
                  FROM venues v JOIN unlabelled_venues u ON u.venue_id = v.venue_id
                  JOIN closure ON v.geo_id = descendant_id WHERE parent_id = -1) r
         ON r.venue_id = v.venue_id AND r.ancestor_id = v.geo_id"""
)
def locate_venues_missing_types(spark, sf):
    """Venues without a type have a listing of their own."""
    return locate.locate_venues(cw.unlabelled_world(spark, sf), per_page=2)


@query(
    f"""SELECT person_id, CAST(bytes AS BIGINT) AS bytes,
               CAST(bytes_before AS BIGINT) AS bytes_before,
               bytes_before <= 16384 AS kept
        FROM (SELECT person_id, {_SIZED} AS bytes, 1000 + coalesce(sum({_SIZED}) OVER
                (ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                AS bytes_before
              FROM people)"""
)
def size_budget(spark, sf):
    return _budgeted(spark, sf).drop("ordinal")


@query(
    f"""SELECT count(CASE WHEN b <= 16384 THEN 1 END) AS kept,
               count(CASE WHEN b > 16384 THEN 1 END) AS dropped,
               CAST(sum(CASE WHEN b <= 16384 THEN bytes END) AS BIGINT) AS kept_bytes
        FROM (SELECT {_SIZED} AS bytes, 1000 + coalesce(sum({_SIZED}) OVER
                (ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
              FROM people)"""
)
def size_budget_report(spark, sf):
    return paging.budget_report(_budgeted(spark, sf), "bytes")


def _budgeted(spark, sf):
    records = cw.world(spark, sf).people.select(
        "person_id", "ordinal", F.expr(f"CAST({_SIZED} AS BIGINT)").alias("bytes")
    )
    return paging.take_within_bytes(records, "ordinal", "bytes", budget=16384, start=1000)


# --- events -------------------------------------------------------------------------

_TYPES = ", ".join(f"('{t}')" for t in f.EVENT_TYPES)
_WINDOW = "time >= 2.0e0 AND time <= 9.0e0"


@query(
    f"""SELECT t.event_type, count(e.event_id) AS n,
               (SELECT min(time) FROM world_events) AS time_min,
               (SELECT max(time) FROM world_events) AS time_max
        FROM (VALUES {_TYPES}) AS t(event_type) LEFT JOIN world_events e USING (event_type)
        GROUP BY t.event_type"""
)
def event_summary(spark, sf):
    return events.event_summary(cw.event_log(spark, sf), f.EVENT_TYPES)


@query(
    """SELECT event_type, CAST(floor(time) AS BIGINT) AS day, count(*) AS n FROM world_events
       GROUP BY event_type, floor(time)"""
)
def event_timeseries(spark, sf):
    return events.event_timeseries(cw.event_log(spark, sf).events)


@query("SELECT DISTINCT event_type FROM world_events")
def event_types(spark, sf):
    return events.available_types(cw.event_log(spark, sf).events)


@query("SELECT event_id, event_type, time, person_id, venue_id, geo_id FROM located")
def located_events(spark, sf):
    log = cw.event_log(spark, sf)
    return events.resolve_geo(log.events, log)


@query(f"SELECT event_id, event_type, time, person_id, venue_id FROM world_events WHERE {_WINDOW}")
def events_in_window(spark, sf):
    return events.in_window(cw.event_log(spark, sf).events, 2, 9)


@query(
    f"""SELECT event_type, geo_id, count(*) AS n FROM located
        WHERE event_type = 'purchase' AND {_WINDOW} GROUP BY event_type, geo_id"""
)
def event_counts(spark, sf):
    return events.geo_counts(cw.event_log(spark, sf), ["purchase"], 2, 9)


@query(
    f"""SELECT event_type, geo_id, count(*) AS n FROM located
        WHERE event_type IN ('click', 'error', 'view') AND {_WINDOW} GROUP BY event_type, geo_id"""
)
def event_counts_batch(spark, sf):
    return events.geo_counts(cw.event_log(spark, sf), ["click", "error", "view"], 2, 9)


@query(
    """SELECT event_type, geo_id, count(*) AS n FROM located
       WHERE time <= 9.0e0 GROUP BY event_type, geo_id"""
)
def event_counts_cumulative(spark, sf):
    return events.geo_cumulative(cw.event_log(spark, sf), end=9)


_RATE = "CASE WHEN p.population > 0 THEN n / p.population * 100000 ELSE 0.0e0 END"


@query(
    f"""SELECT event_type, c.geo_id, n, p.population, {_RATE} AS rate
        FROM (SELECT event_type, geo_id, count(*) AS n FROM located WHERE {_WINDOW}
              GROUP BY event_type, geo_id) c LEFT JOIN rate_population p ON p.geo_id = c.geo_id"""
)
def event_rates(spark, sf):
    counts = events.geo_counts(cw.event_log(spark, sf), start=2, end=9)
    return events.geo_rates(counts, events.rate_population(cw.world(spark, sf)))


@query(
    f"""SELECT event_type, c.geo_id, n, {_RATE} AS rate, g.lat, g.lon
        FROM (SELECT event_type, geo_id, count(*) AS n FROM located WHERE {_WINDOW}
              GROUP BY event_type, geo_id) c
        JOIN geo_units g ON g.geo_id = c.geo_id AND g.lat IS NOT NULL
        LEFT JOIN rate_population p ON p.geo_id = c.geo_id"""
)
def event_features(spark, sf):
    return events.event_features(cw.event_log(spark, sf), cw.world(spark, sf), None, 2, 9)


@query(
    f"""SELECT event_type, count(*) AS total, count(g.lat) AS shown_total
        FROM located e LEFT JOIN geo_units g ON g.geo_id = e.geo_id WHERE {_WINDOW}
        GROUP BY event_type"""
)
def event_feature_totals(spark, sf):
    return events.feature_totals(cw.event_log(spark, sf), cw.world(spark, sf), None, 2, 9)


@query(
    f"""SELECT t.event_type, count(e.event_id) AS n FROM (VALUES {_TYPES}) AS t(event_type)
        LEFT JOIN located e ON e.event_type = t.event_type AND time >= 11.0e0 AND time <= 12.0e0
        GROUP BY t.event_type"""
)
def event_window_totals(spark, sf):
    return events.window_totals(cw.event_log(spark, sf), f.EVENT_TYPES, 12, 1)


@query(
    """SELECT geo_id, event_type, count(CASE WHEN time >= 11.0e0 THEN 1 END) AS rolling,
              count(*) AS cumulative
       FROM located WHERE time <= 12.0e0 GROUP BY geo_id, event_type"""
)
def unit_event_cards(spark, sf):
    return events.unit_event_card(cw.event_log(spark, sf), f.EVENT_TYPES, 12, 1)


@query(
    f"""SELECT CAST(1000 AS BIGINT) AS geo_id, t.event_type,
               count(CASE WHEN time >= 11.0e0 THEN 1 END) AS rolling,
               count(e.event_id) AS cumulative
        FROM (VALUES {_TYPES}) AS t(event_type)
        LEFT JOIN located e ON e.event_type = t.event_type AND time <= 12.0e0 AND geo_id = 1000
        GROUP BY t.event_type"""
)
def unit_event_card_one(spark, sf):
    return events.unit_event_card(cw.event_log(spark, sf), f.EVENT_TYPES, 12, 1, unit=1000)


# --- frames -------------------------------------------------------------------------


@query("SELECT event_type, frame, geo_id, n FROM frames")
def event_frames(spark, sf):
    return frames.bake_frames(cw.event_log(spark, sf))


@query(
    """SELECT event_type, k AS frame, geo_id, count(*) AS n
       FROM located JOIN (
         SELECT CAST(k AS BIGINT) AS k, 
                round_even((t0 + k * 0.5e0) * 1000000.0e0, 0) / 1000000.0e0 AS ft
         FROM frame_bounds, range(0, 4000) AS r(k)
         WHERE t0 + k * 0.5e0 <= t1 + 0.005e0) ON time <= ft AND time >= ft - 2.0e0
       GROUP BY event_type, k, geo_id"""
)
def event_frames_overlapping(spark, sf):
    return frames.bake_frames(cw.event_log(spark, sf), step=0.5, width=2.0)


@query(
    """SELECT event_type, frame, geo_id, count(*) AS n
       FROM located JOIN frame_times ON time <= frame_time AND time >= frame_time - 10.0e0
       GROUP BY event_type, frame, geo_id"""
)
def event_frames_wide(spark, sf):
    """Windows ten steps wide, counted by differences."""
    return frames.bake_frames(cw.event_log(spark, sf), step=1.0, width=10.0)


@query(
    """SELECT event_type, k AS frame, geo_id, count(*) AS n
       FROM located JOIN (
         SELECT CAST(k AS BIGINT) AS k, 
                round_even((t0 + k * 2.0e0) * 1000000.0e0, 0) / 1000000.0e0 AS ft
         FROM frame_bounds, range(0, 4000) AS r(k)
         WHERE t0 + k * 2.0e0 <= t1 + 0.02e0) ON time <= ft AND time >= ft - 0.7e0
       GROUP BY event_type, k, geo_id"""
)
def event_frames_with_gaps(spark, sf):
    return frames.bake_frames(cw.event_log(spark, sf), step=2.0, width=0.7)


@query(
    """SELECT event_type, frame, geo_id, n, CAST(sum(n) OVER
         (PARTITION BY event_type, geo_id ORDER BY frame) AS BIGINT) AS total FROM frames"""
)
def event_frames_cumulated(spark, sf):
    return frames.cumulate_frames(frames.bake_frames(cw.event_log(spark, sf)))


@query(
    """SELECT event_type, frame, geo_id, n FROM frames, frame_bounds
       WHERE frame = CAST(floor((12.4e0 - t0) / 1.0e0 + 0.5e0) AS BIGINT)"""
)
def event_frame_at_time(spark, sf):
    log = cw.event_log(spark, sf)
    return frames.frame_at(log, frames.bake_frames(log), 12.4)


@query(
    """SELECT event_type, geo_id, CAST(sum(n) AS BIGINT) AS n FROM frames, frame_bounds
       WHERE frame <= CAST(floor((12.4e0 - t0) / 1.0e0 + 0.5e0) AS BIGINT)
       GROUP BY event_type, geo_id"""
)
def event_frame_at_time_cumulative(spark, sf):
    log = cw.event_log(spark, sf)
    return frames.frame_at(log, frames.bake_frames(log), 12.4, cumulative=True)


@query(
    """SELECT g.geo_id, g.lat, g.lon, p.population FROM geo_units g
       LEFT JOIN rate_population p ON p.geo_id = g.geo_id WHERE g.lat IS NOT NULL"""
)
def geo_lookup(spark, sf):
    return frames.geo_lookup(cw.world(spark, sf))


@query(
    f"""SELECT event_type, frame, c.geo_id, n, g.lat, g.lon, p.population, {_RATE} AS rate
        FROM frames c JOIN geo_units g ON g.geo_id = c.geo_id AND g.lat IS NOT NULL
        LEFT JOIN rate_population p ON p.geo_id = c.geo_id"""
)
def event_frame_features(spark, sf):
    baked = frames.bake_frames(cw.event_log(spark, sf))
    return frames.frame_features(baked, frames.geo_lookup(cw.world(spark, sf)))


# --- map classes and extent ---------------------------------------------------------

_DAY_FRAMES = "(SELECT *, max(n) OVER (PARTITION BY event_type, frame) AS largest FROM frames)"


@query(
    """SELECT event_type, frame, geo_id, n, CASE WHEN n <= 2 THEN 0 WHEN n <= 5 THEN 1
         WHEN n <= 10 THEN 2 WHEN n <= 20 THEN 3 ELSE 4 END AS class FROM frames"""
)
def count_classes(spark, sf):
    return map_classes.count_classes(frames.bake_frames(cw.event_log(spark, sf)))


@query(
    f"""SELECT event_type, frame, geo_id, n, largest, CASE WHEN n / largest < 0.25e0 THEN 0
          WHEN n / largest < 0.5e0 THEN 1 WHEN n / largest < 0.75e0 THEN 2 ELSE 3 END AS class
        FROM {_DAY_FRAMES}"""
)
def relative_classes(spark, sf):
    baked = frames.bake_frames(cw.event_log(spark, sf))
    return map_classes.relative_classes(baked, ["event_type", "frame"])


@query(
    f"""SELECT event_type, frame, geo_id, n, largest,
               round(sqrt(n) / sqrt(largest), 9) AS by_sqrt,
               round(log10(n + 1) / log10(largest + 1), 9) AS by_log,
               round(n / largest, 9) AS by_share
        FROM {_DAY_FRAMES}"""
)
def magnitudes(spark, sf):
    baked = frames.bake_frames(cw.event_log(spark, sf))
    sized = map_classes.magnitudes(baked, ["event_type", "frame"]).withColumnRenamed(
        "magnitude", "by_sqrt"
    )
    n, largest = F.col("n"), F.col("largest")
    return sized.withColumns(
        {
            "by_sqrt": F.round("by_sqrt", 9),
            "by_log": F.round(classify.magnitude(n, largest, "log"), 9),
            "by_share": F.round(classify.magnitude(n, largest, "linear"), 9),
        }
    )


@query(
    """SELECT geo_id, population, CASE WHEN population > 10000 THEN 4 WHEN population > 5000
         THEN 3 WHEN population > 1000 THEN 2 WHEN population > 500 THEN 1 ELSE 0 END AS class
       FROM unit_population"""
)
def population_classes(spark, sf):
    w = cw.world(spark, sf)
    return map_classes.population_classes(
        us.rollup(us.direct_population(w), w, [], n="population", counted=True)
    )


@query(
    """SELECT level, min(lat) AS south, max(lat) AS north, min(lon) AS west, max(lon) AS east
       FROM geo_units WHERE lat IS NOT NULL GROUP BY level"""
)
def level_extent(spark, sf):
    return extent.extent(cw.world(spark, sf).geo)


@query(
    """SELECT zone, 32600 + zone + CASE WHEN lat < 0 THEN 100 ELSE 0 END AS epsg FROM (
         SELECT CAST(trunc((median(lon) + 180) / 6) AS INTEGER) % 60 + 1 AS zone,
                median(lat) AS lat
         FROM geo_units WHERE lat IS NOT NULL)"""
)
def utm_zone(spark, sf):
    return extent.utm_zone(cw.world(spark, sf).geo)


# --- sources and sinks --------------------------------------------------------------


def _level_codes(spark, sf):
    """Units with their level as a code; areas get a code that no registry knows."""
    codes = {"world": 0, "region": 1, "nation": 2, "district": 3}
    code = F.lit(99)
    for level, number in codes.items():
        code = F.when(F.col("level") == level, F.lit(number)).otherwise(code)
    registry = cw.world(spark, sf).geo.groupBy("level").agg(F.count("*").alias("n"))
    registry = registry.where("level <> 'area'").select(
        code.alias("code"), F.upper("level").alias("label")
    )
    return cw.world(spark, sf).geo.select("geo_id", code.alias("level_code")), registry


@query(
    """SELECT geo_id, CASE level WHEN 'area' THEN 'unknown' ELSE upper(level) END AS level_name,
              CASE level WHEN 'world' THEN 0 WHEN 'region' THEN 1 WHEN 'nation' THEN 2
                WHEN 'district' THEN 3 ELSE 99 END AS level_code
       FROM geo_units"""
)
def decoded_levels(spark, sf):
    units, registry = _level_codes(spark, sf)
    return lookups.decode(units, "level_code", registry, "level_name")


@query(
    """SELECT c_custkey AS person_id, CAST(c_custkey % 5 - 1 AS INTEGER) AS sex_code,
              CASE c_custkey % 5 - 1 WHEN 0 THEN 'male' WHEN 1 THEN 'female'
                ELSE 'unknown' END AS sex
       FROM customer"""
)
def decoded_sexes(spark, sf):
    coded = cw.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("person_id"),
        (F.col("c_custkey") % 5 - 1).cast("int").alias("sex_code"),
    )
    return lookups.decode_sex(coded, "sex_code")


@query(
    """SELECT geo_id, ordinal, name, level, parent_id, lat, lon FROM geo_units"""
)
def stored_units(spark, sf):
    """Units written without ordinal and with NaN for missing coordinates, read back."""
    path = storage.new_folder(spark, "units")
    geo = cw.world(spark, sf).geo.withColumn("lat", F.coalesce("lat", F.lit(float("nan"))))
    geo.drop("ordinal").write.parquet(path)
    return world_source.read_table(spark, path, "geo_units")


def _with_tables(w: World, **tables: DataFrame) -> World:
    return cw.ChangedWorld(w, **tables)


@query(
    """SELECT 'unit' AS kind, geo_id AS id, parent_id <> -1 AS is_orphan FROM geo_units
       WHERE parent_id NOT IN (SELECT geo_id FROM geo_units)
       UNION ALL SELECT 'venue', venue_id, FALSE FROM venues JOIN geo_units USING (geo_id)
       WHERE venues.parent_id = -1"""
)
def stored_null_parents(spark, sf):
    """Roots and top-level venues of a world stored with NULL where there is no parent."""
    given, path = cw.world(spark, sf), storage.new_folder(spark, "null-parents")
    none = F.when(F.col("parent_id") != -1, F.col("parent_id"))
    for name in ("geo", "venues"):
        getattr(given, name).withColumn("parent_id", none).write.parquet(f"{path}/{name}")
    read = _with_tables(
        given,
        geo=world_source.read_table(spark, f"{path}/geo", "geo_units"),
        venues=world_source.read_table(spark, f"{path}/venues", "venues"),
    )
    units = hierarchy.roots(read).select(
        F.lit("unit").alias("kind"), F.col("geo_id").alias("id"), "is_orphan"
    )
    listed = venues.unit_venues(read).where("ancestor_id = geo_id")
    return units.unionByName(
        listed.select(F.lit("venue").alias("kind"), F.col("venue_id").alias("id"), F.lit(False).alias("is_orphan"))
    )


@query("SELECT *, FALSE AS lost FROM memberships")
def offset_lists(spark, sf):
    """Memberships through their offset encoding and back."""
    members = cw.world(spark, sf).memberships
    sizes = cw.world(spark, sf).subsets.withColumn(
        "order", F.col("venue_id") * 8 + F.col("subset_pos")
    )
    placed = ranking.prefix_sum(sizes, "order", value="member_count", name="start")
    owners = ranking.prefix_sum(placed, "order", name="idx").select(
        "idx", F.struct("venue_id", "subset_pos").alias("owner"), "start"
    )
    values = members.join(
        owners.select("owner.venue_id", "owner.subset_pos", "start"), ["venue_id", "subset_pos"]
    ).select((F.col("start") + F.col("seq")).alias("pos"), F.col("person_id").alias("value"))
    return offsets.expand_offsets(owners, values).select(
        "owner.venue_id",
        "owner.subset_pos",
        "seq",
        F.col("value").alias("person_id"),
        F.col("value").isNull().alias("lost"),
    )


@query(
    """SELECT person_id, map_keys(m)[1] AS first_key, map_values(m)[1] AS first_value,
              CAST(cardinality(m) AS INTEGER) AS entries
       FROM (SELECT person_id, CASE WHEN person_id % 3 = 0 THEN MAP {'home': CAST(geo_id AS VARCHAR)}
               ELSE MAP {'segment': segment, 'home': CAST(geo_id AS VARCHAR)} END AS m
             FROM people)"""
)
def person_properties(spark, sf):
    rows = cw.world(spark, sf).people.select(
        "person_id",
        F.when(F.col("person_id") % 3 != 0, F.col("segment")).alias("segment"),
        F.col("geo_id").alias("home"),
        F.col("income").alias("internal_id"),
    )
    folded = world_source.with_properties(
        rows, ["segment", "home", "internal_id"], exclude=["internal_id"]
    )
    return folded.select(
        "person_id",
        F.map_keys("properties")[0].alias("first_key"),
        F.map_values("properties")[0].alias("first_value"),
        F.size("properties").alias("entries"),
    )


@query(
    """SELECT geo_id, name, CASE WHEN level <> 'district' OR geo_id % 4 <> 3
         THEN concat('The ', lower(name)) END AS display_name FROM geo_units"""
)
def display_names(spark, sf):
    """Names through a CSV with padded, blank and repeated ids."""
    path = storage.new_folder(spark, "names")
    geo = cw.world(spark, sf).geo.where("level <> 'district' OR geo_id % 4 <> 3")
    entry = F.struct(
        F.concat(F.lit(" "), "name", F.lit(" ")).alias("Unit"),
        F.concat(F.lit(" The "), F.lower("name")).alias("Name"),
    )
    stale = F.struct(F.col("name").alias("Unit"), F.lit("stale").alias("Name"))
    blank = F.struct(F.lit("  ").alias("Unit"), F.col("name").alias("Name"))
    geo.select(F.explode(F.array(stale, blank, entry)).alias("e")).select("e.*").write.csv(
        path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    names = names_source.read_display_names(spark, path, "Unit", "Name")
    return names_source.with_display_names(cw.world(spark, sf).geo, names).select(
        "geo_id", "name", "display_name"
    )


@query("SELECT venue_id, geo_id FROM venue_geo")
def venue_lookup(spark, sf):
    return cw.event_log(spark, sf).venue_geo


@query("SELECT person_id, geo_id FROM person_geo")
def person_lookup(spark, sf):
    return cw.event_log(spark, sf).person_geo


def _located_log(spark, sf):
    """The event log stored located, in two batches."""
    path, log = storage.new_folder(spark, "located"), cw.event_log(spark, sf)
    for batch, when in (("early", "time < 18"), ("late", "time >= 18")):
        part = dataclasses.replace(log, events=log.events.where(when))
        event_source.write_located_events(part, path, batch)
    return event_source.read_located_log(spark, path)


@query(
    """SELECT event_type, geo_id, count(*) AS n FROM located WHERE time >= 15 AND time <= 21
       GROUP BY event_type, geo_id"""
)
def event_counts_located_log(spark, sf):
    return events.geo_counts(_located_log(spark, sf), start=15, end=21)


@query("SELECT event_type, frame, geo_id, n FROM frames")
def event_frames_located_log(spark, sf):
    return frames.bake_frames(_located_log(spark, sf))


@query("SELECT event_id, event_type, time, person_id, venue_id FROM world_events")
def stored_events(spark, sf):
    """Events stored per type, one type without a venue column and one with
    ``hospital_id`` in its place."""
    path = storage.new_folder(spark, "events")
    events_in = cw.event_log(spark, sf).events
    shapes = {
        "error": events_in.drop("venue_id"),
        "signup": events_in.withColumnRenamed("venue_id", "hospital_id"),
    }
    for kind, shaped in shapes.items():
        shaped.where(F.col("event_type") == kind).drop("event_type").write.parquet(
            f"{path}/event_type={kind}"
        )
    others = events_in.where(~F.col("event_type").isin(list(shapes)))
    event_source.write_events(others, path, mode="append")
    return event_source.read_events(spark, path).drop("hospital_id")


@query(
    """SELECT g.geo_id, g.name, g.level, s.population, s.venues_count, g.lat, g.lon,
              v.category AS venue_type, v.n
       FROM geo_units g JOIN stats s ON s.geo_id = g.geo_id
       LEFT JOIN rolled v ON v.geo_id = g.geo_id AND v.kind = 'venue'
       WHERE g.lat IS NOT NULL"""
)
def level_geojson(spark, sf):
    """Features of every level, their text parsed back."""
    w = cw.world(spark, sf)
    features = us.level_features(w, us.unit_stats(w, with_activities=False))
    props = ["geo_id", "name", "level", "population", "venues_count", "venue_types"]
    shape = (
        "properties struct<geo_id: bigint, name: string, level: string, population: bigint, "
        "venues_count: bigint, venue_types: map<string, bigint>>, "
        "geometry struct<coordinates: array<double>>"
    )
    texts = geojson.geojson_features(features, props).select("feature")
    return texts.select(F.from_json("feature", shape).alias("f")).select(
        *[f"f.properties.{p}" for p in props[:-1]],
        F.col("f.geometry.coordinates")[1].alias("lat"),
        F.col("f.geometry.coordinates")[0].alias("lon"),
        F.explode_outer("f.properties.venue_types").alias("venue_type", "n"),
    )


@query(
    """SELECT geo_id, level, lon, lat FROM geo_units WHERE lat IS NOT NULL"""
)
def geojson_round_trip(spark, sf):
    """Features written per level and parsed back."""
    path = storage.new_folder(spark, "geojson")
    geojson.write_geojson(cw.world(spark, sf).geo, path, ["geo_id", "name"], by=["level"])
    parsed = F.from_json(
        "value",
        "properties struct<geo_id: bigint>, geometry struct<coordinates: array<double>>",
    )
    return (
        spark.read.schema("value string, level string")
        .text(path)
        .select("level", parsed.alias("f"))
        .select(
            "f.properties.geo_id",
            "level",
            F.col("f.geometry.coordinates")[0].alias("lon"),
            F.col("f.geometry.coordinates")[1].alias("lat"),
        )
    )


# --- streaming ----------------------------------------------------------------------


_EVENT_COLUMNS = (
    "event_type",
    "CAST(ts AS TIMESTAMP) AS ts",
    "user_id AS person_id",
    f"{f.EVENT_VENUE} AS venue_id",
)


def _event_stream(spark, sf):
    """The events table as a stream: a glob, since a single file is no stream source."""
    schema = cw.table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet")
    return raw.selectExpr(*_EVENT_COLUMNS)


def _replayed(spark, counts, combine=None):
    path = storage.new_folder(spark, "stream")
    streaming.replay(counts, f"{path}/counts", f"{path}/checkpoint", combine)
    return spark.read.schema(counts.schema).parquet(f"{path}/counts")


@query(
    """SELECT CAST(floor(time) AS BIGINT) AS day, event_type, geo_id, count(*) AS n FROM located
       GROUP BY floor(time), event_type, geo_id"""
)
def stream_daily_counts(spark, sf):
    counts = streaming.stream_daily(_event_stream(spark, sf), cw.event_log(spark, sf))
    day = F.floor(cw.days(F.col("window_start"))).alias("day")
    return _replayed(spark, counts).select(day, "event_type", "geo_id", "n")


@query(
    """SELECT CAST(k AS BIGINT) AS start_day, event_type, geo_id, count(*) AS n
       FROM located JOIN range(-10, 4000) AS r(k) ON time >= k AND time < k + 3
       GROUP BY k, event_type, geo_id"""
)
def stream_rolling_counts(spark, sf):
    counts = streaming.stream_rolling(
        _event_stream(spark, sf), cw.event_log(spark, sf), width=3, step=1
    )
    start = F.floor(cw.days(F.col("window_start"))).alias("start_day")
    return _replayed(spark, counts).select(start, "event_type", "geo_id", "n")


@query(
    """SELECT CAST(k AS BIGINT) AS start_day, event_type, geo_id, count(*) AS n
       FROM located JOIN range(-20, 4000) AS r(k) ON (k + 19723) % 2 = 0 AND time >= k AND time < k + 7
       GROUP BY k, event_type, geo_id"""
)
def stream_paned_counts(spark, sf):
    """Weeks that begin every other day (of 1970), from panes of one day."""
    panes = streaming.stream_panes(_event_stream(spark, sf), cw.event_log(spark, sf), 7, 2)
    found = _replayed(spark, panes, lambda counts: streaming.windows_of(counts, 7, 2))
    start = F.floor(cw.days(F.col("window_start"))).alias("start_day")
    return found.select(start, "event_type", "geo_id", "n")


@query("SELECT event_type, geo_id, count(*) AS n FROM located GROUP BY event_type, geo_id")
def stream_running_totals(spark, sf):
    return _replayed(
        spark, streaming.stream_cumulative(_event_stream(spark, sf), cw.event_log(spark, sf))
    )


@query(
    """SELECT CAST(floor(time) AS BIGINT) AS day, event_type, geo_id, count(*) AS n FROM located
       WHERE floor(time) + 1 <= (SELECT max(time) FROM world_events) - 9
       GROUP BY floor(time), event_type, geo_id"""
)
def stream_closed_days(spark, sf):
    """Daily windows appended once the watermark has closed them. The events arrive in
    files of four spans of eight days, one span after the other, and out of order within."""
    path = storage.new_folder(spark, "closed")
    arriving = _arriving_in_spans(spark, sf, path)
    windows = streaming.stream_daily(arriving, cw.event_log(spark, sf), lateness="9 days")
    day = F.floor(cw.days(F.col("window_start"))).alias("day")
    return _closed(spark, windows, path).select(day, "event_type", "geo_id", "n")


def _arriving_in_spans(spark, sf, path):
    given = cw.table(spark, sf, "events")
    span = F.floor(cw.days(F.col("ts")) / 8)
    for number in range(4):
        given.where(F.least(span, F.lit(3)) == number).write.mode("append").parquet(f"{path}/in")
    raw = spark.readStream.schema(given.schema).option("maxFilesPerTrigger", 8)
    return raw.parquet(f"{path}/in").selectExpr(*_EVENT_COLUMNS)


def _closed(spark, windows, path):
    """The windows that the watermark has closed once all input is read."""
    streaming.frames_sink(
        windows, f"{path}/out", f"{path}/checkpoint", availableNow=True
    ).start().awaitTermination()
    return spark.read.schema(windows.schema).parquet(f"{path}/out")


@query(
    """SELECT CAST(k AS BIGINT) AS start_day, event_type, geo_id, count(*) AS n
       FROM located JOIN range(-20, 4000) AS r(k) ON time >= k AND time < k + 5
       WHERE k + 5 <= (SELECT max(time) FROM world_events) - 9
       GROUP BY k, event_type, geo_id"""
)
def stream_closed_windows(spark, sf):
    """Five-day windows each day, put together from closed panes and appended when closed."""
    path = storage.new_folder(spark, "closed-windows")
    arriving = _arriving_in_spans(spark, sf, path)
    windows = streaming.stream_rolling(arriving, cw.event_log(spark, sf), 5, 1, "9 days")
    start = F.floor(cw.days(F.col("window_start"))).alias("start_day")
    return _closed(spark, windows, path).select(start, "event_type", "geo_id", "n")
