"""

    python -m tools.published_scale <folder> [make|time ...]

``make`` derives a world of 19,752 units, 4.75 M people, 1.93 M venues, 2.84 M subsets,
30.7 M activity rows and 9.47 M events over 730 days from row numbers alone and stores it;
``time`` runs the operators on it, or only the named ones.
"""

from __future__ import annotations

import sys
import time

from pyspark.sql import functions as F

from checks.session import local_session
from popatlas import EventLog, World
from popatlas.operators import events, frames, hierarchy, locate, people, profile, unit_stats
from popatlas.sources.events import read_events, write_events
from popatlas.sources.world import read_world, write_world

COUNTIES, AREAS, PEOPLE, VENUES = 41, 19_710, 4_751_126, 1_930_282
SUBSETS, ACTIVITIES = 2_837_264, 30_700_000
EVENTS = {"infections": 1_893_919, "deaths": 1_631_493, "symptom_changes": 5_947_605}
FIRST_AREA = 1 + COUNTIES


def _pick(n: int, salt: int):
    """A hash-spread number below ``n`` per row."""
    return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n))


def make(spark, folder: str) -> None:
    geo = spark.range(1 + COUNTIES + AREAS).select(
        F.col("id").alias("geo_id"),
        F.concat(F.lit("U"), "id").alias("name"),
        F.when(F.col("id") == 0, "country").when(F.col("id") < FIRST_AREA, "county")
        .otherwise("area").alias("level"),
        F.when(F.col("id") == 0, -1).when(F.col("id") < FIRST_AREA, 0)
        .otherwise(1 + F.col("id") % COUNTIES).cast("bigint").alias("parent_id"),
        F.col("id").alias("ordinal"),
        (F.col("id") % 90 / 2).alias("lat"),
        (F.col("id") % 180 / 2).alias("lon"),
    )
    area = (FIRST_AREA + _pick(AREAS, 1)).alias("geo_id")
    population = spark.range(PEOPLE).select(
        F.col("id").alias("person_id"),
        _pick(100, 2).cast("int").alias("age"),
        F.when(_pick(2, 3) == 0, "male").otherwise("female").alias("sex"),
        area,
        F.col("id").alias("ordinal"),
        (_pick(1_000_000, 4) / 100).alias("income"),
    )
    kinds = F.array(*[F.lit(k) for k in ("household", "school", "company", "church", "market")])
    venues = spark.range(VENUES).select(
        F.col("id").alias("venue_id"),
        F.concat(F.lit("V"), "id").alias("name"),
        kinds[_pick(5, 5).cast("int")].alias("venue_type"),
        area,
        F.col("id").alias("ordinal"),
        F.lit(-1).cast("bigint").alias("parent_id"),
        F.lit(51.5).alias("lat"),
        F.lit(-0.1).alias("lon"),
        F.lit(False).alias("is_residence"),
    )
    subsets = spark.range(SUBSETS).select(
        (F.col("id") % VENUES).alias("venue_id"),
        F.expr(f"id div {VENUES}").cast("int").alias("subset_pos"),
        F.concat(F.lit("S"), F.col("id") % 7).alias("subset_name"),
        _pick(12, 6).alias("member_count"),
    )
    names = F.array(*[F.lit(n) for n in ("primary_activity", "leisure", "shopping", "residence")])
    activities = spark.range(ACTIVITIES).select(
        (F.col("id") % PEOPLE).alias("person_id"),
        F.expr(f"id div {PEOPLE}").alias("seq"),
        names[_pick(4, 7).cast("int")].alias("activity"),
        _pick(VENUES, 8).alias("venue_id"),
        F.lit(0).alias("subset_pos"),
    )
    members = spark.range(PEOPLE).select(
        _pick(VENUES, 9).alias("venue_id"),
        F.lit(0).alias("subset_pos"),
        F.col("id").alias("seq"),
        F.col("id").alias("person_id"),
    )
    write_world(World(geo, population, venues, subsets, members, activities), f"{folder}/world")
    log = None
    for kind, n in EVENTS.items():
        some = spark.range(n).select(
            F.lit(kind).alias("event_type"),
            (_pick(73_050_000, 10) / 100_000).alias("time"),
            _pick(PEOPLE, 11).alias("person_id"),
            F.when(_pick(5, 12) > 0, _pick(VENUES, 13)).otherwise(F.lit(-1)).alias("venue_id"),
        )
        log = some if log is None else log.unionByName(some)
    write_events(log, f"{folder}/events")


def operators(spark, folder: str) -> dict:
    w = read_world(spark, f"{folder}/world")
    log = EventLog(
        read_events(spark, f"{folder}/events"),
        w.venues.select("venue_id", "geo_id"),
        w.people.select("person_id", "geo_id"),
    )
    return {
        "geo_closure": lambda: hierarchy.closure(w),
        "unit_stats_without_activities": lambda: unit_stats.unit_stats(w, with_activities=False),
        "unit_stats": lambda: unit_stats.unit_stats(w),
        "profile_people": lambda: profile.profile_people(w),
        "subset_sizes": lambda: profile.subset_sizes(w),
        "activity_summary": lambda: profile.activity_summary(w),
        "event_counts_one_week": lambda: events.geo_counts(log, start=100, end=107),
        "event_counts_all": lambda: events.geo_counts(log),
        "bake_frames": lambda: frames.bake_frames(log),
        "locate_people": lambda: locate.locate_people(w),
        "person_activities": lambda: people.person_activities(w),
        "unit_people_pages": lambda: people.unit_people(w, descendants=True),
    }


def main() -> None:
    folder, action, *names = sys.argv[1:]
    spark = local_session()
    if action == "make":
        make(spark, folder)
        return
    for name, build in operators(spark, folder).items():
        if names and name not in names:
            continue
        runs = []
        for _ in range(2):
            start = time.time()
            build().write.format("noop").mode("overwrite").save()
            runs.append(round(time.time() - start, 1))
        print(name, runs, flush=True)


if __name__ == "__main__":
    main()
