"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the local cores. Every
query is run twice and the faster run is reported. That leaves out what the first run
alone does: deriving and storing the check tables and the unit paths. Results go to a
``noop`` sink, so all rows are computed and none is collected. Arguments select queries;
``all`` runs every registered one.
"""

from __future__ import annotations

import json
import os
import sys
import time

from checks.queries import QUERIES
from checks.session import local_session

HEADLINE = """population_rollup unit_stats_categories unit_stats_totals activity_counts
    unit_detail geo_closure geo_preorder geo_subtree_people people_profile activity_summary
    subset_sizes venue_member_pages person_activities unit_people_pages locate_people
    locate_venues people_page size_budget event_counts event_rates event_features
    event_frames event_frames_overlapping event_frames_cumulated unit_event_cards
    offset_lists stream_daily_counts""".split()


def run(spark, name: str, sf_dir: str) -> float:
    start = time.time()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.time() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(QUERIES)
    spark = local_session()
    seconds = {}
    for name in names:
        first = run(spark, name, sf_dir)
        seconds[name] = round(min(first, run(spark, name, sf_dir)), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
