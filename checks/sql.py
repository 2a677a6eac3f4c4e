"""The check world as DuckDB CTEs, and assembly of the SQL twins."""

from __future__ import annotations

import re

from checks import formulas as f

CTES: dict[str, str] = {
    "geo_units": f"""
        SELECT *, geo_id AS ordinal FROM (
          SELECT {f.columns(f.WORLD)}
          UNION ALL SELECT {f.columns(f.REGIONS)} FROM region
          UNION ALL SELECT {f.columns(f.NATIONS)} FROM nation
          UNION ALL SELECT {f.columns(f.DISTRICTS)} FROM nation
            CROSS JOIN (VALUES (0), (1), (2), (3)) AS ds(d) WHERE n_nationkey % 5 <> 4
          UNION ALL SELECT {f.columns(f.AREAS)} FROM customer WHERE {f.FOUNDS_AREA})""",
    "people": f"SELECT {f.columns(f.PEOPLE)} FROM customer",
    "venues": f"SELECT {f.columns(f.VENUES)} FROM supplier",
    "visits": "SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "members": """
        SELECT DISTINCT l_suppkey AS venue_id, l_returnflag AS subset_name, o_custkey AS person_id
        FROM visits""",
    "named_subsets": """
        SELECT venue_id, CAST(row_number() OVER (PARTITION BY venue_id ORDER BY subset_name) - 1
                              AS INTEGER) AS subset_pos,
               subset_name, count(*) AS member_count
        FROM members GROUP BY venue_id, subset_name""",
    "subsets": """
        SELECT * FROM named_subsets
        UNION ALL SELECT venue_id, CAST(count(*) AS INTEGER), 'reserve', CAST(0 AS BIGINT)
        FROM named_subsets WHERE venue_id % 7 = 0 GROUP BY venue_id""",
    "memberships": """
        SELECT m.venue_id, s.subset_pos,
               row_number() OVER (PARTITION BY m.venue_id, m.subset_name ORDER BY person_id) - 1
                 AS seq, person_id
        FROM members m JOIN named_subsets s
          ON m.venue_id = s.venue_id AND m.subset_name = s.subset_name""",
    "activities": f"""
        SELECT o_custkey AS person_id,
               row_number() OVER (PARTITION BY o_custkey
                 ORDER BY l_orderkey * 8 + l_linenumber, l_partkey, l_suppkey) - 1 AS seq,
               {f.ACTIVITY} AS activity, l_suppkey AS venue_id, s.subset_pos
        FROM visits JOIN named_subsets s
          ON l_suppkey = s.venue_id AND l_returnflag = s.subset_name""",
    "world_events": f"""
        SELECT event_id, event_type,
               (epoch_us(ts) - 1704067200000000) / 86400000000.0e0 AS time,
               user_id AS person_id, {f.EVENT_VENUE} AS venue_id
        FROM events""",
    "venue_geo": "SELECT venue_id, geo_id FROM venues",
    "person_geo": "SELECT person_id, geo_id FROM people WHERE person_id % 19 <> 0",
    "located": """
        SELECT e.*, coalesce(v.geo_id, p.geo_id) AS geo_id
        FROM world_events e LEFT JOIN venue_geo v ON e.venue_id = v.venue_id
        LEFT JOIN person_geo p ON e.person_id = p.person_id
        WHERE coalesce(v.geo_id, p.geo_id) IS NOT NULL""",
    "closure": """
        SELECT geo_id AS ancestor_id, geo_id AS descendant_id, 0 AS depth FROM geo_units
        UNION ALL
        SELECT g.parent_id, c.descendant_id, c.depth + 1
        FROM closure c JOIN geo_units g ON c.ancestor_id = g.geo_id
        JOIN geo_units p ON g.parent_id = p.geo_id""",
    "direct_people": """
        SELECT geo_id, count(*) AS n FROM people JOIN geo_units USING (geo_id) GROUP BY geo_id""",
    "unit_population": """
        SELECT ancestor_id AS geo_id, CAST(sum(n) AS BIGINT) AS population
        FROM direct_people JOIN closure ON geo_id = descendant_id GROUP BY ancestor_id""",
    "age_direct": """
        SELECT geo_id, label AS category, count(CASE WHEN age >= lo AND age < hi THEN 1 END) AS n
        FROM people JOIN geo_units USING (geo_id) CROSS JOIN (VALUES
          ('0-15', 0, 16), ('16-24', 16, 25), ('25-34', 25, 35), ('35-49', 35, 50),
          ('50-64', 50, 65), ('65+', 65, 1000000)) AS a(label, lo, hi)
        GROUP BY geo_id, label""",
    "sex_direct": """
        SELECT geo_id, sex AS category, count(*) AS n
        FROM people JOIN geo_units USING (geo_id) GROUP BY geo_id, sex""",
    "venue_direct_all": """
        SELECT geo_id, venue_type AS category, count(*) AS n
        FROM venues JOIN geo_units USING (geo_id) GROUP BY geo_id, venue_type""",
    "venue_direct": """
        SELECT * FROM venue_direct_all WHERE geo_id IN (SELECT geo_id FROM direct_people)""",
    "activity_direct": """
        SELECT geo_id, activity AS category, count(DISTINCT person_id) AS n
        FROM activities JOIN people USING (person_id) JOIN geo_units USING (geo_id)
        GROUP BY geo_id, activity""",
    "direct": """
        SELECT geo_id, 'age' AS kind, category, n FROM age_direct
        UNION ALL SELECT geo_id, 'sex', category, n FROM sex_direct
        UNION ALL SELECT geo_id, 'venue', category, n FROM venue_direct
        UNION ALL SELECT geo_id, 'activity', category, n FROM activity_direct""",
    "rolled": """
        SELECT ancestor_id AS geo_id, kind, category, CAST(sum(n) AS BIGINT) AS n
        FROM direct JOIN closure ON geo_id = descendant_id
        GROUP BY ancestor_id, kind, category""",
    # Labels go missing as in the formulas; what is missing counts as unknown.
    "unlabelled_people": f"""
        SELECT person_id, geo_id, CASE WHEN NOT ({f.NO_SEX}) THEN sex END AS sex FROM people""",
    "unlabelled_venues": f"""
        SELECT venue_id, geo_id, CASE WHEN NOT ({f.NO_VENUE_TYPE}) THEN venue_type END
          AS venue_type FROM venues""",
    "unlabelled_activities": f"""
        SELECT person_id, seq, venue_id, CASE WHEN NOT ({f.NO_ACTIVITY}) THEN activity END
          AS activity FROM activities""",
    "unlabelled_direct": """
        SELECT geo_id, 'sex' AS kind, coalesce(sex, 'unknown') AS category, count(*) AS n
        FROM unlabelled_people JOIN geo_units USING (geo_id) GROUP BY geo_id, category
        UNION ALL
        SELECT geo_id, 'venue', coalesce(venue_type, 'unknown') AS category, count(*)
        FROM unlabelled_venues JOIN direct_people USING (geo_id) GROUP BY geo_id, category
        UNION ALL
        SELECT geo_id, 'activity', activity, count(DISTINCT person_id)
        FROM unlabelled_activities JOIN people USING (person_id) JOIN geo_units USING (geo_id)
        WHERE activity IS NOT NULL GROUP BY geo_id, activity""",
    "unlabelled_rolled": """
        SELECT ancestor_id AS geo_id, kind, category, CAST(sum(n) AS BIGINT) AS n
        FROM unlabelled_direct JOIN closure ON geo_id = descendant_id
        GROUP BY ancestor_id, kind, category""",
    "child_counts": """
        SELECT parent_id AS geo_id, count(*) AS children_count FROM geo_units
        WHERE parent_id <> -1 GROUP BY parent_id""",
    "stats": """
        SELECT g.geo_id, coalesce(p.population, 0) AS population,
               CAST(coalesce(v.n, 0) AS BIGINT) AS venues_count,
               coalesce(c.children_count, 0) AS children_count,
               coalesce(p.population, 0) > 0 OR c.children_count IS NOT NULL AS has_stats
        FROM geo_units g LEFT JOIN unit_population p ON g.geo_id = p.geo_id
        LEFT JOIN (SELECT geo_id, sum(n) AS n FROM rolled WHERE kind = 'venue' GROUP BY geo_id) v
          ON g.geo_id = v.geo_id
        LEFT JOIN child_counts c ON g.geo_id = c.geo_id""",
    "rate_population": """
        SELECT geo_id, population FROM unit_population
        WHERE geo_id IN (SELECT geo_id FROM direct_people)""",
    "frame_bounds": "SELECT min(time) AS t0, max(time) AS t1 FROM world_events",
    "frame_times": """
        SELECT CAST(k AS BIGINT) AS frame, 
               round_even((t0 + k * 1.0e0) * 1000000.0e0, 0) / 1000000.0e0 AS frame_time
        FROM frame_bounds, range(0, 4000) AS r(k) WHERE t0 + k * 1.0e0 <= t1 + 0.01e0""",
    "frames": """
        SELECT event_type, frame, geo_id, count(*) AS n
        FROM located JOIN frame_times
          ON time <= frame_time AND time >= frame_time - 1.0e0
        GROUP BY event_type, frame, geo_id""",
}


def _needs(text: str) -> set[str]:
    return {name for name in CTES if re.search(rf"\b{name}\b", text)}


def with_world(query: str) -> str:
    """Prefix ``query`` with the CTEs it uses, in definition order."""
    wanted: set[str] = set()
    todo = _needs(query)
    while todo:
        name = todo.pop()
        if name not in wanted:
            wanted.add(name)
            todo |= _needs(CTES[name]) - wanted
    parts = [f"{name} AS ({CTES[name]})" for name in CTES if name in wanted]
    return f"WITH RECURSIVE {', '.join(parts)} {query}" if parts else query
