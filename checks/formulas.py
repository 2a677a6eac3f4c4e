"""Formulas of the check world, used as text by both engines (see FIXTURES.md)."""

AREA_BASE = 1000000
NO_UNIT = 999999999
LOST_PARENT = 888888888

# Where a customer with no area of their own lives: a nation or one of its districts.
CUSTOMER_HOME = """
CASE WHEN c_nationkey % 5 = 4 OR c_custkey % 11 = 0 OR (c_nationkey = 0 AND c_custkey % 4 = 3)
     THEN CAST(100 + c_nationkey AS BIGINT)
     ELSE CAST(1000 + 4 * c_nationkey + c_custkey % 4 AS BIGINT) END"""

# Every tenth customer founds an area, in which two more customers live.
FOUNDS_AREA = "c_custkey % 10 = 7"
PERSON_UNIT = f"""
CASE WHEN c_custkey % 97 = 96 THEN CAST({NO_UNIT} AS BIGINT)
     WHEN c_custkey % 10 >= 7 THEN CAST({AREA_BASE} + c_custkey - c_custkey % 10 + 7 AS BIGINT)
     ELSE {CUSTOMER_HOME} END"""

WORLD = {
    "geo_id": "CAST(0 AS BIGINT)",
    "name": "'WORLD'",
    "level": "'world'",
    "parent_id": "CAST(-1 AS BIGINT)",
    "lat": "CAST(NULL AS DOUBLE)",
    "lon": "CAST(NULL AS DOUBLE)",
}
REGIONS = {
    "geo_id": "CAST(1 + r_regionkey AS BIGINT)",
    "name": "r_name",
    "level": "'region'",
    "parent_id": "CAST(0 AS BIGINT)",
    "lat": "CAST(10 * r_regionkey - 20 AS DOUBLE)",
    "lon": "CAST(30 * r_regionkey - 60 AS DOUBLE)",
}
NATION_LAT = "CASE WHEN n_nationkey % 7 <> 6 THEN CAST(2 * n_nationkey - 24 AS DOUBLE) END"
NATION_LON = "CAST(5 * n_nationkey - 60 AS DOUBLE)"
NATIONS = {
    "geo_id": "CAST(100 + n_nationkey AS BIGINT)",
    "name": "n_name",
    "level": "'nation'",
    "parent_id": "CAST(1 + n_regionkey AS BIGINT)",
    "lat": NATION_LAT,
    "lon": NATION_LON,
}
DISTRICTS = {
    "geo_id": "CAST(1000 + 4 * n_nationkey + d AS BIGINT)",
    "name": "concat('DISTRICT_', CAST(4 * n_nationkey + d AS VARCHAR(20)))",
    "level": "'district'",
    "parent_id": "CAST(100 + n_nationkey AS BIGINT)",
    "lat": f"{NATION_LAT} + d * 0.25e0",
    "lon": f"{NATION_LON} + d * 0.25e0",
}
AREAS = {
    "geo_id": f"CAST({AREA_BASE} + c_custkey AS BIGINT)",
    "name": "concat('AREA_', CAST(c_custkey AS VARCHAR(20)))",
    "level": "'area'",
    "parent_id": f"CASE WHEN c_custkey % 500 = 107 THEN CAST({LOST_PARENT} AS BIGINT) "
    f"ELSE {CUSTOMER_HOME} END",
    "lat": "CASE WHEN c_custkey % 70 <> 7 THEN CAST(c_custkey % 120 AS DOUBLE) / 2 - 30 END",
    "lon": "CAST(c_custkey % 300 AS DOUBLE) - 150",
}
PEOPLE = {
    "person_id": "c_custkey",
    "age": "CAST((37 * c_custkey + 11) % 100 AS INT)",
    "sex": "CASE WHEN c_custkey % 50 = 49 THEN 'unknown' WHEN c_custkey % 3 = 0 THEN 'male' "
    "WHEN c_custkey % 3 = 1 THEN 'female' ELSE 'unknown' END",
    "geo_id": PERSON_UNIT,
    "ordinal": "c_custkey",
    "income": "c_acctbal",
    "segment": "c_mktsegment",
}
VENUE_TYPES = ("household", "school", "company", "hospital", "church")
VENUE_LAT = "CASE WHEN s_nationkey % 7 <> 6 THEN CAST(2 * s_nationkey - 24 AS DOUBLE) END"
VENUES = {
    "venue_id": "s_suppkey",
    "name": "s_name",
    "venue_type": "CASE s_suppkey % 5 "
    + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(VENUE_TYPES))
    + " END",
    "geo_id": f"CASE WHEN s_suppkey % 9 = 5 THEN CAST({AREA_BASE} + 10 * s_suppkey + 7 AS BIGINT) "
    "WHEN s_nationkey % 5 = 4 THEN CAST(100 + s_nationkey AS BIGINT) "
    "ELSE CAST(1000 + 4 * s_nationkey + s_suppkey % 4 AS BIGINT) END",
    "parent_id": "CASE WHEN s_suppkey % 10 IN (1, 2, 3) THEN s_suppkey - s_suppkey % 10 "
    "WHEN s_suppkey % 50 = 44 THEN 900000000 + s_suppkey ELSE CAST(-1 AS BIGINT) END",
    "lat": f"CASE WHEN s_suppkey % 13 <> 0 THEN {VENUE_LAT} END",
    "lon": "CAST(5 * s_nationkey - 60 AS DOUBLE)",
    "is_residence": "s_suppkey % 5 = 0",
    "ordinal": "s_suppkey",
    "balance": "s_acctbal",
}
ACTIVITY = """CASE substr(o_orderpriority, 1, 1)
     WHEN '1' THEN 'primary_activity' WHEN '2' THEN 'leisure' WHEN '3' THEN 'shopping'
     WHEN '4' THEN 'medical_facility' ELSE 'residence' END"""
ACTIVITY_NAMES = (
    "primary_activity",
    "leisure",
    "shopping",
    "medical_facility",
    "residence",
    "commute",
)
# What a world without some of its labels lacks: sexes, venue types and activities.
NO_SEX = "person_id % 7 = 3"
NO_VENUE_TYPE = "venue_id % 4 = 1"
NO_ACTIVITY = "seq % 5 = 2"
EVENT_TYPES = ("click", "error", "purchase", "recovery", "signup", "view")
# Venue ids reach a quarter beyond the suppliers, at every scale factor.
EVENT_VENUE = """CASE WHEN event_type = 'error' THEN CAST(NULL AS BIGINT)
     WHEN event_id % 3 = 0 THEN CAST(-1 AS BIGINT) ELSE CAST(floor(event_id / 80.0e0) AS BIGINT) END"""


def columns(formulas: dict[str, str]) -> str:
    return ", ".join(f"{text} AS {name}" for name, text in formulas.items())


def expressions(formulas: dict[str, str]) -> list[str]:
    return [f"{text} AS {name}" for name, text in formulas.items()]
