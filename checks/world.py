"""The check world as Spark DataFrames over the given parquet tables."""

from __future__ import annotations

from functools import cache, cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from checks import formulas as f
from popatlas.model import EventLog, World
from popatlas.plans.ranking import prefix_sum
from popatlas.plans.sizing import sized_broadcast, spread
from popatlas.plans.storage import stored
from popatlas.sources.lookups import latest_lookup

# Positions of the visits of one person that are ranked in one task: eight to an order.
VISIT_SLICE = 1 << 23
TABLES = ("geo", "people", "venues", "subsets", "memberships", "activities")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def geo_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    customer = table(spark, sf_dir, "customer")
    districts = nation.where("n_nationkey % 5 <> 4").withColumn(
        "d", F.explode(F.array(*[F.lit(d) for d in range(4)]))
    )
    parts = [
        spark.range(1).selectExpr(*f.expressions(f.WORLD)),
        table(spark, sf_dir, "region").selectExpr(*f.expressions(f.REGIONS)),
        nation.selectExpr(*f.expressions(f.NATIONS)),
        districts.selectExpr(*f.expressions(f.DISTRICTS)),
        customer.where(f.FOUNDS_AREA).selectExpr(*f.expressions(f.AREAS)),
    ]
    units = parts[0]
    for part in parts[1:]:
        units = units.unionByName(part)
    return units.withColumn("ordinal", F.col("geo_id"))


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the customer and priority of their order."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    n = lines.count()
    return spread(lines, n, "l_orderkey").join(
        spread(orders, n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")
    )


def subset_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``venue_id, subset_name, subset_pos``: a handful of names per venue."""
    names = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("venue_id"), F.col("l_returnflag").alias("subset_name")
    )
    place = F.row_number().over(Window.partitionBy("venue_id").orderBy("subset_name"))
    return names.distinct().withColumn("subset_pos", (place - 1).cast("int"))


def with_positions(named: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a venue and subset name with ``subset_pos``. The positions are few, so the rows
    stay where they are."""
    places = stored(subset_positions(spark, sf_dir), "subset-positions")
    return named.join(sized_broadcast(places), ["venue_id", "subset_name"])


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (venue, subset name, person)."""
    named = visits(spark, sf_dir).select(
        F.col("l_suppkey").alias("venue_id"),
        F.col("l_returnflag").alias("subset_name"),
        F.col("o_custkey").alias("person_id"),
    )
    return spread(named, table(spark, sf_dir, "lineitem").count(), *named.columns).distinct()


def subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = (
        members(spark, sf_dir)
        .groupBy("venue_id", "subset_name")
        .agg(F.count("*").alias("member_count"))
    )
    place = F.row_number().over(Window.partitionBy("venue_id").orderBy("subset_name"))
    named = counts.select(
        "venue_id", (place - 1).cast("int").alias("subset_pos"), "subset_name", "member_count"
    )
    reserve = (
        counts.where("venue_id % 7 = 0")
        .groupBy("venue_id")
        .agg(F.count("*").cast("int").alias("subset_pos"))
        .select(
            "venue_id",
            "subset_pos",
            F.lit("reserve").alias("subset_name"),
            F.lit(0).cast("bigint").alias("member_count"),
        )
    )
    return named.unionByName(reserve)


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = prefix_sum(
        members(spark, sf_dir), "person_id", keys=["venue_id", "subset_name"], name="seq"
    )
    return with_positions(ranked, spark, sf_dir).select(
        "venue_id", "subset_pos", "seq", "person_id"
    )


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = visits(spark, sf_dir).select(
        F.col("o_custkey").alias("person_id"),
        F.expr(f.ACTIVITY).alias("activity"),
        F.col("l_suppkey").alias("venue_id"),
        F.col("l_returnflag").alias("subset_name"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("position"),
        "l_partkey",
    )
    ranked = prefix_sum(
        taken,
        "position",
        keys=["person_id"],
        ties=["l_partkey", "venue_id"],
        width=VISIT_SLICE,
        name="seq",
    )
    return with_positions(ranked, spark, sf_dir).select(
        "person_id", "seq", "activity", "venue_id", "subset_pos"
    )


class CheckWorld(World):
    """People and venues are projections of the given tables; the tables that need unions
    or joins are derived on first use and stored, as a world would be."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.max_depth = None
        self._given = (spark, sf_dir)
        self.people = table(spark, sf_dir, "customer").selectExpr(*f.expressions(f.PEOPLE))
        self.venues = table(spark, sf_dir, "supplier").selectExpr(*f.expressions(f.VENUES))

    @cached_property
    def geo(self) -> DataFrame:
        return stored(geo_units(*self._given), "geo-units")

    @cached_property
    def subsets(self) -> DataFrame:
        return stored(subsets(*self._given), "subsets")

    @cached_property
    def memberships(self) -> DataFrame:
        return stored(memberships(*self._given), "memberships")

    @cached_property
    def activities(self) -> DataFrame:
        return stored(activities(*self._given), "activities")


@cache
def world(spark: SparkSession, sf_dir: str) -> World:
    return CheckWorld(spark, sf_dir)


class ChangedWorld(World):
    """A world with some of its tables replaced. The others are asked for on first use only,
    so that a query derives no table that it does not read."""

    def __init__(self, given: World, **tables: DataFrame) -> None:
        self.max_depth = given.max_depth
        self._given = given
        vars(self).update(tables)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return getattr(self._given, name)


def _without(df: DataFrame, column: str, where: str) -> DataFrame:
    return df.withColumn(column, F.when(~F.expr(where), F.col(column)))


class UnlabelledWorld(ChangedWorld):
    """A world with sexes, venue types and activities missing here and there."""

    def __init__(self, given: World) -> None:
        super().__init__(
            given,
            people=_without(given.people, "sex", f.NO_SEX),
            venues=_without(given.venues, "venue_type", f.NO_VENUE_TYPE),
        )

    @cached_property
    def activities(self) -> DataFrame:
        return _without(self._given.activities, "activity", f.NO_ACTIVITY)


@cache
def unlabelled_world(spark: SparkSession, sf_dir: str) -> World:
    return UnlabelledWorld(world(spark, sf_dir))


def days(ts) -> F.Column:
    """Days since 2024-01-01, UTC."""
    start = F.lit(1704067200000000)
    return (F.unix_micros(ts.cast("timestamp")) - start) / F.lit(86400000000)


def world_events(raw: DataFrame) -> DataFrame:
    return raw.select(
        "event_id",
        "event_type",
        days(F.col("ts")).alias("time"),
        F.col("user_id").alias("person_id"),
        F.expr(f.EVENT_VENUE).alias("venue_id"),
    )


def venue_lookup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venue → unit rows, with a superseded earlier row for every 17th venue."""
    venues = table(spark, sf_dir, "supplier").selectExpr(*f.expressions(f.VENUES))
    current = venues.select("venue_id", "geo_id", F.lit(1).alias("row_order"))
    stale = venues.where("venue_id % 17 = 0").select(
        "venue_id", F.lit(0).cast("bigint").alias("geo_id"), F.lit(0).alias("row_order")
    )
    return stale.unionByName(current)


def person_lookup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Person → unit rows; every 19th person is missing, every 17th has a stale row."""
    people = (
        table(spark, sf_dir, "customer")
        .selectExpr(*f.expressions(f.PEOPLE))
        .where("person_id % 19 <> 0")
    )
    current = people.select("person_id", "geo_id", F.lit(1).alias("row_order"))
    stale = people.where("person_id % 17 = 0").select(
        "person_id", F.lit(0).cast("bigint").alias("geo_id"), F.lit(0).alias("row_order")
    )
    return stale.unionByName(current)


@cache
def event_log(spark: SparkSession, sf_dir: str) -> EventLog:
    return EventLog(
        events=world_events(table(spark, sf_dir, "events")),
        venue_geo=latest_lookup(
            venue_lookup_rows(spark, sf_dir), "venue_id", "geo_id", "row_order"
        ),
        person_geo=latest_lookup(
            person_lookup_rows(spark, sf_dir), "person_id", "geo_id", "row_order"
        ),
    )
