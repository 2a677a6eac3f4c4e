"""Reading and writing world tables as directories of parquet, CSV or JSON files."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from popatlas.functions.decode import nan_to_null
from popatlas.model import CORE_COLUMNS, NO_PARENT, World

_OPTIONS = {"csv": {"header": "true"}}
# What an absent optional column stands for.
_DEFAULTS = {"parent_id": NO_PARENT}


def _read(spark: SparkSession, path: str, fmt: str, schema: T.StructType | None) -> DataFrame:
    reader = spark.read.format(fmt).options(**_OPTIONS.get(fmt, {}))
    return (reader.schema(schema) if schema is not None else reader).load(path)


def conform(df: DataFrame, table: str) -> DataFrame:
    """Core columns typed and complete, property columns kept as they are.

    A missing required column fails; a missing optional one is NULL (no parent, for
    ``parent_id``, as is a NULL one); without ``ordinal`` the id gives the file order. NaN becomes NULL.
    """
    required, optional = CORE_COLUMNS[table]
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise ValueError(f"{table} lacks {', '.join(absent)}")
    identifier = next(iter(required))

    def core(name: str, kind: str) -> Column:
        if name in df.columns:
            value = F.col(name).cast(kind)
            value = nan_to_null(value) if kind == "double" else value
            if name in _DEFAULTS:
                value = F.coalesce(value, F.lit(_DEFAULTS[name]).cast(kind))
            return value.alias(name)
        if name == "ordinal":
            return F.col(identifier).cast(kind).alias(name)
        return F.lit(_DEFAULTS.get(name)).cast(kind).alias(name)

    known = {**required, **optional}
    return df.select(
        *[core(name, kind) for name, kind in known.items()],
        *[c for c in df.columns if c not in known],
    )


def read_table(
    spark: SparkSession,
    path: str,
    table: str,
    fmt: str = "parquet",
    schema: T.StructType | None = None,
) -> DataFrame:
    """One world table. Pass ``schema`` for CSV or JSON properties that are not text."""
    return conform(_read(spark, path, fmt, schema), table)


def read_world(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    schemas: dict[str, T.StructType] | None = None,
    max_depth: int | None = None,
) -> World:
    """The world stored below ``path``, one directory per table."""
    schemas = schemas or {}
    tables = {
        name: read_table(spark, f"{path}/{name}", name, fmt, schemas.get(name))
        for name in CORE_COLUMNS
    }
    return World(geo=tables.pop("geo_units"), max_depth=max_depth, **tables)


def write_world(w: World, path: str, fmt: str = "parquet", mode: str = "error") -> None:
    """The world tables below ``path`` in a layout :func:`read_world` reads."""
    tables = {
        "geo_units": w.geo,
        "people": w.people,
        "venues": w.venues,
        "subsets": w.subsets,
        "memberships": w.memberships,
        "activities": w.activities,
    }
    for name, df in tables.items():
        df.write.format(fmt).options(**_OPTIONS.get(fmt, {})).mode(mode).save(f"{path}/{name}")


# The tables that facts about venues join by, and are stored in buckets of.
BUCKETED = ("venues", "subsets", "memberships", "activities")


def write_bucketed_world(w: World, path: str, buckets: int, mode: str = "error") -> None:
    """As :func:`write_world` in parquet, the tables in ``BUCKETED`` dealt into ``buckets`` by
    venue and sorted by it within each, so that joins by venue need not shuffle them.

    A venue with a third of all assignments makes one large bucket; where that is so, the
    plain layout lets the optimizer split it.
    """
    spark = w.geo.sparkSession
    for name in ("geo_units", "people"):
        df = w.geo if name == "geo_units" else w.people
        df.write.mode(mode).parquet(f"{path}/{name}")
    for name in BUCKETED:
        table = f"{name}_{uuid.uuid4().hex}"
        (
            getattr(w, name)
            .repartition(buckets, "venue_id")
            .write.mode(mode)
            .bucketBy(buckets, "venue_id")
            .sortBy("venue_id")
            .option("path", f"{path}/{name}")
            .saveAsTable(table)
        )
        spark.sql(f"DROP TABLE {table}")  # its files stay, they have a path of their own
    layout = spark.createDataFrame([(name, buckets) for name in BUCKETED], "name string, buckets int")
    layout.coalesce(1).write.mode(mode).parquet(f"{path}/layout")


def read_bucketed_world(spark: SparkSession, path: str, max_depth: int | None = None) -> World:
    """The world of :func:`write_bucketed_world`. Its bucketed tables are named in the
    session's catalog, which is how Spark knows of buckets."""
    buckets = {r["name"]: r["buckets"] for r in spark.read.parquet(f"{path}/layout").collect()}
    tables = {}
    for name in CORE_COLUMNS:
        stored = spark.read.parquet(f"{path}/{name}")
        if name in buckets:
            table = f"{name}_{uuid.uuid4().hex}"
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema)
            place = f"{path}/{name}".replace("'", "\\'")
            spark.sql(
                f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (venue_id) "
                f"SORTED BY (venue_id) INTO {buckets[name]} BUCKETS LOCATION '{place}'"
            )
            stored = spark.table(table)
        tables[name] = conform(stored, name)
    return World(geo=tables.pop("geo_units"), max_depth=max_depth, **tables)


def with_properties(
    df: DataFrame, cols: Sequence[str], exclude: Sequence[str] = (), name: str = "properties"
) -> DataFrame:
    """Fold property columns into a text map, without NULLs and excluded names."""
    kept = [c for c in cols if c not in exclude]
    folded = F.expr("cast(map() as map<string, string>)")
    if kept:
        pairs = F.create_map(*[x for c in kept for x in (F.lit(c), F.col(c).cast("string"))])
        folded = F.map_filter(pairs, lambda _, v: v.isNotNull())
    return df.select(*[c for c in df.columns if c not in cols], folded.alias(name))


def with_typed_properties(
    df: DataFrame,
    by_type: dict[str, Sequence[str]],
    type_column: str,
    exclude: Sequence[str] = (),
    name: str = "properties",
) -> DataFrame:
    """As :func:`with_properties`, with the property set that belongs to each row's type."""
    every = list(dict.fromkeys(c for cols in by_type.values() for c in cols))
    folded = with_properties(df, every, exclude, name)
    allowed = F.create_map(
        *[
            x
            for kind, cols in by_type.items()
            for x in (F.lit(kind), F.array(*[F.lit(c) for c in cols]).cast("array<string>"))
        ]
    )
    names = F.try_element_at(allowed, F.col(type_column))
    return folded.withColumn(
        name,
        F.map_filter(name, lambda k, _: F.coalesce(F.array_contains(names, k), F.lit(False))),
    )
