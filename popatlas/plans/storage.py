"""Where intermediate tables live: the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str | None:
    """``spark.checkpoint.dir`` of the session, or the checkpoint folder set on its context.
    Without one a local session gets a folder of its own; on a cluster there is none, since
    no machine-local folder would do."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    named = named or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return None
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="popatlas-")
    return _LOCAL[app]


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    base = shared_folder(spark)
    if base is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base}/popatlas/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, which also gives the optimizer
    its true size. Without a shared folder ``df`` itself."""
    spark = df.sparkSession
    if shared_folder(spark) is None:
        return df
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
