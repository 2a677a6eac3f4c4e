"""Roll-ups that are kept up to date from batches, without another full pass.

A :class:`CountStore` holds additive counts of whole subtrees, ``geo_id, <by>, n``, below a
shared folder: a base and one small table for each batch added since. A batch of facts is
counted per unit, climbs the tree on its own and is written beside the others, so adding it
costs the batch and its units' ancestors, never the base. Facts that leave a unit are a
batch too, with negative counts. Reading sums base and batches; :meth:`CountStore.compact`
folds them into a new base.

Batches are named. Adding one again replaces it, so a job that failed after its write may
be run once more. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popatlas.model import EventLog, World
from popatlas.operators.events import count_by_unit
from popatlas.operators.unit_stats import rollup
from popatlas.plans.joins import join_on_keys
from popatlas.plans.sizing import sized_broadcast

BASE = "base"


def summed(counts: DataFrame, by: Sequence[str], n: str = "n") -> DataFrame:
    """One row per unit and category; those that come to 0 are gone."""
    return (
        counts.groupBy("geo_id", *by).agg(F.sum(n).cast("bigint").alias(n)).where(F.col(n) != 0)
    )


def merged(base: DataFrame, delta: DataFrame, by: Sequence[str], n: str = "n") -> DataFrame:
    """``base`` with the counts of ``delta`` added, each with one row per unit and category.

    While the delta's counted rows fit, they are broadcast and no row of the base moves;
    only categories new to the base are found by a second, narrow pass over it.
    """
    keys = ["geo_id", *by]
    small = sized_broadcast(delta.select(*keys, F.col(n).alias("_more")))
    changed = join_on_keys(base, small, keys, "left").select(
        *keys, (F.col(n) + F.coalesce("_more", F.lit(0))).cast("bigint").alias(n)
    )
    known = base.select(*keys).withColumn("_known", F.lit(True))
    fresh = join_on_keys(delta, known, keys, "left").where("_known is null").select(*keys, n)
    return changed.unionByName(fresh).where(F.col(n) != 0)


def people_delta(
    w: World,
    added: DataFrame | None = None,
    removed: DataFrame | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Subtree counts ``geo_id, <by>, n`` of a batch: people who came less those who went.
    Someone who moved is in both, with the old unit and the new one."""
    sides = [
        people.groupBy("geo_id", *by).agg((F.lit(sign) * F.count("*")).alias("n"))
        for people, sign in ((added, 1), (removed, -1))
        if people is not None
    ]
    if not sides:
        raise ValueError("a batch adds or removes people")
    both = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    known = summed(both, by).join(w.units.select("geo_id"), "geo_id", "left_semi")
    return summed(rollup(known, w, by, counted=True), by)


def event_delta(log: EventLog, w: World, events: DataFrame, by: Sequence[str] = ("event_type",)) -> DataFrame:
    """Subtree counts ``geo_id, <by>, n`` of a batch of events, located as those of ``log``."""
    return rollup(count_by_unit(events, log, list(by)), w, by, counted=True)


class CountStore:
    """Counts below ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, by: Sequence[str] = (), n: str = "n"):
        self.spark, self.path, self.by, self.n = spark, path.rstrip("/"), list(by), n

    def _folder(self, name: str) -> str:
        return f"{self.path}/part={name}"

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def batches(self) -> list[str]:
        """The names of what counts now, the base included: not unfinished writes, nor what
        a finished base has folded already."""
        path, files = self._files()
        if not files.exists(path):
            return []
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        done = {
            s.getPath().getName()
            for s in files.listStatus(path)
            if files.exists(hadoop(s.getPath(), "_SUCCESS"))
        }
        names = {x.removeprefix("part=") for x in done if x.startswith("part=")}
        for base in [x for x in names if f"folded={x}" in done]:
            listed = self.spark.read.parquet(f"{self.path}/folded={base}")
            names -= {row["name"] for row in listed.collect()}  # one row a batch
        return sorted(names)

    def write(self, counts: DataFrame, batch: str = BASE) -> None:
        """Store counts of whole subtrees as the base, or as the batch of that name, which
        must not be folded into a base yet. Names that begin with ``BASE`` are taken."""
        if batch != BASE and batch.startswith(BASE):
            raise ValueError(f"a batch cannot be named {batch}")
        self._write_part(batch, counts)

    def _write_part(self, name: str, counts: DataFrame) -> None:
        kept = counts.select("geo_id", *self.by, F.col(self.n).cast("bigint").alias(self.n))
        kept.write.mode("overwrite").parquet(self._folder(name))

    def parts(self) -> DataFrame:
        """All rows, batch by batch."""
        names = self.batches()
        if not names:
            raise ValueError(f"no counts below {self.path}")
        return self.spark.read.parquet(*[self._folder(name) for name in names])

    def counts(self) -> DataFrame:
        """The counts as of the last batch."""
        return summed(self.parts(), self.by, self.n)

    def compact(self) -> None:
        """Fold base and batches into one base.

        The new base is complete under a name of its own before the list of what it holds
        is written beside it; readers leave out what a complete base has folded, so a run
        that breaks off at any point neither loses a count nor counts it twice.
        """
        names = self.batches()
        if len(names) < 2:
            return
        bases = [int(x.removeprefix(BASE)[1:] or 0) for x in names if x.startswith(BASE)]
        target = f"{BASE}-{max(bases, default=0) + 1}"
        listed = self.spark.createDataFrame([(x,) for x in names], "name string").coalesce(1)
        listed.write.mode("overwrite").parquet(f"{self.path}/folded={target}")
        self._write_part(target, self.counts())
        _, files = self._files()
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        for name in names:
            files.delete(hadoop(self._folder(name)), True)
