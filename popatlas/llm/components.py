"""Connected components of a link table, by alternating star operations.

Every round points the larger neighbours of a node at the smallest one (large star), then
all smaller neighbours (small star), until no link changes; rounds grow with the logarithm
of the number of nodes. Minima are pre-aggregated before they are shuffled and joined back
on the node, a join whose hot nodes the optimizer can split, so a node with very many links
is not gathered in one task. Links are written to the shared folder after each round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popatlas.plans.storage import stored

LINKS = "u long, v long"


def spanning_forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links ``(node, smallest node of its component)`` with the same components."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    child = np.flatnonzero(label != np.arange(len(names)))
    return names[child], names[label[child]]


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that join nothing new within a batch are left out."""
    for batch in batches:
        u, v = spanning_forest(batch["u"].to_numpy(), batch["v"].to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links ``(u, v)`` with ``u > v`` after one large or small star."""
    if large:
        near = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = links
    low = near.groupBy("u").agg(F.min("v").alias("low"))
    joined = near.join(low, "u")
    if large:
        low_or_self = F.least("low", "u")
        out = joined.where("v > u").select(F.col("v").alias("u"), low_or_self.alias("v"))
    else:
        out = joined.where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        out = out.unionByName(low.select("u", F.col("low").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """``node, component`` for every node of ``links (u, v)`` that is not itself the
    smallest of its component. Self-links and repeated links are ignored."""
    ordered = links.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    now = stored(ordered.mapInArrow(_thin, LINKS).where("u <> v").distinct(), name)
    before = None
    while True:
        row = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == before or row[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = tuple(row)
        now = stored(_star(_star(now, True), False), name)
