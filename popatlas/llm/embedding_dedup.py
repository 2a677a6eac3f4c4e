"""Embedding near-dedup by Euclidean p-stable hashing and exact cosine checks.

Normalised vectors at cosine ``t`` are ``sqrt(2 - 2t)`` apart. A hash is the floor of a
Gaussian projection plus a random shift, over a width of ten such distances; a table keys a
vector by ``k`` hashes. ``k`` grows with the logarithm of the largest label, so that
unrelated vectors rarely share a bucket; the number of tables follows from it, so that a
pair just at the threshold misses all of them with probability ``MISS`` at most (closer
pairs miss far less often). Pairs that share a bucket are compared exactly in double precision.

Equal vectors of a label are one entry with a count. Keys are narrow; only entries that share
a bucket with another take their vector along. Buckets of over ``CHUNK`` entries are split
into chunks, and each pair of chunks is a unit of its own. Units compare blocks by matrix
products and give back, not the pairs, but per entry the number of links and a spanning
forest. A pair that shares several tables counts in the first one only.

Vectors that are null, empty, all zero, or hold nulls or non-finite components, and rows
without a label, link with nothing; so do vectors of different length. Rows of one
``vec_id``, null ones too, are vectors of their own: entries carry a number that nothing
else has, and only the answer names a component by its smallest id (null if all are null).
The cosine of a vector to its copies is 1.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popatlas.llm.components import components, spanning_forest
from popatlas.llm.runs import whole_runs
from popatlas.plans.storage import stored

THRESHOLD = 0.98
WIDTHS = 10.0
MISS = 1e-4
CHUNK = 4096
BLOCK = 1024
SEED = 11


def same_hash(distance: float, width: float) -> float:
    """Chance that two points at a distance share one quantised projection."""
    r = width / distance
    normal = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * normal - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def shape(n: int, threshold: float) -> tuple[float, int, int]:
    """Width, hashes per table and tables for ``n`` vectors."""
    near = math.sqrt(2 - 2 * threshold)
    width = WIDTHS * near
    unrelated = same_hash(math.sqrt(2), width)
    # On average a sixteenth of an unrelated vector per bucket.
    k = max(4, math.ceil(math.log(16 * max(n, 2)) / -math.log(unrelated)))
    return width, k, math.ceil(math.log(MISS) / math.log1p(-(same_hash(near, width) ** k)))


def _valid(x: object) -> np.ndarray | None:
    if x is None or len(x) == 0 or any(v is None for v in x):
        return None
    x = np.asarray(x, dtype=np.float64)
    return x if np.isfinite(x).all() and x.any() else None


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = [_valid(v) for v in batch["vector"].to_pylist()]
        labelled = batch["label"].is_valid().to_pylist()
        out = [
            hashlib.blake2b((x + 0.0).tobytes(), digest_size=16).digest() if x is not None and has else None
            for x, has in zip(vectors, labelled, strict=True)
        ]
        digest = pa.array(out, pa.binary())
        kept = pa.array([v if d else None for v, d in zip(vectors, out, strict=True)], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], digest, kept], ["vec_id", "label", "digest", "vector"])


def _unit_rows(vectors: pa.ChunkedArray) -> np.ndarray:
    """Normalised rows; the vectors have one length."""
    flat = vectors.combine_chunks().flatten().to_numpy()
    x = flat.reshape(len(vectors), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _keys(width: float, k: int, tables: int):
    """Adds the key of each table to distinct vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            vectors, lengths = batch["vector"], np.array([len(v) for v in batch["vector"]])
            keys = np.zeros((batch.num_rows, tables), dtype=np.int64)
            for n in np.unique(lengths):
                if n not in planes:
                    rng = np.random.default_rng([SEED, int(n)])
                    planes[n] = rng.standard_normal((n, tables * k)), rng.uniform(0, width, tables * k)
                mine = np.flatnonzero(lengths == n)
                unit = _unit_rows(pa.chunked_array([vectors.take(pa.array(mine))]))
                directions, shift = planes[n]
                cells = np.floor((unit @ directions + shift) / width).astype(np.int64).reshape(-1, tables, k)
                for i, row in zip(mine, cells, strict=True):
                    keys[i] = [
                        int.from_bytes(hashlib.blake2b(t.tobytes(), digest_size=8).digest(), "little", signed=True)
                        for t in row
                    ]
            lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, tables, dtype=np.int32), keys.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "keys"])

    return run


def _compare(threshold: float):
    """Links within units of sorted rows ``unit..., side, rep, copies, vector, keys``."""

    def unit(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        x = _unit_rows(table["vector"])
        reps, copies = table["rep"].to_numpy(), table["copies"].to_numpy()
        keys = table["keys"].combine_chunks().flatten().to_numpy().reshape(len(reps), -1)
        at, side = int(table["tab"][0].as_py()), table["side"].to_numpy()
        across = bool(side.min() != side.max())
        left = np.flatnonzero(side == side.min())
        right = np.flatnonzero(side != side.min()) if across else left
        for i in range(0, len(left), BLOCK):
            a = left[i : i + BLOCK]
            for j in range(0 if across else i, len(right), BLOCK):
                b = right[j : j + BLOCK]
                p, q = np.nonzero(x[a] @ x[b].T >= threshold)
                p, q = a[p], b[q]
                if not across:
                    p, q = p[p < q], q[p < q]
                new = ~(keys[p, :at] == keys[q, :at]).any(axis=1)
                u, v = spanning_forest(reps[p], reps[q])
                p, q = p[new], q[new]
                links = np.bincount(p, copies[q], len(reps)) + np.bincount(q, copies[p], len(reps))
                yield reps[links > 0], links[links > 0].astype(np.int64), u, v

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_runs(batches, ["label", "dim", "tab", "key", "c1", "c2"]):
            for start, stop in zip(starts, [*starts[1:], table.num_rows], strict=True):
                # A chunk pair whose one side is empty has nothing to compare.
                part = table.slice(start, stop - start)
                if part.num_rows < 2 or (part["c1"][0] != part["c2"][0] and len(part["side"].unique()) < 2):
                    continue
                for reps, links, u, v in unit(part):
                    none = pa.nulls(len(reps), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(reps), none, pa.array(links)], ["u", "v", "links"])
                    none = pa.nulls(len(u), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), none], ["u", "v", "links"])

    return run


def similar_vectors(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    chunk: int = CHUNK,
) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``."""
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).cast("array<double>").alias("vector"),
    ).mapInArrow(_digests, "vec_id long, label string, digest binary, vector array<double>")
    rows = stored(rows, "vectors")
    distinct = (
        rows.where("digest is not null")
        .groupBy("label", "digest")
        .agg(
            F.min("vec_id").alias("first_id"),
            F.count("*").alias("copies"),
            F.first("vector").alias("vector"),
        )
        .withColumn("dim", F.size("vector"))
        .withColumn("rep", F.monotonically_increasing_id())  # settled as entries are stored
        .select("rep", "first_id", "label", "digest", "dim", "copies", "vector")
    )
    largest = rows.where("digest is not null").groupBy("label").count().agg(F.max("count")).first()[0] or 0
    width, k, tables = shape(largest, threshold)
    schema = "rep long, first_id long, label string, digest binary, dim int, copies long, vector array<double>, keys array<long>"
    entries = stored(distinct.mapInArrow(_keys(width, k, tables), schema), "entries")
    at = ["label", "dim", "tab", "key"]
    keyed = entries.select("rep", "label", "dim", F.posexplode("keys").alias("tab", "key"))
    shared = keyed.groupBy(*at).count().where("count > 1")
    chunks = F.ceil(F.col("count") / chunk).cast("int")
    mine = F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")
    members = (
        keyed.join(shared, at)
        .withColumn("chunks", chunks)
        .withColumn("side", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select(*at, "rep", "side", F.least("side", "other").alias("c1"), F.greatest("side", "other").alias("c2"))
    )
    unit = [*at, "c1", "c2"]
    compared = (
        members.join(entries.select("rep", "copies", "vector", "keys"), "rep")
        .repartition(*unit)
        .sortWithinPartitions(*unit)
        .mapInArrow(_compare(threshold), "u long, v long, links long")
    )
    found = stored(compared, "compared")
    counts = found.where("links is not null").groupBy("u").agg(F.sum("links").alias("links"))
    grouped = components(found.where("v is not null").select("u", "v"), "vector-links")
    placed = (
        entries.select("label", "digest", "rep", "first_id", "copies")
        .join(counts.withColumnRenamed("u", "rep"), "rep", "left")
        .join(grouped.withColumnRenamed("node", "rep"), "rep", "left")
        .withColumn("component", F.coalesce("component", "rep"))
    )
    smallest = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = placed.join(smallest, "component").select(
        "label",
        "digest",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"),
        "component_id",
        F.lit(True).alias("_named"),
    )
    own = F.when(F.col("_named"), F.col("component_id")).otherwise(F.col("vec_id"))
    return rows.select("vec_id", "label", "digest").join(named, ["label", "digest"], "left").select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        own.alias("component_id"),
        own.eqNullSafe(F.col("vec_id")).alias("kept"),
    )
