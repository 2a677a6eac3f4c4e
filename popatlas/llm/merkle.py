"""Merkle manifest: a tree of digests over all rows, with a proof for each.

A row's leaf is the SHA-256 of its fields. The leaves of a language, by id, are the bottom
of a tree in which every ``ARITY`` consecutive nodes become the digest of their hex digests;
the trees' roots, by language, are the bottom of the last one. A parent is hashed child by
child and keeps a copy of the hash state before each slot. To fold a changed child upwards,
the state kept before its slot is taken up again and only the child and its right siblings
are added; what lies to its left is never hashed again.

Trees are built in chunks of ``ARITY ** levels`` neighbours, each in one task. A chunk's
root is a leaf of the next chunk, so a tree of N rows takes log(N) / levels rounds over
tables that shrink by that factor. Each chunk of rows then gets the path above it: of each
level what stands left and right of it. A hash state cannot leave its process, so the task
absorbs the left part once and keeps that state for all rows of the chunk.

Null fields are written ``-``. Rows come in order of language and id, nulls first, equal
ones by their leaf. Rows that agree in all five fields have equal leaves and one leaf each.
Other columns are not covered. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popatlas.llm.common import number_rows, utf8
from popatlas.llm.runs import whole_runs
from popatlas.plans.joins import join_on_keys
from popatlas.plans.sizing import sized_broadcast
from popatlas.plans.storage import stored

ARITY = 2
LEVELS = 10  # of a chunk
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED = 7  # rows whose id has a checksum divisible by this

STEP = "struct<left:string,right:string>"


def field_bytes(value: Column) -> Column:
    """``-`` for null, else the length in UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    framed = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    return F.coalesce(framed, F.lit("-"))


def leaf_of(fields: list[Column]) -> Column:
    return F.sha2(utf8(F.concat(*[field_bytes(f) for f in fields])), 256)


class Tree:
    """``height`` levels over a list of hex digests, with the states before each slot."""

    def __init__(self, leaves: list[str], height: int):
        self.levels, self.states = [leaves], []
        for _ in range(height):
            below, above, states = self.levels[-1], [], []
            for at in range(0, len(below), ARITY):
                parent = sha256()
                for child in below[at : at + ARITY]:
                    states.append(parent.copy())
                    parent.update(child.encode())
                above.append(parent.hexdigest())
            self.levels.append(above)
            self.states.append(states)

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def beside(self, at: int) -> Iterator[tuple[str, str]]:
        """What stands left and right of the node's path, level by level."""
        for level in self.levels[:-1]:
            first = at - at % ARITY
            yield "".join(level[first:at]), "".join(level[at + 1 : first + ARITY])
            at //= ARITY

    def fold(self, at: int, digest: str) -> str:
        """The root with ``digest`` in place of leaf ``at``."""
        for level, states in zip(self.levels, self.states):
            parent = states[at].copy()
            for child in (digest, *level[at + 1 : at - at % ARITY + ARITY]):
                parent.update(child.encode())
            digest, at = parent.hexdigest(), at // ARITY
        return digest


class PathAbove:
    """The levels above a chunk, the states before its slot kept."""

    def __init__(self, steps: list[dict]):
        self.between = "".join(s["left"] + s["right"] for s in steps).encode()
        self.steps = [(sha256(s["left"].encode()), s["right"].encode()) for s in steps]

    def fold(self, digest: str) -> str:
        for before, right in self.steps:
            parent = before.copy()
            parent.update(digest.encode() + right)
            digest = parent.hexdigest()
        return digest


def _height(n: Column) -> Column:
    """Levels above ``n`` leaves until one node remains."""
    height, reach, level = F.lit(0), 1, 1
    while reach < 1 << 62:
        height = F.when(n > reach, F.lit(level)).otherwise(height)
        reach, level = reach * ARITY, level + 1
    return height


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    for table, starts in whole_runs(batches, ["tree", "chunk"]):
        ends = [*starts[1:].tolist(), table.num_rows]
        for start, end in zip(starts.tolist(), ends):
            yield table.slice(start, end - start)


class Chunked:
    """Chunks of ``ARITY ** levels`` nodes; what is done to each of them in a task."""

    def __init__(self, levels: int):
        self.levels, self.size = levels, ARITY**levels

    def tree(self, chunk: pa.Table) -> Tree:
        return Tree(chunk["digest"].to_pylist(), min(self.levels, chunk["height"][0].as_py()))

    def dealt(self, nodes: DataFrame) -> DataFrame:
        """Nodes with their chunk, whole chunks to a task and in order."""
        chunk = F.expr(f"at div {self.size}").alias("chunk")
        rows = nodes.select("tree", "at", chunk, "digest", "height")
        return rows.repartition("tree", "chunk").sortWithinPartitions("tree", "chunk", "at")

    def roots(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row a chunk: its root, a node of the levels above."""
        for chunk in _chunks(batches):
            height = chunk["height"][0].as_py()
            yield pa.RecordBatch.from_arrays(
                [
                    chunk["tree"].combine_chunks()[:1],
                    chunk["chunk"].combine_chunks()[:1],
                    pa.array([self.tree(chunk).root]),
                    pa.array([max(height - self.levels, 0)], pa.int32()),
                ],
                ["tree", "at", "digest", "height"],
            )

    def paths(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row a node: its path through the chunk."""
        kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        for chunk in _chunks(batches):
            tree = self.tree(chunk)
            steps = [
                [{"left": left, "right": right} for left, right in tree.beside(at)]
                for at in range(chunk.num_rows)
            ]
            for batch in chunk.append_column("steps", pa.array(steps, kind)).to_batches():
                yield batch.select(["tree", "at", "chunk", "steps"])

    def proved(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of each chunk below the path of the chunk, which comes first."""
        for table in _chunks(batches):
            subroot, root = table["subroot"][0].as_py(), table["root"][0].as_py()
            above = PathAbove(table["steps"][0].as_py())
            chunk = table.slice(1)
            tree = self.tree(chunk)
            proofs, folded = [], []
            for at, changed in enumerate(chunk["changed"].to_pylist()):
                proof = sha256("".join(left + right for left, right in tree.beside(at)).encode())
                proof.update(above.between)
                proofs.append(proof.hexdigest())
                folded.append(above.fold(tree.fold(at, changed)))
            n = chunk.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    chunk["doc_id"].combine_chunks(),
                    chunk["digest"].combine_chunks(),
                    pa.array([subroot] * n, pa.string()),
                    pa.array([root] * n, pa.string()),
                    pa.array(proofs, pa.string()),
                    pa.array(folded, pa.string()),
                    pa.array([f == root for f in folded], pa.bool_()),
                ],
                ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
            )


NODE = "tree string, at long, digest string, height int"


def paths_to_root(nodes: DataFrame, height: int, levels: int) -> DataFrame:
    """``tree, at, steps, root`` of the nodes ``tree, at, digest, height``; no tree is
    higher than ``height``."""
    if height <= 0:
        none = F.expr(f"cast(array() as array<{STEP}>)")
        return nodes.select("tree", "at", none.alias("steps"), F.col("digest").alias("root"))
    by = Chunked(levels)
    dealt = by.dealt(nodes)
    here = dealt.mapInArrow(by.paths, f"tree string, at long, chunk long, steps array<{STEP}>")
    above = stored(dealt.mapInArrow(by.roots, NODE), "merkle-level")
    onward = paths_to_root(above, height - levels, levels).select(
        "tree", F.col("at").alias("chunk"), F.col("steps").alias("more"), "root"
    )
    joined = join_on_keys(here, onward, ["tree", "chunk"])
    return joined.select("tree", "at", F.concat("steps", "more").alias("steps"), "root")


def _highest(nodes: DataFrame) -> int:
    return nodes.agg(F.max("height")).first()[0] or 0


def leaves(docs: DataFrame) -> DataFrame:
    """``tree`` (the language), ``doc_id``, ``digest`` and ``changed``, the digest after the
    tampering: ``n_chars`` is one more where ``TAMPERED`` divides the id's checksum."""
    fields = {f: F.col(f) for f in FIELDS}
    hit = F.crc32(utf8(F.col("doc_id").cast("string"))) % TAMPERED == 0
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    raised = F.when(hit, more).otherwise(F.col("n_chars").cast("decimal(20,0)"))
    return docs.select(
        F.col("lang").cast("string").alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf_of(list(fields.values())).alias("digest"),
        leaf_of(list((fields | {"n_chars": raised}).values())).alias("changed"),
    )


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """One row per document: ``doc_id, leaf, subroot, root, proof_sha256, folded_root,
    verified``. ``verified`` tells whether the leaf as found now folds to the root. The
    chunks of a task have ``levels`` levels."""
    by = Chunked(levels)
    numbered = number_rows(leaves(docs), ["tree", "doc_id", "digest", "changed"], "leaves", "row")
    trees = stored(
        numbered.groupBy("tree").agg(F.min("row").alias("first"), F.count("*").alias("n")),
        "merkle-trees",
    ).withColumn("height", _height(F.col("n")))
    placed = join_on_keys(numbered, sized_broadcast(trees), ["tree"]).withColumn(
        "at", F.col("row") - F.col("first")
    )
    chunks = stored(by.dealt(placed).mapInArrow(by.roots, NODE), "merkle-chunks")
    below = stored(paths_to_root(chunks, _highest(trees) - levels, levels), "merkle-paths")
    # The roots of the trees, by language, are the leaves of the last one.
    subroots = below.where("at = 0").select("tree", F.col("root").alias("digest"))
    tops = number_rows(subroots, ["tree"], "subroots", "at")
    height = _height(F.lit(tops.count()).cast("long"))
    tops = stored(tops.select("tree", "at", "digest", height.alias("height")), "merkle-top")
    # One tree now: the language only names its leaves.
    one = tops.withColumn("tree", F.lit(""))
    top = paths_to_root(one, _highest(tops), levels).select(
        "at", F.col("steps").alias("more"), "root"
    )
    top = join_on_keys(tops, top, ["at"]).select(
        "tree", F.col("digest").alias("subroot"), "more", "root"
    )
    above = join_on_keys(below.drop("root"), top, ["tree"]).select(
        "tree",
        F.col("at").alias("chunk"),
        F.lit(-1).cast("long").alias("at"),
        F.concat("steps", "more").alias("steps"),
        "subroot",
        "root",
    )
    rows = placed.withColumn("chunk", F.expr(f"at div {by.size}")).select(
        "tree", "chunk", "at", "doc_id", "digest", "changed", "height"
    )
    together = (
        rows.unionByName(above, allowMissingColumns=True)
        .repartition("tree", "chunk")
        .sortWithinPartitions("tree", "chunk", "at")
    )
    return together.mapInArrow(
        by.proved,
        "doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
        "folded_root string, verified boolean",
    )
