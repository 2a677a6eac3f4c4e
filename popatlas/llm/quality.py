"""Quality classifier: neighbours vote in a latent-semantic space.

Terms are hashed byte trigrams of the whole text. A bounded sample of labelled documents
(``per_label`` of each label, those with the smallest hash of their id) gives term weights
and, by a truncated singular value decomposition, a latent space of ``RANK`` dimensions.
The sample's vectors are broadcast (``2 * per_label * RANK`` floats). Every document is
scored by exact cosine products with all of them, block by block; its ``NEIGHBOURS`` most
similar ones vote with their similarity. Only the text is an input of a score.

Ids whose ``crc32(id as text) mod 5`` is 0 are held out and never learned from, nor are
rows without an id or with another label than 0 and 1; an id with both labels counts as 0.
A text without similar neighbours (an empty one, say) gets the share of label 1 in the
sample, as does every text if one label is missing; without any labels all scores are 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popatlas.llm.common import long_rows, utf8, whole_text

TERMS = 4096
RANK = 64
PER_LABEL = 2000
NEIGHBOURS = 25
SHARPNESS = 8
THRESHOLD = 0.3
BLOCK = 128  # rows scored at once; a block takes TERMS numbers a row, several times over
CHUNK = 1 << 22


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(utf8(F.col(id_col).cast("string"))) % 5 == 0, F.lit(False))


def term_counts(data: np.ndarray) -> np.ndarray:
    """Counts of the hashed trigrams of a byte string."""
    out = np.zeros(TERMS, dtype=np.int64)
    for at in range(0, max(0, len(data) - 2), CHUNK):
        b = data[at : at + CHUNK + 2].astype(np.uint32)
        code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        code *= np.uint32(0x9E3779B1)  # Fibonacci hashing: the upper bits are the slot
        out += np.bincount(code >> np.uint32(20), minlength=TERMS)
    return out


def _bytes_of(texts: pa.Array) -> Iterator[np.ndarray]:
    for text in texts:
        yield np.frombuffer(text.as_buffer(), dtype=np.uint8) if len(text.as_buffer()) else np.empty(0, np.uint8)


def weighted(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Unit rows of root frequencies times term weights; rows without terms stay zero."""
    x = counts.astype(np.float32)
    np.sqrt(x, out=x)
    x *= weights
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return np.divide(x, norm, out=x, where=norm > 0)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


class Votes:
    """The fitted space, the sample's latent vectors and their labels."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, rank: int = RANK):
        seen = np.count_nonzero(counts, axis=0)
        self.weights = np.log((1 + len(counts)) / (1 + seen)).astype(np.float32) + 1
        self.labels = labels.astype(np.float64)
        x = weighted(counts, self.weights)
        rank = min(rank, *x.shape) if len(x) else 0
        basis = np.random.default_rng(7).standard_normal((x.shape[1], rank + 16)).astype(np.float32)
        for _ in range(6 if len(x) else 0):  # subspace iteration towards the leading directions
            basis, _ = np.linalg.qr(x.T @ (x @ basis))
        if len(x):
            _, _, axes = np.linalg.svd(x @ basis, full_matrices=False)
            basis = basis @ axes.T
        self.axes = np.ascontiguousarray(basis[:, :rank], dtype=np.float32)
        self.vectors = _unit(x @ self.axes)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """The vote for each row of counts, block by block."""
        prior = self.labels.mean() if len(self.labels) else 0.5
        out = np.full(len(counts), prior)
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(counts), BLOCK):
            rows = counts[at : at + BLOCK]
            near = _unit(weighted(rows, self.weights) @ self.axes) @ self.vectors.T
            top = np.argpartition(-near, k - 1, axis=1)[:, :k]
            votes = np.clip(np.take_along_axis(near, top, axis=1), 0, 1).astype(np.float64) ** SHARPNESS
            total = votes.sum(axis=1)
            ones = (votes * self.labels[top]).sum(axis=1)
            out[at : at + BLOCK] = np.divide(ones, total, out=np.full(len(rows), prior), where=total > 0)
        return np.clip(out, 0, 1)


_CELL = np.dtype([("slot", ">u2"), ("count", ">u4")])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The label and the counts that are not 0, slot by slot."""
    for batch in batches:
        rows = []
        for text in _bytes_of(batch["text"]):
            counts = term_counts(text)
            cells = np.empty(np.count_nonzero(counts), _CELL)
            cells["slot"] = np.flatnonzero(counts)
            cells["count"] = counts[cells["slot"]]
            rows.append(cells.tobytes())
        yield pa.RecordBatch.from_arrays([batch["label"], pa.array(rows, pa.binary())], ["label", "counts"])


def _table_of(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Counts and labels of the sample in an order that its content alone decides, so ties
    between neighbours fall the same way however the rows arrive."""
    rows.sort(key=lambda r: (bytes(r["counts"]), r["label"]))
    counts = np.zeros((len(rows), TERMS), np.float32)  # whole numbers below 2^24 are exact
    for row, found in zip(counts, rows):
        cells = np.frombuffer(found["counts"], _CELL)
        row[cells["slot"]] = cells["count"]
    return counts, np.array([r["label"] for r in rows])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    per_label: int = PER_LABEL,
) -> Votes:
    """Learn from at most ``per_label`` documents of each label."""
    known = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.min(label_col).cast("int").alias("label"))
    )
    have = known.join(docs.select(F.col(id_col).alias("_id")).distinct(), "_id", "left_semi")
    by_hash = [F.xxhash64("_id"), F.col("_id")]
    picked = [have.where(F.col("label") == v).orderBy(*by_hash).limit(per_label) for v in (0, 1)]
    sample = picked[0].unionByName(picked[1])
    texts = (
        docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("text"))
        .join(F.broadcast(sample), "_id")  # 2 * per_label rows
        .select("label", "text")
    )
    rows = texts.mapInArrow(_counted, "label int, counts binary").collect()
    counts, known_labels = _table_of(rows)
    del rows
    return Votes(counts, known_labels)


def score(
    docs: DataFrame, votes: Votes, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(votes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                counts = np.stack([term_counts(b) for b in _bytes_of(part["text"])])
                found = shared.value.scores(counts)
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["held_out"], pa.array(found)], ["doc_id", "held_out", "score"]
                )

    rows = long_rows(docs).select(
        F.col(id_col).cast("long").alias("doc_id"),
        held_out(id_col).alias("held_out"),
        whole_text(text_col).alias("text"),
    )
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(
    docs: DataFrame, votes: Votes, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` without the documents that are predicted 0, all columns kept. The decision
    is made where the row is read, on its own text; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(votes)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                text = part.column(names.index(text_col)).fill_null("")
                counts = np.stack([term_counts(b) for b in _bytes_of(text)])
                yield part.filter(pa.array(shared.value.scores(counts) >= THRESHOLD))

    return long_rows(docs).mapInArrow(run, docs.schema)
