"""Ranked lexical search: documents that look alike to the items are scored once.

Each document is cut down to the items' terms: its bag is the list of those terms with their
counts. The score of a document depends on its bag and on ``m``, which its length sets, on
nothing else. Documents of equal bag and ``m`` form a class, found by a 64-bit hash and told
apart by the bag itself. A class is scored once for all items, and only the classes an item
ranks first are expanded to their documents, by ascending id.

An item's first ``k`` documents lie in its first ``k`` classes, taken by score and smallest
id: each class before another adds one document that comes before all of that other.
So every task keeps ``k`` classes an item, and at most ``k`` documents of a class are ever
sought. Items are searched in blocks of about ``BLOCK_TERMS`` (item, term) pairs; only
those of one block are sent to the tasks.

Null texts and texts without terms are in no result and count for nothing. Rows of one
``item_id`` (nulls too) are one item with the terms of all; an item without terms has no
rows. Documents of one id are documents of their own; null ids come after all others.
Scores are sums of 64-bit integers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from popatlas.llm.common import long_rows, settled
from popatlas.plans.sizing import sized_broadcast
from popatlas.plans.storage import stored

BEST = 50
BLOCK_TERMS = 500_000
CELLS = 1 << 21  # scores, or products of term and item, held at once
FANS = 16
NO_ID = np.iinfo(np.int64).max

def _folded(byte: int) -> int:
    """The byte as it stands in a term, A-Z lower-cased, or a blank."""
    if byte > 127:
        return byte
    return ord(chr(byte).lower()) if chr(byte).isalnum() else ord(" ")


TABLE = bytes(map(_folded, range(256)))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, in order."""
    return text.translate(TABLE).split()


def _texts(column: pa.Array) -> Iterator[bytes]:
    for text in column:
        yield text.as_buffer().to_pybytes() if text.is_valid else b""


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, term``: the distinct terms of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms_of(text))) for text in _texts(batch["text"])]
            terms = pa.array(found, pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([batch["item_id"], terms], ["item_id", "terms"])

    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["item_id"].dataType.simpleString()
    cut = long_rows(rows).mapInArrow(run, f"item_id {kind}, terms array<binary>")
    return cut.select("item_id", F.explode("terms").alias("term")).distinct()


def bags(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n, terms, tfs`` of the documents that have terms: how many, and the numbers
    and counts of those in the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            lengths, keys, counts = [], [], []
            for text in _texts(batch["text"]):
                words = terms_of(text)
                bag = sorted(Counter(map(number, words)).items(), key=lambda x: (x[0] is None, x[0]))
                if bag and bag[-1][0] is None:
                    bag.pop()
                lengths.append(len(words))
                keys.append([t for t, _ in bag])
                counts.append([c for _, c in bag])
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array(lengths, pa.int64()),
                    pa.array(keys, pa.list_(pa.int32())),
                    pa.array(counts, pa.list_(pa.int64())),
                ],
                ["doc_id", "n", "terms", "tfs"],
            )

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )
    cut = long_rows(rows).mapInArrow(
        run, "doc_id long, n long, terms array<int>, tfs array<bigint>"
    )
    return cut.where("n > 0")


def first_rows(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group with their ``rank``. Groups are cut down by task
    and then by fan first, so none meets in one task."""
    fanned = df.withColumn("_fan", F.pmod(F.spark_partition_id(), F.lit(FANS)))
    for by in ([*keys, "_fan"], keys):
        place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        fanned = fanned.withColumn("rank", place).where(F.col("rank") <= k)
    return fanned.drop("_fan")


class Postings:
    """The items of each term and the terms' weights."""

    def __init__(self, pairs: list[tuple[int, int]], n_terms: int, n_items: int):
        self.items, self.n_items = np.array([i for _, i in sorted(pairs)], np.int64), n_items
        counts = np.bincount([t for t, _ in pairs], minlength=n_terms)
        self.counts, self.starts = counts, np.concatenate([[0], np.cumsum(counts)[:-1]])
        self.weights = np.zeros(n_terms, np.int64)

    def weigh(self, total: int, frequencies: dict[int, int]) -> None:
        for term, df in frequencies.items():
            self.weights[term] = math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))

    def scores(self, rows: np.ndarray, n_rows: int, terms: np.ndarray, tfs: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Scores of ``n_rows`` bags for all items; term ``terms[i]`` is in bag ``rows[i]``."""
        worth = self.weights[terms] * (1_000_000_000 * tfs // (1000 * tfs + 20 * m[rows]))
        out = np.zeros(n_rows * self.n_items, np.int64)
        cells = rows * self.n_items
        ends = np.cumsum(self.counts[terms])
        at = 0
        while at < len(terms):  # products of bounded number
            spent = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, spent + CELLS, side="right")))
            reps = self.counts[terms[at:to]]
            inside = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
            item = self.items[np.repeat(self.starts[terms[at:to]], reps) + inside]
            cell, value = np.repeat(cells[at:to], reps) + item, np.repeat(worth[at:to], reps)
            # Sums of doubles are exact below 2^53, so the halves are summed apart.
            out += np.bincount(cell, value >> 20, len(out)).astype(np.int64) << 20
            out += np.bincount(cell, value & 0xFFFFF, len(out)).astype(np.int64)
            at = to
        return out.reshape(n_rows, self.n_items)


class Best:
    """The first ``k`` classes of each item so far, by score, smallest id and class."""

    def __init__(self, n_items: int, k: int):
        self.k, self.floor = k, np.ones(n_items, np.int64)
        self.rows = np.empty((0, 4), np.int64)  # item, score, smallest id, class

    def add(self, scores: np.ndarray, ids: np.ndarray, classes: np.ndarray) -> None:
        row, item = np.nonzero(scores >= self.floor)
        if not len(row):
            return
        new = np.stack([item, scores[row, item], ids[row], classes[row]], axis=1)
        rows = np.concatenate([self.rows, new])
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], -rows[:, 1], rows[:, 0]))]
        starts = np.searchsorted(rows[:, 0], rows[:, 0])
        place = np.arange(len(rows)) - starts
        self.rows = rows[place < self.k]
        last = rows[place == self.k - 1]
        self.floor[last[:, 0]] = last[:, 1]


def _ranked(classes: DataFrame, postings: Postings, k: int) -> DataFrame:
    """``item, score, first_id, class_id``: the first classes of each item, task by task."""
    shared = classes.sparkSession.sparkContext.broadcast(postings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        postings = shared.value
        best = Best(postings.n_items, k)
        step = max(1, CELLS // postings.n_items)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                sizes = np.diff(part["terms"].offsets.to_numpy())
                scores = postings.scores(
                    np.repeat(np.arange(part.num_rows), sizes),
                    part.num_rows,
                    part["terms"].flatten().to_numpy(),
                    part["tfs"].flatten().to_numpy(),
                    part["m"].to_numpy(),
                )
                ids = part["first_id"].fill_null(NO_ID).to_numpy()
                best.add(scores, ids, part["class_id"].to_numpy())
        item, score, first, number = best.rows.T
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(item),
                pa.array(score),
                pa.array(first, mask=first == NO_ID),
                pa.array(number),
            ],
            ["item", "score", "first_id", "class_id"],
        )

    found = classes.select("class_id", "m", "terms", "tfs", "first_id")
    kept = found.mapInArrow(run, "item long, score long, first_id long, class_id long")
    order = [F.desc("score"), F.asc_nulls_last("first_id"), F.asc("class_id")]
    return first_rows(kept, ["item"], order, k).drop("rank")


SAME = ["bag", "m", "terms", "tfs"]


def _search_block(
    docs: DataFrame, pairs: list, id_col: str, text_col: str, k: int
) -> tuple[DataFrame, list]:
    """``item, rank, doc_id, score`` for the items of one block, and their ids by number."""
    ids = sorted({i for i, _ in pairs}, key=lambda i: (i is None, i))
    words = sorted({t for _, t in pairs})
    numbers = {i: n for n, i in enumerate(ids)}
    vocabulary = {t: n for n, t in enumerate(words)}
    postings = Postings(
        [(vocabulary[t], numbers[i]) for i, t in pairs], len(words), len(ids)
    )
    cut = stored(bags(docs, vocabulary, id_col, text_col), "bags")
    total = cut.agg(F.count("*").alias("N"), F.sum("n").alias("L")).first()
    n, length = total["N"], total["L"] or 1
    by_length = F.expr(
        f"50 + cast((cast(50 * n as decimal(18,0)) * cast({n} as decimal(18,0))) div {length} as bigint)"
    )
    known = (
        cut.where(F.size("terms") > 0)
        .withColumn("m", by_length)
        .withColumn("bag", F.xxhash64("m", "terms", "tfs"))
        .drop("n")
    )
    classes = settled(
        known.groupBy(*SAME)
        .agg(F.min("doc_id").alias("first_id"), F.count("*").alias("members"))
        .withColumn("class_id", F.monotonically_increasing_id()),
        "bag-classes",
    )
    frequencies = (
        classes.select(F.explode("terms").alias("term"), "members")
        .groupBy("term")
        .agg(F.sum("members").alias("df"))
        .collect()  # a row for each term of the block at most
    )
    postings.weigh(n, {r["term"]: r["df"] for r in frequencies})
    ranked = stored(_ranked(classes, postings, k), "ranked-classes")
    wanted = ranked.select("class_id").distinct()
    chosen = stored(classes.join(sized_broadcast(wanted), "class_id"), "chosen-classes")  # k an item
    near = known.join(sized_broadcast(chosen.select("bag").distinct()), "bag", "left_semi")
    by_id = [F.asc_nulls_last("doc_id")]
    members = first_rows(near, SAME, by_id, k).drop("rank")
    expanded = members.join(chosen.select("class_id", *SAME), SAME).select("class_id", "doc_id")
    hits = ranked.select("item", "score", "class_id").join(expanded, "class_id")
    found = first_rows(hits, ["item"], [F.desc("score"), *by_id], k)
    return found.select("item", "rank", "doc_id", "score"), ids


def search(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    k: int = BEST,
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item."""
    spark = docs.sparkSession
    wanted = stored(item_terms(items, item_col, item_text_col), "item-terms")
    kind = wanted.schema["item_id"].dataType.simpleString()
    blocks = max(1, math.ceil(wanted.count() / block_terms))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    found = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for number in range(blocks):
        rows = wanted.where(block == number).collect()
        if not rows:
            continue
        pairs = [(r["item_id"], bytes(r["term"])) for r in rows]
        hits, ids = _search_block(docs, pairs, id_col, text_col, k)
        names = spark.createDataFrame(list(enumerate(ids)), f"item long, item_id {kind}")
        hits = stored(hits, "hits") if blocks > 1 else hits
        found = found.unionByName(
            hits.join(sized_broadcast(names, len(ids)), "item").select("item_id", "rank", "doc_id", "score")
        )
    return found
