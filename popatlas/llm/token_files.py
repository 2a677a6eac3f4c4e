"""Token files: whole tables of texts as range-coded id blocks, and back.

``write_tokens`` deals documents by range of their id, so that the files hold them in
ascending order, encodes them, and cuts the ids of each task into blocks of ``BLOCK`` ids.
A file row is one block (see ``token_coder`` for its bytes) with the documents in it; a
long document goes on in the next block. ``read_tokens`` gives the ids back, and
``token_index`` one row per document with its place in the whole sequence.

The files are Parquet with a binary column, so any store that Spark can write to will do,
and its commit protocol keeps out what lost or repeated tasks wrote. Null texts count as
empty; null ids come first; rows with equal ids stay apart, ordered by their text's hash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from popatlas.llm.common import long_rows, whole_text
from popatlas.llm.token_coder import BLOCK, decode_blocks, encode_blocks
from popatlas.llm.tokens import END_ID, encoder

# Of a block: the number of its task, its place in the task, its bytes, and for each piece of
# a document in it: the document's number in the task, its id, the ids of the task before it,
# its length, and which of its ids the piece starts with and how many it holds.
BLOCKS = (
    "part long, block long, code binary, doc_no array<long>, doc_id array<long>, "
    "doc_start array<long>, doc_tokens array<long>, piece_start array<long>, piece array<long>"
)
ROWS = 8  # blocks of a batch
_POLYNOMIAL = 0xEDB88320


def _times_x(crc: int, count: int) -> int:
    """A checksum remainder times ``x ** count``, modulo the CRC-32 polynomial."""

    def product(a: int, b: int) -> int:
        out = 0
        for i in range(32):
            if a >> (31 - i) & 1:
                out ^= b
            b = (b >> 1) ^ (_POLYNOMIAL if b & 1 else 0)
        return out

    power = 1 << 30  # x, in reflected bit order
    while count:
        if count & 1:
            crc = product(crc, power)
        power = product(power, power)
        count >>= 1
    return crc


def _encode_blocks(path: str):
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, coder = TaskContext.get().partitionId(), encoder(path)
        alphabet = coder.tokenizer.get_vocab_size()
        held, held_ids, pieces = [], 0, []
        done, block, number = 0, 0, 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, held_ids, pieces, done, block
            ids = np.frombuffer(b"".join(held), "<u4")
            whole = len(ids) if last else len(ids) - len(ids) % BLOCK
            cuts = range(0, whole, BLOCK)
            codes = encode_blocks([ids[a : min(a + BLOCK, whole)] for a in cuts], alphabet)
            rows: list[list] = [[[] for _ in range(6)] for _ in cuts]
            for no, doc, start, n in pieces:
                # The block borders inside this document, counted from the first held id.
                at = max(start - done, 0)
                stop = min(start - done + n, whole)
                while at < stop:
                    upto = min(stop, (at // BLOCK + 1) * BLOCK)
                    row = rows[at // BLOCK]
                    for column, value in zip(row, (no, doc, start, n, at + done - start, upto - at), strict=True):
                        column.append(value)
                    at = upto
            pieces = [p for p in pieces if p[2] + p[3] > done + whole]
            held, held_ids, done = [ids[whole:].tobytes()], len(ids) - whole, done + whole
            for at in range(0, len(codes), ROWS):
                some = range(at, min(at + ROWS, len(codes)))
                lists = [pa.array([rows[i][k] for i in some], pa.list_(pa.int64())) for k in range(6)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * len(some), pa.int64()),
                        pa.array([block + i for i in some], pa.int64()),
                        pa.array([codes[i] for i in some], pa.binary()),
                        *lists,
                    ],
                    [f.split()[0] for f in BLOCKS.split(", ")],
                )
            block += len(codes)

        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = coder.encode(text.as_py()) + end
                n = len(ids) // 4
                pieces.append((number, doc, done + held_ids, n))
                held.append(ids)
                held_ids, number = held_ids + n, number + 1
                if held_ids >= BLOCK:
                    yield from flush(last=False)
        yield from flush(last=True)

    return run


def write_tokens(
    docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encode all texts, an end id after each, into token files below ``path``."""
    rows = long_rows(docs).select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    dealt.mapInArrow(_encode_blocks(tokenizer), BLOCKS).write.parquet(path)


def _decoded(with_ids: bool):
    names = ["doc_no", "doc_id", "doc_start", "doc_tokens", "piece_start", "piece"]

    def pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
        blocks = decode_blocks(batch["code"].to_pylist())
        lists = {n: batch[n].to_pylist() for n in names}
        rows = []
        for i, (part, ids) in enumerate(zip(batch["part"].to_pylist(), blocks, strict=True)):
            raw, at = memoryview(ids.tobytes()), 0
            for no, doc, start, total, first, n in zip(*(lists[x][i] for x in names), strict=True):
                piece = raw[4 * at : 4 * (at + n)]
                after = total - first - n
                crc = zlib.crc32(piece)
                row = (part, no, doc, start, first, n, _times_x(crc, 32 * after) if after else crc)
                rows.append((*row, np.frombuffer(piece, "<u4")) if with_ids else row)
                at += n
            if 4 * at != len(raw):
                raise ValueError("a token block does not fit its documents")
        columns = list(zip(*rows, strict=True)) or [[]] * (8 if with_ids else 7)
        arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
        if with_ids:
            arrays.append(pa.array(list(columns[7]), pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays(arrays, PIECE_NAMES[: len(arrays)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows):
                yield pieces(batch.slice(at, 1))

    return run


PIECE_NAMES = ["part", "doc_no", "doc_id", "doc_start", "piece_start", "n", "crc_term", "ids"]
_PIECES = ", ".join(f"{n} long" for n in PIECE_NAMES[:-1])


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, from the decoded ids: ``doc_id, start, n_tokens, ids_crc32``.

    Checksums of the pieces of a document are shifted by the ids that follow and summed
    modulo 2, which gives that of the whole without bringing its ids together."""
    files = spark.read.parquet(path)
    found = files.mapInArrow(_decoded(False), _PIECES)
    documents = found.groupBy("part", "doc_no").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("doc_start").alias("doc_start"),
        F.sum("n").alias("n_tokens"),
        F.bit_xor("crc_term").alias("ids_crc32"),
    )
    lengths = files.select("part", F.aggregate("piece", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        lengths.groupBy("part")
        .agg(F.sum("n").alias("n"))
        .select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    )
    return documents.join(F.broadcast(before), "part").select(  # a row per file
        "doc_id", (F.col("before") + F.col("doc_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Pieces of documents with their ids: ``part, doc_no, doc_id, piece_start, ids``;
    a document is its pieces by ``piece_start``, the table by ``(part, doc_no)``."""
    found = spark.read.parquet(path).mapInArrow(_decoded(True), _PIECES + ", ids array<long>")
    return found.select("part", "doc_no", "doc_id", "piece_start", "ids")
