"""Packing of documents into fixed-length sequences along a Hilbert curve through hashed document vectors."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.common import cut, parallelism, slices, texts_of, utf8
from wayfold.llm.wordpieces import cache, tokenizer_path

DIMS, BITS = 4, 15
#: Tokens of a range partition, about, so that tasks stay as large as they are on larger inputs.
PART_TOKENS = 32 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def projection(vocab: int, dims: int = DIMS) -> np.ndarray:
    """A hash of every token id to one sign for each dimension: a random projection that is never stored."""
    x = np.arange(vocab, dtype=np.uint64)[:, None] * np.uint64(dims) + np.arange(dims, dtype=np.uint64)[None, :]
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
    return np.where(x >> np.uint64(63), 1.0, -1.0).astype(np.float32)


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position of each row of integer cells (n, dims) on the Hilbert curve of that many dimensions.

    Gray-code walk from the highest bit: at each level the cell's orthant is read in the present orientation, then the
    orientation of the orthant is undone in place (reflection or exchange with the first axis).
    """
    x = cells.astype(np.int64).copy()
    n, dims = x.shape
    for level in range(bits - 1, 0, -1):
        high, low = 1 << level, (1 << level) - 1
        for axis in range(dims):
            flip = (x[:, axis] & high) != 0
            swap = np.where(flip, 0, (x[:, 0] ^ x[:, axis]) & low)
            x[:, 0] ^= np.where(flip, low, swap)
            x[:, axis] ^= swap
    for axis in range(1, dims):
        x[:, axis] ^= x[:, axis - 1]
    turn = np.zeros(n, np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[:, -1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn[:, None]
    key = np.zeros(n, np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in range(dims):
            key = (key << 1) | ((x[:, axis] >> level) & 1)
    return key


def curve_position(ids: list[bytes], signs: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents given as 16-bit ids; the mean direction of the hashed tokens, scaled by a fixed range."""
    sizes = np.array([len(x) // 2 for x in ids], np.int64)
    sums = np.zeros((len(ids), signs.shape[1]))
    full = sizes > 0
    if full.any():
        flat = np.frombuffer(b"".join(ids), np.uint16)
        sums[full] = np.add.reduceat(signs[flat], (np.cumsum(sizes) - sizes)[full], axis=0, dtype=np.float32)
    unit = sums / np.maximum(sizes, 1)[:, None]
    cells = np.clip((unit + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1)
    return hilbert_key(cells)


def encode_for_packing(docs: DataFrame, *, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """(doc_id, key, n, ids): ids as 16-bit little-endian binary with the end id, key its place on the curve."""
    name = tokenizer or tokenizer_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = cache(name)
        signs = projection(pieces.tokenizer.get_vocab_size())
        end = np.array([end_id], "<u2").tobytes()
        for batch in slices(batches, "text", 1 << 19):
            raw, off = utf8(batch.column("text"))
            data = raw.tobytes()
            ids = pieces.encode([data[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist())])
            keys = curve_position(ids, signs)
            ids = [x + end for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "key", "n", "ids"])

    return texts_of(docs).mapInArrow(encode, "doc_id long, key long, n long, ids binary")


def pack(docs: DataFrame, *, tokenizer: str | None = None, end_id: int = 1, length: int = 2048, partitions: int | None = None) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids) of sequences of `length` tokens.

    Documents are range-sorted by Hilbert key, so each partition holds a stretch of the curve; its documents are laid
    end to end and cut every `length` tokens. Only the last sequence of a partition can be short: at most one padded
    sequence for each partition, whatever the input. sequence_id is (partition << 32) + number in it. Nothing is
    gathered: a partition is read once, in order.

    A null or empty text is the end id alone. Ties on the curve follow doc_id, then ids. Repeated rows are packed
    each. An empty table gives no pieces. Other columns are ignored.
    """
    spark = docs.sparkSession
    encoded = cut(encode_for_packing(docs, tokenizer=tokenizer, end_id=end_id), "packing")

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        at = 0
        for batch in batches:
            for cut_at in range(0, batch.num_rows, 500):
                rows = []
                few = batch.slice(cut_at, 500)
                for doc, n, ids in zip(few.column("doc_id").to_pylist(), few.column("n").to_pylist(), few.column("ids").to_pylist()):
                    start = 0
                    while start < n:
                        take = min(n - start, length - at % length)
                        part = ids[2 * start : 2 * (start + take)]
                        crc = zlib.crc32(np.frombuffer(part, "<u2").astype("<u4").tobytes())
                        rows.append((doc, start, take, crc, n, base + at // length, at % length, part))
                        start += take
                        at += take
                cols = list(zip(*rows)) if rows else [[]] * 8
                kinds = [pa.int64()] * 7 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in PIECES.split(", ")])

    if partitions is None:  # a short last sequence each: partitions of 128 sequences at least keep padding under one per cent
        total = encoded.agg(F.sum("n")).first()[0] or 0
        partitions = max(1, min(parallelism(spark), total // (128 * length)), -(-total // PART_TOKENS))
    ordered = encoded.repartitionByRange(partitions, "key", "doc_id").sortWithinPartitions("key", "doc_id", "ids")
    return ordered.mapInArrow(lay, PIECES)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return pieces.drop("ids")


def group_by_sequence(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, n_pieces): the filling of every sequence."""
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.count("*").alias("n_pieces"))
