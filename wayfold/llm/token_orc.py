"""Token ids as ORC files: runs of integers, row indexes, Bloom filters on document ids."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.llm.common import parallelism, shared_dir, slices, texts_of, utf8
from wayfold.llm.wordpieces import cache, tokenizer_path

FILE_SCHEMA = "part int, row long, doc_id long, n_tokens long, ids array<int>"


def write_token_orc(
    docs: DataFrame,
    path: str,
    *,
    tokenizer: str | None = None,
    end_id: int = 2,
    stripe_bytes: int = 16 << 20,
    index_stride: int = 1000,
    false_positives: float = 0.01,
    partitions: int | None = None,
) -> None:
    """Write (part, row, doc_id, n_tokens, ids) in ascending doc_id order over part and row.

    Range-partitioned by doc_id, so every file and stripe covers a range of ids that its statistics tell. Integer
    lists are stored by ORC's run-length encodings; `index_stride` rows make one entry of the row index, and a Bloom
    filter on doc_id per entry lets a reader skip it. Only texts move in the shuffle; ids never do.

    A null text is empty and gives the end id alone. A null doc_id sorts first. Rows with one doc_id keep their own rows,
    ordered by text. An empty table writes a valid empty file set. Other columns are ignored.
    """
    spark = docs.sparkSession
    name = tokenizer or tokenizer_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        pieces, row = cache(name), 0
        for batch in slices(batches, "text", 4 << 20):
            raw, off = utf8(batch.column("text"))
            data = raw.tobytes()
            ids = pieces.encode([data[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist())])
            end = np.array([end_id], np.uint16).tobytes()
            sizes = np.array([len(x) // 2 + 1 for x in ids], np.int64)
            flat = np.frombuffer(b"".join(y for x in ids for y in (x, end)), np.uint16).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
            rows = pa.array(np.arange(row, row + len(ids)))
            row += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int32)), rows, batch.column("doc_id"), pa.array(sizes), lists], names=["part", "row", "doc_id", "n_tokens", "ids"])

    ordered = texts_of(docs).repartitionByRange(partitions or parallelism(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    (
        ordered.mapInArrow(encode, FILE_SCHEMA)
        .write.option("compression", "zstd")
        .option("orc.stripe.size", str(stripe_bytes))
        .option("orc.row.index.stride", str(index_stride))
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", str(false_positives))
        .orc(path)
    )


def read_token_orc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).orc(path)


def describe_token_orc(stored: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of stored documents, from the files alone.

    start counts the ids of all documents before: running sums inside each part, plus the parts' totals before it. There
    are as many totals as files, not as documents.
    """

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            off = np.asarray(ids.offsets)
            flat = np.asarray(ids.values).astype("<u4")
            view = memoryview(flat).cast("B")
            sums = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "row", "doc_id", "n_tokens")), pa.array(sums, pa.int64())], names=["part", "row", "doc_id", "n_tokens", "ids_crc32"])

    sums = stored.mapInArrow(crc, "part int, row long, doc_id long, n_tokens long, ids_crc32 long")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        sums.withColumn("ahead", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(parts, "part")
        .select("doc_id", (F.col("base") + F.col("ahead")).alias("start"), "n_tokens", "ids_crc32")
    )


def op5_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/wayfold-orc-{uuid.uuid4().hex}"
    write_token_orc(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return describe_token_orc(read_token_orc(spark, path))
