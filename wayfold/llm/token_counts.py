"""Token counts of documents without token ids: each distinct pre-token is counted once and joined back."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.common import cut, parallelism, slices, texts_of, utf8
from wayfold.llm.wordpieces import cache, tokenizer_path, words_of

BLOCKS = "kind int, block long, bucket int, payload binary, doc_ids binary, n_bytes binary, slots binary, times binary, offsets binary"
_VOCAB, _DOCS = 0, 1


def _pack(values: np.ndarray) -> bytes:
    """Compressed bytes of an integer array, low bytes together first."""
    wide = np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T)
    return zlib.compress(wide.tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    wide = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(wide.T).view("<i8").ravel()


def _blocks(name: str, buckets: int, most: int):
    """Dictionary-encode blocks of documents: vocabulary rows by bucket of the pre-token, and one row of frequencies."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        schema = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("bucket", pa.int32())] + [(n, pa.binary()) for n in ("payload", "doc_ids", "n_bytes", "slots", "times", "offsets")])
        pieces = cache(name)
        slot_of: dict[bytes, int] = {}
        slots_of: dict[bytes, list[int]] = {}
        kept: list[tuple[np.ndarray, list, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, size
            block = (part << 24) + number
            by_bucket: dict[int, list[bytes]] = {}
            place = np.empty(len(slot_of), np.int64)
            bucket_of = [zlib.crc32(w) % buckets for w in slot_of]
            for w, b in zip(slot_of, bucket_of):
                by_bucket.setdefault(b, []).append(w)
            # A slot is the pre-token's place when the block's buckets are laid one after another.
            place[np.argsort(np.array(bucket_of, np.int64), kind="stable")] = np.arange(len(slot_of))
            rows = [(_VOCAB, block, b, zlib.compress(b"\n".join(by_bucket[b]), 1), None, None, None, None, None) for b in sorted(by_bucket)]
            doc_ids = [d for x in kept for d in x[1]]
            ids = np.array([-(1 << 63) if d is None else d for d in doc_ids], np.int64)
            words = np.concatenate([x[3] for x in kept])
            doc = np.repeat(np.arange(len(words)), words)
            pair = np.sort(doc << 32 | place[np.concatenate([x[2] for x in kept])])
            new = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.empty(0, np.int64)
            times, pair = np.diff(np.append(new, len(pair))), pair[new]
            distinct, slots = np.bincount(pair >> 32, minlength=len(words)), pair & 0xFFFFFFFF
            # Each document's slots in ascending order, as steps.
            steps = np.diff(slots, prepend=0)
            first = (np.cumsum(distinct) - distinct)[distinct > 0]
            steps[first] = slots[first]
            sizes = np.concatenate([x[0] for x in kept])
            rows.append((_DOCS, block, -1, None, ids.tobytes(), *map(_pack, (sizes, steps, times, distinct))))
            slot_of.clear()
            slots_of.clear()
            kept.clear()
            number, size = number + 1, 0
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in slices(batches, "text", 2 << 20):
            raw, off = utf8(batch.column("text"))
            data = raw.tobytes()
            slots, sizes = [], []
            for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
                words = words_of(data[a:b])
                for w in words:
                    if w not in slots_of:
                        slots_of[w] = [slot_of.setdefault(p, len(slot_of)) for p in pieces.pre_tokens(w)]
                own = list(chain.from_iterable(map(slots_of.__getitem__, words)))
                slots += own
                sizes.append(len(own))
            kept.append((np.diff(off), batch.column("doc_id").to_pylist(), np.array(slots, np.int64), np.array(sizes, np.int64)))
            size += len(data)
            if size >= most:
                yield from flush()
        if kept:
            yield from flush()

    return encode


def token_counts(docs: DataFrame, *, tokenizer: str | None = None, limit: int = 2048, block_bytes: int = 24 << 20, buckets: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document; ids are never kept.

    Pre-tokens are those of the tokenizer (a word that may hold a special string stands whole). Documents are
    dictionary-encoded in blocks of about `block_bytes`: a block's distinct pre-tokens leave by bucket, every bucket
    counts the pieces of each pre-token once, and the counts come back to the block, where they are joined to the
    documents' pre-token occurrences and summed. A pre-token that all documents hold is one entry a block, so there are
    no hot keys; a block is bounded by its bytes, and a bucket is read as a stream.

    A null or empty text has no tokens. Repeated rows keep their own rows, null ids stay null, an empty table gives no
    rows, and other columns are ignored.
    """
    spark = docs.sparkSession
    name = tokenizer or tokenizer_path()
    blocks = cut(texts_of(docs).mapInArrow(_blocks(name, buckets or max(64, parallelism(spark)), block_bytes), BLOCKS), "blocks", codec="none")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = cache(name)
        known: dict[bytes, int] = {}
        for batch in batches:
            for block, bucket, payload in zip(*(batch.column(c).to_pylist() for c in ("block", "bucket", "payload"))):
                words = zlib.decompress(payload).split(b"\n")
                if len(known) > 2_000_000:
                    known.clear()
                for w in words:
                    if w not in known:
                        known[w] = pieces.count(w)
                counts = _pack(np.array([known[w] for w in words], np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), pa.array([counts], pa.binary())], names=["block", "bucket", "counts"])

    vocab = blocks.where(F.col("kind") == _VOCAB).select("block", "bucket", "payload")
    counted = vocab.repartition(parallelism(spark), "bucket").mapInArrow(count, "block long, bucket int, counts binary")

    def total(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("bucket")
        pieces = np.concatenate([np.empty(0, np.int64), *map(_unpack, right["counts"])])
        out = []
        for ids, sizes, steps, times, distinct in zip(left["doc_ids"], left["n_bytes"], left["slots"], left["times"], left["offsets"]):
            steps, distinct = _unpack(steps), _unpack(distinct)
            end = np.cumsum(distinct)
            way = np.concatenate([[0], np.cumsum(steps)])
            slots = way[1:] - np.repeat(way[end - distinct], distinct)
            run = np.concatenate([[0], np.cumsum(pieces[slots] * _unpack(times))]).astype(np.int64)
            doc = pd.Series(np.frombuffer(ids, np.int64)).astype("Int64").replace(-(1 << 63), pd.NA)
            out.append(pd.DataFrame({"doc_id": doc, "n_bytes": _unpack(sizes), "n_tokens": run[end] - run[end - distinct]}))
        return pd.concat(out)

    kept = blocks.where(F.col("kind") == _DOCS).select("block", "doc_ids", "n_bytes", "slots", "times", "offsets")
    sums = kept.groupBy("block").cogroup(counted.groupBy("block")).applyInPandas(total, "doc_id long, n_bytes long, n_tokens long")
    return sums.withColumn("over_limit", F.col("n_tokens") > limit)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
