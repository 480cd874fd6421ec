"""How many sets hold a key, asked for by blocks: five bytes for each key of a block are shuffled, hot keys once a block."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.common import cut, parallelism

#: Keys that one bucket, so one task's group, is to hold on average.
BUCKET_KEYS = 2 << 20
#: Size up to which levels are broadcast; beyond it they are joined by a shuffle.
MOST_BROADCAST_BYTES = 32 << 20
LOW = np.uint64((1 << 40) - 1)


def squeeze(data: bytes | np.ndarray) -> bytes:
    data = data.tobytes() if isinstance(data, np.ndarray) else data
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True) if data else (0).to_bytes(8, "little")


def spread(data: bytes, kind=np.uint8) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], n, "zstd"), kind) if n else np.empty(0, kind)


def buckets_for(spark: SparkSession, n_keys: int) -> int:
    """Buckets that follow the counted keys, so that none outgrows a task."""
    return max(128, parallelism(spark), math.ceil(n_keys / BUCKET_KEYS))


def routed(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket above 40 bits of the key: the order in which keys and their levels travel."""
    return ((keys >> np.uint64(40)) % np.uint64(buckets)) << np.uint64(40) | (keys & LOW)


def _emit(buckets: int, keys_of: Callable[[dict], np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, times = np.unique(routed(keys_of(row), buckets), return_counts=True)
                level = np.log2(times).astype(np.uint8)
                edges = np.searchsorted(keys >> np.uint64(40), np.arange(buckets + 1, dtype=np.uint64))
                five = np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, :5])
                rows = [(row["block"], b, five[x:y].tobytes(), level[x:y].tobytes()) for b, (x, y) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())) if y > x]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["block", "bucket", "keys", "level"])

    return run


def _sum(table: pa.Table) -> pa.Table:
    """One bucket: the level of each block's keys over all blocks."""
    parts = table.column("keys").to_pylist()
    sizes = [len(p) // 5 for p in parts]
    wide = np.zeros((sum(sizes), 8), np.uint8)
    wide[:, :5] = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 5)
    keys = wide.view(np.uint64).ravel()
    count = np.int64(1) << np.frombuffer(b"".join(table.column("level").to_pylist()), np.uint8).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    new = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
    level = np.empty(len(keys), np.uint8)
    level[order] = np.log2(np.add.reduceat(count[order], np.flatnonzero(new))).astype(np.uint8)[np.cumsum(new) - 1]
    edges = np.concatenate([[0], np.cumsum(sizes)])
    out = [squeeze(level[a:b]) for a, b in zip(edges[:-1], edges[1:])]
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "level": pa.array(out, pa.binary())})


def with_levels(blocks: DataFrame, keys_of: Callable[[dict], np.ndarray], buckets: int, *, most_broadcast_bytes: int = MOST_BROADCAST_BYTES) -> DataFrame:
    """blocks (block long, ...) with levels: for `levels_of`, a level of 0 is a key of one set, one of 1 or more of several.

    keys_of gives the keys of a row of blocks, each as often as sets of the block hold it. The level is the logarithm of
    the number of sets; each block's share is rounded down to a power of two, so it is right to a factor of two, and 0
    exactly for keys that one set has. It depends on the key alone, never on the block that asks.
    """
    keys = blocks.mapInArrow(_emit(buckets, keys_of), "block long, bucket int, keys binary, level binary")
    found = cut(keys.groupBy("bucket").applyInArrow(_sum, "block long, bucket int, level binary"), "levels")
    by_block = found.groupBy("block").agg(F.collect_list(F.struct("bucket", "level")).alias("levels"))
    small = (found.agg(F.sum(F.octet_length("level") + 24)).first()[0] or 0) <= most_broadcast_bytes
    return blocks.join(F.broadcast(by_block) if small else by_block.hint("shuffle_hash"), "block")


def levels_of(row: dict) -> np.ndarray:
    """The levels of a row's distinct keys, in the order of their `routed` values."""
    return np.concatenate([spread(m["level"]) for m in sorted(row["levels"], key=lambda m: m["bucket"])] or [np.empty(0, np.uint8)])


def level_of_each(row: dict, keys: np.ndarray, buckets: int) -> np.ndarray:
    """The level of each of a row's keys, as they come."""
    uniq, place = np.unique(routed(keys, buckets), return_inverse=True)
    levels = levels_of(row)
    if len(levels) != len(uniq):
        raise RuntimeError("levels of another block")
    return levels[place] if len(uniq) else np.empty(0, np.uint8)
