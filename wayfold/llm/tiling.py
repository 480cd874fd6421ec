"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.common import slices, texts_of, utf8
from wayfold.llm.shingles import alnum_hashes, shingle_hashes

#: Words of all benchmark items up to which they are broadcast (some 100 MB); beyond it, seeds are joined by a shuffle.
MOST_BROADCAST_WORDS = 4_000_000
LEAKS = "doc_id long, item_id long, n_tiles long, covered long, item_words long"

_BASE = 0x9DDFEA08EB382D69
_INVERSE = pow(_BASE, -1, 1 << 64)


def _windows(words: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of that width, rolled over prefix sums modulo 2^64."""
    if len(words) < width:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        up = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(words), _BASE, np.uint64), dtype=np.uint64)])
        down = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(words), _INVERSE, np.uint64), dtype=np.uint64)])
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[:-1], dtype=np.uint64)])
        return (total[width:] - total[:-width]) * down[: len(words) - width + 1]


def _free(marked: np.ndarray, width: int) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(marked)])
    return run[width:] == run[:-width] if len(marked) >= width else np.empty(0, bool)


def greedy_tiles(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(length, place in item, place in doc) of non-overlapping common runs of `least` words or more, longest first.

    Running Karp-Rabin: windows of the search length s of unmarked words are matched by rolling hashes, compared word by
    word and extended as far as they go; the search length jumps up where a longer match turns up, and is halved down
    to `least` as tiles are marked. A shorter item is one run.
    """
    least = min(least, len(item))
    mark_i, mark_d = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    tiles: list[tuple[int, int, int]] = []
    s = max(least, min(len(item), 32))
    while True:
        hi, hd = _windows(item, s), _windows(doc, s)
        fi, fd = np.flatnonzero(_free(mark_i, s)), np.flatnonzero(_free(mark_d, s))
        found: dict[tuple[int, int], int] = {}
        if len(fi) and len(fd):
            fi = fi[np.argsort(hi[fi], kind="stable")]
            own = hi[fi]
            left, right = np.searchsorted(own, hd[fd], "left"), np.searchsorted(own, hd[fd], "right")
            for d, a, b in zip(fd[right > left].tolist(), left[right > left].tolist(), right[right > left].tolist()):
                for i in fi[a:b].tolist():
                    # A match that goes on to the left was found there.
                    if i and d and item[i - 1] == doc[d - 1] and not mark_i[i - 1] and not mark_d[d - 1]:
                        continue
                    n = min(len(item) - i, len(doc) - d)
                    stop = (item[i : i + n] != doc[d : d + n]) | mark_i[i : i + n] | mark_d[d : d + n]
                    n = int(stop.argmax()) if stop.any() else n
                    if n >= s:
                        found[i, d] = n
        longest = max(found.values(), default=0)
        if longest > 2 * s:
            s = longest
            continue
        marked = False
        for n, i, d in sorted(((n, i, d) for (i, d), n in found.items()), key=lambda x: (-x[0], x[1], x[2])):
            if not mark_i[i : i + n].any() and not mark_d[d : d + n].any():
                mark_i[i : i + n] = mark_d[d : d + n] = True
                tiles.append((n, i, d))
                marked = True
        if s == least and not marked:
            return tiles
        if s > least and not marked:
            s = max(least, s // 2)


def item_words(benchmark: DataFrame, least: int) -> DataFrame:
    """(item_id, words binary, seeds array<long>) of the items that have words; seeds of a shorter item have its own length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            words, counts = alnum_hashes(*utf8(batch.column("text")))
            end = np.cumsum(counts)
            rows = [words[e - c : e] for e, c in zip(end, counts)]
            seeds = [np.unique(shingle_hashes(w, np.array([len(w)]), max(1, min(least, len(w))))[0]).view(np.int64) for w in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([w.tobytes() for w in rows], pa.binary()), pa.array(seeds, pa.list_(pa.int64()))], names=["item_id", "words", "seeds"])

    return benchmark.mapInArrow(run, "item_id long, words binary, seeds array<long>").where(F.size("seeds") > 0)


def _leaks_by_broadcast(docs: DataFrame, items: DataFrame, least: int) -> DataFrame:
    got = items.toArrow()
    ids = got.column("item_id").to_pylist()
    words = [np.frombuffer(w, np.uint64) for w in got.column("words").to_pylist()]
    seeds = [np.array(s, np.int64).view(np.uint64) for s in got.column("seeds").to_pylist()]
    by_width = []
    for width in sorted({min(least, len(w)) for w in words}):
        own = [i for i, w in enumerate(words) if min(least, len(w)) == width]
        flat, owner = np.concatenate([seeds[i] for i in own]), np.repeat(own, [len(seeds[i]) for i in own])
        order = np.argsort(flat, kind="stable")
        by_width.append((width, flat[order], owner[order]))
    held = docs.sparkSession.sparkContext.broadcast((ids, words, by_width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, items, by_width = held.value
        for batch in slices(batches, "text", 2 << 20):
            words, counts = alnum_hashes(*utf8(batch.column("text")))
            end, doc_ids, rows = np.cumsum(counts), batch.column("doc_id").to_pylist(), []
            for width, flat, owner in by_width:
                shingles, runs = shingle_hashes(words, counts, width)
                if not len(shingles):
                    continue
                left = np.searchsorted(flat, shingles, "left")
                hit = np.flatnonzero(flat[np.minimum(left, len(flat) - 1)] == shingles)
                right = np.searchsorted(flat, shingles[hit], "right")
                text = np.repeat(np.arange(len(runs)), runs)[hit]
                n = right - left[hit]
                pair = np.unique(np.stack([np.repeat(text, n), owner[np.repeat(left[hit], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]], 1), axis=0)
                for t, i in pair.tolist():
                    tiles = greedy_tiles(items[i], words[end[t] - counts[t] : end[t]], least)
                    rows.append((doc_ids[t], ids[i], len(tiles), sum(x[0] for x in tiles), len(items[i])))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "n_tiles", "covered", "item_words"])

    return docs.mapInArrow(run, LEAKS)


def _leaks_by_join(docs: DataFrame, items: DataFrame, least: int) -> DataFrame:
    """The same by shuffles: seeds meet on their hash, pairs are made distinct, and each pair is tiled on its own."""

    widths = sorted(r[0] for r in items.select(F.least(F.octet_length("words") / 8, F.lit(least)).cast("int")).distinct().collect())

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            words, counts = alnum_hashes(*utf8(batch.column("text")))
            end = np.cumsum(counts)
            own = [words[e - c : e] for e, c in zip(end.tolist(), counts.tolist())]
            got = [np.unique(np.concatenate([shingle_hashes(w, np.array([len(w)]), k)[0] for k in widths] or [w[:0]])).view(np.int64) for w in own]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([w.tobytes() for w in own], pa.binary()), pa.array(got, pa.list_(pa.int64()))], names=["doc_id", "words", "seeds"])

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, i, doc, item in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "item_id", "words", "item"))):
                doc, item = np.frombuffer(doc, np.uint64), np.frombuffer(item, np.uint64)
                tiles = greedy_tiles(item, doc, least)
                rows.append((d, i, len(tiles), sum(x[0] for x in tiles), len(item)))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "n_tiles", "covered", "item_words"])

    rows = docs.mapInArrow(seeds, "doc_id long, words binary, seeds array<long>").withColumn("row", F.struct(F.xxhash64("doc_id", "words").alias("a"), F.xxhash64(F.lit(1), "doc_id", "words").alias("b")))
    by_seed = items.select("item_id", F.explode("seeds").alias("seed"))
    pairs = rows.select("row", F.explode("seeds").alias("seed")).join(by_seed, "seed").select("row", "item_id").distinct()
    both = rows.select("row", "doc_id", "words").join(pairs, "row").join(items.select("item_id", F.col("words").alias("item")), "item_id")
    return both.select("doc_id", "item_id", "words", "item").mapInArrow(tile, LEAKS)


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, *, least_words: int = 5, coverage: float = 0.5, most_broadcast_words: int = MOST_BROADCAST_WORDS) -> DataFrame:
    """(doc_id, item_id, n_tiles, covered, item_words, coverage): documents that hold a benchmark item.

    Words are runs of ASCII letters and digits and of any non-ASCII characters, A-Z in lower case. Documents and items
    that share a run of `least_words` words are tiled: the longest common runs that are still free are marked again and
    again, so passages that were put in another order still count, and no word counts twice. A document leaks an item if
    tiles cover `coverage` of its words. An item of fewer than `least_words` words leaks where the whole of it stands in a
    document; so an item of one common word leaks nearly everywhere, and such items are to be left out before.

    Benchmarks of up to `most_broadcast_words` words are broadcast; larger ones are joined by a shuffle, with the same
    result. Null texts count as empty; rows with null ids are compared too; repeated rows give repeated rows; empty
    tables give none; other columns are ignored.
    """
    own = texts_of(docs)
    items = item_words(texts_of(benchmark, id_col="item_id"), least_words)
    total = items.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    found = _leaks_by_broadcast(own, items, least_words) if total <= 8 * most_broadcast_words else _leaks_by_join(own, items, least_words)
    return found.where(F.col("covered") >= coverage * F.col("item_words")).withColumn("coverage", F.col("covered") / F.col("item_words"))


def op3_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
