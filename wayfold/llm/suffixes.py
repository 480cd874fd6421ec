"""Removal of long substrings that earlier documents hold, by interval expansion on Burrows-Wheeler transforms."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.common import cut, slices, texts_of, utf8
from wayfold.llm.keyblocks import LOW, MOST_BROADCAST_BYTES, buckets_for, level_of_each, routed, spread, squeeze, with_levels
from wayfold.llm.shingles import _BYTE, _powers, mix

#: Bytes of the grams that route windows to tasks.
GRAM = 20
#: Bytes of text in a block of documents, and of segments in one transform.
BLOCK_BYTES, BATCH_BYTES = 8 << 20, 3 << 19
#: Bytes of text for each key, about: with the bytes that are counted, this gives the number of buckets.
BYTES_A_KEY = 16
#: Documents (to a factor of two) from which on a key's windows go to all buckets one by one.
HOT_DOCUMENTS = 16_384
#: No byte of UTF-8.
SEPARATOR = 0xFF

BLOCKS = "block long, doc_ids binary, sizes binary, known binary, text binary, raw_bytes long"


def text_blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Documents in blocks: a row holds some megabytes of texts, compressed, with their ids and sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for number, batch in enumerate(slices(batches, "text", block_bytes)):
            raw, off = utf8(batch.column("text"))
            ids = batch.column("doc_id")
            row = [(part << 32) + number, ids.fill_null(0).to_numpy().tobytes(), np.diff(off).tobytes(), ids.is_valid().to_numpy(zero_copy_only=False).tobytes(), squeeze(raw), len(raw)]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, (pa.int64(), *[pa.binary()] * 4, pa.int64()))], names=[c.split()[0] for c in BLOCKS.split(", ")])

    return docs.mapInArrow(run, BLOCKS)


class Block:
    """The texts of a row of text_blocks. Copies inside a block are told apart: the least doc_id stands for them."""

    def __init__(self, row: dict):
        self.raw = spread(row["text"])
        self.ids, sizes = np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["sizes"], np.int64)
        self.known = np.frombuffer(row["known"], bool)
        self.sizes, self.off = sizes, np.concatenate([[0], np.cumsum(sizes)])
        self.stands = np.zeros(len(sizes), bool)
        best: dict[bytes, int] = {}
        for i in np.flatnonzero(self.known).tolist():
            key = hashlib.sha256(self.raw[self.off[i] : self.off[i + 1]]).digest()
            if key not in best or self.ids[i] < self.ids[best[key]]:
                best[key] = i
        self.stands[list(best.values())] = True
        #: The id that stands for each document.
        self.same = self.ids.copy()
        for i in np.flatnonzero(self.known & ~self.stands).tolist():
            self.same[i] = self.ids[best[hashlib.sha256(self.raw[self.off[i] : self.off[i + 1]]).digest()]]

    def segments(self, least: int) -> tuple[np.ndarray, ...]:
        """(key, doc, start, windows): runs of `least`-byte windows with one routing gram, of documents that stand.

        A window's routing gram is the one with the least hash (the first of equals) of all grams in it, so equal windows
        have equal grams at equal places and meet under the gram's key, wherever they stand.
        """
        out, many = [], least - GRAM + 1
        own = np.flatnonzero(self.stands & (self.sizes >= least))
        at = 0
        while at < len(own):
            end = max(at + 1, int(np.searchsorted(np.cumsum(self.sizes[own[at:]]), 1 << 20, "right")) + at)
            take = own[at:end]
            at = end
            sizes = self.sizes[take]
            first = np.cumsum(sizes) - sizes
            raw = np.concatenate([self.raw[self.off[i] : self.off[i + 1]] for i in take])
            up, down = _powers(len(raw))
            with np.errstate(over="ignore"):
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * up, dtype=np.uint64)])
                grams = mix((total[GRAM:] - total[:-GRAM]) * down[: len(raw) - GRAM + 1])
            del total
            low = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
            width = 1
            while 2 * width <= many:
                low = np.minimum(low[:-width], low[width:])
                width *= 2
            if width < many:
                low = np.minimum(low[: len(low) - (many - width)], low[many - width :])
            place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
            starts = np.repeat(first, sizes - least + 1) + np.arange(int((sizes - least + 1).sum())) - np.repeat(np.cumsum(sizes - least + 1) - (sizes - least + 1), sizes - least + 1)
            text = np.repeat(np.arange(len(take)), sizes - least + 1)
            gram = place[starts]
            new = np.ones(len(gram), bool)
            new[1:] = (gram[1:] != gram[:-1]) | (text[1:] != text[:-1])
            run = np.flatnonzero(new)
            out.append((mix(grams[gram[run]] ^ np.uint64(0x5BD1E995)), take[text[run]], starts[run] - first[text[run]], np.diff(np.append(run, len(gram)))))
        if not out:
            return np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3))
        return tuple(np.concatenate(x) for x in zip(*out))


SEGMENTS = "bucket int, block long, n_bytes long, keys binary, doc binary, ids binary, start binary, size binary, bytes binary"


def _keys_of(least: int):
    """The keys of a block's row, once for each document that has them."""

    def run(row: dict) -> np.ndarray:
        keys, doc, _, _ = Block(row).segments(least)
        order = np.lexsort((doc, keys))
        keys, doc = keys[order], doc[order]
        return keys[np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])]))] if len(keys) else keys

    return run


def _windows_of(block: Block, doc: np.ndarray, start: np.ndarray, windows: np.ndarray, least: int, buckets: int) -> tuple[np.ndarray, ...]:
    """(key, doc, start, size) of single windows, keyed by their own bytes: equal ones meet, in all buckets alike."""
    line = np.repeat(np.arange(len(doc)), windows)
    shift = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    doc, start = doc[line], start[line] + shift
    keys = np.empty(len(doc), np.uint64)
    for at in range(0, len(doc), 20_000):
        part = slice(at, at + 20_000)
        raw = block.raw[(block.off[doc[part]] + start[part])[:, None] + np.arange(least)]
        first = np.arange(len(raw)) * least
        keys[part] = routed(mix(segment_hashes(raw.ravel(), first, np.full(len(raw), least))), buckets)
    return keys, doc, start, np.full(len(doc), least, np.int64)


def _segment_rows(buckets: int, least: int, hot_level: int):
    """The segments of keys that several documents have, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                keys, doc, start, windows = block.segments(least)
                levels = level_of_each(row, keys, buckets)
                keys = routed(keys, buckets)
                keep = np.flatnonzero(levels)
                very = levels[keep] >= hot_level
                single = _windows_of(block, doc[keep[very]], start[keep[very]], windows[keep[very]], least, buckets)
                keep = keep[~very]
                keys, doc, start, size = (np.concatenate(x) for x in zip((keys[keep], doc[keep], start[keep], windows[keep] + least - 1), single))
                order = np.argsort(keys, kind="stable")
                keys, doc, start, size = keys[order], doc[order], start[order], size[order]
                bucket = (keys >> np.uint64(40)).astype(np.int64)
                edges = np.searchsorted(bucket, np.arange(buckets + 1))
                for b, (x, y) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
                    if y > x:
                        n = size[x:y]
                        at = np.repeat(block.off[doc[x:y]] + start[x:y] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                        cols = [b, row["block"], int(n.sum()), *map(squeeze, (keys[x:y] & LOW, doc[x:y].astype(np.int32), block.ids[doc[x:y]], start[x:y], n.astype(np.int32), block.raw[at]))]
                        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cols, (pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 6))], names=[c.split()[0] for c in SEGMENTS.split(", ")])

    return run


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of all suffixes by their first `depth` bytes at least: ranks of two or three stretches make one key."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : k + n]
    done, parts = 8, 3 if n < 1 << 21 else 2
    bits = np.uint64(64 // parts)
    while True:
        order = np.argsort(key)
        ranked = key[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(new).astype(np.uint64)
        if done >= depth or new.all():
            return order, rank
        key = rank.copy()
        for k in range(1, parts):
            key <<= bits
            key[: max(0, n - k * done)] |= rank[k * done :]
        done *= parts


def interval_classes(text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, class of each place in it): suffixes are of one class if they share their first `least` bytes.

    Breadth-first backward extension on the Burrows-Wheeler transform: the intervals of strings of l bytes are told by
    the boundaries between neighbours whose common prefix is at most l. To extend all of them by a byte to the left, each
    neighbouring pair of suffixes with one first byte looks at the interval that its rests (the occurrences of that byte in
    the transform) lie in: a boundary between the rests is a boundary, one byte longer, between the two. So common prefixes
    come by increasing value, every boundary is set once, and the walk stops at `least`.
    """
    n = len(text)
    order, _ = suffix_order(text, least)
    order = order.astype(np.int32)
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    # Where each suffix's rest stands: the place of the suffix's first byte in the transform.
    rest = place[np.where(order + 1 < n, order + 1, 0)]
    head = text[order]
    edge = np.ones(n, bool)
    edge[1:] = head[1:] != head[:-1]
    edge |= (order + 1 >= n) | np.concatenate([[False], order[:-1] + 1 >= n])
    open_ = np.flatnonzero(~edge)
    left, right = rest[open_ - 1].astype(np.intp), rest[open_].astype(np.intp)
    # Most rests are neighbours: one boundary lies between them. For the others boundaries are counted.
    next_ = right - left == 1
    pair, between = open_[next_], right[next_]
    wide, left, right = open_[~next_], left[~next_], right[~next_]
    for _ in range(least - 1):
        if not len(pair) and not len(wide):
            break
        apart = edge[between]
        if len(wide):
            interval = np.cumsum(edge, dtype=np.int32)
            split = interval[left] != interval[right]
            edge[wide[split]] = True
            if split.any():
                wide, left, right = wide[~split], left[~split], right[~split]
        edge[pair[apart]] = True
        if np.count_nonzero(apart) > len(apart) >> 3:
            pair, between = pair[~apart], between[~apart]
    return order, np.cumsum(edge) - 1


def least_holders(segments: np.ndarray, sizes: np.ndarray, holder: np.ndarray, least: int) -> np.ndarray:
    """For every window of `least` bytes of each segment, the least holder of the same bytes in any segment."""
    n = len(sizes)
    end = np.cumsum(sizes + 1)
    text = np.full(int(end[-1]), SEPARATOR, np.uint8)
    inside = np.ones(len(text), bool)
    inside[end - 1] = False
    text[inside] = segments
    order, kind = interval_classes(text, least)
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes + 1)
    at = np.arange(len(text), dtype=np.int32) - np.repeat((end - sizes - 1).astype(np.int32), sizes + 1)
    window = at <= (sizes - least)[owner]
    most = np.iinfo(np.int64).max
    value = np.where(window, holder[owner], most)[order]
    best = np.minimum.reduceat(value, np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]])))
    out = np.empty(len(text), np.int64)
    out[order] = best[kind]
    return out[window]


def segment_hashes(raw: np.ndarray, first: np.ndarray, size: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """A hash of each segment of raw, some megabytes at a time; segments lie one after another."""
    out, at = np.empty(len(first), np.uint64), 0
    while at < len(first):
        end = max(at + 1, int(np.searchsorted(first, first[at] + most)))
        part = raw[first[at] : first[end - 1] + size[end - 1]]
        up, down = _powers(len(part))
        begin = first[at:end] - first[at]
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[part] * up, dtype=np.uint64)])
            out[at:end] = mix((total[begin + size[at:end]] - total[begin]) * down[begin] + size[at:end].astype(np.uint64))
        at = end
    return out


def _repeats(least: int, batch_bytes: int):
    """For one bucket: (block, removed) runs of windows that stand in a document with a smaller id."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        parts = [[spread(r[c], k) for r in rows] for c, k in (("keys", np.uint64), ("doc", np.int32), ("ids", np.int64), ("start", np.int64), ("size", np.int32), ("bytes", np.uint8))]
        keys, doc, ids, start, size = (np.concatenate(p) for p in parts[:5])
        size = size.astype(np.int64)
        raw = np.concatenate(parts[5])
        source = np.repeat(np.arange(len(rows)), [len(p) for p in parts[0]])
        del parts
        first = np.cumsum(size) - size
        print_ = segment_hashes(raw, first, size)
        # Equal segments are one, with the least id of their documents.
        order = np.lexsort((ids, print_, keys))
        k, p, z = keys[order], print_[order], size[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (p[1:] != p[:-1]) | (z[1:] != z[:-1])])
        stand, same = order[new], np.cumsum(new) - 1
        # A segment whose key no other one has meets copies of itself alone: all its windows have the same least holder.
        _, group, times = np.unique(keys[stand], return_inverse=True, return_counts=True)
        alone = (times == 1)[group][same]
        later = alone & (ids[order] > ids[stand[same]])
        m = order[later]
        found = [np.stack([source[m], doc[m], start[m], start[m] + size[m]], 1)]
        order, new = order[~alone], new[~alone]
        stand, same = order[new], np.cumsum(new) - 1
        bound = np.flatnonzero(np.concatenate([[True], keys[stand][1:] != keys[stand][:-1]])) if len(stand) else stand
        cost = np.cumsum(size[stand] + 1)
        at = 0
        while at < len(stand):
            limit = int(np.searchsorted(cost, (cost[at - 1] if at else 0) + batch_bytes, "right"))
            i = int(np.searchsorted(bound, limit, "right")) - 1
            end = len(stand) if limit >= len(stand) else int(bound[i]) if bound[i] > at else int(bound[i + 1]) if i + 1 < len(bound) else len(stand)
            seg = stand[at:end]
            n = size[seg]
            place = np.repeat(first[seg] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            holder = least_holders(raw[place], n, ids[seg], least)
            windows = n - least + 1
            base = np.cumsum(windows) - windows
            # All members of these classes, each window of theirs against the least holder.
            low, high = np.searchsorted(same, [at, end])
            member, own = order[low:high], same[low:high] - at
            lowest = np.minimum.reduceat(holder, base)
            hit = lowest[own] < ids[member]
            member, own = member[hit], own[hit]
            for part in range(0, len(member), 100_000):
                m, o = member[part : part + 100_000], own[part : part + 100_000]
                w = windows[o]
                line = np.repeat(np.arange(len(m)), w)
                shift = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
                gone = holder[base[o][line] + shift] < ids[m][line]
                line, shift = line[gone], shift[gone]
                if len(line):
                    begin = np.concatenate([[True], (line[1:] != line[:-1]) | (shift[1:] != shift[:-1] + 1)])
                    b = np.flatnonzero(begin)
                    e = np.append(b[1:], len(line)) - 1
                    mm = m[line[b]]
                    found.append(np.stack([source[mm], doc[mm], start[mm] + shift[b], start[mm] + shift[e] + least], 1))
            at = end
        out = np.concatenate(found)
        out = out[np.argsort(out[:, 0], kind="stable")]
        edges = np.searchsorted(out[:, 0], np.arange(len(rows) + 1))
        given = [(r["block"], squeeze(np.ascontiguousarray(out[a:b, 1:]))) for r, a, b in zip(rows, edges[:-1].tolist(), edges[1:].tolist()) if b > a]
        return pa.table({"block": pa.array([g[0] for g in given], pa.int64()), "removed": pa.array([g[1] for g in given], pa.binary())})

    return run


def _cover(block: Block, removed: list[bytes], least: int) -> np.ndarray:
    """Which bytes of the block's texts go."""
    change = np.zeros(len(block.raw) + 1, np.int32)
    for part in removed:
        doc, start, end = spread(part, np.int64).reshape(-1, 3).T
        np.add.at(change, block.off[doc] + start, 1)
        np.add.at(change, block.off[doc] + end, -1)
    gone = np.cumsum(change[:-1]) > 0
    for i in np.flatnonzero(block.known & ~block.stands & (block.sizes >= least) & (block.same < block.ids)).tolist():
        gone[block.off[i] : block.off[i + 1]] = True
    # A row that repeats its own id and text shares what was found for the one that stands.
    twins = np.flatnonzero(block.known & ~block.stands & (block.same == block.ids))
    if len(twins):
        where = {int(block.ids[i]): [] for i in twins}
        for i in np.flatnonzero(block.stands).tolist():
            if int(block.ids[i]) in where:
                where[int(block.ids[i])].append(i)
        for i in twins.tolist():
            text = block.raw[block.off[i] : block.off[i + 1]]
            for j in where[int(block.ids[i])]:
                if np.array_equal(text, block.raw[block.off[j] : block.off[j + 1]]):
                    gone[block.off[i] : block.off[i + 1]] = gone[block.off[j] : block.off[j + 1]]
    return gone


def _results(least: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                gone = _cover(block, row["removed"] or [], least)
                rows = []
                for i in range(len(block.sizes)):
                    a, b = block.off[i], block.off[i + 1]
                    off = gone[a:b]
                    n = int(off.sum())
                    kept = block.raw[a:b][~off].tobytes() if n else block.raw[a:b].tobytes()
                    spans = int(off[0]) + int((off[1:] & ~off[:-1]).sum()) if n else 0
                    rows.append((int(block.ids[i]) if block.known[i] else None, int(b - a), n, spans, hashlib.sha256(kept).hexdigest(), *([kept] if with_text else [])))
                kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_text
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


def remove_repeats(docs: DataFrame, *, least: int = 50, with_text: bool = False, buckets: int | None = None, block_bytes: int = BLOCK_BYTES, batch_bytes: int = BATCH_BYTES, most_broadcast_bytes: int = MOST_BROADCAST_BYTES, hot_documents: int = HOT_DOCUMENTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]): documents without what earlier ones hold.

    Every byte goes that a `least`-byte string covers which also starts in a document with a smaller doc_id. Texts are
    UTF-8 bytes, judged as they came in; strings never cross documents.

    1. Documents are put in blocks. A window's routing gram (see Block.segments) gives its key; blocks send their
       distinct keys by bucket, and get back which of them several documents have.
    2. Segments of such keys go to their buckets: some 65 bytes for 16 windows, and for repeated text alone.
    3. A bucket keeps each distinct segment once with the least id that has it. Where a key has several, it finds classes of
       equal windows by interval expansion on the Burrows-Wheeler transform of a batch of segments (`interval_classes`).
    4. Windows with a smaller holder go back to their blocks as runs, and are cut out there.

    Keys are 40 bits and the bucket: equal ones only let more segments meet. A passage of a third of all documents is one
    key a block in step 1; from `hot_documents` on its windows are dealt to all buckets by their own hash, so that no bucket
    has all the texts that such a passage stands in.

    Null texts are empty. Rows with a null id lose nothing and make nobody else lose anything. Rows of one id are not
    earlier than each other. Copies lose all (if they have `least` bytes). An empty table gives no rows; other columns are
    ignored.
    """
    if least < GRAM:
        raise ValueError(f"least is {GRAM} bytes or more")
    spark = docs.sparkSession
    blocks = cut(text_blocks(texts_of(docs), block_bytes), "blocks", codec="none")
    size = blocks.agg(F.sum("raw_bytes")).first()[0] or 0
    n = buckets or buckets_for(spark, size // BYTES_A_KEY)
    flagged = with_levels(blocks, _keys_of(least), n, most_broadcast_bytes=most_broadcast_bytes)
    segments = flagged.mapInArrow(_segment_rows(n, least, max(1, int(hot_documents).bit_length() - 1)), SEGMENTS)
    removed = cut(segments.groupBy("bucket").applyInArrow(_repeats(least, batch_bytes), "block long, removed binary"), "removed")
    per_block = removed.groupBy("block").agg(F.collect_list("removed").alias("removed"))
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return blocks.join(per_block.hint("shuffle_hash"), "block", "left").mapInArrow(_results(least, with_text), out)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
