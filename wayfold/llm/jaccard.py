"""Similarity join of documents on word shingles: rare shared shingles route documents, signature trees join them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.common import components, cut, meet, parallelism, slices, texts_of, utf8
from wayfold.llm.keyblocks import buckets_for, level_of_each, spread, squeeze, with_levels
from wayfold.llm.shingles import distinct_in_text, mix, shingle_hashes, word_hashes

#: Sets, and bytes of sets, of a group that meet in one task at most; larger groups are dealt in tiles.
TILE, TILE_BYTES = 1000, 32 << 20
#: Words of 64 bits of a signature, children of a tree node.
SIGNATURE, FANOUT = 32, 16
#: In the first order a set of n shingles looks at one more for every SPARE of them, and shares as many with each partner.
SPARE = 40
#: Rounds in which each set is compared in one group and tile, before all groups that still hold several components are.
MERGES = 3
#: Parts in which the classes of copies are given their component, so that no class of copies lands in one task.
SALTS = 16
_PART, _BLOCK = 2 << 20, 8 << 20


def _sets(raw: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    return distinct_in_text(*shingle_hashes(*word_hashes(raw, off), width))


def _in_parts(raw: np.ndarray, off: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The sets of many texts, a few megabytes of text at a time."""
    at = 0
    while at < len(off) - 1:
        end = max(at + 1, int(np.searchsorted(off, off[at] + _PART, "right")) - 1)
        yield _sets(raw[off[at] : off[end]], off[at : end + 1] - off[at], width)
        at = end


def _lacking(n: np.ndarray, percent: int) -> np.ndarray:
    """How many shingles of a set of n a partner over the threshold may lack."""
    return n - -(-percent * n // 100)


def _prints(h: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of each set."""
    at, full = np.cumsum(n) - n, n > 0
    sums = [np.zeros(len(n), np.uint64) for _ in range(2)]
    if len(h):
        with np.errstate(over="ignore"):
            for s, salt in zip(sums, (0x1B873593, 0x85EBCA6B)):
                s[full] = np.add.reduceat(mix(h ^ np.uint64(salt)), at[full])
    return sums


PRINTS = "block long, n_keys long, doc_ids binary, known binary, n binary, h1 binary, h2 binary, keys binary"


def print_blocks(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Blocks of documents: the size of each set, its 128-bit hash and its first shingles in the order of their hashes.

    Of two sets over the threshold take the one whose last such shingle comes first. It lacks `_lacking(n)` shingles of
    the other at most, so of its n_lacking + 1 + n // SPARE first ones 1 + n // SPARE at least are the other's too, and
    stand among the other's first ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(slices(batches, "text", _BLOCK)):
            cols = []
            for h, n in _in_parts(*utf8(batch.column("text")), width):
                rank = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
                take = np.where(n > 0, _lacking(n, percent) + 1 + n // SPARE, 0)
                cols.append((n, *_prints(h, n), h[rank < np.repeat(take, n)]))
            n, h1, h2, keys = (np.concatenate(c) for c in zip(*cols))
            ids = batch.column("doc_id")
            row = [base + number, len(keys), ids.fill_null(0).to_numpy().tobytes(), ids.is_valid().to_numpy(zero_copy_only=False).tobytes(), *(x.tobytes() for x in (n, h1, h2, keys))]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, (pa.int64(), pa.int64(), *[pa.binary()] * 6))], names=[c.split()[0] for c in PRINTS.split(", ")])

    return docs.mapInArrow(run, PRINTS)


def _print_rows(row: dict) -> tuple[np.ndarray, ...]:
    return tuple(np.frombuffer(row[c], k) for c, k in (("doc_ids", np.int64), ("known", bool), ("n", np.int64), ("h1", np.int64), ("h2", np.int64)))


def documents_of(blocks: DataFrame) -> DataFrame:
    """(doc_id, n, h1, h2) of every document of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, known, *rest = _print_rows(row)
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=~known), *map(pa.array, rest)], names=["doc_id", "n", "h1", "h2"])

    return blocks.select("doc_ids", "known", "n", "h1", "h2").mapInArrow(run, "doc_id long, n long, h1 long, h2 long")


def sharing_classes(blocks: DataFrame, percent: int) -> DataFrame:
    """(doc_id, n, h1, h2): one document of each class of equal sets whose first shingles others have often enough."""
    spark = blocks.sparkSession
    buckets = buckets_for(spark, blocks.agg(F.sum("n_keys")).first()[0] or 0)

    def of(row: dict) -> tuple[np.ndarray, ...]:
        """The row's documents, those that stand for their copies in it, and all keys with their document."""
        ids, known, n, h1, h2 = _print_rows(row)
        _, first = np.unique(np.stack([n, h1, h2], 1), axis=0, return_index=True) if len(n) else (None, np.empty(0, np.int64))
        stands = np.zeros(len(n), bool)
        stands[first] = True
        # A copy without an id stands for nobody: those with an id come first.
        for i in np.flatnonzero(stands & ~known).tolist():
            same = np.flatnonzero(known & (n == n[i]) & (h1 == h1[i]) & (h2 == h2[i]))
            stands[i] = False
            stands[same[:1]] = True
        stands &= n > 0
        take = np.where(n > 0, _lacking(n, percent) + 1 + n // SPARE, 0)
        owner = np.repeat(np.arange(len(n)), take)
        keys = np.frombuffer(row["keys"], np.uint64)
        return ids, n, h1, h2, stands, keys, owner

    def keys_of(row: dict) -> np.ndarray:
        *_, stands, keys, owner = of(row)
        return mix(keys[stands[owner]])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, n, h1, h2, stands, keys, owner = of(row)
                owner, keys = owner[stands[owner]], keys[stands[owner]]
                shared = np.bincount(owner[level_of_each(row, mix(keys), buckets) > 0], minlength=len(n))
                # The smaller of two sets over the threshold has this many shingles at least.
                left = np.flatnonzero(stands & (shared >= -(-percent * n // 100) // SPARE + 1))
                yield pa.RecordBatch.from_arrays([pa.array(x[left]) for x in (ids, n, h1, h2)], names=["doc_id", "n", "h1", "h2"])

    found = with_levels(blocks, keys_of, buckets).mapInArrow(keep, "doc_id long, n long, h1 long, h2 long")
    return found.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("doc_id"))


TEXTS = "block long, n_keys long, sets binary, sizes binary, text binary"


def class_texts(docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """Blocks of the texts of classes (set, doc_id, n, h1, h2), taken from any row with that doc_id and that set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(slices(batches, "text", _BLOCK)):
            raw, off = utf8(batch.column("text"))
            got = [(n, *_prints(h, n)) for h, n in _in_parts(raw, off, width)]
            n, h1, h2 = (np.concatenate(x) for x in zip(*got))
            same = (n == batch.column("n").to_numpy()) & (h1.view(np.int64) == batch.column("h1").to_numpy()) & (h2.view(np.int64) == batch.column("h2").to_numpy())
            sizes = np.diff(off)
            row = [base + number, int(n[same].sum()), batch.column("set").to_numpy()[same].tobytes(), sizes[same].tobytes(), squeeze(raw[np.repeat(same, sizes)])]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, (pa.int64(), pa.int64(), *[pa.binary()] * 3))], names=[c.split()[0] for c in TEXTS.split(", ")])

    # Most texts stand for no class: these stay where they are.
    return meet(docs.where("doc_id is not null"), classes, ["doc_id"]).select("set", "n", "h1", "h2", "text").mapInArrow(run, TEXTS)


ROUTES = "set long, n long, keys array<long>, hashes binary, bits binary"


def routes(blocks: DataFrame, width: int, percent: int) -> DataFrame:
    """(set, n, keys, hashes, bits): sets that may have a partner, with the shared ones of their rarest shingles.

    All sets have one order of shingles in common: by the logarithm of the number of sets that hold them, then by hash. A
    set lacks `_lacking(n)` shingles of a partner at most, so two sets over the threshold share one of their
    lacking + 1 first. Shingles that one set alone has lead nowhere: a set that has enough of those has no partner.
    """
    buckets = buckets_for(blocks.sparkSession, blocks.agg(F.sum("n_keys")).first()[0] or 0)

    def sets_of(row: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        return _in_parts(spread(row["text"]), np.concatenate([[0], np.cumsum(np.frombuffer(row["sizes"], np.int64))]), width)

    def keys_of(row: dict) -> np.ndarray:
        return np.concatenate([np.empty(0, np.uint64), *(mix(h) for h, _ in sets_of(row))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sets = np.frombuffer(row["sets"], np.int64)
                levels, at, done = level_of_each(row, keys_of(row), buckets), 0, 0
                for h, n in sets_of(row):
                    level = levels[done : done + len(h)]
                    text = np.repeat(np.arange(len(n)), n)
                    order = np.lexsort((h, level, text))
                    rank = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
                    first = order[(rank < (_lacking(n, percent) + 1)[text]) & (level[order] > 0)]
                    many = np.bincount(text[first], minlength=len(n))
                    end, stop = np.cumsum(n), np.cumsum(many)
                    keys, rows = h[first].view(np.int64), []
                    for i in np.flatnonzero(many).tolist():
                        own = h[end[i] - n[i] : end[i]]
                        rows.append((sets[at + i], n[i], keys[stop[i] - many[i] : stop[i]], own.tobytes(), bitmap(own).tobytes()))
                    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=[c.split()[0] for c in ROUTES.split(", ")])
                    at, done = at + len(n), done + len(h)

    return with_levels(blocks, keys_of, buckets).mapInArrow(run, ROUTES)


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """Words of 64 bits, a power of two of them, with four bits or more for every hash."""
    words = max(1, 1 << (4 * len(hashes) // 64).bit_length())
    place = mix(hashes) % np.uint64(64 * words)
    out = np.zeros(words, np.uint64)
    np.bitwise_or.at(out, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    return out


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap of the same set with fewer words: places are hashes modulo its size."""
    return np.bitwise_or.reduce(bits.reshape(-1, words), axis=0)


class SignatureTree:
    """Nodes over sets that are sorted by size: OR-combined bitmaps, size ranges, most collisions."""

    def __init__(self, bitmaps: list[np.ndarray], sizes: list[int]):
        words = min(SIGNATURE, *(len(b) for b in bitmaps))
        bits, n = np.stack([fold(b, words) for b in bitmaps]), np.array(sizes, np.int64)
        self.order = np.lexsort((bits[:, 0], n))
        bits = bits[self.order]
        low = high = n[self.order]
        slack = low - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        self.levels = [(bits, low, high, slack)]
        while len(bits) > 1:
            at = np.arange(0, len(bits), FANOUT)
            bits, low, high, slack = np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(slack, at)
            self.levels.append((bits, low, high, slack))

    def possible(self, level: int, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Whether some pair of sets below nodes a and b can reach the threshold.

        The overlap of two sets is at most the common bits of their nodes and the shingles that share a bit with another
        one of their set; the threshold asks for percent / (100 + percent) of both sizes.
        """
        bits, low, high, slack = self.levels[level]
        ok = (100 * high[a] >= percent * low[b]) & (100 * high[b] >= percent * low[a])
        a, b = a[ok], b[ok]
        common = np.concatenate([np.bitwise_count(bits[a[i : i + 8192]] & bits[b[i : i + 8192]]).sum(axis=1, dtype=np.int64) for i in range(0, len(a), 8192)] or [np.empty(0, np.int64)])
        most = common + np.minimum(slack[a], slack[b])
        ok[np.flatnonzero(ok)] = (100 + percent) * most >= percent * (low[a] + low[b])
        return ok

    def pairs(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Candidate pairs of sets (places in the given list), by a dual traversal from the root."""
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, a, b = stack.pop()
            ok = self.possible(level, a, b, percent)
            a, b = a[ok], b[ok]
            if not level:
                own = a < b
                yield self.order[a[own]], self.order[b[own]]
                continue
            below = len(self.levels[level - 1][0])
            step = max(1, 200_000 // FANOUT**2)
            for i in range(0, len(a), step):
                x = (a[i : i + step, None, None] * FANOUT + np.arange(FANOUT)[None, :, None]).repeat(FANOUT, 2).ravel()
                y = (b[i : i + step, None, None] * FANOUT + np.arange(FANOUT)[None, None, :]).repeat(FANOUT, 1).ravel()
                inside = (x < below) & (y < below) & (x <= y)
                stack.append((level - 1, x[inside], y[inside]))


def forest(sets: list[np.ndarray], groups: list, percent: int, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Verified links that join the groups of the given sets: a spanning forest, with the same components as all links.

    Pairs whose groups are joined already need no look. sides: if given, only pairs of different sides count (tiles).
    """
    if len(sets) < 2:
        return []
    parent = {g: g for g in groups}
    group, side = np.unique(groups, return_inverse=True)[1], None if sides is None else np.array(sides)

    def root(g):
        while parent[g] != g:
            parent[g] = parent[parent[g]]
            g = parent[g]
        return g

    out = []
    for a, b in SignatureTree([bitmap(x) for x in sets], [len(x) for x in sets]).pairs(percent):
        apart = group[a] != group[b]
        if side is not None:
            apart &= side[a] != side[b]
        for i, j in zip(a[apart].tolist(), b[apart].tolist()):
            x, y = root(groups[i]), root(groups[j])
            if x == y:
                continue
            p, q = sets[i], sets[j]
            both = np.concatenate([p, q])
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            if 100 * shared >= percent * (len(p) + len(q) - shared):
                parent[y] = x
                out.append((i, j))
    return out


def near_rows(bits: list[np.ndarray], sizes: list[int], groups: list, percent: int, sides: list | None) -> set[int]:
    """Which sets may reach the threshold with one of another group, by their bitmaps: no set that does is missing.

    Two bitmaps of one size differ in as many places at most as the sets have elements that the other one lacks.
    """
    group, side = np.unique(groups, return_inverse=True)[1], np.array(sides if sides is not None else range(len(bits)))
    flagged = np.zeros(len(bits), bool)
    for a, b in SignatureTree(bits, sizes).pairs(percent):
        for at in range(0, len(a), 4096):
            x, y = a[at : at + 4096], b[at : at + 4096]
            open_ = (group[x] != group[y]) & (side[x] != side[y]) & ~(flagged[x] & flagged[y])
            for i, j in zip(x[open_].tolist(), y[open_].tolist()):
                if flagged[i] and flagged[j]:
                    continue
                words = min(len(bits[i]), len(bits[j]))
                apart = int(np.bitwise_count(fold(bits[i], words) ^ fold(bits[j], words)).sum())
                if (100 + percent) * apart <= (100 - percent) * (sizes[i] + sizes[j]):
                    flagged[[i, j]] = True
    return set(np.flatnonzero(flagged).tolist())


def _by_group(columns: tuple[str, ...], names: list[str], work):
    """A function over a partition sorted by (key, i, j): work on the distinct sets of each group, read as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, [], []

        def done() -> list[tuple]:
            own = list({r[0]: r for r in rows}.values())
            return work(now, own) if len(own) > 1 and len({r[1] for r in own}) > 1 else []

        def give() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[c] for p in out], pa.int64()) for c in range(len(names))], names=names)

        for batch in batches:
            for k, i, j, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "set", "component", "side", *columns))):
                if (k, i, j) != now:
                    out += done()
                    now, rows = (k, i, j), []
                rows.append(tuple(row))
            yield give()
            out = []
        out = done()
        yield give()

    return run


def _links(percent: int):
    def work(key: tuple, rows: list[tuple]) -> list[tuple]:
        sides = [r[2] for r in rows] if key[1] != key[2] else None
        pairs = forest([np.frombuffer(r[3], np.uint64) for r in rows], [r[1] for r in rows], percent, sides)
        # As stars round the least component, which settle sooner than chains.
        near: dict[int, set[int]] = {}
        for i, j in pairs:
            own = near.get(rows[i][1], {rows[i][1]}) | near.get(rows[j][1], {rows[j][1]})
            near.update(dict.fromkeys(own, own))
        return [(c, min(own)) for c, own in near.items() if c != min(own)]

    return _by_group(("hashes",), ["a", "b"], work)


def _near(percent: int):
    def work(key: tuple, rows: list[tuple]) -> list[tuple]:
        sides = [r[2] for r in rows] if key[1] != key[2] else None
        kept = near_rows([np.frombuffer(r[3], np.uint64) for r in rows], [r[4] for r in rows], [r[1] for r in rows], percent, sides)
        return [(*key, rows[i][0], rows[i][1], rows[i][2]) for i in sorted(kept)]

    return _by_group(("bits", "n"), ["key", "i", "j", "set", "component", "side"], work)


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(parallelism(rows.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j", "set")


def shared_groups(routed: DataFrame) -> DataFrame:
    """(set, key, tiles): keys that two sets or more have, one for each group of sets that is the same for several keys.

    Two near copies share dozens of keys. Only groups of one tile are compared whole; larger ones stay as they are.
    """
    rows = routed.select("set", "n", F.explode("keys").alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("c"), F.sum("n").alias("shingles")).where("c > 1")
    tiles = F.greatest(F.ceil(F.col("c") / TILE), F.ceil(8 * F.col("shingles") / TILE_BYTES))
    kept = rows.join(sizes.select("key", tiles.alias("tiles")), "key").select("set", "key", "tiles")
    few = kept.where("tiles = 1").groupBy("key").agg(F.sort_array(F.collect_list("set")).alias("members"))
    few = few.groupBy("members").agg(F.min("key").alias("key")).select(F.explode("members").alias("set"), "key", F.lit(1).cast("long").alias("tiles"))
    return few.unionByName(kept.where("tiles > 1"))


def mixed_groups(groups: DataFrame, stars: DataFrame) -> DataFrame:
    """groups (set, key, tiles) of two components or more, with component."""
    named = groups.join(stars.withColumnRenamed("node", "set"), "set", "left").select("set", "key", "tiles", F.coalesce("component", "set").alias("component"))
    mixed = named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y")
    return named.join(mixed.select("key"), "key")


def _once(groups: DataFrame, turn: int) -> DataFrame:
    """One group and one of its tiles for each set: the smallest group first, later any; sets of like groups choose alike."""
    order = F.col("tiles") if turn == 0 else F.lit(0)
    one = groups.groupBy("set").agg(F.min(F.struct(order.alias("t"), F.xxhash64("key", F.lit(turn)).alias("o"), "key", "tiles", "component")).alias("m"))
    tile = F.pmod(F.xxhash64("set", F.lit(turn)), F.col("m.tiles"))
    return one.select("m.key", tile.alias("i"), tile.alias("j"), "set", "m.component", F.lit(0).cast("long").alias("side"))


def _pairs_of_tiles(groups: DataFrame) -> DataFrame:
    """(key, i, j, set, component, side): every two sets of one group and of two components meet under some (i, j).

    The largest component of a group need not meet itself: its tiles meet only those of the others, which also meet each
    other. So a group of many linked sets and a few others costs little more than one reading of it.
    """
    sizes = groups.groupBy("key", "component").agg(F.count("*").alias("c"), F.first("tiles").alias("tiles"))
    largest = sizes.groupBy("key").agg(F.max_by("component", F.struct("c", "component")).alias("large"), F.max("c").alias("most"), F.sum("c").alias("all"), F.first("tiles").alias("tiles"))
    own = F.ceil(F.col("tiles") * F.col("most") / F.col("all"))
    rest = F.ceil(F.col("tiles") * (F.col("all") - F.col("most")) / F.col("all"))
    known = groups.join(largest.select("key", "large", own.alias("a"), rest.alias("b")), "key")
    in_large = F.col("component") == F.col("large")
    alone = F.col("tiles") == 1
    side = F.when(alone, F.lit(0)).when(in_large, F.pmod(F.xxhash64("set"), "a")).otherwise(F.col("a") + F.pmod(F.xxhash64("set"), "b"))
    none = F.lit(0).cast("long")
    others = F.when(alone, F.array(none)).when(in_large, F.sequence(F.col("a"), F.col("a") + F.col("b") - 1)).otherwise(F.sequence(none, F.col("a") + F.col("b") - 1))
    dealt = known.withColumns({"side": side.cast("long"), "other": F.explode(others)})
    return dealt.select("key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "set", "component", "side")


def _rest(groups: DataFrame, routed: DataFrame, stars: DataFrame, percent: int) -> DataFrame:
    """stars with the links between the components that groups still hold: by bitmaps, then by whole sets."""
    near = _dealt(_pairs_of_tiles(groups).join(routed.select("set", "bits", "n"), "set"))
    near = cut(near.mapInArrow(_near(percent), "key long, i long, j long, set long, component long, side long"), "near")
    more = cut(_dealt(near.join(routed.select("set", "hashes"), "set")).mapInArrow(_links(percent), "a long, b long"), "links")
    return components(more.union(stars.select(F.col("node").alias("a"), F.col("component").alias("b"))))


def similar_sets(docs: DataFrame, *, width: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(members (doc_id, n, h1, h2), classes (h1, h2, n, component)): components over the links of documents.

    1. Equal sets are one class, found on hashes alone: copies never meet again. component is null where a class has no
       links and no copies, and else the least doc_id.
    2. Classes whose first shingles by hash are not often enough other classes' leave (`sharing_classes`): most of a corpus.
    3. Of the others, the number of sets that hold each shingle gives the order in which shingles route (`routes`): a passage
       of many texts comes last, and a text that is for the most part its own routes nowhere.
    4. Some rounds compare each set in one group of its routing shingles, by a signature tree of bitmaps.
    5. Groups that still hold two components get a tree of their sets' bitmaps, then one of the sets that may have a link to
       another component: every pair over the threshold is in one component already or compared, so no link is lost.

    A shingle of many sets, or of very long ones, is dealt in tiles by hash, so no task has an unbounded group. Only the texts
    of step 3 move, once.
    """
    own = texts_of(docs)
    blocks = cut(print_blocks(own, width, percent), "prints", codec="none")
    members = documents_of(blocks)
    classes = cut(sharing_classes(blocks, percent).withColumn("set", F.monotonically_increasing_id()), "classes")
    texts = cut(class_texts(own, classes, width), "texts", codec="none")
    routed = cut(routes(texts, width, percent), "routes")
    groups = cut(shared_groups(routed), "groups")
    hashes = routed.select("set", "hashes")
    open_, stars = groups.withColumn("component", F.col("set")), None
    for turn in range(MERGES):
        found = cut(_dealt(_once(open_, turn).join(hashes, "set")).mapInArrow(_links(percent), "a long, b long"), "links")
        stars = components(found if stars is None else found.union(stars.select(F.col("node").alias("a"), F.col("component").alias("b"))))
        open_ = cut(mixed_groups(open_.select("set", "key", "tiles"), stars), "open")
        if open_.isEmpty():
            break
    else:
        stars = _rest(open_, routed, stars, percent)
    linked = classes.select("n", "h1", "h2", "set").join(stars.withColumnRenamed("node", "set"), "set")
    copies = members.where("n > 0 and doc_id is not null").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    several = cut(copies.join(linked, ["n", "h1", "h2"], "left").where("copies > 1 or component is not null"), "several")
    lowest = several.where("component is not null").groupBy("component").agg(F.min("least").alias("low"))
    named = several.join(lowest, "component", "left").select("n", "h1", "h2", F.coalesce("low", "least").alias("component"))
    return members, cut(named, "named")


def jaccard_components(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    Documents link when 100 * intersection >= percent * union of their sets of distinct `width`-word shingles (A-Z in
    lower case, words are runs of anything but ASCII white space; a shorter text is one shingle). component_id is the least
    doc_id that links reach. Null and blank texts have an empty set and link with nothing; so do rows with a null id, whose
    component is null. Repeated rows keep their rows. An empty table gives no rows. Other columns are ignored.
    """
    members, classes = similar_sets(docs, width=width, percent=percent)
    # Each class stands once for every part of its copies.
    parted = classes.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = members.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(parted, ["n", "h1", "h2", "part"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4, percent=85)


ORACLE = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, unnest(list_distinct(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as g from d),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 85 * (x.n + y.n - shared)),
r(a, b) as (select doc_id, doc_id from d union select r.a, l.b from r join l on l.a = r.b)
select d.doc_id, coalesce(any_value(n), 0) as n_shingles, min(r.b) as component_id from d left join n on n.doc_id = d.doc_id join r on r.a = d.doc_id group by d.doc_id
"""
