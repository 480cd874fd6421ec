"""Scores of texts by an n-gram model as a weighted automaton with failure arcs, one walk from left to right for each text."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.common import cut, slices, texts_of
from wayfold.llm.keyblocks import buckets_for, spread, squeeze
from wayfold.llm.shingles import mix

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Hashes that stand for the begin and the end of a text; words have hashes of their bytes.
_BEGIN, _END = np.uint64(1), np.uint64(2)
#: Bytes of a hash that travel for one n-gram, beside the bucket it is in.
_SIX = 6
#: Tokens of a stretch: a long text is walked in stretches, each after the tokens that fix its first state.
STRETCH = 512
#: Classes of words by checksum; buckets of words are made of neighbouring ones.
CLASSES = 1 << 16
_BLOCK = "block long, n_tokens long, doc_ids array<long>, sizes binary, slots binary, edges binary, words binary"
_WORDS, _GRAMS = 0, 1


def is_held_out(doc_id: int | None, modulus: int, rest: int) -> bool:
    return zlib.crc32(b"" if doc_id is None else b"%d" % doc_id) % modulus == rest


def _blocks(most: int):
    """Texts as blocks: the words by class, and each token as its word's place among them."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        slot_of: defaultdict[bytes, int] = defaultdict()
        slot_of.default_factory = slot_of.__len__
        kept: list[tuple[list, np.ndarray, np.ndarray]] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, held
            words = list(slot_of)
            class_ = np.fromiter((zlib.crc32(w) % CLASSES for w in words), np.int64, len(words))
            order = np.argsort(class_, kind="stable")
            place = np.empty(len(words), np.int32)
            place[order] = np.arange(len(words), dtype=np.int32)
            edges = np.searchsorted(class_[order], np.arange(CLASSES + 1)).astype(np.int32)
            slots = place[np.concatenate([k[2] for k in kept])]
            sizes = np.concatenate([k[1] for k in kept])
            # Low bytes of all slots first, then the next: they pack better.
            planes = np.ascontiguousarray(slots.astype("<i4").view(np.uint8).reshape(-1, 4).T)
            row = [(part << 24) + number, len(slots), [d for k in kept for d in k[0]], squeeze(sizes), squeeze(planes), squeeze(edges), squeeze(b" ".join([words[k] for k in order.tolist()]))]
            kept.clear()
            slot_of.clear()
            number, held = number + 1, 0
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=["block", "n_tokens", "doc_ids", "sizes", "slots", "edges", "words"])

        for batch in slices(batches, "text", 4 << 20):
            # White space of bytes.split is that of the words' definition; lower() changes A-Z alone.
            texts = [t.lower().split() for t in batch.column("text").cast(pa.binary()).to_pylist()]
            slots = np.fromiter(chain.from_iterable(map(slot_of.__getitem__, t) for t in texts), np.int64)
            kept.append((batch.column("doc_id").to_pylist(), np.array([len(t) for t in texts], np.int64), slots))
            # Texts of very short words have more tokens than their bytes tell.
            held += max(batch.column("text").nbytes, 6 * len(slots))
            if held >= most:
                yield from flush()
        if kept:
            yield from flush()

    return encode


class Tokens:
    """A block's tokens: every text with its begin and end, and the block's distinct n-grams of each order in a fixed order."""

    def __init__(self, row: dict, order: int, buckets: int):
        planes = spread(row["slots"]).reshape(4, -1)
        slots = np.ascontiguousarray(planes.T).view("<i4").ravel()
        self.sizes = spread(row["sizes"], np.int64)
        edges = spread(row["edges"], np.int32)
        self.n_words = n = int(edges[-1])
        self.end, self.begin = n, n + 1
        ends = np.cumsum(self.sizes + 2) - 1
        self.first = ends - self.sizes - 1
        at = np.ones(int(ends[-1]) + 1 if len(ends) else 0, bool)
        at[self.first], at[ends] = False, False
        self.token = np.full(len(at), self.begin, np.int32)
        self.token[ends] = self.end
        self.token[at] = slots
        #: A word's class; begin and end have the first.
        class_of = np.concatenate([np.repeat(np.arange(CLASSES), np.diff(edges)), [0, 0]])
        self.offset = (np.arange(len(at)) - np.repeat(self.first, self.sizes + 2)).astype(np.int32)
        #: Of each order from 2 on: places whose token ends an n-gram, its number among the distinct ones, and their parts.
        self.grams: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.bucket: list[np.ndarray] = []
        last, bucket = self.token, class_of
        for k in range(2, order + 1):
            places = np.flatnonzero(self.offset >= k - 1)
            distinct, number = np.unique(last[places - 1].astype(np.int64) * (n + 2) + self.token[places], return_inverse=True)
            number = number.astype(np.int32)
            head, tail = distinct // (n + 2), distinct % (n + 2)
            self.grams.append((places, number, head, tail))
            bucket = (bucket[head] * 0x9E3B + class_of[tail] * 0x7F4D + k) % buckets
            self.bucket.append(bucket)
            last = np.zeros(len(self.token), np.int32)
            last[places] = number

    def by_bucket(self) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all n-grams of all orders, one order after another, and how they stand when sorted by them."""
        bucket = np.concatenate(self.bucket) if self.bucket else np.empty(0, np.int64)
        return bucket, np.argsort(bucket, kind="stable")


def _ask(order: int, buckets: int, modulus: int, rest: int):
    """What a block asks of each bucket: its words and its n-grams, with how often the texts to learn from have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                t = Tokens(row, order, buckets)
                learn = np.repeat(np.array([not is_held_out(d, modulus, rest) for d in row["doc_ids"]], bool), t.sizes + 2)
                words = bytes(spread(row["words"])).split(b" ") if t.n_words else []
                times = np.bincount(t.token[learn], minlength=t.n_words + 2).astype(np.uint32)
                few = min(buckets, CLASSES)
                edges = spread(row["edges"], np.int32)[np.arange(few + 1) * CLASSES // few].tolist()
                out = []
                for b, (x, y) in enumerate(zip(edges[:-1], edges[1:])):
                    if y > x:
                        out.append((_WORDS, row["block"], b, squeeze(b" ".join(words[x:y])), squeeze(times[x:y])))
                # The end of a text is a word of no letters in a last bucket of its own.
                out.append((_WORDS, row["block"], few, b"", squeeze(times[t.end : t.end + 1])))
                hashes = np.concatenate([np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), [_END, _BEGIN]])
                keys, counts = [], []
                last = hashes
                for places, number, head, tail in t.grams:
                    with np.errstate(over="ignore"):
                        last = mix(last[head] * _ODD + hashes[tail])
                    keys.append(last)
                    counts.append(np.bincount(number[learn[places]], minlength=len(head)).astype(np.uint32))
                bucket, order_ = t.by_bucket()
                keys, counts, bucket = np.concatenate([*keys, np.empty(0, np.uint64)])[order_], np.concatenate([*counts, np.empty(0, np.uint32)])[order_], bucket[order_]
                level = np.concatenate([*(np.full(len(g[2]), k + 2, np.uint8) for k, g in enumerate(t.grams)), np.empty(0, np.uint8)])[order_]
                six = np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, :_SIX])
                edges = np.searchsorted(bucket, np.arange(buckets + 1)).tolist()
                for b, (x, y) in enumerate(zip(edges[:-1], edges[1:])):
                    if y > x:
                        out.append((_GRAMS, row["block"], b, six[x:y].tobytes(), squeeze(np.concatenate([counts[x:y].view(np.uint8), level[x:y]]))))
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["kind", "block", "bucket", "keys", "times"])

    return run


def _bins(counts: np.ndarray, level: int) -> list[dict]:
    """How many keys have a count of about the same size, and their sum."""
    seen = counts[counts > 0].astype(np.int64)
    bin_ = np.where(seen < 64, seen, 40 + (4 * np.log2(np.maximum(seen, 1))).astype(np.int64))
    n, s = np.bincount(bin_), np.bincount(bin_, weights=seen)
    return [{"level": level, "bin": int(b), "n": int(n[b]), "total": int(s[b])} for b in np.flatnonzero(n)]


_TOTALS = "kind int, block long, bucket int, totals binary, bins array<struct<level: int, bin: int, n: long, total: long>>"
_BINS = pa.list_(pa.struct([("level", pa.int32()), ("bin", pa.int32()), ("n", pa.int64()), ("total", pa.int64())]))


def _sum(table: pa.Table) -> pa.Table:
    """One bucket of words or n-grams: for each block's keys, how often all texts to learn from have them."""
    kind = table.column("kind")[0].as_py()
    keys, times = table.column("keys").to_pylist(), table.column("times").to_pylist()
    if kind == _WORDS:
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        parts = [np.fromiter(map(number.__getitem__, bytes(spread(k)).split(b" ") if k else [b""]), np.int64) for k in keys]
        which = np.concatenate(parts)
        level = np.ones(len(number), np.uint8)
        counts = np.concatenate([spread(t, np.uint32) for t in times])
    else:
        parts = [np.frombuffer(k, np.uint8).reshape(-1, _SIX) for k in keys]
        wide = np.zeros((sum(map(len, parts)), 8), np.uint8)
        wide[:, :_SIX] = np.concatenate(parts)
        both = [spread(t) for t in times]
        counts = np.concatenate([b[: len(p) * 4].view(np.uint32) for b, p in zip(both, parts)])
        of = np.concatenate([b[len(p) * 4 :] for b, p in zip(both, parts)])
        wide[:, 6] = of
        distinct, which = np.unique(wide.view(np.uint64).ravel(), return_inverse=True)
        level = (distinct >> np.uint64(48)).astype(np.uint8)
    total = np.bincount(which, weights=counts, minlength=len(level)).astype(np.int64)
    bins = [b for k in np.unique(level).tolist() for b in _bins(total[level == k], k)]
    edges = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    each = np.minimum(total, np.iinfo(np.uint32).max).astype(np.uint32)[which] if total.max(initial=0) < 2**32 else total[which]
    out = [each.dtype.itemsize.to_bytes(1, "little") + squeeze(each[a:b]) for a, b in zip(edges[:-1], edges[1:])]
    return pa.table({
        "kind": table.column("kind"), "block": table.column("block"), "bucket": table.column("bucket"), "totals": pa.array(out, pa.binary()),
        "bins": pa.array([bins] + [None] * (len(out) - 1), _BINS),
    })


def _totals(data: bytes) -> np.ndarray:
    return spread(data[1:], np.uint32 if data[0] == 4 else np.int64).astype(np.int64)


def follower_power(contexts: list[tuple[int, int]], types: int) -> float:
    """The power b for which the sum of count^b over all contexts is the number of different n-grams that follow them."""
    n = np.array([c[0] for c in contexts], np.float64)
    mean = np.array([c[1] for c in contexts], np.float64) / np.maximum(n, 1)
    low, high = 0.0, 1.0
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if (n * mean**mid).sum() < types else (low, mid)
    return (low + high) / 2


def arcs_and_failures(tokens: Tokens, words: np.ndarray, grams: np.ndarray, n_tokens: int, n_types: int, powers: list[float]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Log-probability of the arc that each place's token takes from a state of 0, 1, ... tokens (nan: no such arc), and
    the weight of the failure arc from each state of 1, 2, ... tokens that ends at a place (nan: no such state)."""
    known = np.concatenate([words, [words[-1]]])[tokens.token]  # the begin counts as often as the end
    prob = (np.where(tokens.token == tokens.begin, 0, known) + 1) / (n_tokens + n_types + 1)
    arcs, failures = [np.log10(prob)], []
    count, a = known.astype(np.float64), 0
    for (places, number, head, _), power in zip(tokens.grams, powers):
        own = np.zeros(len(tokens.token))
        own[places] = grams[a : a + len(head)][number]
        a += len(head)
        before = np.concatenate([[0.0], count[:-1]])
        stronger = np.where(before > 0, before, 1) ** power
        prob = np.where(before > 0, (own + stronger * prob) / (before + stronger), prob)
        arcs.append(np.where(own > 0, np.log10(prob), np.nan))
        here = np.where(count > 0, count, 1) ** power
        failures.append(np.where(count > 0, np.log10(here / (count + here)), np.nan))
        count = own
    return arcs, failures


def walk(tokens: Tokens, arcs: list[np.ndarray], failures: list[np.ndarray]) -> np.ndarray:
    """Each text's log-probability: the state (as how many last tokens it holds) goes from left to right, and where it has no
    arc for the next token the failure arc is taken, with its weight, to the state of one token less. All stretches of all
    texts take their next step at once; a stretch first walks the few tokens that fix its state, without score."""
    deepest = len(arcs) - 1
    lengths = tokens.sizes + 1  # the begin is no step
    pieces = -(-lengths // STRETCH)
    text = np.repeat(np.arange(len(lengths)), pieces)
    start = (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * STRETCH
    stop = np.minimum(start + STRETCH, lengths[text])
    warm = np.minimum(start + 1, deepest)
    at = tokens.first[text] + 1 + start - warm  # the first place that is read; the begin itself where a text begins
    left = stop - start + warm
    arc, fail = np.stack(arcs), np.stack([np.zeros(len(tokens.token)), *failures]) if failures else np.zeros((1, len(tokens.token)))
    seen = np.stack([np.ones(len(tokens.token), bool), *(~np.isnan(f) for f in failures)])
    state = np.zeros(len(text), np.int64)
    score = np.zeros(len(text))
    order = np.argsort(-left, kind="stable")
    at, left, warm, state, score, text = at[order], left[order], warm[order], state[order], score[order], text[order]
    for j in range(int(left.max(initial=0))):
        n = int(np.searchsorted(-left, -j, "left"))  # stretches that have a step left
        place, s, gain = at[:n] + j, state[:n].copy(), np.zeros(n)
        while True:
            stuck = np.isnan(arc[s, place])
            if not stuck.any():
                break
            gain[stuck] += fail[s[stuck], place[stuck] - 1]
            s[stuck] -= 1
        gain += arc[s, place]
        score[:n] += np.where(j >= warm[:n], gain, 0)
        s = np.minimum(s + 1, deepest)
        # A token that nothing was learnt of leads to the empty state.
        state[:n] = np.where(seen[s, place], s, 0)
    return np.bincount(text, weights=score, minlength=len(lengths))


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def lm_scores(docs: DataFrame, *, order: int = 2, modulus: int = 7, rest: int = 2, block_bytes: int = 6 << 20, buckets: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    The model learns from all documents whose crc32(doc_id) % modulus is not `rest`. Tokens are the words of the lower-cased
    text and its end. States are the n-grams (of up to order - 1 tokens, the begin of a text among them) that were learnt; a
    state h has an arc for each token w that followed it, of probability (n(h, w) + k(h) p(w | h')) / (n(h) + k(h)), where h'
    is h without its first token, and a failure arc to h' of weight k(h) / (n(h) + k(h)). k(h) = n(h)^b stands for the
    number of different followers; b makes its sum over all states the number of n-grams that were counted. The empty state
    has (n(w) + 1) / (N + V + 1), alone the base score. So every state's probabilities sum to one over all words and one for
    the unknown.

    Documents are dictionary-encoded in blocks. Every block asks buckets of words and of n-grams for counts over the whole
    corpus (n-grams as six bytes of a hash within their bucket, once a block, so that frequent ones are no hot keys), gets
    the part of the automaton that its texts can reach, and walks them. No model is broadcast or collected: only the sizes
    of counts, a few hundred numbers, come to the driver. Buckets follow the counted keys. A text of any length is walked
    whole, in stretches.

    A null or empty text is its end alone. A null doc_id counts as an empty one and learns. Repeated rows keep their own rows
    and count each; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    blocks = cut(texts_of(docs).mapInArrow(_blocks(block_bytes), _BLOCK), "blocks", codec="none")
    if buckets is None:
        buckets = buckets_for(spark, (blocks.agg(F.sum("n_tokens")).first()[0] or 0) * (order - 1))
    asks = blocks.mapInArrow(_ask(order, buckets, modulus, rest), "kind int, block long, bucket int, keys binary, times binary")
    found = cut(asks.groupBy("kind", "bucket").applyInArrow(_sum, _TOTALS), "totals", codec="none")
    bins: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for r in found.select(F.explode("bins").alias("b")).groupBy("b.level", "b.bin").agg(F.sum("b.n").alias("n"), F.sum("b.total").alias("total")).collect():
        bins[r.level].append((r.n, r.total))
    n_tokens, n_types = sum(t for _, t in bins[1]), sum(n for n, _ in bins[1])
    powers = [follower_power(bins[k - 1], sum(n for n, _ in bins[k])) for k in range(2, order + 1)]

    def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        parts: dict[int, list[tuple[int, bytes]]] = {_WORDS: [], _GRAMS: []}
        for kind, bucket, totals in zip(*(right.column(c).to_pylist() for c in ("kind", "bucket", "totals"))):
            parts[kind].append((bucket, totals))
        words, kept = (np.concatenate([np.empty(0, np.int64), *(_totals(t) for _, t in sorted(parts[k]))]) for k in (_WORDS, _GRAMS))
        out = []
        for row in left.to_pylist():
            t = Tokens(row, order, buckets)
            grams = np.empty(len(kept), np.int64)
            grams[t.by_bucket()[1]] = kept
            arcs, failures = arcs_and_failures(t, words, grams, n_tokens, n_types, powers)
            step = t.offset > 0
            text = np.repeat(np.arange(len(t.sizes)), t.sizes + 1)
            known = np.bincount(text, weights=words[t.token[step]] > 0, minlength=len(t.sizes)).astype(np.int64)
            base = np.bincount(text, weights=arcs[0][step], minlength=len(t.sizes))
            out.append(pa.table({
                "doc_id": pa.array(row["doc_ids"], pa.int64()), "held_out": [is_held_out(d, modulus, rest) for d in row["doc_ids"]], "n_tokens": t.sizes + 1, "n_known": known,
                "train_tokens": np.full(len(t.sizes), n_tokens, np.int64), "base_score": base, "score": walk(t, arcs, failures),
            }))
        return pa.concat_tables(out)

    docs_of = blocks.drop("words").groupBy("block")
    return docs_of.cogroup(found.drop("bins").groupBy("block")).applyInArrow(score, _SCORES)


def op12_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
