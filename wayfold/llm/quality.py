"""A byte-level convolutional network in numpy that tells good documents from bad ones."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.common import free_name, slices, utf8

#: Bytes of a block; a chunk is four blocks, and the next chunk starts three blocks on, so neighbours share one.
BLOCK, SPAN, STEP = 64, 4, 3
WIDTH, FILTERS, HIDDEN = 4, 24, 12


@dataclass
class Network:
    """Filters over WIDTH bytes -> max over each chunk -> a hidden layer -> mean and max over chunks -> probability."""

    conv: np.ndarray = field(default_factory=lambda: np.zeros((WIDTH, 256, FILTERS), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(FILTERS, np.float32))
    mix: np.ndarray = field(default_factory=lambda: np.zeros((FILTERS, HIDDEN), np.float32))
    mix_bias: np.ndarray = field(default_factory=lambda: np.zeros(HIDDEN, np.float32))
    out: np.ndarray = field(default_factory=lambda: np.zeros(2 * HIDDEN, np.float32))
    out_bias: np.ndarray = field(default_factory=lambda: np.zeros(1, np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.conv, self.bias, self.mix, self.mix_bias, self.out, self.out_bias]

    @classmethod
    def start(cls, seed: int = 7) -> Network:
        rng, net = np.random.default_rng(seed), cls()
        net.conv[:] = rng.normal(0, 0.5, net.conv.shape)
        net.mix[:] = rng.normal(0, FILTERS**-0.5, net.mix.shape)
        net.out[:] = rng.normal(0, (2 * HIDDEN) ** -0.5, net.out.shape)
        return net


def lay_out(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts in blocks of their own, behind WIDTH - 1 zero bytes so that no filter sees two texts, and the blocks of each."""
    sizes = np.diff(offsets)
    blocks = (sizes + WIDTH - 1 + BLOCK - 1) // BLOCK
    first = (np.cumsum(blocks) - blocks) * BLOCK + WIDTH - 1
    padded = np.zeros(int(blocks.sum()) * BLOCK + WIDTH, np.uint8)
    padded[np.repeat(first - offsets[:-1], sizes) + np.arange(len(raw))] = raw
    return padded, blocks


def chunk_rows(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each chunk its SPAN block numbers (the last one again where a text ends), and the chunks of each text."""
    chunks = 1 + np.maximum(0, -(-(blocks - SPAN) // STEP))
    base, last = np.repeat(np.cumsum(blocks) - blocks, chunks), np.repeat(np.cumsum(blocks) - 1, chunks)
    number = np.arange(int(chunks.sum())) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    return np.minimum((base + number * STEP)[:, None] + np.arange(SPAN), last[:, None]), chunks


def _pairs(conv: np.ndarray) -> list[np.ndarray]:
    """Responses to two bytes at once: one look-up for each pair of filter columns."""
    return [(conv[k][:, None, :] + conv[k + 1][None, :, :]).reshape(1 << 16, -1) for k in range(0, WIDTH, 2)]


def responses(padded: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """(blocks, BLOCK, FILTERS) responses at every byte."""
    n = len(padded) - WIDTH
    two = padded[:-1].astype(np.intp) << 8
    two |= padded[1:]
    got = tables[0].take(two[:n], axis=0)
    for k, table in enumerate(tables[1:], 1):
        got += table.take(two[2 * k : 2 * k + n], axis=0)
    return got.reshape(-1, BLOCK, got.shape[1])


def _largest(padded: np.ndarray, blocks: int, tables: list[np.ndarray], where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """The largest response of each filter in each block (and its byte), some blocks at a time."""
    best, place = [], []
    for a in range(0, blocks, 2048):
        got = responses(padded[a * BLOCK : min(a + 2048, blocks) * BLOCK + WIDTH], tables)
        best.append(got.max(axis=1))
        place += [got.argmax(axis=1)] if where else []
    return np.concatenate(best), np.concatenate(place) if where else None


def _head(net: Network, pooled: np.ndarray, chunks: np.ndarray) -> tuple[np.ndarray, ...]:
    act = np.maximum(pooled + net.bias, 0)
    hid = np.maximum(act @ net.mix + net.mix_bias, 0)
    at = np.cumsum(chunks) - chunks
    mean, most = np.add.reduceat(hid, at, axis=0) / chunks[:, None], np.maximum.reduceat(hid, at, axis=0)
    return act, hid, mean, most, 1 / (1 + np.exp(-(np.hstack([mean, most]) @ net.out + net.out_bias[0])))


def score(net: Network, raw: np.ndarray, offsets: np.ndarray, tables: list[np.ndarray] | None = None) -> np.ndarray:
    """Probability of label 1 for each whole text."""
    if len(offsets) < 2:
        return np.empty(0)
    tables = tables or _pairs(net.conv)
    padded, blocks = lay_out(raw, offsets)
    best, _ = _largest(padded, int(blocks.sum()), tables)
    rows, chunks = chunk_rows(blocks)
    return _head(net, best[rows].max(axis=1), chunks)[-1].astype(np.float64)


def _step(net: Network, texts: list[bytes], labels: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean cross-entropy; the maximum sends a chunk's gradient to the bytes that made it."""
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    padded, blocks = lay_out(np.frombuffer(b"".join(texts), np.uint8), offsets)
    best, where = _largest(padded, int(blocks.sum()), _pairs(net.conv), where=True)
    rows, chunks = chunk_rows(blocks)
    inside = best[rows].argmax(axis=1)
    block = np.take_along_axis(rows, inside, axis=1)
    pooled = np.take_along_axis(best, block, axis=0)
    byte = block * BLOCK + np.take_along_axis(where, block, axis=0)
    act, hid, mean, most, p = _head(net, pooled, chunks)
    d = ((p - labels) / len(labels)).astype(np.float32)
    g_out, g_bias = np.hstack([mean, most]).T @ d, np.array([d.sum()], np.float32)
    each = np.repeat(np.arange(len(chunks)), chunks)
    g_hid = (d / chunks)[each, None] * net.out[:HIDDEN]
    top = hid >= most[each]
    g_hid = g_hid + np.where(top, d[each, None] * net.out[HIDDEN:], 0)
    g_hid = np.where(hid > 0, g_hid, 0)
    g_act = np.where(act > 0, g_hid @ net.mix.T, 0)
    g_conv = np.zeros_like(net.conv)
    f = np.broadcast_to(np.arange(FILTERS), byte.shape)
    for k in range(WIDTH):
        g_conv[k] = np.bincount((padded[byte + k].astype(np.int64) * FILTERS + f).ravel(), g_act.ravel(), 256 * FILTERS).reshape(256, FILTERS)
    return [g_conv, g_act.sum(axis=0), act.T @ g_hid, g_hid.sum(axis=0), g_out, g_bias]


def _loss(net: Network, texts: list[bytes], labels: np.ndarray) -> float:
    p = np.clip(score(net, np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)), 1e-6, 1 - 1e-6)
    return float(-np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p)))


def fit(texts: list[bytes], labels: np.ndarray, *, epochs: int = 24, least_steps: int = 400, batch: int = 32, rate: float = 0.01, patience: int = 6, seed: int = 7) -> Network:
    """Adam on whole texts. Few texts are gone over more often, so that there are `least_steps` steps at least.

    From 500 texts on every tenth is held back; the round with the least loss on these is taken, and rounds end when
    `patience` of them brought nothing.
    """
    net, rng = Network.start(seed), np.random.default_rng(seed)
    if not texts:
        return net
    labels = np.asarray(labels, np.float32)
    back = np.arange(len(texts)) % 10 == 9 if len(texts) >= 500 else np.zeros(len(texts), bool)
    own, asked = np.flatnonzero(~back), np.flatnonzero(back)
    epochs = max(epochs, -(-least_steps // -(-len(own) // batch)))
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    t, least, since, kept = 0, np.inf, 0, None
    for epoch in range(epochs):
        order = own[rng.permutation(len(own))]
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            t += 1
            speed = rate * (1 - 0.9 * epoch / epochs)
            for p, g, (m, v) in zip(net.parameters(), _step(net, [texts[i] for i in some], labels[some]), state):
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                p -= speed * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        if len(asked):
            now = _loss(net, [texts[i] for i in asked], labels[asked])
            since = 0 if now < least else since + 1
            if now < least:
                least, kept = now, [p.copy() for p in net.parameters()]
            if since >= patience:
                break
    for p, q in zip(net.parameters(), kept or []):
        p[:] = q
    return net


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit_quality(docs: DataFrame, labels: DataFrame, *, most_rows: int = 3000, most_bytes: int = 1 << 16, epochs: int = 24, label: str = "quality") -> Network:
    """Fit on a bounded sample: at most `most_rows` labelled documents that are not held out, chosen by a hash of their ids,
    and of these the ones of `most_bytes` bytes or fewer, as whole texts.

    The bound holds for the ids (a top-k by hash, never a full sort) and for the bytes, so what is broadcast and what
    reaches the driver is bounded too. Scoring is not: it takes every text whole. Rows whose label or id is null, and ids with two labels, teach nothing.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows).select("doc_id", "y")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = text.where(F.octet_length("text") <= most_bytes).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("y").alias("y"), F.min("text").alias("text")).orderBy("doc_id").toArrow()
    return fit([t.encode() for t in rows.column("text").to_pylist()], np.array(rows.column("y").to_pylist(), np.float32), epochs=epochs)


def score_quality(docs: DataFrame, net: Network, *, threshold: float = 0.3, score_name: str = "score", predicted_name: str = "predicted") -> DataFrame:
    """docs with score (double, 0 to 1, higher: label 1 is likelier) and predicted (int): score >= threshold.

    Only the bytes of the whole text are read; a null text counts as empty and is scored like one. All rows and all other
    columns pass through, but for own columns of these two names, which are replaced. Tasks work on slices of a few
    hundred kilobytes and on filters of fixed size, so memory does not depend on the input.
    """
    tables: list[np.ndarray] = []
    own = docs.drop(score_name, predicted_name)
    text = free_name("text_bytes", [*own.columns, score_name])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = tables or _pairs(net.conv)
        for batch in slices(batches, text, 1 << 18):
            p = score(net, *utf8(batch.column(text)), made)
            rest = batch.drop_columns([text])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(p)], names=[*rest.schema.names, score_name])

    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in own.schema), f"`{score_name}` double"])
    scored = own.withColumn(text, F.coalesce(F.col("text").cast("string"), F.lit(""))).mapInArrow(run, schema)
    return scored.withColumn(predicted_name, (F.col(f"`{score_name}`") >= threshold).cast("int"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    # Only the id goes with the text into the network's tasks.
    scored = score_quality(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), net)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
