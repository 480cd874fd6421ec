"""Spelling variants: a frontier of (word, position, node, edits) states walks a trie of all words, level by level."""

from __future__ import annotations

import functools
import os
import re
import uuid
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.common import cut, shared_dir, slices, texts_of

#: Maximal runs of these letters are words.
LETTERS = "[A-Za-z\u00C0-\u00FF]+"
#: What a row of the frontier is: on its own path, on another one by one edit, or a pair that was found.
_ZERO, _ONE, _PAIR = 0, 1, 2


#: Byte lengths up to which a word's checksum is put together from its own and the text's.
_SHORT = 64


def _shifted(seeds: np.ndarray) -> np.ndarray:
    """What each start value adds (by exclusive or) to the crc32 of 0 to _SHORT bytes that follow it."""
    zeros = bytes(_SHORT)
    plain = [zlib.crc32(zeros[:k]) for k in range(_SHORT + 1)]
    return np.array([[zlib.crc32(zeros[:k], s) ^ p for k, p in enumerate(plain)] for s in seeds.tolist()], np.uint32)


def _counter(least_letters: int, modulus: int, most: int):
    """Count the words of each task's texts, in dictionaries of some `most` words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A run that is long enough is matched whole: from its first letter to its last.
        runs = re.compile(LETTERS[:-1] + f"{{{least_letters},}}")
        lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
        slot_of: defaultdict[str, int] = defaultdict()
        slot_of.default_factory = slot_of.__len__
        words, crc, size, total = [], np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
        odd: Counter[str] = Counter()

        def rows() -> Iterator[pa.RecordBatch]:
            held = list(slot_of)
            for w, n in ((held, total), (list(odd), np.array(list(odd.values()), np.int64))):
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(n, pa.int64())], names=["word", "n"])

        for batch in slices(batches, "text", 4 << 20):
            own = [runs.findall(t.translate(lower).decode()) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            slots = np.fromiter(chain.from_iterable(map(slot_of.__getitem__, x) for x in own), np.int64)
            fresh = list(islice(slot_of, len(crc), None))
            coded = [w.encode() for w in fresh]
            words += fresh
            crc = np.concatenate([crc, np.array([zlib.crc32(c) for c in coded], np.uint32)])
            size = np.concatenate([size, np.array([len(c) for c in coded], np.int64)])
            seeds = np.array([zlib.crc32(b":" if d is None else b"%d:" % d) for d in batch.column("doc_id").to_pylist()], np.uint32)
            doc = np.repeat(np.arange(len(own)), [len(x) for x in own])
            h = crc[slots] ^ _shifted(seeds)[doc, np.minimum(size[slots], _SHORT)]
            for k in np.flatnonzero(size[slots] > _SHORT).tolist():
                h[k] = zlib.crc32(words[slots[k]].encode(), int(seeds[doc[k]]))
            hit = h % np.uint32(modulus) == 0
            for s, x in zip(slots[hit].tolist(), h[hit].tolist()):
                at = x % len(words[s])
                odd[words[s][:at] + words[s][at + 1 :]] += 1
            grown = np.bincount(slots[~hit], minlength=len(slot_of))
            grown[: len(total)] += total
            total = grown
            if len(slot_of) >= most:
                yield from rows()
                slot_of.clear()
                odd.clear()
                words, crc, size, total = [], crc[:0], size[:0], total[:0]
        yield from rows()

    return count


def word_counts(docs: DataFrame, *, least_letters: int = 6, least_n: int = 5, modulus: int = 199, most: int = 1 << 19) -> DataFrame:
    """(word, n) of the words that are long and frequent enough, counted over all whole texts.

    Let h be the crc32 of '<doc_id>:<run>'; where `modulus` divides it, the run loses the code point at h % length.
    """
    words = texts_of(docs).mapInArrow(_counter(least_letters, modulus, most), "word string, n long").where((F.col("n") > 0) & (F.char_length("word") >= least_letters))
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def _shared(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the common prefix."""
    return pd.Series([len(os.path.commonprefix(p)) for p in zip(a, b)], dtype="int32")


def _ends(groups: DataFrame, depth: Column) -> DataFrame:
    """Groups of words with (lo, hi, size) under one edge: where the edge ends, what it spells after `depth`, and the word that ends there."""
    groups = groups.withColumn("end", F.when(F.col("size") == 1, F.char_length("lo.w")).otherwise(F.pandas_udf(_shared, "int")(F.col("lo.w"), F.col("hi"))))
    last = F.when(F.char_length("lo.w") == F.col("end"), F.col("lo"))
    return groups.withColumn("label", F.substring("lo.w", depth + 1, F.col("end") - depth)).withColumn("last", last)


def _group() -> list[Column]:
    return [F.min("wid").alias("child"), F.min(F.struct("w", "n")).alias("lo"), F.max("w").alias("hi"), F.count(F.lit(1)).alias("size")]


def _level(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of the frontier, written apart by kind in the shared folder and read back."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/wayfold-frontier-{uuid.uuid4().hex}"
    rows.withColumn("last", F.when(F.col("kind") == _PAIR, F.col("last"))).write.option("compression", "zstd").partitionBy("kind").parquet(path)
    back = spark.read.schema(rows.schema).parquet(path)
    return tuple(back.where(F.col("kind") == k).drop("kind") for k in (_ZERO, _ONE, _PAIR))


def near_words(words: DataFrame, *, least_letters: int = 6) -> DataFrame:
    """(word, n, near, near_n) for every ordered pair of different words of (word, n) that are one edit apart.

    Words stand in two tries, one spelt forwards and one backwards. The longer word of a pair (either of equal ones) walks:
    its first difference lies in the second half of one of the two spellings, so states branch only from there on, where
    nodes have few edges. Edges of the trie spell whole unbranched stretches, so levels are as many as branchings on one
    path, whatever the words' lengths. A level's edges are the least and greatest word of each (node, letter), which are
    pre-aggregated, and one row of the edge table. States ask for edges by node and letter; only those that replace a letter
    meet all edges of a node, at most one for each letter. An edge is one row at every node, so the states of a hot node can
    be split. A state that ends on a word is a pair.
    """
    own = words.select(F.col("word").alias("w"), "n")
    both = own.withColumn("back", F.lit(False)).union(own.select(F.reverse("w"), "n", F.lit(True)))
    base = cut(both.select("w", "n", "back").withColumn("wid", F.monotonically_increasing_id()), "words")
    # Letters before the earliest possible branching make the first edge.
    first = F.substring("w", 1, least_letters // 2)
    stems = _ends(base.groupBy("back", first.alias("stem")).agg(*_group()).where("size > 1"), F.lit(0))
    start = base.withColumn("stem", first).join(stems.select("back", "stem", "child", "end", "last"), ["back", "stem"])
    left = F.char_length("w") - F.col("end")
    state = [F.col(c) for c in ("w", "n", "back")]
    walk = start.where(left > 0).select(F.lit(_ZERO).alias("kind"), *state, "wid", F.col("end").alias("pos"), F.col("child").alias("nid"), F.col("end").alias("depth"), "last")
    short = start.where((left == 1) & F.col("last").isNotNull()).select(F.lit(_PAIR).alias("kind"), *state, "wid", F.lit(0).alias("pos"), F.lit(None).cast("long").alias("nid"), F.lit(0).alias("depth"), "last")
    zero, one, found = _level(walk.union(short))
    pairs = [found]
    pos, length = F.col("pos"), F.char_length("w")
    here, then = F.substring("w", pos + 1, F.lit(1)), F.substring("w", pos + 2, F.lit(1))
    size = F.char_length("label")

    def spelt(at: Column, skip: int = 0) -> Column:
        """The edge's letters after `skip` are the word's after position `at`."""
        return F.substring("w", at + 1, size - skip) == F.substring("label", F.lit(skip + 1), size - skip)

    while not zero.isEmpty():
        zero, one = zero.drop("last"), one.drop("last")
        edges = _ends(zero.groupBy("nid", "depth", here.alias("letter")).agg(*_group()), F.col("depth"))
        edges = cut(edges.select("nid", "letter", "label", "child", "end", "last", F.col("size").alias("held")), "edges")
        late = zero.where(2 * pos >= length - 1)
        # By the next letter: states on their own path, and those that left out one letter, here or before.
        asks = zero.select("*", here.alias("letter"), pos.alias("at"), F.lit(_ZERO).alias("to"))
        asks = asks.union(late.where((then != here) & (then != "")).select("*", then.alias("letter"), (pos + 1).alias("at"), F.lit(_ONE).alias("to")))
        asks = asks.union(one.where(here != "").select("*", here.alias("letter"), pos.alias("at"), F.lit(_ONE).alias("to")))
        asked = asks.join(edges, ["nid", "letter"]).where(spelt(F.col("at"))).select(*state, "wid", "to", (F.col("at") + size).alias("at"), "child", "end", "last", "held")
        # Any other letter in place of the word's: the lesser letter looks for the greater one.
        others = late.join(edges, "nid").where((F.col("letter") > here) & spelt(pos + 1, 1)).select(*state, "wid", F.lit(_ONE).alias("to"), (pos + size).alias("at"), "child", "end", "last", "held")
        moved = asked.union(others)
        rest = F.char_length("w") - F.col("at")
        pair = F.col("last").isNotNull() & (rest == 1 - F.col("to"))
        goes = (F.col("held") > 1) & (rest > 0)
        kinds = F.when(goes & pair, F.array(F.col("to"), F.lit(_PAIR))).when(goes, F.array("to")).when(pair, F.array(F.lit(_PAIR)))
        moved = moved.where(goes | pair).select(F.explode(kinds).alias("kind"), *state, "wid", F.col("at").alias("pos"), F.col("child").alias("nid"), F.col("end").alias("depth"), "last")
        zero, one, found = _level(moved)
        pairs.append(found)
    found = functools.reduce(DataFrame.union, pairs)
    turned = lambda c: F.when(F.col("back"), F.reverse(c)).otherwise(F.col(c))
    found = found.select(turned("w").alias("word"), "n", turned("last.w").alias("near"), F.col("last.n").alias("near_n")).distinct()
    found = found.where(F.levenshtein("word", "near") == 1)
    return cut(found.union(found.select("near", "near_n", "word", "n")).distinct(), "near")


def follow_forms(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the last word of each chain, by doubling the way at every round."""
    now = cut(forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = cut(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = after.select("word", "root")
        if after.where("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, *, least_letters: int = 6, least_n: int = 5, modulus: int = 199, factor: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n): near words of every frequent word, and the word each is a variant of.

    A word's form is its near word of largest n (of those the smallest in code-point order) where that n is `factor` times its
    own or more; its root is the last word along forms. Near words are found by `near_words`.

    A null or empty text has no words; a null doc_id counts as an empty one in the letters to drop; repeated rows count as
    often as they stand; an empty table gives no rows; other columns are ignored.
    """
    words = cut(word_counts(docs, least_letters=least_letters, least_n=least_n, modulus=modulus), "words")
    near = near_words(words, least_letters=least_letters)
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    is_form = -F.col("best.m") >= factor * F.col("n")
    known = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.m")).alias("form_n")
    )
    known = cut(known, "forms")
    roots = follow_forms(known)
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
