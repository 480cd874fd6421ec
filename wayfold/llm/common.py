"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one of our own only where none is set and all run on one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def free_name(name: str, columns: list[str]) -> str:
    """The name, or one like it that no column has."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def cut(df: DataFrame, tag: str, *, codec: str = "zstd") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    Lost executors only cost the reading of files, and the plan so far runs once.
    """
    path = f"{shared_dir(df.sparkSession)}/wayfold-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts_of(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string): only these two columns, a null text as an empty one."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bits of a map for each key that it holds, and of a map at most; with fewer bits it tells fewer rows apart.
MAP_BITS, MOST_MAP_BITS = 8, 1 << 26


def may_have(rows: DataFrame, found: DataFrame, key: Column, found_key: Column) -> DataFrame:
    """rows with maybe: false only where no row of found has this key (64-bit hashes of what is compared).

    A bitmap of the keys is broadcast, as words of 64 bits: a word for eight keys, a million words at most. So of rows that
    are joined with a few keys only those that may meet one, and an eighth of the others, need to be moved.
    """
    bits = 1 << min(MOST_MAP_BITS.bit_length() - 1, max(10, (MAP_BITS * found.count() - 1).bit_length()))
    # Words are numbers, which rows are held against without a copy.
    word, bit = lambda x: F.shiftright(F.pmod(x, F.lit(bits)), 6), lambda x: x.bitwiseAND(63).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit(found_key))
    words = found.select(word(found_key).alias("map_word"), one.alias("one")).groupBy("map_word").agg(F.bit_or("one").alias("map"))
    known = rows.withColumns({"map_word": word(key), "map_bit": bit(key)}).join(F.broadcast(words), "map_word", "left")
    return known.withColumn("maybe", F.coalesce(F.getbit("map", F.col("map_bit")) == 1, F.lit(False))).drop("map_word", "map_bit", "map")


def meet(rows: DataFrame, found: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows.join(found, keys, how) for inner, left and left_anti; rows whose keys found lacks stay where they are. Keys have one type on both sides."""
    marked = may_have(rows, found, F.xxhash64(*keys), F.xxhash64(*keys))
    met = marked.where("maybe").drop("maybe").join(found, keys, how)
    return met if how == "inner" else met.unionByName(marked.where("not maybe").drop("maybe"), allowMissingColumns=True)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1, from 0) of a string or binary array without copying each value."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.large_binary()
    column = column.cast(pa.large_string()).cast(wide) if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.cast(wide)
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(column) else np.empty(0, np.uint8)
    return raw, off - off[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most about `most` text bytes (one longer text makes a slice of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = utf8(batch.column(text))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(off, off[start] + most, "right")) - 1
            end = max(end, start + 1)
            yield batch.slice(start, end - start)
            start = end


def components(edges: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that can be reached, for every node of edges (a, b).

    Rounds of large-star and small-star steps; each halves the depth at least, so rounds grow with the logarithm of
    the longest path. Hubs are safe: both steps are a minimum per key and a join on it, which are pre-aggregated.
    Edges are never collected.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    if now.isEmpty():
        return now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    for _ in range(most_rounds):
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo"), F.col("hi")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        small_min = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(small_min, "hi")
        small = joined.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").union(joined.select("hi", F.col("m").alias("lo"))).distinct()
        after = cut(small, "edges")
        # A fixed point is a forest of stars: nobody is both a child and a parent, and each child has one parent.
        kids = after.select("hi")
        settled = after.join(kids.withColumnRenamed("hi", "lo"), "lo", "left_semi").isEmpty() and after.groupBy("hi").count().where("count > 1").isEmpty()
        now = after
        if settled:
            break
    else:
        raise RuntimeError("components did not settle")
    kids = now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return cut(kids.union(roots).distinct(), "components")
