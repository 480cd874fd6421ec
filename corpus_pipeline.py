"""A corpus pipeline of five stages: quality, boilerplate lines, near-duplicates, benchmark leaks, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.common import cut, free_name, meet, table
from wayfold.llm.jaccard import jaccard_components
from wayfold.llm.lines import drop_recurring_lines
from wayfold.llm.packing import pack
from wayfold.llm.quality import fit_quality, score_quality
from wayfold.llm.tiling import benchmark_leaks


def _keyed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text, print): each row as it is, its id, its text (null: empty) and a hash of the text."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("print"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network accepts; null texts are judged as empty ones, rows of one id each by its text."""
    net = fit_quality(docs, table(spark, sf_dir, "labels"))
    score, good = free_name("score", docs.columns), free_name("predicted", docs.columns)
    return score_quality(docs, net, score_name=score, predicted_name=good).where(F.col(good) == 1).select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without recurring lines; a document goes only if nothing is left of it: all it held stays in earlier ones.

    Texts that lose nothing stay as they are, null ones too; n_chars, where there is one, follows the text.
    """
    out = drop_recurring_lines(_keyed(docs).select("row", "doc_id", "text"))
    cleared = F.col("n_dropped") > 0
    row = F.col("row").withField("text", F.col("text_kept"))
    row = row.withField("n_chars", F.char_length("text_kept").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else row
    kept = out.where(~(cleared & (F.trim(F.regexp_replace("text_kept", r"\s+", " ")) == "")))
    return kept.select(F.when(cleared, row).otherwise(F.col("row")).alias("row")).select("row.*").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, a similarity of 0.8): the one with the least id.

    Rows without an id are nobody's copies. Rows that share an id are documents of their own, copies too if their texts are
    equal or near: of these the one with the least text hash keeps the id, and the others come after all ids.
    """
    own = _keyed(docs)
    by_text = own.where("doc_id is not null").groupBy("doc_id", "print").agg(F.count("*").alias("n"))
    shared = by_text.groupBy("doc_id").agg(F.sum("n").alias("n"), F.min("print").alias("least")).where("n > 1").select("doc_id", "least")
    shared = cut(shared, "shared")
    if shared.isEmpty():
        named = jaccard_components(docs, width=5, percent=80)
        copies = cut(named.where("doc_id <> component_id").select("doc_id").distinct(), "copies")
        return meet(own.select("row", "doc_id"), copies.hint("shuffle_hash"), ["doc_id"], "left_anti").select("row.*").select(docs.columns)
    last = own.agg(F.max("doc_id")).first()[0]
    numbers = by_text.join(shared, "doc_id").select("doc_id", "print", F.when(F.col("print") == F.col("least"), F.col("doc_id")).otherwise(F.monotonically_increasing_id() + last + 1).alias("number"))
    numbers = cut(numbers, "numbers")
    numbered = own.join(numbers, ["doc_id", "print"], "left").select("row", "text", "number", F.coalesce("number", "doc_id").alias("id"))
    named = jaccard_components(numbered.select(F.col("id").alias("doc_id"), "text"), width=5, percent=80)
    copies = cut(named.where("doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct(), "copies")
    left = meet(numbered, copies.hint("shuffle_hash"), ["id"], "left_anti")
    once = left.where("number is not null").dropDuplicates(["number"])
    return left.where("number is null").select("row").union(once.select("row")).select("row.*").select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item: each row by its own text, with or without an id."""
    own = _keyed(docs).withColumn("key", F.xxhash64("doc_id", "text", "print"))
    found = benchmark_leaks(own.select(F.col("key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    leaks = cut(found.select(F.col("doc_id").alias("key")).distinct(), "leaks")
    return meet(own.select("row", "key"), leaks, ["key"], "left_anti").select("row.*").select(docs.columns)


def pack_along_curve(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return pack(docs).drop("ids")


STAGES = [
    ("quality", keep_good),
    ("line_dedup", drop_lines),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack_along_curve),
]

#: The network and the tokenizer can't be put in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
