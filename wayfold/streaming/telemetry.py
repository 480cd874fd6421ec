"""Telemetry as Structured Streaming: ingest, watchdog, first record of a session."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def shared_folder(spark: SparkSession) -> str:
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (where or f"file://{tempfile.mkdtemp(prefix='spark-')}").rstrip("/")


def records_stream(spark: SparkSession, path: str, *, own_clock: bool = False) -> DataFrame:
    """(sid, n, kind, at) from event files, on request with up, a clock of the session's own; both in milliseconds."""
    at = F.expr("datediff(cast(ts as date), date '1970-01-01') * 86400000L + (hour(ts) * 3600L + minute(ts) * 60L) * 1000L + cast(floor(extract(second from ts) * 1000) as bigint)")
    up = [F.round(F.col("value") * 100).cast("long").alias("up")] if own_clock else []
    return spark.readStream.schema(EVENTS).parquet(path).select(F.col("user_id").alias("sid"), F.col("event_id").alias("n"), F.col("event_type").alias("kind"), at.alias("at"), *up)


def ingest(spark: SparkSession, folder: str, *, most_files: int = 1000) -> DataFrame:
    """Newline-delimited JSON as (rx, at, sid, t, raw): receive stamp, typed fields, and the raw line where it is no object.

    Blank lines are dropped; a line that is not JSON, or not an object, is kept as it came.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", str(most_files)).text(folder).where(F.trim("value") != "")
    parsed = F.from_json("value", "t string, sid string, at long, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    good = parsed.isNotNull() & parsed["_bad"].isNull() & F.startswith(F.ltrim(F.col("value")), F.lit("{"))
    return lines.select(F.current_timestamp().alias("rx"), F.when(good, parsed["at"]).alias("at"), F.when(good, parsed["sid"]).alias("sid"), F.when(good, parsed["t"]).alias("t"), F.when(~good, F.col("value")).alias("raw"))


def watchdog(records: DataFrame, *, limit_ms: int, frames: tuple[str, ...] = ("view", "click", "purchase"), hidden: str = "error", visible: str = "signup") -> DataFrame:
    """(sid, n, at, silent_ms): frames after `limit_ms` of visible silence, by a state of four numbers for each session.

    Records of a session are taken in order of time inside a micro-batch; a record older than the state adds no time.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, clock, seen, shown = state.get if state.exists else (None, 0, None, True)
        out = []
        for row in pd.concat(list(parts)).sort_values(["at", "n"]).itertuples():
            if at is not None and shown:
                clock += max(0, row.at - at)
            at = row.at if at is None else max(at, row.at)
            if row.kind == hidden:
                shown = False
            elif row.kind == visible:
                shown, seen = True, clock
            elif row.kind in frames:
                if seen is not None and clock - seen >= limit_ms:
                    out.append((key[0], row.n, row.at, clock - seen))
                seen = clock
        state.update((at, clock, seen, shown))
        yield pd.DataFrame(out, columns=["sid", "n", "at", "silent_ms"])

    return records.groupBy("sid").applyInPandasWithState(step, "sid long, n long, at long, silent_ms long", "at long, clock long, seen long, shown boolean", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, tag: str) -> DataFrame:
    """Run a stream over what its source holds now, into files in the shared folder, and read them."""
    spark = stream.sparkSession
    top = f"{shared_folder(spark)}/wayfold-{tag}-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("checkpointLocation", f"{top}/checkpoint").option("path", f"{top}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{top}/out")


def keep_first(spark: SparkSession, store: str):
    """A foreachBatch function that keeps each session's first record and counts the later ones, in versions of a table.

    Every batch writes a new version from the one before it; a batch that is run again writes its version again.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        new = batch.groupBy("sid").agg(F.min(F.struct("at", "n", "kind")).alias("first"), F.count("*").alias("count"))
        if number:
            old = batch.sparkSession.read.parquet(f"{store}/version={number - 1}")
            new = old.unionByName(new).groupBy("sid").agg(F.min("first").alias("first"), F.sum("count").alias("count"))
        new.write.mode("overwrite").parquet(f"{store}/version={number}")

    return upsert
