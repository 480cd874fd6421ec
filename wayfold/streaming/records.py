"""A store of stall records that batches of reports amend: only the buckets that a batch touches are written again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REPORTS = "owner long, session long, what string, at long, n long, ms long, flag boolean"
RECORDS = (
    "owner long, session long, first struct<at: long, n: long, at_stall: boolean>, stalls long, last_at long, "
    "verdict struct<at: long, rendering: boolean>, recovered struct<at: long, ms: long>, slot int"
)


def session_records(reports: DataFrame) -> DataFrame:
    """Reports (owner, session, what, at, n, ms, flag) as records, one for each session, without slots."""
    is_ = lambda what: F.col("what") == what
    return reports.groupBy("owner", "session").agg(
        F.min(F.when(is_("stall"), F.struct("at", "n", F.col("flag").alias("at_stall")))).alias("first"),
        F.count_if(is_("stall")).alias("stalls"),
        F.max(F.when(is_("stall"), F.col("at"))).alias("last_at"),
        F.max(F.when(is_("verdict"), F.struct("at", F.col("flag").alias("rendering")))).alias("verdict"),
        F.max(F.when(is_("resume"), F.struct("at", "ms"))).alias("recovered"),
    )


def merged(records: DataFrame) -> DataFrame:
    """Records of the same session put together: the first stall stays, later ones are counted, verdict and recovery are
    amended (where they come after the first stall). An owner keeps the records of two sessions: slot 0 is the one that
    stalled last for the first time, slot 1 the one before it, which steps back when a new one comes."""
    one = records.groupBy("owner", "session").agg(
        F.min("first").alias("first"), F.sum("stalls").alias("stalls"), F.max("last_at").alias("last_at"), F.max("verdict").alias("verdict"), F.max("recovered").alias("recovered")
    )
    one = one.where("stalls > 0")
    for c in ("verdict", "recovered"):
        one = one.withColumn(c, F.when(F.col(f"{c}.at") >= F.col("first.at"), F.col(c)))
    slot = F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("first.at"), F.desc("session"))) - 1
    return one.withColumn("slot", slot).where("slot < 2").select("owner", "session", "first", "stalls", "last_at", "verdict", "recovered", "slot")


class RecordStore:
    """Records by owner in buckets under a folder that all executors share.

    Batch b writes `data/batch=b/bucket=k` for the buckets k that it touches, each from that bucket's latest version before b,
    and then one small table `index/batch=b` that says for every bucket which batch wrote it last. A batch is there once its
    index is; one that is run again starts from the same versions and overwrites its own, so it changes nothing. Buckets are a
    fixed number for a store: they are to grow with the number of owners, not with the reports.
    """

    def __init__(self, spark: SparkSession, path: str, *, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _index(self, before: int | None) -> list[tuple[int, int]]:
        """(bucket, batch) of the newest index, or of the newest one of a batch before a given one."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/index")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        done = [int(s.getPath().getName().split("=")[1]) for s in files.listStatus(folder) if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{s.getPath()}/_SUCCESS"))]
        done = [b for b in done if before is None or b < before]
        return [tuple(r) for r in self.spark.read.parquet(f"{self.path}/index/batch={max(done)}").select("bucket", "batch_of").collect()] if done else []

    def _read(self, index: list[tuple[int, int]]) -> DataFrame:
        if not index:
            return self.spark.createDataFrame([], RECORDS)
        return self.spark.read.schema(RECORDS).parquet(*(f"{self.path}/data/batch={b}/bucket={k}" for k, b in index))

    def read(self) -> DataFrame:
        return self._read(self._index(None))

    def upsert(self, batch: DataFrame, number: int) -> None:
        """Amend the store by a batch of reports; the signature is that of foreachBatch. Batches come in order of time: a verdict or a
        recovery amends what is kept by then. Reports without an owner or a session are left out."""
        bucket = F.pmod(F.xxhash64("owner"), F.lit(self.buckets)).cast("int")
        path = f"{self.path}/data/batch={number}"
        fresh = session_records(batch.where("owner is not null and session is not null"))
        index = dict(self._index(number))
        touched = [r[0] for r in fresh.select(bucket).distinct().collect()]
        old = self._read([(k, index[k]) for k in touched if k in index])
        out = merged(old.drop("slot").unionByName(fresh)).withColumn("bucket", F.pmod(F.xxhash64("owner"), F.lit(self.buckets)).cast("int"))
        out.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        written = [r[0] for r in self.spark.read.parquet(path).select("bucket").distinct().collect()] if touched and self._has_files(path) else []
        # The number of buckets bounds this list.
        rows = [(k, b) for k, b in sorted({**index, **{k: number for k in written}}.items())]
        self.spark.createDataFrame(rows, "bucket int, batch_of long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/index/batch={number}")

    def _has_files(self, path: str) -> bool:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return any(s.isDirectory() for s in folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(folder))
