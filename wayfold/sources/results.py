"""Keyed results on shared storage: a job runs again only where what it was made from has changed."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DIGEST = "n long, a string, b string"


def key_of(inputs: dict, code: str, settings: dict, tables: dict, group: str) -> str:
    """A digest of what a group's result depends on: inputs, code, settings and the group's rows of hand-made tables."""
    own = {name: sorted([*k, v] for k, v in rows.items() if k[0] == group) for name, rows in tables.items()}
    return hashlib.sha256(json.dumps([inputs, code, settings, own], sort_keys=True, default=str).encode()).hexdigest()


def digest_of(df: DataFrame) -> tuple[int, str, str]:
    """Rows and two sums of hashes of them: the same for the same rows in any order."""
    row = F.to_json(F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in df.columns)))
    total = lambda h: F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string")
    return tuple(df.select(F.xxhash64(row).alias("a"), F.xxhash64(F.lit(1), row).alias("b")).agg(F.count("*"), total(F.col("a")), total(F.col("b"))).first())


class Results:
    """Tables under root/group=.../key=..., each with a digest that is written after it and verified on reading."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, group: str, key: str) -> str:
        return f"{self.root}/group={group}/key={key}"

    def _exists(self, path: str) -> bool:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)

    def read(self, group: str, key: str) -> DataFrame | None:
        """The stored table, or None if there is none that was written whole, can be read and has the rows of its digest."""
        path = self._path(group, key)
        if not self._exists(f"{path}/_SUCCESS"):
            return None
        try:
            stored = self.spark.read.parquet(path)
            kept = self.spark.read.schema(_DIGEST).json(f"{path}/_digest").first() if self._exists(f"{path}/_digest/_SUCCESS") else None
            if kept is None or tuple(kept) != digest_of(stored):
                return None
        except Exception as error:  # a defect of stored files is a miss, whatever it is
            if not any(s in str(error) for s in ("PARQUET", "parquet", "UNABLE_TO_INFER_SCHEMA", "FAILED_READ_FILE", "CANNOT_READ")):
                raise
            return None
        return stored

    def write(self, group: str, key: str, df: DataFrame) -> DataFrame:
        path = self._path(group, key)
        df.write.mode("overwrite").parquet(path)
        stored = self.spark.read.schema(df.schema).parquet(path)
        self.spark.createDataFrame([digest_of(stored)], _DIGEST).write.mode("overwrite").json(f"{path}/_digest")
        return stored

    def get(self, group: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        found = self.read(group, key)
        return self.write(group, key, make()) if found is None else found
