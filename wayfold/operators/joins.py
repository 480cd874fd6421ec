"""Joins that Spark has no operator for, as compositions of equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast where its size has been counted.
SMALL_ROWS = 100_000


def bracket_join(segments: DataFrame, probes: DataFrame, key: str, at: str, *, lo: str = "ta", hi: str = "tb", last: str = "is_last") -> DataFrame:
    """As-of bracketing: the segment of the key that holds each probe; half-open, the last one closed.

    An equi-join on the key with the range as a residual: both sides move once, on the key.
    """
    inside = (F.col(at) >= F.col(lo)) & ((F.col(at) < F.col(hi)) | (F.col(last) & (F.col(at) <= F.col(hi))))
    return segments.join(probes, key).where(inside)


def as_of_join(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """left with the value of the last right row of its key at or before `at` (later rows win ties), null if none.

    Union and one window over the key: no range join, and a key's rows stream through the window in order.
    """
    carried = [c for c in left.columns if c not in (key, at)]
    a = left.select(key, at, F.lit(1).alias("_side"), F.lit(None).cast(dict(right.dtypes)[value]).alias("_v"), *carried)
    b = right.select(key, at, F.lit(0).alias("_side"), F.col(value).alias("_v"), *[F.lit(None).cast(dict(left.dtypes)[c]).alias(c) for c in carried])
    upto = Window.partitionBy(key).orderBy(at, "_side", F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn(value, F.last("_v", ignorenulls=True).over(upto)).where("_side = 1").drop("_side", "_v")


def bucket_rows(df: DataFrame, lo: Column, hi: Column, width: int, *, first: int | None = None, last: int | None = None) -> DataFrame:
    """df with a row for each bucket of `width` that [lo, hi] touches; empty intervals give none (sequence counts down)."""
    a, b = F.floor(lo / width), F.floor(hi / width)
    if first is not None:
        a = F.greatest(a, F.lit(first))
    if last is not None:
        b = F.least(b, F.lit(last))
    return df.withColumns({"_a": a, "_b": b}).where("_a <= _b").withColumn("bucket", F.explode(F.sequence("_a", "_b"))).drop("_a", "_b")


def range_join(intervals: DataFrame, points: DataFrame, lo: str, hi: str, at: str, width: int) -> DataFrame:
    """Every interval with every point in it, closed on both ends, by buckets of `width` and an equi-join on them.

    Choose a width near the mean length: an interval is repeated in each bucket it touches. A bucket with a third of the
    rows is split by adaptive execution, as the join is a plain equi-join.
    """
    left = bucket_rows(intervals, F.col(lo), F.col(hi), width)
    right = points.withColumn("bucket", F.floor(F.col(at) / width))
    return left.join(right, "bucket").where(F.col(at).between(F.col(lo), F.col(hi))).drop("bucket")


def _cells(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    return df.withColumns({"_cx": F.floor(F.col(x) / size), "_cy": F.floor(F.col(y) / size)})


def within_radius(points: DataFrame, targets: DataFrame, radius: float) -> DataFrame:
    """(point columns, t_* columns, d2): targets at most `radius` away; both have id, x, y.

    Targets stand in their cell of a grid as wide as the radius, points look in the nine cells round theirs: one equi-join.
    """
    around = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    p = _cells(points, "x", "y", radius).withColumn("_o", F.explode(around)).select(*points.columns, (F.col("_cx") + F.col("_o.dx")).alias("_cx"), (F.col("_cy") + F.col("_o.dy")).alias("_cy"))
    t = _cells(targets, "x", "y", radius).select(*[F.col(c).alias(f"t_{c}") for c in targets.columns], "_cx", "_cy")
    d2 = F.pow(F.col("x") - F.col("t_x"), 2) + F.pow(F.col("y") - F.col("t_y"), 2)
    return p.join(t, ["_cx", "_cy"]).withColumn("d2", d2).where(F.col("d2") <= radius * radius).drop("_cx", "_cy")


def nearest_within(points: DataFrame, targets: DataFrame, radius: float) -> DataFrame:
    """(id, nn_id, d2): the nearest target of each point within the radius; the least id wins ties."""
    near = within_radius(points, targets, radius)
    return near.groupBy("id").agg(F.min(F.struct("d2", F.col("t_id").alias("nn_id"))).alias("m")).select("id", "m.nn_id", "m.d2")


def nearest(points: DataFrame, targets: DataFrame, cell: float, *, most_rounds: int = 20) -> DataFrame:
    """(id, nn_id, d2): the nearest target of each point, however far.

    Grid search with a radius that doubles: points that found a target within the radius are done, the others go on. The
    count of open points falls with every round and decides when to stop; no pair beyond a point's radius is made.
    """
    done, left, radius = None, points, cell
    for _ in range(most_rounds):
        found = nearest_within(left, targets, radius)
        done = found if done is None else done.unionByName(found)
        left = left.join(found.select("id"), "id", "left_anti")
        if left.isEmpty():
            return done
        radius *= 2
    raise RuntimeError("no target within reach")


def radius_pairs(points: DataFrame, radius: float) -> DataFrame:
    """(a, b, d2): pairs of different points at most `radius` apart, a < b."""
    return within_radius(points, points, radius).where("id < t_id").select(F.col("id").alias("a"), F.col("t_id").alias("b"), "d2")


def broadcast_if_small(df: DataFrame, rows: int = SMALL_ROWS, *, otherwise: str | None = None) -> DataFrame:
    """A broadcast hint where a bounded count shows that df is small; beyond it no hint, or the one that `otherwise` names."""
    if df.limit(rows + 1).count() <= rows:
        return F.broadcast(df)
    return df if otherwise is None else df.hint(otherwise)
