"""Life of a schedule as tables: validation, merging, subsets, differences."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators.joins import broadcast_if_small

@dataclass
class Schedule:
    """Tables of a schedule. pattern_stops (p, i, d[, ir, id, u]); trips (trip, r, p, days); stop_times (trip, i, t).

    document (native, insets, ranges): the stated number of supplied shapes, and how long the two lists by shape are (null:
    not there); range_counts (s, n): call-out ranges of each shape.
    """

    systems: DataFrame
    routes: DataFrame
    shapes: DataFrame
    patterns: DataFrame
    pattern_stops: DataFrame
    trips: DataFrame
    stop_times: DataFrame
    inset_runs: DataFrame | None = None
    document: DataFrame | None = None
    range_counts: DataFrame | None = None


def _lines(df: DataFrame, rule: str, idx: Column, detail: str) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), idx.cast("long").alias("idx"), F.lit(detail).alias("detail"))


def _found(df: DataFrame, rule: str, idx: Column, details: dict[str, str]) -> DataFrame:
    """A line for each detail whose condition holds, from one reading of df."""
    hits = F.array_compact(F.array(*[F.when(F.expr(condition), detail) for detail, condition in details.items()]))
    return df.select(F.lit(rule).alias("rule"), idx.cast("long").alias("idx"), F.explode(hits).alias("detail"))


def _finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(c) < F.lit(float("inf")))


def shape_lengths(points: DataFrame) -> DataFrame:
    """(s, n, length, bad) of polylines (s, k, x, y)."""
    w = Window.partitionBy("s").orderBy("k")
    step = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    return points.withColumn("_l", F.coalesce(step, F.lit(0.0))).groupBy("s").agg(F.count("*").alias("n"), F.sum("_l").alias("length"), F.count_if(~(_finite("x") & _finite("y"))).alias("bad"))


def violations(d: Schedule) -> DataFrame:
    """(rule, idx, detail): every violation, none for a sound schedule; each rule is a filter, anti-join or window.

    Patterns, their stops and shapes grow with the schedule, so they are only broadcast where they were counted: Spark's estimate by
    the size of compressed files is far too low for them.
    """
    lengths = shape_lengths(d.shapes)
    order = Window.partitionBy("p").orderBy("i")
    stops = d.pattern_stops.withColumn("_b", F.lag("d").over(order))
    per = stops.groupBy("p").agg(F.count("*").alias("n"), F.count_if(~_finite("d")).alias("bad"), F.count_if(F.col("d") < F.col("_b")).alias("back"), F.min("d").alias("lo"), F.max("d").alias("hi"))
    pat = d.patterns.where("s is not null").join(broadcast_if_small(lengths.select("s", "length"), otherwise="merge"), "s", "left").join(per.hint("merge"), "p", "left")
    stop_times = d.stop_times.withColumn("_b", F.lag("t").over(Window.partitionBy("trip").orderBy("i")))
    counts = stop_times.groupBy("trip").agg(F.count("*").alias("n"), F.count_if(~_finite("t")).alias("bad"), F.count_if(F.col("t") < F.col("_b")).alias("back"))
    known = d.patterns.select("p", "s", F.lit(True).alias("_p")).join(per.select("p", F.col("n").alias("pn")).hint("merge"), "p", "full")
    trip = d.trips.join(d.routes.select("r", F.lit(True).alias("_r")), "r", "left").join(counts.hint("merge"), "trip", "left").join(broadcast_if_small(known, otherwise="merge"), "p", "left")
    empty = lambda t, name: t.limit(1).agg(F.count("*").alias("c")).where("c = 0").select(F.lit("V1").alias("rule"), F.lit(0).cast("long").alias("idx"), F.lit(f"no {name}").alias("detail"))
    found = [
        empty(d.routes, "routes"),
        empty(d.trips, "trips"),
        _lines(lengths.where("n < 2 or bad > 0"), "V2", F.col("s"), "polyline"),
        _lines(d.routes.join(d.systems, "sy", "left_anti"), "V6", F.col("r"), "system"),
        _found(pat, "V7", F.col("p"), {"shape": "length is null", "distances": "n is null or n < 2 or bad > 0", "outside shape": "lo < 0 or hi > length + 1", "backward": "back > 0"}),
        _found(trip, "V10", F.col("trip"), {"route": "_r is null", "pattern": "_p is null or s is null", "stop count": "_p and s is not null and not (n <=> pn)", "times": "bad > 0", "days": "days is null or days <= 0 or days >= 128"}),
        _lines(counts.where("back > 0"), "V10", F.col("trip"), "backward times"),
    ]
    if d.document is not None:
        sizes = d.document.crossJoin(F.broadcast(lengths.agg(F.count("*").alias("n_shapes"))))
        zero = F.lit(0)
        found += [
            _lines(sizes.where("native < 0 or native > n_shapes or native <> floor(native)"), "V3", zero, "native shapes"),
            _lines(sizes.where("insets is null or insets <> n_shapes"), "V4", zero, "insets"),
            _lines(sizes.where("ranges <> n_shapes"), "V4", zero, "ranges"),
        ]
    if d.range_counts is not None:
        runs = d.inset_runs.groupBy("s").agg(F.count("*").alias("runs"))
        both = d.range_counts.join(runs, "s", "full")
        found.append(_lines(both.where("coalesce(n, 0) <> coalesce(runs, 0)"), "V4", F.col("s"), "ranges and runs"))
    if "ir" in d.pattern_stops.columns:
        runs = d.inset_runs
        s = d.pattern_stops.join(d.patterns, "p").join(runs.select("s", F.col("run").alias("ir"), F.col("length").alias("run_length")), ["s", "ir"], "left")
        w = Window.partitionBy("p", "ir").orderBy("i")
        s = s.withColumn("_b", F.coalesce(F.lag("id").over(w), F.lit(0.0)))
        found += [
            _lines(s.where("ir < -1 or (ir >= 0 and run_length is null)"), "V8", F.col("p"), "inset run"),
            _lines(s.where("ir >= 0 and (id is null or id < _b or id > run_length + 1)"), "V8", F.col("p"), "inset distance"),
        ]
        r = runs.withColumn("_b", F.coalesce(F.lag("u0").over(Window.partitionBy("s").orderBy("run")), F.lit(0.0)))
        found.append(_lines(r.where("u0 is null or u1 is null or not (_b <= u0 and u0 <= u1 and u1 <= 1)"), "V5", F.col("s"), "range"))
    if "u" in d.pattern_stops.columns:
        u = d.pattern_stops.withColumn("_b", F.lag("u").over(order))
        found.append(_lines(u.where("u is null or u < 0 or u > 1 or u < _b"), "V9", F.col("p"), "source distance"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def dense_ids(df: DataFrame, group: list[Column], inside: list[str], name: str) -> DataFrame:
    """df with ids 0, 1, ... in the order of group, then inside.

    Numbers inside each group come from a window by group, the groups' offsets from their counts, so no window spans the
    whole table (there are as many counts as groups).
    """
    named = df.withColumns({f"_g{i}": g for i, g in enumerate(group)})
    keys = [f"_g{i}" for i in range(len(group))]
    sizes = named.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*keys, before.alias("_o"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*inside)) - 1
    return named.withColumn("_k", number).join(offsets, keys).withColumn(name, F.col("_o") + F.col("_k")).drop(*keys, "_k", "_o")


def merge_feeds(shapes: DataFrame, patterns: DataFrame, trips: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One schedule of several feeds: shapes (feed, s, native), patterns (feed, p, s), trips (feed, trip, p).

    Ids are given anew: supplied shapes of all feeds come first, then synthesised ones; references follow their rows.
    """
    s = dense_ids(shapes, [(~F.col("native")).cast("int"), F.col("feed")], ["s"], "new_s")
    p = dense_ids(patterns, [F.col("feed")], ["p"], "new_p").join(s.select("feed", "s", "new_s"), ["feed", "s"], "left")
    t = dense_ids(trips, [F.col("feed")], ["trip"], "new_trip").join(p.select("feed", "p", "new_p"), ["feed", "p"], "left")
    return s, p, t


def subset(routes: DataFrame, patterns: DataFrame, trips: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Only the routes that keep holds for, and what they refer to."""
    r = routes.where(keep)
    t = trips.join(r.select("r"), "r", "left_semi")
    return r, patterns.join(t.select("p").distinct(), "p", "left_semi"), t


def changed_keys(before: DataFrame, after: DataFrame, key: list[str], signature: Callable[[DataFrame], Column]) -> DataFrame:
    """(key, changed) of keys that both versions have; a key's last row (by the column i) stands for it."""
    last = lambda d, name: d.groupBy(*key).agg(F.max_by(signature(d), "i").alias(name))
    return last(before, "_a").join(last(after, "_b"), key).select(*key, (~F.col("_a").eqNullSafe(F.col("_b"))).alias("changed"))
