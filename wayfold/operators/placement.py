"""Placing stops and vehicles along runs and shapes; stretches where a path leaves a stroke and comes back."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators.geometry import edges, feet
from wayfold.operators.joins import nearest_within


def inset_place(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """rows with (run, dist): the place in a call-out of a vehicle between two stops, null where it is in none.

    rows: id, s, ra, rb (the stops' runs or -1), da, db (way along them), ua, ub (fractions of the source shape or null),
    f (0 to 1 between the stops). runs: s, run, u0, u1 (null where a schedule has no ranges), length.

    A shape has a handful of runs; they come as one array by shape, so the look-up is one join on the shape.
    """
    lists = runs.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("run", "u0", "u1", "length"))).alias("_runs"))
    r = rows.join(lists, "s", "left").withColumn("_at", F.col("ua") + (F.col("ub") - F.col("ua")) * F.col("f"))
    hit = F.get(F.filter("_runs", lambda x: F.col("_at").between(x["u0"], x["u1"])), F.lit(0))
    own = F.get(F.filter("_runs", lambda x: x["run"] == F.col("ra")), F.lit(0))
    ranged = F.col("ua").isNotNull() & F.exists("_runs", lambda x: x["u0"].isNotNull())
    r = r.withColumns({"_hit": hit, "_own": own, "_ranged": F.coalesce(ranged, F.lit(False))})
    at_a, at_b = F.col("ra") == F.col("_hit.run"), F.col("rb") == F.col("_hit.run")
    lo, hi = F.when(at_a, F.col("ua")).otherwise(F.col("_hit.u0")), F.when(at_b, F.col("ub")).otherwise(F.col("_hit.u1"))
    d0, d1 = F.when(at_a, F.col("da")).otherwise(0.0), F.when(at_b, F.col("db")).otherwise(F.col("_hit.length"))
    g = F.when(hi > lo, F.least(F.greatest((F.col("_at") - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    same = (F.col("ra") >= 0) & (F.col("ra") == F.col("rb"))
    entering, leaving = (F.col("ra") < 0) & (F.col("rb") >= 0), (F.col("ra") >= 0) & (F.col("rb") < 0)
    run = F.when(same, F.col("ra")).when(F.col("_ranged"), F.col("_hit.run")).when(entering, F.col("rb")).when(leaving, F.col("ra"))
    dist = (
        F.when(same, F.col("da") + (F.col("db") - F.col("da")) * F.col("f")).when(F.col("_ranged"), d0 + (d1 - d0) * g)
        .when(entering, F.col("db") * F.col("f")).when(leaving, F.col("da") + (F.col("_own.length") - F.col("da")) * F.col("f"))
    )
    return r.withColumns({"run": run, "dist": dist}).drop("_runs", "_at", "_hit", "_own", "_ranged")


def inset_stops(stops: DataFrame, runs: DataFrame, run_points: DataFrame) -> DataFrame:
    """(id, run, d): the run of each stop (id, u, x, y) by its source fraction, -1 for none, and its place along it.

    runs: run, u0, u1 of one shape; run_points: run, k, x, y. The first range that holds u wins.
    """
    near = stops.join(F.broadcast(runs), F.col("u").between(F.col("u0"), F.col("u1")), "left").groupBy("id", "x", "y").agg(F.min("run").alias("run"))
    lines = edges(run_points.withColumnRenamed("run", "s"))
    foot = feet(near.where("run is not null").select("id", F.col("run").alias("s"), "x", "y"), lines)
    return near.join(foot.select("id", "arc"), "id", "left").select("id", F.coalesce("run", F.lit(-1)).alias("run"), F.coalesce("arc", F.lit(0.0)).alias("d"))


def measured_positions(shape: DataFrame, stops: DataFrame, *, most_metres: float = 150.0) -> DataFrame:
    """(key, i, u): fraction of the source shape at each stop's measure; null for a whole key that can't be trusted.

    shape: key, k, lon, lat, m; stops: key, i, lon, lat, m. Measures of the shape must rise, those of stops must not fall
    and lie on it, and each place must be near the stop.
    """
    metre, deg = 111_320.0, math.pi / 180
    w = Window.partitionBy("key").orderBy("k")
    step = F.hypot((F.col("lon") - F.lag("lon").over(w)) * F.cos(F.col("lat") * deg), F.col("lat") - F.lag("lat").over(w)) * metre
    cum = F.sum(F.coalesce("_step", F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    v = shape.withColumn("_step", step).withColumn("c0", cum).withColumns({c: F.lead(o).over(w) for c, o in (("m1", "m"), ("lon1", "lon"), ("lat1", "lat"))})
    v = v.withColumn("c1", F.lead("c0").over(w)).withColumn("_last", F.lead("k", 2).over(w).isNull())
    good = v.groupBy("key").agg((F.count_if(F.col("m").isNull()) == 0).alias("a"), (F.count_if(F.col("m1") <= F.col("m")) == 0).alias("b"), F.max("c0").alias("total"))
    seg = v.where("m1 is not null and m is not null").select("key", "c0", "c1", F.col("m").alias("m0"), "m1", F.col("lon").alias("lon0"), F.col("lat").alias("lat0"), "lon1", "lat1", "_last")
    o = Window.partitionBy("key").orderBy("i")
    s = stops.withColumn("_back", F.coalesce(F.col("m") < F.lag("m").over(o), F.lit(False)))
    on = (F.col("m") >= F.col("m0")) & ((F.col("m") < F.col("m1")) | (F.col("_last") & (F.col("m") <= F.col("m1"))))
    f = (F.col("m") - F.col("m0")) / (F.col("m1") - F.col("m0"))
    hit = s.alias("s").join(seg.withColumnRenamed("key", "_key"), (F.col("key") == F.col("_key")) & on, "left").withColumn("_f", f)
    far = F.hypot((F.col("lon0") + (F.col("lon1") - F.col("lon0")) * F.col("_f") - F.col("lon")) * F.cos(F.col("lat") * deg), F.col("lat0") + (F.col("lat1") - F.col("lat0")) * F.col("_f") - F.col("lat")) * metre
    hit = hit.withColumns({"_at": F.col("c0") + (F.col("c1") - F.col("c0")) * F.col("_f"), "_bad": F.coalesce(F.col("_back") | (far > most_metres), F.lit(True))})
    whole = hit.groupBy("key").agg(F.max("_bad").alias("bad"))
    out = hit.select("key", "i", "_at").join(whole, "key").join(good, "key", "left")
    return out.select("key", "i", F.when(F.col("a") & F.col("b") & ~F.col("bad"), F.col("_at") / F.col("total")).alias("u"))


def rejoins(samples: DataFrame, ink: DataFrame, *, step: float, contact: float = 2.0, ride: float = 12.0, leave: float = 7.0, rejoin: float = 400.0, pairs: DataFrame | None = None) -> DataFrame:
    """(s, sid, k0, k1, off): stretches where a path that rode a stroke leaves it and comes back to it.

    samples: s, k, x, y every `step`; ink: sid, n, arc, x, y. A ride is `ride` of way within `contact` of the stroke; the
    stretch is `rejoin` long at most, and stands off by `leave` somewhere. Places far apart along the stroke are two visits.
    With pairs (s, sid) each path is held against its own strokes alone, in grid cells of each stroke.
    """
    points = ink.select(F.struct("sid", "n").alias("id"), "x", "y")
    on = nearest_within(samples.select(F.struct("s", "k").alias("id"), "x", "y"), points, contact).where(F.col("d2") < contact * contact)
    on = on.select("id.s", "id.k", "nn_id.sid")
    if pairs is not None:
        cell = lambda c: F.floor(F.col(c) / contact)
        around = lambda c: F.explode(F.array(*[cell(c) + n for n in (-1, 0, 1)]))
        strokes = ink.select("sid", F.col("x").alias("_x"), F.col("y").alias("_y"), cell("x").alias("_cx"), cell("y").alias("_cy"))
        own = samples.join(pairs, "s").withColumn("_cx", around("x")).withColumn("_cy", around("y")).join(strokes, ["sid", "_cx", "_cy"])
        on = own.where(F.pow(F.col("x") - F.col("_x"), 2) + F.pow(F.col("y") - F.col("_y"), 2) < contact * contact).select("s", "k", "sid").distinct()
    w = Window.partitionBy("s", "sid").orderBy("k")
    runs = on.withColumn("_g", F.col("k") - F.row_number().over(w)).groupBy("s", "sid", "_g").agg(F.min("k").alias("a"), F.max("k").alias("b"), F.count("*").alias("n"))
    runs = runs.where(F.col("n") >= math.ceil(ride / step))
    nxt = Window.partitionBy("s", "sid").orderBy("a")
    gaps = runs.select("s", "sid", F.col("b").alias("k0"), F.lead("a").over(nxt).alias("k1")).where((F.col("k1") - F.col("k0")) * step <= rejoin)
    inside = gaps.join(samples, "s").where(F.col("k").between(F.col("k0"), F.col("k1")))
    own = inside.join(ink.select("sid", "arc", F.col("x").alias("ix"), F.col("y").alias("iy")), "sid")
    d = F.hypot(F.col("x") - F.col("ix"), F.col("y") - F.col("iy"))
    foot = own.groupBy("s", "sid", "k0", "k1", "k").agg(F.min(F.struct(d.alias("d"), "arc")).alias("m"))
    end = lambda c: F.max(F.when(F.col("k") == F.col(c), F.col("m.arc")))
    out = foot.groupBy("s", "sid", "k0", "k1").agg(F.max("m.d").alias("off"), F.abs(end("k1") - end("k0")).alias("_apart"))
    return out.where((F.col("off") >= leave) & (F.col("_apart") <= 3 * (F.col("k1") - F.col("k0")) * step + 40)).drop("_apart")


#: Distances that `line_rejoins` holds at once.
_TILE = 1_000_000


def _touching(points: np.ndarray, ink: np.ndarray, contact: float) -> np.ndarray:
    """Which points have ink nearer than `contact`, by grid cells of that width: three stretches of sorted ink for each point."""
    low = ink.min(axis=0)
    own, theirs = (np.floor((p - low) / contact).astype(np.int64) + 1 for p in (points, ink))
    wide = max(own[:, 0].max(), theirs[:, 0].max()) + 3
    cells = theirs[:, 1] * wide + theirs[:, 0]
    order = np.argsort(cells, kind="stable")
    cells, ink = cells[order], ink[order]
    out = np.zeros(len(points), bool)
    near = np.flatnonzero((own[:, 0] >= 0) & (own[:, 0] <= theirs[:, 0].max() + 1))
    for row in (-1, 0, 1):
        middle = (own[near, 1] + row) * wide + own[near, 0]
        first, last = np.searchsorted(cells, middle - 1, "left"), np.searchsorted(cells, middle + 1, "right")
        each = last - first
        start = 0
        for stop in [*np.flatnonzero(np.diff(np.cumsum(each) // _TILE)) + 1, len(near)]:
            n, who = each[start:stop], np.repeat(near[start:stop], each[start:stop])
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[start:stop], n)
            out[who[((points[who] - ink[at]) ** 2).sum(axis=1) < contact * contact]] = True
            start = stop
    return out


def line_rejoins(line: np.ndarray, stroke: np.ndarray, *, step: float, contact: float = 2.0, ride: float = 12.0, leave: float = 7.0, rejoin: float = 400.0) -> list[tuple[int, int, float]]:
    """(k0, k1, off) of `rejoins` for the samples of one path (n, 2) and those of one stroke, both every `step`."""
    if not len(line) or not len(stroke):
        return []
    on = np.flatnonzero(_touching(line, stroke, contact))
    runs = [r for r in np.split(on, np.flatnonzero(np.diff(on) > 1) + 1) if len(r) >= math.ceil(ride / step)]
    out = []
    for k0, k1 in ((int(a[-1]), int(b[0])) for a, b in zip(runs, runs[1:])):
        if (k1 - k0) * step > rejoin:
            continue
        off, foot, rows = 0.0, {}, max(1, _TILE // len(stroke))
        for k in range(k0, k1 + 1, rows):
            part = line[k : min(k + rows, k1 + 1)]
            d = np.hypot(part[:, None, 0] - stroke[None, :, 0], part[:, None, 1] - stroke[None, :, 1])
            off = max(off, float(d.min(axis=1).max()))
            foot |= {e: int(d[e - k].argmin()) * step for e in (k0, k1) if k <= e < k + len(part)}
        if off >= leave and abs(foot[k1] - foot[k0]) <= 3 * (k1 - k0) * step + 40:
            out.append((k0, k1, off))
    return out
