"""Cells of a grid: connected components and exact distances, by runs and by tiles, never a whole sheet in one task."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.streaming.telemetry import shared_folder


def _kept(df: DataFrame, tag: str) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/wayfold-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def runs_of_cells(cells: DataFrame, *, wide: int = 4096) -> DataFrame:
    """(y, x0, x1, run): maximal runs of set cells (x, y) within a row and a stripe of `wide` columns, with an id each."""
    stripe = F.floor(F.col("x") / wide)
    w = Window.partitionBy("y", "stripe").orderBy("x")
    own = cells.where("x is not null and y is not null").select("x", "y").distinct().withColumn("stripe", stripe)
    own = own.withColumn("at", F.col("x") - F.row_number().over(w))
    runs = own.groupBy("y", "stripe", "at").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("at")
    return _kept(runs.select("y", "x0", "x1", "stripe").withColumn("run", F.monotonically_increasing_id()), "runs")


def _touching(runs: DataFrame) -> DataFrame:
    """(a, b): runs of which some cells are neighbours, diagonals among them: in the next row, or at a stripe's edge."""
    # A run meets those of the row below that begin no later than its end + 1 and end no earlier than its start - 1.
    # Runs of one row and stripe are apart, so both stand in order: they are joined by row and stripe, and by place in it.
    side = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    near = runs.select("run", "y", "x0", "x1", "stripe", side.alias("side")).select(F.col("run").alias("a"), (F.col("y") + 1).alias("y"), F.col("x0").alias("a0"), F.col("x1").alias("a1"), (F.col("stripe") + F.col("side")).alias("stripe"))
    below = near.join(runs, ["y", "stripe"]).where("x0 <= a1 + 1 and x1 >= a0 - 1").select("a", F.col("run").alias("b"))
    right = runs.select(F.col("run").alias("a"), "y", (F.col("x1") + 1).alias("x0")).join(runs.select("y", "x0", F.col("run").alias("b")), ["y", "x0"]).select("a", "b")
    return below.union(right)


def _least_reachable(links: DataFrame) -> DataFrame:
    """(node, root): the least node that can be reached over links (a, b), by rounds that halve the way to it."""
    now = _kept(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct(), "links")
    while not now.isEmpty():
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        joined = large.join(large.groupBy("hi").agg(F.min("lo").alias("m")), "hi")
        small = joined.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").union(joined.select("hi", F.col("m").alias("lo"))).distinct()
        after = _kept(small, "links")
        stars = after.join(after.select(F.col("hi").alias("lo")), "lo", "left_semi").isEmpty() and after.groupBy("hi").count().where("count > 1").isEmpty()
        now = after
        if stars:
            break
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(now.select("lo", "lo").distinct())


def components(cells: DataFrame, *, wide: int = 4096) -> DataFrame:
    """(y, x0, x1, label, size): runs of set cells (x, y) with the component that they are part of, by eight neighbours, and
    how many cells it has. A label is the id of one of the component's runs.

    Cells are packed into runs, runs are linked over neighbouring rows and stripes, and links are resolved in rounds that
    shrink every way by half or more. Repeated cells count once, cells without a coordinate are left out.
    """
    runs = runs_of_cells(cells, wide=wide)
    roots = _least_reachable(_touching(runs))
    own = runs.join(roots, runs["run"] == roots["node"], "left").select("y", "x0", "x1", F.coalesce("root", "run").alias("label"))
    sizes = own.groupBy("label").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("size"))
    return own.join(sizes, "label").select("y", "x0", "x1", "label", "size")


def large_components(cells: DataFrame, *, least: int = 64, wide: int = 4096) -> DataFrame:
    """(x, y, label, size): the cells of components of `least` cells or more."""
    kept = components(cells, wide=wide).where(F.col("size") >= least)
    return kept.select(F.explode(F.sequence("x0", "x1")).alias("x"), "y", "label", "size")


def lower_envelope(at: np.ndarray, height: np.ndarray, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least height + (probe - at)^2 over all parabolas for each ascending probe, and which parabola gives it."""
    keep, cuts = [], []
    for k in range(len(at)):
        while keep:
            j = keep[-1]
            cut = ((height[k] + at[k] ** 2) - (height[j] + at[j] ** 2)) / (2 * (at[k] - at[j]))
            if cuts[-1] < cut:
                break
            keep.pop()
            cuts.pop()
        cuts.append(cut if keep else -np.inf)
        keep.append(k)
    which = np.array(keep)[np.searchsorted(np.array(cuts), probes, "left") - 1 if len(keep) > 1 else np.zeros(len(probes), int)]
    return height[which] + (probes - at[which]) ** 2, which


def distances(cells: DataFrame, box: tuple[int, int, int, int], *, columns: int = 64) -> DataFrame:
    """(x, y, d2): for every cell of the box (x0, y0, x1, y1; ends included) the exact squared distance to the nearest set
    cell (x, y), wherever that lies; no rows where no cell is set.

    Along rows a cell's nearest set cells are as-of looks to both sides, made once for each stretch between two set cells;
    along columns the distances are lower envelopes of parabolas. A task holds `columns` neighbouring columns of the box.
    """
    x0, y0, x1, y1 = box
    own = cells.where("x is not null and y is not null").select(F.col("x").cast("long"), F.col("y").cast("long")).distinct()
    w = Window.partitionBy("y").orderBy("x")
    # Between two set cells of a row the left one is nearest up to the middle, and the right one from there on.
    reach = own.withColumn("a", F.coalesce(F.floor((F.lag("x").over(w) + F.col("x")) / 2) + 1, F.lit(x0))).withColumn("b", F.coalesce(F.floor((F.col("x") + F.lead("x").over(w)) / 2), F.lit(x1)))
    reach = reach.withColumn("a", F.greatest("a", F.lit(x0))).withColumn("b", F.least("b", F.lit(x1))).where("a <= b")
    tile = lambda c: F.floor((F.col(c) - x0) / columns)
    parts = reach.withColumn("tile", F.explode(F.sequence(tile("a"), tile("b"))))
    parts = parts.select("tile", "y", F.col("x").alias("at"), F.greatest("a", F.col("tile") * columns + x0).alias("a"), F.least("b", F.col("tile") * columns + x0 + columns - 1).alias("b"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows, out = rows.sort_values("y", kind="stable"), []
        y, at, a, b = (rows[c].to_numpy(np.int64) for c in ("y", "at", "a", "b"))
        probes = np.arange(y0, y1 + 1)
        left = key[0] * columns + x0
        for x in range(left, min(left + columns, x1 + 1)):
            here = (a <= x) & (x <= b)
            if here.any():
                d2, _ = lower_envelope(y[here].astype(float), ((at[here] - x) ** 2).astype(float), probes.astype(float))
                out.append(pd.DataFrame({"x": x, "y": probes, "d2": d2.astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"x": [], "y": [], "d2": []}, dtype="int64")

    return parts.groupBy("tile").applyInPandas(run, "x long, y long, d2 long")
