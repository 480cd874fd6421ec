"""Paths drawn by hand in place of a stretch of a shape, with stops kept at the junctions they belong to."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.operators import geometry as G
from wayfold.streaming.telemetry import shared_folder

#: What a specification row holds beside the key that it is joined by.
SPEC = (
    "spec int, box struct<x0: double, y0: double, x1: double, y1: double>, path array<struct<x: double, y: double>>, "
    "waypoints array<struct<wx: double, wy: double, x: double, y: double>>, shape_ids array<bigint>, pass int, forward boolean, exact boolean"
)
_LEGS = "array<struct<x0: double, y0: double, x1: double, y1: double, c0: double, c1: double>>"


def _kept(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: worked out once, and with a short plan from here on."""
    path = f"{shared_folder(df.sparkSession)}/wayfold-override-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _legs(path: Column) -> Column:
    """The path's legs, with the way along it at both ends; legs without length are left out."""
    far = lambda a, b: F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"]))
    pairs = F.filter(F.zip_with(F.slice(path, F.lit(1), F.size(path) - 1), F.slice(path, F.lit(2), F.size(path) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: far(p["a"], p["b"]) > 0)

    def longer(legs: Column, p: Column) -> Column:
        c0 = F.coalesce(F.try_element_at(legs, F.lit(-1))["c1"], F.lit(0.0))
        leg = F.struct(p["a"]["x"].alias("x0"), p["a"]["y"].alias("y0"), p["b"]["x"].alias("x1"), p["b"]["y"].alias("y1"), c0.alias("c0"), (c0 + far(p["a"], p["b"])).alias("c1"))
        return F.concat(legs, F.array(leg))

    return F.aggregate(pairs, F.array().cast(_LEGS), longer)


def _foot(legs: Column, x: Column, y: Column) -> Column:
    """(d2, arc) of the point of the legs that is nearest to (x, y): the first one on a tie."""

    def on(e: Column) -> Column:
        dx, dy = e["x1"] - e["x0"], e["y1"] - e["y0"]
        f = F.least(F.greatest(((x - e["x0"]) * dx + (y - e["y0"]) * dy) / (dx * dx + dy * dy), F.lit(0.0)), F.lit(1.0))
        px, py = x - e["x0"] - f * dx, y - e["y0"] - f * dy
        return F.struct((px * px + py * py).alias("d2"), (e["c0"] + f * (e["c1"] - e["c0"])).alias("arc"))

    return F.array_min(F.transform(legs, on))


def _between(knots: Column, at: Column, of: str, to: str) -> Column:
    """The value `to` where `of` is `at`, along knots that ascend in both."""
    pairs = F.zip_with(F.slice(knots, F.lit(1), F.size(knots) - 1), F.slice(knots, F.lit(2), F.size(knots) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    here = F.coalesce(F.try_element_at(F.filter(pairs, lambda p: p["b"][of] >= at), F.lit(1)), F.try_element_at(pairs, F.lit(-1)))
    a, b = here["a"], here["b"]
    return a[to] + F.when(b[of] > a[of], (at - a[of]) / (b[of] - a[of])).otherwise(0.0) * (b[to] - a[to])


def _place(legs: Column, arc: Column, axis: str) -> Column:
    e = F.coalesce(F.try_element_at(F.filter(legs, lambda e: e["c1"] >= arc), F.lit(1)), F.try_element_at(legs, F.lit(-1)))
    return e[f"{axis}0"] + (e[f"{axis}1"] - e[f"{axis}0"]) * F.least((arc - e["c0"]) / (e["c1"] - e["c0"]), F.lit(1.0))


def override_once(points: DataFrame, specs: DataFrame, key: str = "s") -> DataFrame:
    """points (s, k, x, y, wx, wy) with a stretch of each shape on the path of its specification: at most one for each `key`."""
    plain = points.select("s", "k", "x", "y", "wx", "wy", F.col(key).alias("_key"))
    own = plain.join(specs.withColumnRenamed(key, "_key"), "_key", "left").drop("_key")
    hit = F.col("spec").isNotNull() & (F.col("shape_ids").isNull() | F.array_contains("shape_ids", F.col("s")))
    inside = F.coalesce(hit & F.col("wx").between(F.col("box.x0"), F.col("box.x1")) & F.col("wy").between(F.col("box.y0"), F.col("box.y1")), F.lit(False))
    w, whole = G.by_shape(), Window.partitionBy("s")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("_in", inside).withColumn("_new", (F.col("_in") & ~F.coalesce(F.lag("_in").over(w), F.lit(False))).cast("int"))
    own = own.withColumn("_nth", F.sum("_new").over(upto)).withColumn("_passes", F.sum("_new").over(whole))
    wanted = F.when(F.col("pass").isNull(), F.lit(True)).when(F.col("pass") >= 0, F.col("_nth") == F.col("pass") + 1).otherwise(F.col("_nth") == F.col("_passes") + F.col("pass") + 1)
    chosen = F.when(F.col("_in") & wanted, F.col("k"))
    own = own.withColumn("_lo", F.min(chosen).over(whole)).withColumn("_hi", F.max(chosen).over(whole))
    run = F.col("k").between(F.col("_lo"), F.col("_hi"))
    step = F.sqrt((F.col("wx") - F.lag("wx").over(w)) ** 2 + (F.col("wy") - F.lag("wy").over(w)) ** 2)
    own = own.withColumn("_step", F.when(F.col("k") > F.col("_lo"), step).otherwise(0.0)).withColumn("_run", F.coalesce(run, F.lit(False)))
    own = own.withColumn("_arc", F.sum(F.when(F.col("_run"), F.col("_step"))).over(upto))

    # One row for each shape that is changed: how it runs, and where its waypoints stand along the stretch and along the path.
    own = _kept(own)
    stretch = own.where("_run")
    ends = stretch.groupBy("s").agg(
        F.min_by(F.struct("wx", "wy"), "k").alias("a"), F.max_by(F.struct("wx", "wy"), "k").alias("b"), F.max("_arc").alias("total"), F.min("k").alias("lo"), F.count("*").alias("held"),
        *(F.first(c).alias(c) for c in ("path", "waypoints", "forward", "exact")),
    )
    start, stop = F.element_at("path", 1), F.element_at("path", -1)
    against = (F.col("b.wx") - F.col("a.wx")) * (stop["x"] - start["x"]) + (F.col("b.wy") - F.col("a.wy")) * (stop["y"] - start["y"]) < 0
    turned = ends.withColumn("_back", ~F.coalesce("forward", F.lit(False)) & against)
    for c in ("path", "waypoints"):
        turned = turned.withColumn(c, F.when(F.col("_back"), F.reverse(c)).otherwise(F.col(c)))
    turned = turned.withColumn("legs", _legs(F.col("path")))
    turned = _kept(turned).withColumn("length", F.element_at("legs", -1)["c1"])
    edges = G.edges(stretch.select("s", "k", F.col("wx").alias("x"), F.col("wy").alias("y")))
    probes = turned.select("s", F.posexplode("waypoints").alias("i", "v"), "legs").select("s", F.struct("s", "i").alias("id"), F.col("v.wx").alias("x"), F.col("v.wy").alias("y"), _foot(F.col("legs"), F.col("v.x"), F.col("v.y"))["arc"].alias("to"))
    feet = G.feet(probes.select("id", "s", "x", "y"), edges).join(probes.select("id", "to"), "id").select(F.col("id.s").alias("s"), F.col("id.i").alias("i"), F.col("arc").alias("src"), F.col("to").cast("double"))
    knots = feet.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("i", "src", "to"))).alias("mid"))
    knot = lambda a, b: F.struct(a.cast("double").alias("src"), b.cast("double").alias("to"))
    known = turned.join(knots, "s", "left").withColumn(
        "knots", F.concat(F.array(knot(F.lit(0.0), F.lit(0.0))), F.coalesce(F.transform("mid", lambda m: knot(m["src"], m["to"])), F.array().cast("array<struct<src: double, to: double>>")), F.array(knot(F.col("total"), F.col("length"))))
    )
    pairs = F.zip_with(F.slice("knots", F.lit(1), F.size("knots") - 1), F.slice("knots", F.lit(2), F.size("knots") - 1), lambda a, b: (a["src"] < b["src"]) & (a["to"] < b["to"]))
    rising = (F.size("knots") == 2) | F.forall(pairs, lambda p: p)
    known = known.withColumn("knots", F.when(rising, F.col("knots")).otherwise(F.raise_error(F.concat(F.lit("waypoints must follow the direction of travel on shape "), F.col("s").cast("string")))))
    known = _kept(known.select("s", "legs", "knots", "length", "lo", F.coalesce("exact", F.lit(False)).alias("exact")))

    moved = stretch.select("s", "k", "wx", "wy", "_arc").join(known.drop("lo", "length", "exact"), "s")
    moved = moved.withColumn("to", _between(F.col("knots"), F.col("_arc"), "src", "to"))
    moved = moved.select("s", F.col("k").alias("_k"), "to", _place(F.col("legs"), F.col("to"), "x").alias("x"), _place(F.col("legs"), F.col("to"), "y").alias("y"), "wx", "wy")
    # Corners of the path between the stretch's own points, with the place on the warp that maps to them.
    corners = known.where("exact").select("s", "knots", "lo", "length", F.explode("legs").alias("e")).where("e.c1 < length")
    corners = corners.withColumn("at", _between(F.col("knots"), F.col("e.c1"), "to", "src"))
    at = G.point_at(stretch.select("s", "k", F.col("wx").alias("x"), F.col("wy").alias("y")), corners.select("s", "at").distinct()).select("s", "at", F.col("x").alias("wx"), F.col("y").alias("wy"))
    corners = corners.join(at, ["s", "at"]).select("s", F.col("lo").cast("bigint").alias("_k"), F.col("e.c1").alias("to"), F.col("e.x1").alias("x"), F.col("e.y1").alias("y"), "wx", "wy")
    taken = moved.select("s", F.col("to").alias("_to"))
    corners = corners.join(taken, (corners["s"] == taken["s"]) & (F.abs(F.col("to") - F.col("_to")) < 1e-9), "left_anti")
    # Along the path, points go by their place on it: the stretch is renumbered as one.
    lows = known.select("s", F.col("lo").alias("_first"))
    inner = moved.unionByName(corners).join(lows, "s").select("s", F.col("_first").cast("bigint").alias("_k"), "to", F.col("_k").alias("_own"), "x", "y", "wx", "wy")
    outer = own.where("not _run").select("s", F.col("k").cast("bigint").alias("_k"), F.lit(-1.0).alias("to"), F.col("k").cast("bigint").alias("_own"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "wx", "wy")
    out = outer.unionByName(inner.withColumn("_own", F.col("_own").cast("bigint")))
    k = F.row_number().over(Window.partitionBy("s").orderBy("_k", "to", "_own")) - 1
    kept = [c for c in points.columns if c not in ("k", "x", "y", "wx", "wy", "s")]
    out = out.withColumn("k", k.cast("bigint")).select("s", "k", "x", "y", "wx", "wy")
    return out.join(points.groupBy("s").agg(*(F.first(c).alias(c) for c in kept)), "s") if kept else out


def override_paths(points: DataFrame, specs: DataFrame, key: str = "s") -> DataFrame:
    """(s, k, x, y, wx, wy, ...): points (s, k, x, y; wx, wy: their places on the warp) with stretches redrawn by specifications.

    A specification's box is matched against the warp. The stretch runs from a shape's first warp point in it to the last
    one, or over one of its passes through it (`pass`: 0 the first, -1 the last). Each point of the stretch moves to the path, at the
    share of the way that it has along the warp; waypoints (a place on the warp, a place on the path, in order of travel)
    part the way, and both of their places must advance strictly, else the job fails. The path runs in the shape's own
    direction, by its heading, unless `forward` is set. `exact` puts the path's corners in between. `shape_ids` names the
    shapes (null: all of the key). Several specifications of one key apply in order of `spec`.

    Shapes without a specification, or without a point in the box, stay as they are; k is numbered anew from 0. A stretch of
    one point goes to the path's start. Shapes are windows by s; specifications join by an equi-join and their paths are
    arrays in one row for each shape that changes.
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy("spec"))
    ranked = specs.where(F.col(key).isNotNull()).withColumn("_rank", rank)
    rounds = ranked.agg(F.max("_rank")).first()[0] or 0
    for r in range(1, rounds + 1):
        points = override_once(points, ranked.where(F.col("_rank") == r).drop("_rank"), key)
    return points
