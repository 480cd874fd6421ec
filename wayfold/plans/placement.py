"""Queries on placement along runs, matching of shapes, fits, heartbeats and small selections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wayfold.functions.scalars import poly2
from wayfold.operators import fitting, placement
from wayfold.operators import geometry as G
from wayfold.operators import relations as R
from wayfold.operators import telemetry as T
from wayfold.plans.registry import query
from wayfold.plans.telemetry import _REC, records

_RUNS = "runs(run, u0, u1, length) as (values (0, 0.1, 0.3, 10.0), (1, 0.25, 0.5, 20.0), (2, 0.7, 0.9, 30.0))"
_K7 = f"""with {R.SEGMENTS}, {_RUNS},
g as (select trip, i, ta % 4 - 1 as ra, tb % 4 - 1 as rb, (da % 1000) / 100.0 as da, (db % 1000) / 100.0 as db, least(ta, 86399999999) / 86400000000.0 as ua, tb / 86400000000.0 as ub from segments),
h as (select *, ua + (ub - ua) * 0.5 as pos, (select min(run) from runs where ua + (ub - ua) * 0.5 between u0 and u1) as hit from g),
r as (select h.*, u0, u1, length from h left join runs on run = hit),
q as (select *, case when ra = hit then ua else u0 end as lo, case when rb = hit then ub else u1 end as hi, case when ra = hit then da else 0 end as d0, case when rb = hit then db else length end as d1 from r)
select trip, i, case when ra >= 0 and ra = rb then ra else hit end as run,
  round(case when ra >= 0 and ra = rb then da + (db - da) * 0.5 when hit is not null then d0 + (d1 - d0) * case when hi > lo then least(greatest((pos - lo) / (hi - lo), 0), 1) else 0 end end, 4) as dist from q"""


@query("k7_inset", _K7)
def k7(spark, sf_dir):
    """Half-way between stops: the place in a call-out with three runs."""
    g = R.segments(R.stops(spark, sf_dir))
    at = lambda c: F.col(c) / R.DAY_US
    rows = g.select(
        "trip", "i", F.lit(0).alias("s"), (F.col("ta") % 4 - 1).alias("ra"), (F.col("tb") % 4 - 1).alias("rb"), ((F.col("da") % 1000) / 100).alias("da"), ((F.col("db") % 1000) / 100).alias("db"),
        at("ta").alias("ua"), at("tb").alias("ub"), F.lit(0.5).alias("f"),
    )
    runs = spark.createDataFrame([(0, 0, 0.1, 0.3, 10.0), (0, 1, 0.25, 0.5, 20.0), (0, 2, 0.7, 0.9, 30.0)], "s int, run long, u0 double, u1 double, length double")
    return placement.inset_place(rows, F.broadcast(runs)).select("trip", "i", "run", F.round("dist", 4).alias("dist"))


@query("k13_rejoins")
def k13(spark, sf_dir):
    """Stretches where a shape leaves the line of the next one and comes back, for every shape: vertices move, samples are made in the tasks."""
    pts = R.shape_points(spark, sf_dir)

    def of(a, b):
        return placement.line_rejoins(G.line_samples(a, 10), G.line_samples(b, 10), step=10, contact=30, ride=20, leave=40, rejoin=400)

    return G.by_pair(pts, G.next_shapes(pts), of, "k0 long, k1 long, off double", counted=True).withColumnRenamed("other", "sid")


def _behind(spark, sf_dir):
    w = Window.partitionBy("s").orderBy("k")
    p = R.shape_points(spark, sf_dir).withColumns({"tx": F.lead("x").over(w), "ty": F.lead("y").over(w)}).where("tx is not null")
    return p.select((F.col("x") / 100).alias("lon"), (F.col("y") / 100).alias("lat"), "tx", "ty")


@query("j14_shape_match")
def j14_all(spark, sf_dir):
    """Every shape with the other one that is least away by mean distance and both ends; `j14_shape_match` takes a sample."""
    m = G.match_shapes(R.shape_points(spark, sf_dir), step=100, radius=64)
    return m.select("s", "other", F.round("mean", 3).alias("mean"), F.round("score", 3).alias("score"))


@query("k17_fit_robust")
def k17_robust(spark, sf_dir):
    """The fit of `k17_fit` with soft-L1 weights, over all vertices in each round."""
    cx, cy = fitting.fit_robust(_behind(spark, sf_dir), 0.0, 0.0)
    return spark.createDataFrame([(i, round(a, 6), round(b, 6)) for i, (a, b) in enumerate(zip(cx, cy))], "term int, cx double, cy double")


#: The transform that `k17_fit_nearest` draws its targets by.
PLANTED = ([40.0, 2000.0, 5.0, 0.3, -0.2, 0.1], [-10.0, -4.0, 2100.0, 0.1, 0.2, -0.3])


@query("k17_fit_nearest")
def k17_nearest(spark, sf_dir):
    """Every spot matched anew in each round to the nearest of the spots drawn by a planted transform, which the fit finds."""
    p = R.shape_points(spark, sf_dir).where("k = 0").select(F.col("s").alias("id"), (F.col("x") / 100).alias("lon"), (F.col("y") / 100).alias("lat"))
    x, y = poly2(F.col("lon"), F.col("lat"), 0.0, 0.0, *PLANTED)
    drawn = p.select((-F.col("id") - 1).alias("id"), x.alias("x"), y.alias("y"))
    near = [[c[0] + 3.0, *c[1:]] for c in PLANTED]
    cx, cy = fitting.fit_nearest(p, drawn, 0.0, 0.0, *near, cap=20.0, rounds=8)
    return spark.createDataFrame([(i, round(a, 4), round(b, 4)) for i, (a, b) in enumerate(zip(cx, cy))], "term int, cx double, cy double")


@query("k17_fit")
def k17(spark, sf_dir):
    """Second-order fit of each vertex to the one behind it: sums over all vertices, one small solve."""
    w = Window.partitionBy("s").orderBy("k")
    p = R.shape_points(spark, sf_dir).withColumns({"tx": F.lead("x").over(w), "ty": F.lead("y").over(w)}).where("tx is not null").select((F.col("x") / 100).alias("lon"), (F.col("y") / 100).alias("lat"), "tx", "ty")
    cx, cy = fitting.fit_poly2(p, 0.0, 0.0)
    return spark.createDataFrame([(i, round(a, 6), round(b, 6)) for i, (a, b) in enumerate(zip(cx, cy))], "term int, cx double, cy double")


_T3 = f"""with {_REC}, s as (select *, at_ms - lag(at_ms) over w as gap, lag(kind) over w as before from rec window w as (partition by sid order by at_ms, n))
select sid, n, gap as silent_ms, case when before = 'error' then 'throttled' else 'stall' end as t from s where gap > 57600000"""


@query("t3_heartbeat", _T3)
def t3(spark, sf_dir):
    """Silences between records: throttled where the session was last seen hidden, else a stall."""
    w = T.by_session()
    r = records(spark, sf_dir).withColumns({"silent_ms": F.col("at") - F.lag("at").over(w), "before": F.lag("kind").over(w)})
    return r.where("silent_ms > 57600000").select("sid", "n", "silent_ms", F.when(F.col("before") == "error", "throttled").otherwise("stall").alias("t"))


@query("t10_playback_clock", f"with {_REC}, s as (select sid, n, least(greatest(coalesce(at_ms - lag(at_ms) over w, 0), 0), 7200000) * 5 as step from rec window w as (partition by sid order by at_ms, n)), c as (select sid, n, sum(step) over (partition by sid order by n) as c from (select s.sid, s.n, s.step from s)) select sid, n, cast(c % 86400000 as bigint) as t, cast(c // 86400000 % 7 as bigint) as day from c")
def t10(spark, sf_dir):
    """Steps clamped to two hours and played five times as fast; the clock wraps at midnight and the day moves on."""
    w = T.by_session()
    step = F.least(F.greatest(F.coalesce(F.col("at") - F.lag("at").over(w), F.lit(0)), F.lit(0)), F.lit(7_200_000)) * 5
    c = records(spark, sf_dir).withColumn("step", step).withColumn("c", F.sum("step").over(Window.partitionBy("sid").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))
    return c.select("sid", "n", (F.col("c") % 86_400_000).alias("t"), (F.floor(F.col("c") / 86_400_000) % 7).alias("day"))


@query("t11_frame_dedupe", f"with {_REC} select sid, kind, min(n) as n, count(*) as times from rec group by sid, kind, at_ms // 86400000")
def t11(spark, sf_dir):
    return records(spark, sf_dir).groupBy("sid", "kind", F.floor(F.col("at") / 86_400_000).alias("d")).agg(F.min("n").alias("n"), F.count("*").alias("times")).drop("d")


@query("p5_on_map", f"with {R.POINTS} select s, count(*) filter (x between -15 and 411 and y between -70 and 415) as client, count(*) filter (x between 0 and 409 and y between -70 and 413) as checker, count(*) filter (x < -50 or x > 461 or y < -122 or y > 465) as off from points group by s")
def p5(spark, sf_dir):
    """Three different tests of being on the map, kept apart."""
    x, y = F.col("x"), F.col("y")
    return R.shape_points(spark, sf_dir).groupBy("s").agg(
        F.count_if(x.between(-15, 411) & y.between(-70, 415)).alias("client"), F.count_if(x.between(0, 409) & y.between(-70, 413)).alias("checker"),
        F.count_if((x < -50) | (x > 461) | (y < -122) | (y > 465)).alias("off"),
    )


@query("p12_occlusion", f"with {R.POINTS}, b as (select s, k, x - 12 as x0, x + 12 as x1, y - 12 as y0, y + 12 as y1 from points) select s, k, x0 < 100 and x1 > -100 and y0 < 50 and y1 > -50 as overlaps, x0 >= -100 and x1 <= 100 and y0 >= -50 and y1 <= 50 as inside from b")
def p12_all(spark, sf_dir):
    """Of every shape; `p12_occlusion` is a sample of it."""
    b = R.shape_points(spark, sf_dir).select("s", F.col("k").cast("long").alias("k"), (F.col("x") - 12).alias("x0"), (F.col("x") + 12).alias("x1"), (F.col("y") - 12).alias("y0"), (F.col("y") + 12).alias("y1"))
    return b.select("s", "k", F.expr("x0 < 100 and x1 > -100 and y0 < 50 and y1 > -50").alias("overlaps"), F.expr("x0 >= -100 and x1 <= 100 and y0 >= -50 and y1 <= 50").alias("inside"))


@query("p10_open_bbox", f"with {R.POINTS} select s, k from points where x > -20 and x < 20 and y > -20 and y < 20")
def p10(spark, sf_dir):
    return R.shape_points(spark, sf_dir).where("x > -20 and x < 20 and y > -20 and y < 20").select("s", F.col("k").cast("long").alias("k"))


@query("u7_words_of_two_regions", "select word, count(*) as n from (select unnest(string_split(p_name, ' ')) as word from part where p_size < 10 union all select unnest(string_split(lower(p_type), ' ')) from part where p_size > 40) group by word")
def u7(spark, sf_dir):
    p = R.load(spark, sf_dir, "part")
    a = p.where("p_size < 10").select(F.explode(F.split("p_name", " ")).alias("word"))
    return a.unionAll(p.where("p_size > 40").select(F.explode(F.split(F.lower("p_type"), " ")))).groupBy("word").agg(F.count("*").alias("n"))


@query("o4_group_sequence", f"with {R.STOPS} select trip, string_agg(kind, '>' order by i) as kinds from stops group by trip")
def o4(spark, sf_dir):
    s = R.stops(spark, sf_dir).groupBy("trip").agg(F.array_sort(F.collect_list(F.struct("i", "kind"))).alias("r"))
    return s.select("trip", F.array_join(F.col("r.kind"), ">").alias("kinds"))


@query("f19_even_odd", "select vec_id, round(list_sum(list_transform(range(1, 65, 2), lambda k: embedding[k]::double)), 4) as xs, round(list_sum(list_transform(range(2, 66, 2), lambda k: embedding[k]::double)), 4) as ys from embeddings")
def f19(spark, sf_dir):
    total = lambda odd: F.round(F.aggregate(F.filter("embedding", lambda v, k: k % 2 == odd), F.lit(0.0), lambda a, v: a + v.cast("double")), 4)
    return R.load(spark, sf_dir, "embeddings").select("vec_id", total(0).alias("xs"), total(1).alias("ys"))


@query("k21_run_bounds", f"with {R.STOPS}, g as (select trip, i, kind, i - row_number() over (partition by trip, kind order by i) as g from stops) select trip, i, min(i) over (partition by trip, kind, g) as lo, max(i) over (partition by trip, kind, g) as hi from g")
def k21(spark, sf_dir):
    """First and last stop of the run of equal kinds that a stop is in."""
    g = R.stops(spark, sf_dir).withColumn("g", F.col("i") - F.row_number().over(Window.partitionBy("trip", "kind").orderBy("i")))
    w = Window.partitionBy("trip", "kind", "g")
    return g.select("trip", "i", F.min("i").over(w).alias("lo"), F.max("i").over(w).alias("hi"))
