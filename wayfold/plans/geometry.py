"""Queries on polylines and points."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import scalars as S
from wayfold.operators import geometry as G
from wayfold.operators import grids, joins, overrides, relations as R
from wayfold.plans.registry import query

EDGES = R.POINTS + """,
cums as (select s, k, x, y, sum(coalesce(sqrt(cast((x - px) * (x - px) + (y - py) * (y - py) as double)), 0)) over (partition by s order by k rows unbounded preceding) as cum
  from (select *, lag(x) over w as px, lag(y) over w as py from points window w as (partition by s order by k))),
edges as (select * from (select s, k, x as x0, y as y0, cum as c0, lead(x) over w as x1, lead(y) over w as y1, lead(cum) over w as c1 from cums window w as (partition by s order by k)) where c1 is not null)"""


def samples_sql(step: int) -> str:
    return EDGES + f""",
samples as (select s, n as k, x0 + (x1 - x0) * (n * {step} - c0) / (c1 - c0) as x, y0 + (y1 - y0) * (n * {step} - c0) / (c1 - c0) as y
  from edges, unnest(range(cast(ceil(c0 / {step}) as bigint), cast(ceil(c1 / {step}) as bigint))) as r(n) where c1 > c0)"""


SPOTS = "spots as (select vec_id as id, cast(round(cast(embedding[1] as double) * 1000) as bigint) as x, cast(round(cast(embedding[2] as double) * 1000) as bigint) as y from embeddings where embedding is not null)"


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda k: F.round(F.get("embedding", F.lit(k)).cast("double") * 1000).cast("long")
    return R.load(spark, sf_dir, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("id"), part(0).alias("x"), part(1).alias("y"))


@query("w2_arc_length", f"with {EDGES} select s, k, round(cum, 4) as cum from cums")
def w2(spark, sf_dir):
    return G.arc_lengths(R.shape_points(spark, sf_dir)).select("s", F.col("k").cast("long").alias("k"), F.round("cum", 4).alias("cum"))


@query("k1_point_at", f"""with {EDGES}, p as (select s, cast(a as double) as pos, max(c1) as total, max(k) as last from edges, unnest([-50, 0, 777, 2222, 99999]) as r(a) group by s, a)
select e.s, p.pos as "at", round(x0 + (x1 - x0) * (least(greatest(pos, 0), c1) - c0) / (case when c1 > c0 then c1 - c0 else 1 end), 3) as x, round(y0 + (y1 - y0) * (least(greatest(pos, 0), c1) - c0) / (case when c1 > c0 then c1 - c0 else 1 end), 3) as y
from edges e join p on e.s = p.s and (pos >= c0 or k = 0) and (pos < c1 or k = last)""")
def k1(spark, sf_dir):
    pts = R.shape_points(spark, sf_dir)
    probes = pts.select("s").distinct().select("s", F.explode(F.array(*[F.lit(float(a)) for a in (-50, 0, 777, 2222, 99999)])).alias("at"))
    return G.point_at(pts, probes).select("s", "at", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query("k2_resample", f"with {samples_sql(50)} select s, k, round(x, 3) as x, round(y, 3) as y from samples")
def k2(spark, sf_dir):
    return G.resample(R.shape_points(spark, sf_dir), 50).select("s", "k", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


_FEET = f"""with {EDGES}, p as (select id, (id + 1) % (select count(*) from spots) as s, x, y from spots), {{more}}
f as (select id, e.s, x, y, e.*, case when (x1-x0)*(x1-x0)+(y1-y0)*(y1-y0) > 0 then least(greatest(((x-x0)*(x1-x0)+(y-y0)*(y1-y0)) / ((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)), 0), 1) else 0 end as f from p join edges e on p.s = e.s)
select id, s, round(min(sqrt((x-x0-f*(x1-x0))**2 + (y-y0-f*(y1-y0))**2)), 3) as dist from f group by id, s""".replace("with ", f"with {SPOTS}, ", 1).replace("{more}", "")


@query("k8_foot", _FEET)
def k8(spark, sf_dir):
    p = spots(spark, sf_dir)
    n = p.count()
    probes = p.select("id", ((F.col("id") + 1) % n).alias("s"), "x", "y")
    return G.feet(probes, G.edges(R.shape_points(spark, sf_dir))).select("id", "s", F.round("dist", 3).alias("dist"))


@query("k9_corridor_error")
def k9_all(spark, sf_dir):
    """Every shape against the next one as its corridor, over the stretch between the feet of the corridor's ends."""
    pts = R.shape_points(spark, sf_dir)
    e = G.by_pair(pts, G.next_shapes(pts), lambda a, b: G.corridor_error(a, b, gate=150, step=100), "off double, uncovered double")
    return e.select("s", F.round("off", 3).alias("off"), F.round("uncovered", 3).alias("uncovered"))


_TURNS = samples_sql(20) + """,
t as (select s, k, x - lag(x, 6) over w as ax, y - lag(y, 6) over w as ay, lead(x, 6) over w - x as bx, lead(y, 6) over w - y as qy,
  lead(x, 6) over w - lag(x, 6) over w as gx, lead(y, 6) over w - lag(y, 6) over w as gy from samples window w as (partition by s order by k)),
u as (select s, k, coalesce(case when sqrt(ax*ax+ay*ay) >= 1e-6 and sqrt(bx*bx+qy*qy) >= 1e-6 then degrees(atan2(ax*qy-ay*bx, ax*bx+ay*qy)) else 0 end, 0) as theta, sqrt(gx*gx+gy*gy) as back from t)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shape's samples with their turns. Where a path doubles back the sign of 180 degrees is that of the last bits, so
    these are the SQL's, whose engine sums by 16 rows."""
    return G.turns(G.resample(R.shape_points(spark, sf_dir), 20, block=16), 6)


@query("w7_turns", f"with {_TURNS} select s, k, round(theta, 3) as theta from u")
def w7_all(spark, sf_dir):
    return turns(spark, sf_dir).select("s", "k", F.round("theta", 3).alias("theta"))


@query("w7b_zigzag", f"with {_TURNS}, z as (select s, theta, lag(theta) over (partition by s order by k) as b from u) select s, round(sum(case when abs(theta) > 45 and abs(b) > 45 and sign(theta) <> sign(b) then least(abs(theta), abs(b)) - 45 else 0 end), 2) as zig from z group by s")
def w7b(spark, sf_dir):
    t = turns(spark, sf_dir).withColumn("b", F.lag("theta").over(G.by_shape()))
    pay = F.when((F.abs("theta") > 45) & (F.abs("b") > 45) & (F.sign("theta") != F.sign("b")), F.least(F.abs("theta"), F.abs("b")) - 45).otherwise(0.0)
    return t.groupBy("s").agg(F.round(F.sum(pay), 2).alias("zig"))


@query("k11_roughness", f"""with {_TURNS}, z as (select s, abs(theta) as m, case when back < 120 then greatest(0, abs(theta) - 92) else 0 end as excess,
  case when abs(theta) > 45 and abs(b) > 45 and sign(theta) <> sign(b) then least(abs(theta), abs(b)) - 45 else 0 end as zig from (select *, lag(theta) over (partition by s order by k) as b from u))
select s, round(sum(excess) + sum(zig), 2) as score, count(*) filter (excess > 0) as kinks, round(coalesce(max(m) filter (excess > 0), 0), 2) as worst from z group by s""")
def k11(spark, sf_dir):
    r = G.roughness(G.resample(R.shape_points(spark, sf_dir), 20, block=16), retrace=120.0)
    return r.select("s", F.round("score", 2).alias("score"), "kinks", F.round("worst", 2).alias("worst"))


@query("k12_drift")
def k12_all(spark, sf_dir):
    """The drift of every shape from the vertices of the next one; `k12_drift` takes a tenth against another tenth."""
    pts = R.shape_points(spark, sf_dir)

    def of(a, b):
        return G.pair_drift(G.sample_line(a, 40), b, step=40, off=12, far=60)

    d = G.by_pair(pts, G.next_shapes(pts), of, "arc double, drift double, beyond double, p90 double, median double, worst double").where("arc is not null")
    return d.select("s", *[F.col(c).cast("long").alias(c) for c in ("arc", "drift", "beyond")], *[F.round(c, 3).alias(c) for c in ("p90", "median", "worst")])


_K10 = f"""with {samples_sql(40)}, own as (select distinct s from samples), pr as (select o.s, coalesce(n.s, (select min(s) from own)) as other from own o left join own n on n.s = o.s + 1),
ends as (select s, arg_min(x, k) as hx, arg_min(y, k) as hy, arg_max(x, k) as tx, arg_max(y, k) as ty from samples group by s),
far as (select pr.s, pr.other, k, sqrt((x - hx)**2 + (y - hy)**2) as da, sqrt((x - tx)**2 + (y - ty)**2) as db from pr join samples p on p.s = pr.s join ends e on e.s = pr.other),
win as (select s, other, least(arg_min(k, (da, k)), arg_min(k, (db, k))) as lo, greatest(arg_min(k, (da, k)), arg_min(k, (db, k))) as hi, least(min(da), min(db)) as near from far group by s, other),
d as (select w.s, p.k, o.k as ok, sqrt((p.x - o.x)**2 + (p.y - o.y)**2) as d from win w join samples p on p.s = w.s and p.k between lo and hi join samples o on o.s = w.other where lo < hi and near <= 150),
a as (select s, count(*) as n, quantile_cont(d, 0.5) as p50, quantile_cont(d, 0.9) as p90, max(d) as mx from (select s, k, min(d) as d from d group by s, k) group by s),
b as (select s, avg(case when d < 60 then 1.0 else 0 end) as cover from (select s, ok, min(d) as d from d group by s, ok) group by s)
select pr.s, n, round(p50, 3) as p50, round(p90, 3) as p90, round(mx, 3) as mx, round(cover, 4) as cover from pr left join a on a.s = pr.s left join b on b.s = pr.s"""


@query("k10_corridor_score", _K10)
def k10(spark, sf_dir):
    """Samples of every shape against the next one's, between the closest ones to its ends."""
    pts = R.shape_points(spark, sf_dir)
    c = G.corridor_scores(G.resample(pts, 40), G.next_shapes(pts), reach=150, cover=60)
    return c.select("s", "n", *[F.round(x, 3).alias(x) for x in ("p50", "p90", "mx")], F.round("cover", 4).alias("cover"))


@query("a4_bbox", f"with {R.POINTS} select s, min(x) as x0, min(y) as y0, max(x) as x1, max(y) as y1 from points group by s")
def a4(spark, sf_dir):
    return R.shape_points(spark, sf_dir).groupBy("s").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


@query("k22_fly_to", f"with {R.POINTS} select s, round(least(3, 800 / greatest(max(x) - min(x), 1), 600 / greatest(max(y) - min(y), 1)), 5) as scale, (max(x) + min(x)) / 2 as cx, (max(y) + min(y)) / 2 as cy from points group by s")
def k22(spark, sf_dir):
    b = a4(spark, sf_dir)
    scale = F.least(F.lit(3.0), 800 / F.greatest(F.col("x1") - F.col("x0"), F.lit(1)), 600 / F.greatest(F.col("y1") - F.col("y0"), F.lit(1)))
    return b.select("s", F.round(scale, 5).alias("scale"), ((F.col("x1") + F.col("x0")) / 2).alias("cx"), ((F.col("y1") + F.col("y0")) / 2).alias("cy"))


@query("p4_viewport", f"with {R.POINTS} select s, k from points where x between -124 and 224 and y between -124 and 124")
def p4(spark, sf_dir):
    return R.shape_points(spark, sf_dir).where(F.col("x").between(-124, 224) & F.col("y").between(-124, 124)).select("s", F.col("k").cast("long").alias("k"))


RECTS = [(-50, -50, 50, 50), (100, 0, 150, 60), (-200, -100, -120, 0), (0, 100, 40, 200), (200, 200, 300, 300)]


@query("p6_outside_rects", f"with {R.POINTS}, r(x0, y0, x1, y1) as (values {', '.join(map(str, RECTS))}) select s, k from points where not exists (select 1 from r where x >= x0 and x < x1 and y >= y0 and y < y1)")
def p6(spark, sf_dir):
    """Five fixed half-open rectangles: a predicate, so nothing is joined."""
    inside = F.lit(False)
    for x0, y0, x1, y1 in RECTS:
        inside = inside | ((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1))
    return R.shape_points(spark, sf_dir).where(~inside).select("s", F.col("k").cast("long").alias("k"))


@query("p7_inside_rect", f"with {R.POINTS} select s, count(*) as n from points where x between -50 and 50 and y between -50 and 50 group by s")
def p7(spark, sf_dir):
    return R.shape_points(spark, sf_dir).where(F.col("x").between(-50, 50) & F.col("y").between(-50, 50)).groupBy("s").agg(F.count("*").alias("n"))


@query("j4_nearest", f"with {SPOTS}, d as (select a.id, min(struct_pack(d2 := cast((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) as double), id := b.id)) as m from spots a, spots b where a.id % 2 = 0 and b.id % 2 = 1 group by a.id) select id, m.id as nn_id, m.d2 as d2 from d")
def j4(spark, sf_dir):
    p = spots(spark, sf_dir)
    return joins.nearest(p.where("id % 2 = 0"), p.where("id % 2 = 1"), 16.0)


@query("j4_within_radius", f"with {SPOTS}, d as (select a.id, min(struct_pack(d2 := cast((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) as double), id := b.id)) as m from spots a, spots b where a.id % 2 = 0 and b.id % 2 = 1 and (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 225 group by a.id) select id, m.id as nn_id, m.d2 as d2 from d")
def j4b(spark, sf_dir):
    p = spots(spark, sf_dir)
    return joins.nearest_within(p.where("id % 2 = 0"), p.where("id % 2 = 1"), 15.0)


@query("j5_radius_pairs", f"with {SPOTS} select a.id as a, b.id as b, cast((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) as double) as d2 from spots a, spots b where a.id < b.id and (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 144")
def j5(spark, sf_dir):
    return joins.radius_pairs(spots(spark, sf_dir), 12.0)


@query("k25_trim_lead", _FEET.replace("select id, s, round(min(sqrt((x-x0-f*(x1-x0))**2 + (y-y0-f*(y1-y0))**2)), 3) as dist from f group by id, s", """, g as (select id, s, sqrt((x-x0-f*(x1-x0))**2 + (y-y0-f*(y1-y0))**2) as dist, c0+f*(c1-c0) as arc from f),
a as (select id, s, arg_min(arc, struct_pack(d := dist, a := arc)) as arc from g group by id, s), l as (select s, min(arc) as lead from a group by s)
select c.s, count(*) filter (lead is null or cum > lead + 1e-6) + count(distinct lead) as n, round(coalesce(max(lead), 0), 3) as lead from cums c left join l on c.s = l.s group by c.s"""))
def k25(spark, sf_dir):
    """Every shape from the foot of the next spot on."""
    p = spots(spark, sf_dir)
    count = p.agg(F.count("*").alias("_n"))
    anchors = p.join(F.broadcast(count)).select("id", ((F.col("id") + 1) % F.col("_n")).alias("s"), "x", "y")
    return G.trim_lead(R.shape_points(spark, sf_dir), anchors).groupBy("s").agg(F.count("*").alias("n"), F.round(F.max("lead"), 3).alias("lead"))


@query("f10_speed", f"with {R.SEGMENTS} select trip, i, round((db - da) / 100 / ((tb - ta) / 1000000) / (sqrt((2 * 0.005) ** 2 + (2 * 0.005 + 0.005 ** 2) ** 2) / (0.005 * 111.32)) * 3600, 4) as kmh from segments where tb > ta")
def f10(spark, sf_dir):
    """Map units a second as km/h, by the scale of the transform at one point."""
    scale = S.units_per_km(lambda lon, lat: S.poly2(lon, lat, 5, -7, [3.0, 1.0, 2.0, 0.0, 0.0, 0.0], [1.0, 0.0, 2.0, 0.0, 0.0, 1.0]), 5.0, -7.0)
    rate = (F.col("db") - F.col("da")) / 100 / ((F.col("tb") - F.col("ta")) / 1_000_000)
    seg = R.segments(R.stops(spark, sf_dir)).where("tb > ta")
    return seg.select("trip", F.col("i").cast("long").alias("i"), F.round(S.kmh(rate, scale), 4).alias("kmh"))


@query("f11_transform", f"with {SPOTS} select id, round(3 + 2 * (x - 5) - (y + 7) + 0.001 * (x - 5) * (x - 5) + 0.002 * (x - 5) * (y + 7) - 0.001 * (y + 7) * (y + 7), 4) as px, round(0.5 * x - 2 * y + 9, 4) as ax from spots")
def f11(spark, sf_dir):
    p = spots(spark, sf_dir)
    px, _ = S.poly2(F.col("x"), F.col("y"), 5, -7, [3.0, 2.0, -1.0, 0.001, 0.002, -0.001], [0.0] * 6)
    ax, _ = S.affine(F.col("x"), F.col("y"), [0.5, -2.0, 9.0, 0.0, 0.0, 0.0])
    return p.select("id", F.round(px, 4).alias("px"), F.round(ax, 4).alias("ax"))


@query("f12_through_points", f"with {SPOTS} select id, round(case when x < -50 then 10 + (x + 100) * 0.4 when x < 60 then 30 + (x + 50) * (90 - 30) / 110.0 else 90 + (x - 60) * 0.25 end, 4) as px from spots")
def f12(spark, sf_dir):
    return spots(spark, sf_dir).select("id", F.round(S.through_points(F.col("x"), [(-100, 10), (-50, 30), (60, 90), (100, 100)]), 4).alias("px"))


@query("f13_grid_coordinates", f"with {SPOTS} select id, round((x - 3) * 0.83 * 0.6 + (y - 4) * 0.8, 4) as s, round((y - 4) * 0.6 - (x - 3) * 0.83 * 0.8, 4) as t from spots")
def f13(spark, sf_dir):
    s, t = S.grid_coordinates(F.col("x"), F.col("y"), 3, 4, 0.83, (0.6, 0.8))
    return spots(spark, sf_dir).select("id", F.round(s, 4).alias("s"), F.round(t, 4).alias("t"))


@query("f14_easing", f"with {SPOTS}, u as (select id, abs(x) % 100 / 100.0 as u from spots) select id, round(case when u < 0.5 then 4*u*u*u else 1 - pow(-2*u+2, 3)/2 end, 5) as e, round(120 * 0.3 * (1 - exp(-u / 0.3)), 5) as way from u")
def f14(spark, sf_dir):
    u = (F.abs(F.col("x")) % 100) / 100
    return spots(spark, sf_dir).select("id", F.round(S.ease(u), 5).alias("e"), F.round(S.decay(F.lit(120.0), 0.3, u), 5).alias("way"))


@query("f15_bezier", f"with {R.POINTS}, c as (select s, k // 4 as c, max(x) filter (k % 4 = 0) as p0, max(x) filter (k % 4 = 1) as p1, max(x) filter (k % 4 = 2) as p2, max(x) filter (k % 4 = 3) as p3 from points group by all) select s, c, j, round(pow(1-j/23.0,3)*p0 + 3*pow(1-j/23.0,2)*(j/23.0)*p1 + 3*(1-j/23.0)*pow(j/23.0,2)*p2 + pow(j/23.0,3)*p3, 3) as x from c, range(0, 24) as r(j)")
def f15(spark, sf_dir):
    at = lambda m: F.max(F.when(F.col("k") % 4 == m, F.col("x")))
    c = R.shape_points(spark, sf_dir).groupBy("s", F.floor(F.col("k") / 4).alias("c")).agg(*[at(m).alias(f"p{m}") for m in range(4)])
    c = c.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))))
    return c.select("s", "c", "j", F.round(S.bezier(*[F.col(f"p{m}") for m in range(4)], F.col("j") / 23), 3).alias("x"))


@query("f16_grey_ink", f"with {R.POINTS}, c as (select s, k, abs(x) % 256 as r, abs(y) % 256 as g, (abs(x) + abs(y)) % 256 as b from points) select s, k, (r-10)**2 + (g-20)**2 + (b-30)**2 as d2, (r+g+b)/3 between 130 and 215 and greatest(r,g,b) - least(r,g,b) < 90 as grey from c")
def f16(spark, sf_dir):
    r, g, b = F.abs("x") % 256, F.abs("y") % 256, (F.abs("x") + F.abs("y")) % 256
    return R.shape_points(spark, sf_dir).select("s", F.col("k").cast("long").alias("k"), S.colour_distance2([r, g, b], [F.lit(10), F.lit(20), F.lit(30)]).alias("d2"), S.is_grey(r, g, b, spread=90).alias("grey"))


@query("f21_tiles", f"with {R.POINTS}, b as (select s, min(x) + 500 as x0, max(x) + 500 as x1 from points group by s) select s, greatest(floor(x0 / 64), 0) as first, least(ceil(x1 / 64) - 1, 15) as last from b")
def f21(spark, sf_dir):
    b = R.shape_points(spark, sf_dir).groupBy("s").agg((F.min("x") + 500).alias("x0"), (F.max("x") + 500).alias("x1"))
    first, last = S.tile_range(F.col("x0"), F.col("x1"), F.lit(64), F.lit(16))
    return b.select("s", first.cast("double").alias("first"), last.cast("double").alias("last"))


@query("j13_crossings", f"with {SPOTS}, g as (select *, floor(x / 10.0) as gx, floor(y / 10.0) as gy from spots) select a.id as a, b.id as b, round((a.x / 100.0 * b.y + a.y) / (1 - a.x / 100.0 * b.x / 100.0), 3) as y from g a join g b on a.gx = b.gx and a.gy = b.gy and a.id <> b.id and abs(1 - a.x / 100.0 * b.x / 100.0) > 0.01")
def j13_all(spark, sf_dir):
    """Every spot as a street and as an avenue, joined within grid cells of ten units."""
    cell = [F.floor(F.col(c) / 10).alias(f"g{c}") for c in "xy"]
    p = spots(spark, sf_dir)
    a = p.select(F.col("id").alias("a"), (F.col("x") / 100).alias("m"), F.col("y").alias("c"), *cell)
    b = p.select(F.col("id").alias("b"), (F.col("x") / 100).alias("n"), F.col("y").alias("e"), *cell)
    met = a.join(b, ["gx", "gy"]).where((F.col("a") != F.col("b")) & (F.abs(1 - F.col("m") * F.col("n")) > 0.01))
    return met.select("a", "b", F.round((F.col("m") * F.col("e") + F.col("c")) / (1 - F.col("m") * F.col("n")), 3).alias("y"))


_CELLS = f"with recursive {R.POINTS}, cells as (select distinct cast(floor(x / 20) as bigint) as x, cast(floor(y / 20) as bigint) as y from points)"


@query("a19_large_components", f"""{_CELLS}, l as (select a.x, a.y, b.x as bx, b.y as by from cells a join cells b on abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1),
r(x, y, rx, ry) using key (x, y) as (select x, y, x, y from cells union select l.x, l.y, arg_min(r.rx, (r.ry, r.rx)), min((r.ry, r.rx))[1] from r join l on l.bx = r.x and l.by = r.y join recurring.r o on o.x = l.x and o.y = l.y where (r.ry, r.rx) < (o.ry, o.rx) group by l.x, l.y)
select count(*) over (partition by rx, ry) as size, x, y from r qualify size >= 64""")
def a19(spark, sf_dir):
    """Cells that shapes touch, in connected components of 64 cells or more."""
    cells = R.shape_points(spark, sf_dir).select(F.floor(F.col("x") / 20).alias("x"), F.floor(F.col("y") / 20).alias("y"))
    return grids.large_components(cells).select("x", "y", "size")


@query("k20_distances", f"""with {R.POINTS}, cells as (select distinct cast(floor(x / 20) as bigint) as x, cast(floor(y / 20) as bigint) as y from points),
near as (select px.x, py.y, (select min((c.x - px.x) * (c.x - px.x) + (c.y - py.y) * (c.y - py.y)) from cells c) as d2 from (select unnest(range(-20, 21)) as x) px, (select unnest(range(-20, 21)) as y) py)
select x, y, d2 from near""")
def k20(spark, sf_dir):
    """How far every cell round the origin is from the nearest cell that any shape touches."""
    cells = R.shape_points(spark, sf_dir).select(F.floor(F.col("x") / 20).alias("x"), F.floor(F.col("y") / 20).alias("y"))
    return grids.distances(cells, (-20, -20, 20, 20))


@query("k27_override_path", f"""with {EDGES},
run as (select s, min(k) as lo, max(k) as hi from cums where x between -150 and 150 and y between -150 and 150 group by s),
c as (select c.s, c.k, c.x, c.y, k between lo and hi as inside, cum - min(cum) filter (k between lo and hi) over (partition by c.s) as a, max(cum) filter (k between lo and hi) over (partition by c.s) - min(cum) filter (k between lo and hi) over (partition by c.s) as total from cums c left join run on run.s = c.s),
p as (select *, case when total > 0 then a / total * 800 else 0 end as way from c)
select s, k, round(case when not coalesce(inside, false) then x when way <= 400 then -200 else least(way, 800) - 600 end, 3) as x, round(case when not coalesce(inside, false) then y when way <= 400 then way - 200 else 200 end, 3) as y from p""")
def k27(spark, sf_dir):
    """What every shape has in a box, from its first to its last vertex there, redrawn along two sides of a square."""
    pts = R.shape_points(spark, sf_dir).select("s", "k", "x", "y", F.col("x").cast("double").alias("wx"), F.col("y").cast("double").alias("wy"), F.lit(1).alias("route"))
    spec = spark.createDataFrame([(1, 1, (-150.0, -150.0, 150.0, 150.0), [(-200.0, -200.0), (-200.0, 200.0), (200.0, 200.0)], None, None, None, True, False)], "route int, " + overrides.SPEC)
    return overrides.override_paths(pts, spec, "route").select("s", "k", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query("k14_change_boxes")
def k14(spark, sf_dir):
    """Boxes of moved vertices for each shape between two versions; one shape is one group."""
    pts = R.shape_points(spark, sf_dir)
    moved = pts.where((F.col("s") * 31 + F.col("k") * 17) % 5 == 0).select("s", "x", "y")

    def boxes(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = G.change_boxes(rows, cluster=120.0, least=2)
        out.insert(0, "s", key[0])
        return out

    return moved.groupBy("s").applyInPandas(boxes, "s long, rank long, x0 double, y0 double, x1 double, y1 double")


@query("k15_shortest_path")
def k15_all(spark, sf_dir):
    """The cheapest way from the first to the last vertex of every shape over all its vertices."""
    pts = R.shape_points(spark, sf_dir)
    own = pts.select("s", F.col("s").alias("other")).distinct()
    return G.by_pair(pts, own, lambda a, _: (G.cheapest_way(a, long=150, times=3),), "cost double").select("s", F.round("cost", 3).alias("cost"))


@query("w6_islands", f"with {_TURNS}, f as (select s, k, abs(theta) > 30 as sharp from u), g as (select s, k, k - row_number() over (partition by s order by k) as g from f where sharp) select s, min(k) as first, max(k) as last, count(*) as n from g group by s, g")
def w6(spark, sf_dir):
    t = G.turns(G.resample(R.shape_points(spark, sf_dir), 20), 6).withColumn("sharp", F.abs("theta") > 30)
    return G.islands(t, "s", "k", "sharp")


@query("o6_suppressed_peaks")
def o6(spark, sf_dir):
    """Each shape's sharpest turns, skipping those within 24 units of a kept one: an ordered fold over one shape's samples."""
    t = G.turns(G.resample(R.shape_points(spark, sf_dir), 20), 6).where(F.abs("theta") > 60)

    def keep(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(m=rows["theta"].abs()).sort_values(["m", "k"], ascending=[False, True])
        kept: list[tuple] = []
        for x, y, k, m in zip(rows["x"], rows["y"], rows["k"], rows["m"]):
            if all((x - a) ** 2 + (y - b) ** 2 > 24**2 for a, b, *_ in kept):
                kept.append((x, y, k, m))
        return pd.DataFrame({"s": [key[0]] * len(kept), "k": [c[2] for c in kept], "angle": [round(c[3], 2) for c in kept]})

    return t.select("s", "k", "x", "y", "theta").groupBy("s").applyInPandas(keep, "s long, k long, angle double")


@query("k19_grid_axis", f"with {R.POINTS}, c as (select s, covar_pop(x, y) as xy, var_pop(x) as xx, var_pop(y) as yy from points group by s) select s, round(degrees(0.5 * atan2(2 * xy, xx - yy)), 3) as angle from c")
def k19(spark, sf_dir):
    """Principal direction of each shape's vertices, in closed form from second moments."""
    c = R.shape_points(spark, sf_dir).groupBy("s").agg(F.covar_pop("x", "y").alias("xy"), F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"))
    return c.select("s", F.round(F.degrees(0.5 * F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy"))), 3).alias("angle"))


@query("a18_normal_equations", f"with {SPOTS} select cast(count(*) as bigint) as n, cast(sum(x) as bigint) as sx, cast(sum(y) as bigint) as sy, cast(sum(x*x) as bigint) as sxx, cast(sum(x*y) as bigint) as sxy, cast(sum(y*y) as bigint) as syy from spots")
def a18(spark, sf_dir):
    s = F.sum
    return spots(spark, sf_dir).agg(F.count("*").alias("n"), s("x").alias("sx"), s("y").alias("sy"), s(F.col("x") * F.col("x")).alias("sxx"), s(F.col("x") * F.col("y")).alias("sxy"), s(F.col("y") * F.col("y")).alias("syy"))
