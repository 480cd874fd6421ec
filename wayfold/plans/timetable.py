"""Queries on trips, calendars and positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions import scalars as S
from wayfold.functions import timing
from wayfold.operators import chaining, joins, relations as R
from wayfold.plans.registry import query

TICK_US, FIRST_TICK_US = 300_000_000, 7_000_000
TICKS = "ticks as (select 7000000 + 300000000 * k as t from range(0, 288) as r(k))"


def ticks(spark: SparkSession) -> DataFrame:
    return spark.range(288).select((F.col("id") * TICK_US + FIRST_TICK_US).alias("t"))


def ticks_in(segments: DataFrame) -> DataFrame:
    """Segments with each tick in them. Ticks are a rule, so each segment makes its own: no join, no shuffle."""
    lo = F.greatest(F.ceil((F.col("ta") - FIRST_TICK_US) / TICK_US), F.lit(0))
    hi = F.floor((F.col("tb") - FIRST_TICK_US) / TICK_US)
    hi = F.least(F.when(~F.col("is_last") & (hi * TICK_US + FIRST_TICK_US == F.col("tb")), hi - 1).otherwise(hi), F.lit(287))
    return segments.withColumns({"_lo": lo, "_hi": hi}).where("_lo <= _hi").withColumn("t", F.explode(F.sequence("_lo", "_hi"))).withColumn("t", F.col("t") * TICK_US + FIRST_TICK_US).drop("_lo", "_hi")


_POS = f"""with {R.SEGMENTS}, {TICKS},
s as (select *, case when lag(tb - ta) over w > 0 then lag((db - da) / (tb - ta)) over w when lag(tb) over w is not null then 0 end as vb,
  case when lead(tb - ta) over w > 0 then lead((db - da) / (tb - ta)) over w when lead(tb) over w is not null then 0 end as va
  from segments window w as (partition by trip order by i)),
h as (select trip, i, t, ta, tb, da, db, (t - ta) / (tb - ta) as f, cast(tb - ta as double) as span, (db - da) / (tb - ta) as m, vb, va from s, ticks
  where t >= ta and (t < tb or is_last and t <= tb))
select trip, i, t, case when tb <= ta or da = db then cast(da as double) else round((2*f*f*f - 3*f*f + 1) * da + (f*f*f - 2*f*f + f) * span * least(greatest(coalesce((vb + m) / 2, m) / m, 0), 3) * m
  + (3*f*f - 2*f*f*f) * db + (f*f*f - f*f) * span * least(greatest(coalesce((va + m) / 2, m) / m, 0), 3) * m, 2) end as d from h"""


@query("k3_positions", _POS)
def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every active trip is at each tick: one shuffle by trip, then columns only."""
    seg = R.segments(R.stops(spark, sf_dir))
    order = Window.partitionBy("trip").orderBy("i")
    speed = F.when(F.col("tb") > F.col("ta"), (F.col("db") - F.col("da")) / (F.col("tb") - F.col("ta"))).otherwise(0.0)
    seg = seg.withColumn("v", speed).withColumns({"vb": F.lag("v").over(order), "va": F.lead("v").over(order)})
    c = F.col
    d = timing.hermite(c("t"), c("ta"), c("tb"), c("da"), c("db"), c("vb"), c("va"), F.lit(False))
    return ticks_in(seg).select("trip", "i", "t", F.when((c("tb") <= c("ta")) | (c("da") == c("db")), c("da").cast("double")).otherwise(F.round(d, 2)).alias("d"))


@query("p1_runs_on_day", f"with {R.CALENDAR} select service, days from calendar where (days >> 2) & 1 = 1")
def p1(spark, sf_dir):
    return R.calendar(spark, sf_dir).where(S.runs_on(F.col("days"), 2))


@query("p2_enabled_systems", "select n_nationkey, n_name from nation join region on n_regionkey = r_regionkey where r_name in ('ASIA', 'EUROPE')")
def p2(spark, sf_dir):
    on = R.load(spark, sf_dir, "region").where(F.col("r_name").isin("ASIA", "EUROPE"))
    nation = R.load(spark, sf_dir, "nation")
    return nation.join(joins.broadcast_if_small(on), nation.n_regionkey == on.r_regionkey, "left_semi").select("n_nationkey", "n_name")


@query("p3_active_at", f"with {R.TRIPS} select trip, t0, t1 from trips where 43200000000 between t0 and t1")
def p3(spark, sf_dir):
    return R.trips(R.stops(spark, sf_dir)).where(F.lit(43_200_000_000).between(F.col("t0"), F.col("t1"))).select("trip", "t0", "t1")


@query("j1_star_lookup", "select c_custkey, n_name, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def j1(spark, sf_dir):
    c, n, r = (R.load(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    dims = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")
    return c.join(joins.broadcast_if_small(dims), c.c_nationkey == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@query("j2_bracket", f"with {R.SEGMENTS}, probes as (select trip, us + 30000000 as t from stops where i % 2 = 0) select s.trip, t, i, ta, tb from segments s join probes p on s.trip = p.trip and t >= ta and (t < tb or is_last and t <= tb)")
def j2(spark, sf_dir):
    st = R.stops(spark, sf_dir)
    probes = st.where("i % 2 = 0").select("trip", (F.col("us") + 30_000_000).alias("t"))
    return joins.bracket_join(R.segments(st), probes, "trip", "t").select("trip", "t", "i", "ta", "tb")


@query("j2_as_of", f"with {R.STOPS}, p as (select user_id, us as t, day, d from stops where kind = 'click'), q as (select user_id, day, us as t, max(step) as v from stops where kind = 'view' group by all) select p.user_id, p.day, p.t, p.d, q.v from p asof left join q on p.user_id = q.user_id and p.day = q.day and p.t >= q.t")
def j2_as_of(spark, sf_dir):
    st = R.stops(spark, sf_dir)
    left = st.where("kind = 'click'").select("trip", F.col("us").alias("t"), "user_id", "day", "d")
    right = st.where("kind = 'view'").groupBy("trip", F.col("us").alias("t")).agg(F.max("step").alias("v"))
    return joins.as_of_join(left, right, "trip", "t", "v").select("user_id", "day", "t", "d", "v")


@query("j3_interval_bucket", f"with {R.TRIPS}, {TICKS} select trip, t from trips, ticks where t between t0 and t1")
def j3(spark, sf_dir):
    return joins.range_join(R.trips(R.stops(spark, sf_dir)), ticks(spark), "t0", "t1", "t", TICK_US).select("trip", "t")


@query("j3_bucket_index", f"with {R.TRIPS} select bucket, count(*) as n, cast(sum(trip) as bigint) as trips from trips, range(0, 288) as r(bucket) where bucket between greatest(0, t0 // 300000000) and least(287, t1 // 300000000) group by bucket")
def j3_index(spark, sf_dir):
    rows = joins.bucket_rows(R.trips(R.stops(spark, sf_dir)), F.col("t0"), F.col("t1"), TICK_US, first=0, last=287)
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("trip").alias("trips"))


@query("a14_active_count", f"with {R.TRIPS}, {TICKS} select t, count(*) as n from trips, ticks where t between t0 and t1 group by t")
def a14(spark, sf_dir):
    """Counts from the intervals' ends: two rows a trip, summed by tick before anything moves."""
    t = R.trips(R.stops(spark, sf_dir))
    up = F.greatest(F.ceil((F.col("t0") - FIRST_TICK_US) / TICK_US), F.lit(0))
    down = F.floor((F.col("t1") - FIRST_TICK_US) / TICK_US) + 1
    ends = t.select(F.explode(F.array(F.struct(up.alias("k"), F.lit(1).alias("c")), F.struct(down.alias("k"), F.lit(-1).alias("c")))).alias("e"))
    change = ends.groupBy("e.k").agg(F.sum("e.c").alias("c"))
    steps = spark.range(288).join(change, F.col("id") == F.col("k"), "left")
    # 288 rows whatever the input.
    running = F.sum(F.coalesce("c", F.lit(0))).over(Window.orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    return steps.select((F.col("id") * TICK_US + FIRST_TICK_US).alias("t"), running.alias("n")).where("n > 0")


@query("a11_merge_days", "with o as (select o_custkey % 50 as r, o_orderkey % 7 as p, o_orderpriority as t0, 1 << cast(dayofweek(o_orderdate) as integer) as bit from orders) select r, p, t0, bit_or(bit) as days, count(*) as n from o group by r, p, t0")
def a11(spark, sf_dir):
    o = R.load(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("r"), (F.col("o_orderkey") % 7).alias("p"), F.col("o_orderpriority").alias("t0"), F.expr("shiftleft(1, dayofweek(o_orderdate) - 1)").alias("bit"))
    return o.groupBy("r", "p", "t0").agg(F.bit_or("bit").alias("days"), F.count("*").alias("n"))


@query("a12_busiest_date", "with n as (select cast(o_orderdate as date) as date, count(*) as n from orders group by 1) select cast(dayofweek(date) as integer) as dow, arg_max(date, struct_pack(n := n, d := -epoch(date))) as date, max(n) as n from n group by 1")
def a12(spark, sf_dir):
    n = R.load(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(F.count("*").alias("n"))
    best = F.max(F.struct("n", (-F.unix_date("date")).alias("k"), "date"))
    return n.groupBy((F.dayofweek("date") - 1).alias("dow")).agg(best.alias("m")).select("dow", "m.date", "m.n")


@query("u1_union_distinct", f"with {R.TRIPS} select trip from trips where 36000000000 between t0 and t1 union select trip from trips where 39600000000 between t0 and t1")
def u1(spark, sf_dir):
    t = R.trips(R.stops(spark, sf_dir))
    at = lambda us: t.where(F.lit(us).between(F.col("t0"), F.col("t1"))).select("trip")
    return at(36_000_000_000).union(at(39_600_000_000)).distinct()


@query("u2_midnight", f"with {R.TRIPS}, late as (select trip, t0 + 36000000000 as t0, t1 + 36000000000 as t1, days from trips) select trip, t0, t1, days from late union all select trip, t0 - 86400000000, t1 - 86400000000, ((days << 1) & 127) | (days >> 6) from late where t1 > 86400000000")
def u2(spark, sf_dir):
    """Trips ten hours late; those past midnight run again a day on, from negative times."""
    late = R.trips(R.stops(spark, sf_dir)).select("trip", (F.col("t0") + 36_000_000_000).alias("t0"), (F.col("t1") + 36_000_000_000).alias("t1"), "days")
    again = late.where(F.col("t1") > R.DAY_US).select("trip", F.col("t0") - R.DAY_US, F.col("t1") - R.DAY_US, S.rotate_days(F.col("days")))
    return late.unionAll(again)


@query("w1_running_sum", "with e as (select user_id, ts, event_id, cast(round(value * 100) as bigint) as delta from events) select user_id, event_id, cast(sum(delta) over (partition by user_id order by ts, event_id) as bigint) as t from e")
def w1(spark, sf_dir):
    upto = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return R.load(spark, sf_dir, "events").select("user_id", "event_id", F.sum(F.round(F.col("value") * 100).cast("long")).over(upto).alias("t"))


_W3 = f"""with {R.STOPS}, r as (select trip, i, d, step, case when kind in ('view', 'click') then 0 when kind = 'error' then 1 else -1 end as ir, us // 1000000 as id from stops),
s as (select trip, i, case when i = 0 then 0 when ir >= 0 and ir = lag(ir) over w then greatest(step * 10, abs(id - lag(id) over w) * 2) else step * 10 end as step from r window w as (partition by trip order by i))
select trip, i, cast(sum(step) over (partition by trip order by i) as bigint) as eff from s"""


@query("w3_effective_distance", _W3)
def w3(spark, sf_dir):
    """Tenths of a distance unit; a step inside one run counts a fifth of its way there at least."""
    st = R.stops(spark, sf_dir)
    w = Window.partitionBy("trip").orderBy("i")
    run = F.when(F.col("kind").isin("view", "click"), 0).when(F.col("kind") == "error", 1).otherwise(-1)
    r = st.select("trip", "i", (F.col("step") * 10).alias("step"), run.alias("ir"), F.floor(F.col("us") / 1_000_000).alias("id"))
    inside = (F.col("ir") >= 0) & (F.col("ir") == F.lag("ir").over(w))
    step = F.when(F.col("i") == 0, F.lit(0)).when(inside, F.greatest("step", F.abs(F.col("id") - F.lag("id").over(w)) * 2)).otherwise(F.col("step"))
    return r.withColumn("e", step).select("trip", "i", F.sum("e").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("eff"))


@query("w5_neighbour_speed", f"with {R.SEGMENTS}, v as (select trip, i, case when tb > ta then round((db - da) * 1000000 / (tb - ta), 3) else 0 end as v from segments) select trip, i, v, lag(v) over w as before, lead(v) over w as after from v window w as (partition by trip order by i)")
def w5(spark, sf_dir):
    w = Window.partitionBy("trip").orderBy("i")
    v = F.when(F.col("tb") > F.col("ta"), F.round((F.col("db") - F.col("da")) * 1_000_000 / (F.col("tb") - F.col("ta")), 3)).otherwise(0.0)
    return R.segments(R.stops(spark, sf_dir)).select("trip", "i", v.alias("v")).withColumns({"before": F.lag("v").over(w), "after": F.lead("v").over(w)})


@query("w8_monotone_clamp", f"with {R.STOPS} select trip, i, max(step) over (partition by trip order by i) as d from stops")
def w8(spark, sf_dir):
    w = Window.partitionBy("trip").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return R.stops(spark, sf_dir).select("trip", "i", F.max("step").over(w).alias("d"))


@query("o1_stable_order", "select row_number() over (order by n_regionkey = 0, n_nationkey) as pos, n_nationkey, n_regionkey = 0 as rail from nation")
def o1(spark, sf_dir):
    """Rail last, the given order kept. The dimension has a row for each route."""
    n = R.load(spark, sf_dir, "nation").withColumn("rail", F.col("n_regionkey") == 0)
    return n.select(F.row_number().over(Window.orderBy("rail", "n_nationkey")).cast("long").alias("pos"), "n_nationkey", "rail")


@query("f1_clock12", f"with {R.STOPS}, c as (select event_id, us // 3600000000 as h, (us // 60000000) % 60 as m from stops) select event_id, (case when h % 12 = 0 then 12 else h % 12 end)::varchar || ':' || lpad(m::varchar, 2, '0') || case when h < 12 then ' AM' else ' PM' end as clock from c")
def f1(spark, sf_dir):
    e = R.load(spark, sf_dir, "events").select("event_id", F.floor(R.micros_of_day() / 1_000_000).alias("t"))
    return e.select("event_id", S.clock12(F.col("t")).alias("clock"))


@query("f2_local_time", "select event_id, epoch_us(timezone('America/Los_Angeles', timezone('UTC', ts))) % 86400000000 // 1000000 as t, cast(dayofweek(timezone('America/Los_Angeles', timezone('UTC', ts))) as integer) as dow from events")
def f2(spark, sf_dir):
    """Time of day and weekday in the schedule's zone, of instants given in UTC."""
    local = F.convert_timezone(F.lit("UTC"), F.lit("America/Los_Angeles"), F.col("ts"))
    e = R.load(spark, sf_dir, "events").select("event_id", local.alias("l"))
    return e.select("event_id", (F.hour("l") * 3600 + F.minute("l") * 60 + F.floor(F.expr("extract(second from l)"))).cast("long").alias("t"), (F.dayofweek("l") - 1).alias("dow"))


@query("f3_parse_clock", f"with {R.STOPS} select event_id, (us // 60000000) * 60 as t from stops")
def f3(spark, sf_dir):
    e = R.load(spark, sf_dir, "events").select("event_id", F.date_format("ts", "HH:mm").alias("s"))
    return e.select("event_id", S.parse_clock(F.col("s")).alias("t"))


@query("f20_next_day", f"with {R.TRIPS} select trip, days, ((days << 1) & 127) | (days >> 6) as after from trips")
def f20(spark, sf_dir):
    return R.trips(R.stops(spark, sf_dir)).select("trip", "days", S.rotate_days(F.col("days")).alias("after"))


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips as arrays, with times floored to the hour so that stops tie, and every third stop fixed."""
    st = R.stops(spark, sf_dir).select("trip", "i", (F.floor(F.col("us") / 3_600_000_000) * 3600.0).alias("t"), (F.col("d") / 100).alias("d"))
    rows = F.array_sort(F.collect_list(F.struct("i", "t", "d")))
    return st.groupBy("trip").agg(rows.alias("r")).select("trip", F.col("r.i").alias("i"), F.col("r.t").alias("t"), F.col("r.d").alias("d"), F.transform("r", lambda x: x["i"] % 3 == 0).alias("fixed"))


_K4 = f"""with recursive {R.STOPS},
q as (select trip, list(((us // 3600000000) * 3600)::double order by i) as t, list(d / 100.0 order by i) as d, count(*) as n from stops group by trip),
e as (select trip, n, t, d, 1::bigint as head, false as done from q union all
  select trip, n, case when tail > head and lo >= 1 and d[hi] > d[lo] then
      list_transform(range(1, n + 1), lambda m: case when m > lo and m < hi then t[lo] + (t[hi] - t[lo]) * (d[m] - d[lo]) / (d[hi] - d[lo]) else t[m] end) else t end,
    d, greatest(tail, head + 1), false
  from (select *, case when tail < n then head else head - 1 end as lo, case when tail < n then tail + 1 else tail end as hi from (
    select *, coalesce(list_min(list_filter(range(head, n), lambda k: t[k + 1] - t[k] > 1)), n) as tail from e where head < n)))
select trip, m - 1 as i, round(t[m], 3) as t from (select trip, t, unnest(range(1, n + 1)) as m from e where head >= n)"""


@query("k4_detie", _K4)
def k4(spark, sf_dir):
    s = _sequences(spark, sf_dir).withColumn("out", timing.detie("t", "d"))
    return s.select("trip", F.posexplode("out").alias("i", "t")).select("trip", F.col("i").cast("long").alias("i"), F.round("t", 3).alias("t"))


@query("k6_repair")
def k6(spark, sf_dir):
    s = _sequences(spark, sf_dir).withColumn("out", timing.repair("t", "fixed", "d"))
    return s.select("trip", F.posexplode("out").alias("i", "t"))


_K23 = f"""with {R.TRIPS}, b as (select trip // 10000 as block, trip, t0, t1, days from trips),
c as (select *, case when t0 - lag(t1) over w between 0 and 43200000000 and (days & lag(days) over w) <> 0 then 0 else 1 end as fresh from b window w as (partition by block, days order by trip)),
g as (select *, sum(fresh) over (partition by block, days order by trip) as chain from c)
select block, days, cast(chain as bigint) as chain, min(trip) as trip, count(*) as merged, min(t0) as t0, max(t1) as t1 from g group by all"""


@query("k23_chain_blocks", _K23)
def k23(spark, sf_dir):
    """Workings of a block that start within half a day of the one before are one trip; the first one's id stays."""
    b = R.trips(R.stops(spark, sf_dir)).withColumn("block", F.floor(F.col("trip") / 10000))
    w = Window.partitionBy("block", "days").orderBy("trip")
    gap = F.col("t0") - F.lag("t1").over(w)
    fresh = F.when(gap.between(0, 43_200_000_000), 0).otherwise(1)
    g = b.withColumn("fresh", fresh).withColumn("chain", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy("block", "days", "chain").agg(F.min("trip").alias("trip"), F.count("*").alias("merged"), F.min("t0").alias("t0"), F.max("t1").alias("t1"))


@query("k23_chain_workings", f"""with {R.STOPS}, n as (select trip, max(i) as last from stops group by trip having max(i) >= 1),
legs as (select trip, j, 2 * j as a, least(2 * j + 2, last) as b from n, unnest(range(0, (last + 1) // 2)) as r(j)),
e as (select l.*, p.kind <> q.kind and p.us < q.us as goes from legs l join stops p on p.trip = l.trip and p.i = l.a join stops q on q.trip = l.trip and q.i = l.b),
f as (select *, case when goes and coalesce(lag(goes) over (partition by trip order by j), false) then 0 else 1 end as fresh from e),
c as (select *, sum(fresh) over (partition by trip order by j) as chain from f), h as (select *, min(j) over (partition by trip, chain) as root from c),
s as (select distinct h.trip * 1000 + h.root as trip, t.i, t.us, t.kind as stop from h join stops t on t.trip = h.trip and t.i between h.a and h.b)
select cast(trip as bigint) as trip, cast(row_number() over (partition by trip order by i) as integer) as seq, us, stop from s""")
def k23_workings(spark, sf_dir):
    """Trips that were cut at every second stop, put together again by place and time; round workings stand alone."""
    s = R.stops(spark, sf_dir).select("trip", "i", "us", "kind")
    # A stop at which a trip was cut ends one working and begins the next.
    s = s.withColumn("last", F.max("i").over(Window.partitionBy("trip"))).where("last >= 1")
    leg = F.expr("filter(array((i - 2) div 2, i div 2), j -> j >= 0 and j < (last + 1) div 2 and i between 2 * j and 2 * j + 2)")
    cut = s.withColumn("leg", F.explode(F.array_distinct(leg)))
    stops = cut.select((F.col("trip") * 1000 + F.col("leg")).alias("trip"), F.col("i").cast("long").alias("seq"), F.col("us").alias("arr"), F.col("us").alias("dep"), F.col("kind").alias("stop"), F.lit(0.0).alias("measure"), F.col("trip").alias("block"))
    workings = stops.select("trip", "block").distinct().select("trip", F.lit("all").alias("service"), "block", F.lit("r").alias("route"), F.lit("s").alias("shape"))
    chained, _ = chaining.chain_workings(workings, stops.drop("block"))
    return chained.select("trip", "seq", F.col("arr").alias("us"), "stop")
