"""Queries on event records of sessions, in batches and as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.operators import relations as R
from wayfold.operators import telemetry as T
from wayfold.plans.registry import query
from wayfold.streaming import telemetry as stream
from wayfold.streaming import watch
from wayfold.streaming.records import RecordStore

HOUR = 3_600_000
_REC = "rec as (select user_id as sid, event_id as n, event_type as kind, epoch_us(ts) // 1000 as at_ms, cast(round(value * 100) as bigint) as v from events)"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000 + F.floor(R.micros_of_day() / 1000)
    return R.load(spark, sf_dir, "events").select(F.col("user_id").alias("sid"), F.col("event_id").alias("n"), F.col("event_type").alias("kind"), at.alias("at"), F.round(F.col("value") * 100).cast("long").alias("v"))


@query("w9_rates", f"with {_REC} select sid, n, coalesce(round((v - lag(v) over w) * 1000 / (at_ms - lag(at_ms) over w), 3), 0) as rate from rec window w as (partition by sid order by at_ms, n)")
def w9(spark, sf_dir):
    w = T.by_session()
    rate = F.round((F.col("v") - F.lag("v").over(w)) * 1000 / (F.col("at") - F.lag("at").over(w)), 3)
    return records(spark, sf_dir).select("sid", "n", F.coalesce(rate, F.lit(0.0)).alias("rate"))


@query("w10_peak", f"with {_REC} select sid, n, max(v) over (partition by sid order by at_ms, n) as peak from rec")
def w10(spark, sf_dir):
    return records(spark, sf_dir).select("sid", "n", F.max("v").over(T.by_session().rowsBetween(Window.unboundedPreceding, 0)).alias("peak"))


@query("w12_tail", f"with {_REC}, r as (select sid, n, row_number() over (partition by sid order by at_ms desc, n desc) as back from rec) select sid, n, back from r where back <= 24")
def w12(spark, sf_dir):
    back = F.row_number().over(Window.partitionBy("sid").orderBy(F.desc("at"), F.desc("n"))).cast("long")
    return records(spark, sf_dir).select("sid", "n", back.alias("back")).where("back <= 24")


@query("w13_last_session", f"with {_REC}, f as (select sid, min(n) as first from rec group by sid) select arg_max(sid, first) as sid, max(first) as first from f")
def w13(spark, sf_dir):
    f = records(spark, sf_dir).groupBy("sid").agg(F.min("n").alias("first"))
    return f.agg(F.max(F.struct("first", "sid")).alias("m")).select("m.sid", "m.first")


@query("w14_skew", f"with {_REC} select sid, n, (at_ms - lag(at_ms) over w) - (v - lag(v) over w) as skew from rec window w as (partition by sid order by at_ms, n)")
def w14(spark, sf_dir):
    w = T.by_session()
    return records(spark, sf_dir).select("sid", "n", ((F.col("at") - F.lag("at").over(w)) - (F.col("v") - F.lag("v").over(w))).alias("skew"))


@query("w15_decaying_peak")
def w15(spark, sf_dir):
    """max(x, 0.99 * previous) of each session's last 240 values: a fold over a bounded, ordered array."""
    back = F.row_number().over(Window.partitionBy("sid").orderBy(F.desc("at"), F.desc("n")))
    tail = records(spark, sf_dir).withColumn("b", back).where("b <= 240")
    s = tail.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("at", "n", "v"))).alias("r"))
    return s.select("sid", F.aggregate("r", F.lit(0.0), lambda a, x: F.greatest(x["v"].cast("double"), a * 0.99)).alias("peak"))


@query("a21_worst_per_type", f"with {_REC}, r as (select kind, n, v, row_number() over (partition by kind order by v desc, n) as rn, count(*) over (partition by kind) as records, row_number() over (partition by kind order by at_ms desc, n desc) as back from rec) select kind, max(records) as records, max(n) filter (rn = 1) as worst, max(v) as v, max(n) filter (back = 1) as last from r group by kind")
def a21(spark, sf_dir):
    r = records(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("records"), F.max(F.struct("v", (-F.col("n")).alias("m"))).alias("w"), F.max(F.struct("at", "n")).alias("l"))
    return r.select("kind", "records", (-F.col("w.m")).alias("worst"), "w.v", F.col("l.n").alias("last"))


_STALLED = f"""with {_REC}, s as (select *, lag(case when kind = 'error' then false when kind = 'signup' then true end ignore nulls) over w as st, at_ms - lag(at_ms) over w as step from rec window w as (partition by sid order by at_ms, n)),
v as (select *, sum(case when coalesce(st, true) then coalesce(step, 0) else 0 end) over (partition by sid order by at_ms, n) as vis from s),
f as (select *, vis - lag(vis) over (partition by sid order by at_ms, n) as silent from v where kind in ('view', 'click', 'purchase', 'signup'))"""
_T2 = f"""{_STALLED} select sid, n, cast(silent as bigint) as silent_ms from f where kind <> 'signup' and silent >= {24 * HOUR}"""


def _frames() -> dict:
    kind = F.col("kind")
    return {"frame": kind.isin("view", "click", "purchase"), "hidden": kind == "error", "visible": kind == "signup", "limit_ms": 24 * HOUR}


@query("t2_watchdog", _T2)
def t2(spark, sf_dir):
    return T.stalls(records(spark, sf_dir), **_frames()).select("sid", "n", "silent_ms")


@query("t2_watchdog_stream", _T2)
def t2_stream(spark, sf_dir):
    """The watchdog as a stateful stream over the same records, run until its input is used up."""
    return stream.run_available(stream.watchdog(stream.records_stream(spark, f"{sf_dir}/events.parque[t]"), limit_ms=24 * HOUR), "watchdog").select("sid", "n", "silent_ms")


_LATE = 6 * HOUR
_UNTIL = f"(select max(at_ms) from rec) - {_LATE}"
#: Visible silence of a day, told when it is a day long: z has one row for each record up to the last six hours.
_T2_TIMER = f"""with {_REC}, r as (select *, coalesce(last_value(case when kind = 'error' then false when kind = 'signup' then true end ignore nulls) over (partition by sid order by at_ms, n rows between unbounded preceding and current row), true) as shown from rec where at_ms <= {_UNTIL}),
c as (select *, coalesce(lag(shown) over w, true) as was, coalesce(case when coalesce(lag(shown) over w, true) then at_ms - lag(at_ms) over w end, 0) as step, kind in ('view', 'click') as frame, max(kind in ('view', 'click')) over (partition by sid order by at_ms, n rows between unbounded preceding and current row) as seen from r window w as (partition by sid order by at_ms, n)),
v as (select *, sum(step) over (partition by sid order by at_ms, n rows between unbounded preceding and current row) as vis, frame or (kind = 'signup' and not was and seen) as reset from c),
z as (select *, vis - last_value(case when reset then vis end ignore nulls) over (partition by sid order by at_ms, n rows between unbounded preceding and current row) as silent,
  coalesce(lead(at_ms) over (partition by sid order by at_ms, n), {_UNTIL}) as next_at, last_value(case when frame then n end ignore nulls) over (partition by sid order by at_ms, n rows between unbounded preceding and current row) as last_n,
  first_value(case when reset then struct_pack(a := at_ms, n := n, v := vis) end ignore nulls) over (partition by sid order by at_ms, n rows between 1 following and unbounded following) as fin from v),
s as (select *, at_ms + {24 * HOUR} - silent as ripe from z where shown and silent < {24 * HOUR} and at_ms + {24 * HOUR} - silent <= next_at and (fin is null or fin.a > at_ms + {24 * HOUR} - silent))
select sid, 'stall' as what, cast(ripe as bigint) as at_ms, last_n as n, cast({24 * HOUR} as bigint) as ms from s union all select sid, 'resume', fin.a, fin.n, cast(fin.v - vis - ({24 * HOUR} - silent) as bigint) from s where fin is not null"""


@query("t2_timer_stalls", _T2_TIMER)
def t2_timer(spark, sf_dir):
    """Stalls at the moment when a visible session has been silent for a day, also of sessions that never speak again."""
    r = records(spark, sf_dir)
    kind, until = F.col("kind"), (r.agg(F.max("at")).first()[0] or 0) - _LATE
    return T.timed_stalls(r, frame=kind.isin("view", "click"), hidden=kind == "error", visible=kind == "signup", limit_ms=24 * HOUR, until=until).withColumnRenamed("at", "at_ms")


@query("t2_timer_stalls_stream", _T2_TIMER)
def t2_timer_stream(spark, sf_dir):
    """The same by timers in keyed state, from a stream of the records."""
    source = stream.records_stream(spark, f"{sf_dir}/events.parque[t]").withColumn("up", F.lit(None).cast("long"))
    rule = watch.StallRule(limit=24 * HOUR, tick=1, frames=("view", "click"), beats=(), hidden="error", visible="signup")
    return watch.run_watch(watch.watched(source, rule, late_ms=_LATE), "stalls").where("what <> 'verdict'").select("sid", "what", F.col("at").alias("at_ms"), "n", "ms")


_WEEK = 168 * HOUR


@query("s15_record_store", f"""with t as ({_T2_TIMER}), r as (select sid as owner, at_ms // {_WEEK} as session, * from t),
f as (select owner, session, min(at_ms) as first_at, arg_min(n, at_ms) as n, count(*) as stalls, max(at_ms) as last_at from r where what = 'stall' group by owner, session),
g as (select f.owner, f.session, max(r.at_ms) as recovered_at, arg_max(r.ms, r.at_ms) as recovered_ms from f join r on r.owner = f.owner and r.session = f.session and r.what = 'resume' and r.at_ms >= f.first_at group by f.owner, f.session),
k as (select f.*, recovered_at, recovered_ms, cast(row_number() over (partition by f.owner order by first_at desc, f.session desc) - 1 as integer) as slot from f left join g on g.owner = f.owner and g.session = f.session)
select owner, cast(session as bigint) as session, first_at, n, stalls, last_at, cast(recovered_at as bigint) as recovered_at, recovered_ms, slot from k where slot < 2""")
def s15(spark, sf_dir):
    """A session's first stall of each week, amended by its later reports in four batches, the last of them run twice."""
    r = records(spark, sf_dir)
    kind, until = F.col("kind"), (r.agg(F.max("at")).first()[0] or 0) - _LATE
    told = T.timed_stalls(r, frame=kind.isin("view", "click"), hidden=kind == "error", visible=kind == "signup", limit_ms=24 * HOUR, until=until)
    reports = told.select(F.col("sid").alias("owner"), F.floor(F.col("at") / _WEEK).alias("session"), "what", "at", "n", "ms", F.lit(None).cast("boolean").alias("flag"))
    folder = f"{stream.shared_folder(spark)}/wayfold-records-{uuid.uuid4().hex}"
    reports.write.parquet(f"{folder}/reports")
    reports = spark.read.parquet(f"{folder}/reports")
    ends = reports.agg(F.min("at"), F.max("at")).first()
    low, width = ends[0] or 0, max(((ends[1] or 0) - (ends[0] or 0)) // 4 + 1, 1)
    store = RecordStore(spark, f"{folder}/store")
    for k in (0, 1, 2, 3, 3):
        store.upsert(reports.where(F.floor((F.col("at") - low) / width) == k), k)
    return store.read().select("owner", "session", F.col("first.at").alias("first_at"), "first.n", "stalls", "last_at", F.col("recovered.at").alias("recovered_at"), F.col("recovered.ms").alias("recovered_ms"), "slot")


_QUIET, _FORGET = 12 * HOUR, 72 * HOUR
#: Silences of half a day in a history that ends six hours before the last record; after three days a session is gone.
_HEARTBEAT = f"""with {_REC}, r as (select *, lead(at_ms) over w as next_at, lead(n) over w as next_n, lead(v) over w - v as own, {_UNTIL} as fin from rec where at_ms <= {_UNTIL} window w as (partition by sid order by at_ms, n)),
s as (select *, coalesce(next_at, fin + 1) - at_ms as gap from r)
select sid, 'stall' as what, at_ms + {_QUIET + 1} as at_ms, n, cast({_QUIET + 1} as bigint) as ms, cast(null as boolean) as slept from s where gap > {_QUIET + 1}
union all select sid, 'gone', at_ms + {_FORGET}, n, cast({_FORGET} as bigint), null from s where gap > {_FORGET}
union all select sid, 'resume', next_at, next_n, gap, gap - own >= {24 * HOUR} from s where next_at is not null and gap > {_QUIET + 1} and gap <= {_FORGET}"""


@query("t3_heartbeat_stream", _HEARTBEAT)
def t3_stream(spark, sf_dir):
    """Silent sessions by timers: stall, resume (and whether the session's own clock stood still meanwhile), gone."""
    source = stream.records_stream(spark, f"{sf_dir}/events.parque[t]", own_clock=True)
    rule = watch.HeartbeatRule(quiet=_QUIET, forget=_FORGET, suspended=24 * HOUR)
    return watch.run_watch(watch.watched(source, rule, late_ms=_LATE), "heartbeat").select("sid", "what", F.col("at").alias("at_ms"), "n", "ms", F.col("flag").alias("slept"))


@query("t6_rates_stream", f"""with {_REC}, r as (select sid, n, at_ms, v, v - lag(v) over w as grew, at_ms - lag(at_ms) over w as passed from rec where at_ms <= {_UNTIL} window w as (partition by sid order by at_ms, n))
select sid, n, at_ms, cast(case when passed > 0 then (case when grew < 0 then v else grew end) * 1000000 // passed else 0 end as bigint) as rate, grew < 0 as reset from r where grew is not null""")
def t6_stream(spark, sf_dir):
    """Rates of each session's counter by a state of baselines that restarts where the counter falls."""
    source = stream.records_stream(spark, f"{sf_dir}/events.parque[t]", own_clock=True)
    told = watch.run_watch(watch.watched(source, watch.RateRule(), late_ms=_LATE), "rates")
    return told.select("sid", "n", F.col("at").alias("at_ms"), F.col("ms").alias("rate"), F.col("flag").alias("reset"))


@query("t13_late_records_stream", _HEARTBEAT)
def t13_stream(spark, sf_dir):
    """The same from a stream whose records come up to five hours late, in any order, some of them twice."""
    r = records(spark, sf_dir).select("sid", "n", "kind", "at", F.col("v").alias("up"))
    jitter = lambda seed: F.pmod(F.xxhash64("n", F.lit(seed)), F.lit(5 * HOUR))
    sent = r.withColumn("sent", F.col("at") + jitter(1)).union(r.where("n % 5 = 0").withColumn("sent", F.col("at") + jitter(2)))
    ends = sent.agg(F.min("sent"), F.max("sent")).first()
    folder = f"{stream.shared_folder(spark)}/wayfold-sent-{uuid.uuid4().hex}"
    slices = 4
    for k in range(slices if ends[0] is not None else 1):
        part = F.least(F.floor((F.col("sent") - (ends[0] or 0)) * slices / (((ends[1] or 0) - (ends[0] or 0)) or 1)), F.lit(slices - 1))
        sent.where(part == k).drop("sent").repartition(1).write.mode("append").parquet(folder)
    rule = watch.HeartbeatRule(quiet=_QUIET, forget=_FORGET, suspended=24 * HOUR)
    told = watch.run_watch(watch.watched(watch.file_stream(spark, folder), rule, late_ms=_LATE), "late")
    return told.select("sid", "what", F.col("at").alias("at_ms"), "n", "ms", F.col("flag").alias("slept"))


_T4 = f"""with {_REC}, f as (select *, case when kind <> lag(kind) over w or at_ms - lag(at_ms) over w > {24 * HOUR} or lag(kind) over w is null then 1 else 0 end as fresh from rec window w as (partition by sid order by at_ms, n)),
g as (select *, sum(fresh) over (partition by sid order by at_ms, n) as run from f),
r as (select sid, cast(run as bigint) as run, min(kind) as kind, count(*) as n, min(at_ms) as t0, max(at_ms) as t1 from g group by sid, run), k as (select *, row_number() over (partition by sid order by run desc) as back from r)
select sid, run, kind, n, t0, t1 from k where back <= 24"""


@query("t4_coalesce", _T4)
def t4(spark, sf_dir):
    return T.coalesce_events(records(spark, sf_dir), join_ms=24 * HOUR, keep=24)


_T8 = f"""with {_REC}, r as (select *, row_number() over (partition by sid order by at_ms, n) as k, count(*) over (partition by sid) as count from rec), f as (select sid, n, kind, at_ms, count from r where k = 1)
select sid, n, kind, count, case when row_number() over (order by at_ms desc, sid desc) <= 2 then cast(row_number() over (order by at_ms desc, sid desc) - 1 as integer) end as slot from f"""


@query("t8_first_record", _T8)
def t8(spark, sf_dir):
    return T.first_records(records(spark, sf_dir)).select("sid", "n", "kind", "count", "slot")


@query("t7_stall_verdicts", f"""{_STALLED},
o as (select sid, arg_min(n, struct_pack(a := at_ms, n := n)) as n, count(*) as stalls, max(at_ms) as last_ms, min(at_ms) as first_ms from f where kind <> 'signup' and silent >= {24 * HOUR} group by sid),
seen as (select sid, n, v > lag(v) over w as at_stall, case when lead(kind) over w <> 'purchase' then lead(v) over w > v end as verdict from rec window w as (partition by sid order by at_ms, n)),
k as (select *, row_number() over (order by first_ms desc, sid desc) - 1 as slot from o)
select sid, n, stalls, last_ms, at_stall, verdict, cast(case when slot < 2 then slot end as integer) as slot from k join seen using (sid, n)""")
def t7(spark, sf_dir):
    """What is kept of the first stall of each session, with the verdict of the record after it."""
    r = records(spark, sf_dir)
    kept = T.stall_records(r, T.stalls(r, **_frames()), clock=F.col("v"), recovered=F.col("kind") == "purchase")
    return kept.select("sid", "n", "stalls", F.col("last_at").alias("last_ms"), "at_stall", "verdict", "slot")


_KIND = "case when v > 45000 then 'stall' when v > 40000 then 'throttled' when v < 3000 then 'final' else 'sample' end"


@query("t15_triage", f"with {_REC}, k as (select sid, n, at_ms, {_KIND} as kind from rec), s as (select sid, count(*) filter (kind = 'stall') as stall, count(*) filter (kind = 'throttled') as thr, arg_max(kind, struct_pack(a := at_ms, n := n)) as last, max(at_ms) as at_last from k group by sid) select sid, case when stall > 0 then 'stalls' when thr > 0 then 'throttled' when last = 'final' then 'clean' when (select max(at_ms) from rec) - at_last < {72 * HOUR} then 'arriving' else 'died' end as verdict from s")
def t15_all(spark, sf_dir):
    """Verdicts on all records of each session; `t15_triage` sees each seventh."""
    r = records(spark, sf_dir)
    now = r.agg(F.max("at")).first()[0] or 0
    return T.triage(r.select("sid", "n", "at", F.expr(_KIND).alias("kind")), now=now, alive_ms=72 * HOUR)


@query("s6_malformed_lines", "select count(*) filter (event_id % 10 <> 0 and event_id % 15 <> 0) as kept, count(*) filter (event_id % 10 = 0 or event_id % 15 = 0) as dropped from events")
def s6(spark, sf_dir):
    """Lines that are blank or no JSON object are dropped."""
    line = F.when(F.col("event_id") % 10 == 0, F.lit("")).when(F.col("event_id") % 15 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props"))
    parsed = R.load(spark, sf_dir, "events").select(F.trim(line).alias("line")).withColumn("r", F.from_json("line", "k int, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    good = (F.col("line") != "") & F.col("r").isNotNull() & F.col("r._bad").isNull()
    return parsed.agg(F.count_if(good).alias("kept"), F.count_if(~good).alias("dropped"))


@query("t9_live_clock", """with l as (select user_id as sid, event_id as n, ts, timezone('America/Los_Angeles', timezone('UTC', ts)) as l from events),
s as (select sid, n, ts, l, epoch_us(l) % 86400000000 // 1000000 as t from l),
f as (select *, coalesce(t < lag(t) over w - 3600, false)::int as fell, dayofweek(first_value(l ignore nulls) over w) as d from s window w as (partition by sid order by ts, n))
select sid, n, t, cast((d + sum(fell) over (partition by sid order by ts, n)) % 7 as integer) as day from f""")
def t9(spark, sf_dir):
    """What the live clock of each user shows at each record."""
    e = R.load(spark, sf_dir, "events").select(F.col("user_id").alias("sid"), F.col("event_id").alias("n"), F.col("ts").cast("timestamp_ntz").alias("ts"))
    return T.live_clock(e, zone="America/Los_Angeles")
