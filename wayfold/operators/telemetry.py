"""Liveness of sessions from their event records, as windows over each session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_session(*order: str):
    return Window.partitionBy("sid").orderBy(*(order or ("at", "n")))


def visible_clock(records: DataFrame, hidden: Column, visible: Column) -> DataFrame:
    """records with vis, the milliseconds that the session was visible so far; a session starts visible."""
    w = by_session()
    state = F.last(F.when(hidden, False).when(visible, True), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    step = F.when(F.coalesce(state, F.lit(True)), F.col("at") - F.lag("at").over(w)).otherwise(0)
    return records.withColumn("_step", F.coalesce(step, F.lit(0))).withColumn("vis", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def stalls(records: DataFrame, *, frame: Column, hidden: Column, visible: Column, limit_ms: int) -> DataFrame:
    """(sid, n, at, silent_ms): frames that came after `limit_ms` of visible time without one; hidden time never counts.

    The clock starts anew when a hidden session is shown, so an absence is no stall.
    """
    v = visible_clock(records, hidden, visible).where(frame | visible)
    return v.withColumn("silent_ms", F.col("vis") - F.lag("vis").over(by_session())).withColumn("_frame", frame).where((F.col("silent_ms") >= limit_ms) & F.col("_frame")).select("sid", "n", "at", "silent_ms")


def timed_stalls(records: DataFrame, *, frame: Column, hidden: Column, visible: Column, limit_ms: int, until: int) -> DataFrame:
    """(sid, what, at, n, ms): a `stall` where a session's visible silence since its last frame (n) reaches `limit_ms` by `until`,
    with no other record needed, and the `resume` by the frame or showing (n) that ends it, with the visible time since.

    Windows over each session; a session's last record counts on to `until`.
    """
    w, after = by_session(), by_session().rowsBetween(1, Window.unboundedFollowing)
    upto = by_session().rowsBetween(Window.unboundedPreceding, 0)
    known = visible_clock(records.where(F.col("at") <= until), hidden, visible)
    known = known.withColumn("shown", F.coalesce(F.last(F.when(hidden, False).when(visible, True), ignorenulls=True).over(upto), F.lit(True)))
    known = known.withColumn("frame", frame).withColumn("showing", visible & ~F.coalesce(F.lag("shown").over(w), F.lit(True)))
    seen = F.coalesce(F.max(F.col("frame").cast("int")).over(upto), F.lit(0)) == 1
    known = known.withColumn("reset", F.col("frame") | (F.col("showing") & seen))
    at_reset = lambda c: F.when(F.col("reset"), F.col(c))
    known = known.withColumn("silent", F.col("vis") - F.last(at_reset("vis"), ignorenulls=True).over(upto))
    known = known.withColumn("next_at", F.coalesce(F.lead("at").over(w), F.lit(until))).withColumn("last_n", F.last(F.when(F.col("frame"), F.col("n")), ignorenulls=True).over(upto))
    end = F.first(F.when(F.col("reset"), F.struct("at", "n", "vis")), ignorenulls=True).over(after)
    ripe = F.col("at") + limit_ms - F.col("silent")
    stalls = known.withColumn("end", end).withColumn("ripe", ripe).where(F.col("shown") & (F.col("silent") < limit_ms) & (F.col("ripe") <= F.col("next_at")) & (F.col("end").isNull() | (F.col("end.at") > F.col("ripe"))))
    told = F.array(
        F.struct(F.lit("stall").alias("what"), F.col("ripe").alias("at"), F.col("last_n").alias("n"), F.lit(limit_ms).cast("long").alias("ms")),
        F.struct(F.lit("resume").alias("what"), F.col("end.at").alias("at"), F.col("end.n").alias("n"), (F.col("end.vis") - F.col("vis") - (limit_ms - F.col("silent"))).cast("long").alias("ms")),
    )
    return stalls.select("sid", F.explode(told).alias("t")).select("sid", "t.what", "t.at", "t.n", "t.ms").where("at is not null")


def coalesce_events(records: DataFrame, *, join_ms: int, keep: int) -> DataFrame:
    """(sid, run, kind, n, t0, t1): records of one kind in a row, each within `join_ms` of the one before; the last `keep`."""
    w = by_session()
    fresh = (F.col("kind") != F.lag("kind").over(w)) | (F.col("at") - F.lag("at").over(w) > join_ms)
    runs = records.withColumn("_f", F.coalesce(fresh, F.lit(True)).cast("long")).withColumn("run", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy("sid", "run").agg(F.first("kind").alias("kind"), F.count("*").alias("n"), F.min("at").alias("t0"), F.max("at").alias("t1"))
    last = F.row_number().over(Window.partitionBy("sid").orderBy(F.desc("run")))
    return out.withColumn("_r", last).where(F.col("_r") <= keep).drop("_r")


def first_records(records: DataFrame) -> DataFrame:
    """(sid, at, n, kind, count, slot): each session's first record and its count; slot 0 is the newest session, 1 the one
    before it, null the others."""
    first = records.groupBy("sid").agg(F.min(F.struct("at", "n", "kind")).alias("m"), F.count("*").alias("count"))
    return newest_slots(first.select("sid", "m.at", "m.n", "m.kind", "count"))


def newest_slots(out: DataFrame) -> DataFrame:
    """out, of one row for each session, with slot: 0 for the session with the last `at`, 1 for the one before it, else null."""
    newest = out.orderBy(F.desc("at"), F.desc("sid")).limit(2).withColumn("slot", F.row_number().over(Window.orderBy(F.desc("at"), F.desc("sid"))) - 1).select("sid", "slot")
    return out.join(F.broadcast(newest), "sid", "left")


def stall_records(records: DataFrame, stalled: DataFrame, *, clock: Column, recovered: Column) -> DataFrame:
    """(sid, n, at, stalls, last_at, at_stall, verdict, slot): the first stall of each session; later ones are only counted.

    at_stall: did the clock advance from the record before to the stall; verdict: does it from there to the next record
    (null where that is missing or has recovered; both null for records without a clock). slot as in `newest_slots`.
    """
    w = by_session()
    seen = records.select("sid", "n", (clock > F.lag(clock).over(w)).alias("at_stall"), F.when(~F.lead(recovered).over(w), F.lead(clock).over(w) > clock).alias("verdict"))
    first = stalled.groupBy("sid").agg(F.min(F.struct("at", "n")).alias("m"), F.count("*").alias("stalls"), F.max("at").alias("last_at"))
    return newest_slots(first.select("sid", "m.n", "m.at", "stalls", "last_at").join(seen, ["sid", "n"]))


def triage(records: DataFrame, *, now: int, alive_ms: int) -> DataFrame:
    """(sid, verdict): stalls before throttling before a clean end before still arriving before died."""
    s = records.groupBy("sid").agg(F.count_if(F.col("kind") == "stall").alias("stall"), F.count_if(F.col("kind") == "throttled").alias("throttled"), F.max(F.struct("at", "n", "kind")).alias("last"))
    verdict = F.when(F.col("stall") > 0, "stalls").when(F.col("throttled") > 0, "throttled").when(F.col("last.kind") == "final", "clean").when(F.lit(now) - F.col("last.at") < alive_ms, "arriving").otherwise("died")
    return s.select("sid", verdict.alias("verdict"))


def live_clock(samples: DataFrame, *, zone: str, fall_s: int = 3600) -> DataFrame:
    """(sid, n, t, day): what a live clock shows at each sample (sid, n, ts) of a session, ts in UTC without a zone.

    t is the second of the day in the zone. The weekday (0 for Sunday) is that of the session's first sample, moved on by one
    at each sample whose t is more than `fall_s` less than the one before: at midnight, but not in the hour that the season
    repeats. A session that sleeps for days moves on by one at most. Samples without ts have neither and move nothing;
    samples of no session are those of one. An empty table gives no rows; other columns are ignored.
    """
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("ts"))
    own = samples.select("sid", "n", "ts", local.alias("l"))
    own = own.withColumn("t", (F.hour("l") * 3600 + F.minute("l") * 60 + F.floor(F.expr("extract(second from l)"))).cast("long"))
    by = Window.partitionBy("sid").orderBy("ts", "n")
    fell = F.coalesce(F.col("t") < F.lag("t").over(by) - fall_s, F.lit(False)).cast("int")
    first = F.first("l", ignorenulls=True).over(by)
    own = own.withColumns({"fell": fell, "first": first})
    return own.select("sid", "n", "t", F.when(F.col("t").isNotNull(), (F.dayofweek("first") - 1 + F.sum("fell").over(by)) % 7).cast("int").alias("day"))
