"""Timetable relations derived from the supplied tables, and the SQL that derives the same in the oracle.

Times are whole microseconds since midnight and distances whole cents, so sums do not depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros_of_day(ts: str = "ts") -> Column:
    """Microseconds since midnight of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"(hour({ts}) * 3600L + minute({ts}) * 60L) * 1000000L + cast(extract(second from {ts}) * 1000000 as bigint)")


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stop_times: one trip for each user and day, stops in order of time, d running over the values."""
    day = F.col("ts").cast("date")
    order = Window.partitionBy("trip").orderBy("us", "event_id")
    return (
        load(spark, sf_dir, "events")
        .select((F.col("user_id") * 10000 + F.datediff(day, F.lit("2024-01-01").cast("date"))).alias("trip"), "user_id", day.alias("day"), micros_of_day().alias("us"), F.round(F.col("value") * 100).cast("long").alias("step"), F.col("event_type").alias("kind"), "event_id")
        .withColumn("i", F.row_number().over(order) - 1)
        .withColumn("d", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    )


def segments(stop_times: DataFrame) -> DataFrame:
    """Consecutive pairs of stops; the last one of a trip is closed on the right. One window, one shuffle by trip."""
    order = Window.partitionBy("trip").orderBy("i")
    ahead = lambda c: F.lead(c).over(order)
    return (
        stop_times.select("trip", "i", F.col("us").alias("ta"), F.col("d").alias("da"), ahead("us").alias("tb"), ahead("d").alias("db"), F.lead("us", 2).over(order).isNull().alias("is_last"))
        .where("tb is not null")
    )


def trips(stop_times: DataFrame) -> DataFrame:
    return stop_times.groupBy("trip").agg(F.min("us").alias("t0"), F.max("us").alias("t1"), F.count("*").alias("n"), F.min("day").alias("day")).select("trip", "t0", "t1", "n", (F.expr("shiftleft(1, dayofweek(day) - 1)")).alias("days"))


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekday bits of each customer's orders; bit 0 is Sunday."""
    return load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("service")).agg(F.expr("bit_or(shiftleft(1, dayofweek(o_orderdate) - 1))").alias("days"))


def shape_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, k, x, y): each embedding as a polyline of points, in thousandths as whole numbers."""
    flat = F.transform("embedding", lambda v: F.round(v.cast("double") * 1000).cast("long"))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("e") / 2).cast("int") - 1), lambda k: F.struct(F.get("e", 2 * k).alias("x"), F.get("e", 2 * k + 1).alias("y")))
    e = load(spark, sf_dir, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("s"), flat.alias("e"))
    return e.select("s", F.posexplode(pairs).alias("k", "p")).select("s", "k", "p.x", "p.y")


STOPS = """
stops as (select user_id * 10000 + date_diff('day', date '2024-01-01', cast(ts as date)) as trip, user_id, cast(ts as date) as day, event_type as kind, event_id,
  row_number() over w - 1 as i, epoch_us(ts) % 86400000000 as us, cast(round(value * 100) as bigint) as step,
  cast(sum(cast(round(value * 100) as bigint)) over w as bigint) as d
  from events window w as (partition by user_id, cast(ts as date) order by ts, event_id))"""
SEGMENTS = STOPS + """,
segments as (select * from (select trip, i, us as ta, d as da, lead(us) over w as tb, lead(d) over w as db, lead(us, 2) over w is null as is_last
  from stops window w as (partition by trip order by i)) where tb is not null)"""
TRIPS = STOPS + """,
trips as (select trip, min(us) as t0, max(us) as t1, count(*) as n, 1 << cast(dayofweek(min(day)) as integer) as days from stops group by trip)"""
CALENDAR = "calendar as (select o_custkey as service, bit_or(1 << cast(dayofweek(o_orderdate) as integer)) as days from orders group by 1)"
POINTS = """
points as (select vec_id as s, k, cast(round(cast(embedding[2 * k + 1] as double) * 1000) as bigint) as x, cast(round(cast(embedding[2 * k + 2] as double) * 1000) as bigint) as y
  from embeddings, unnest(range(0, 32)) as r(k) where embedding is not null)"""
