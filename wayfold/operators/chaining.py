"""Workings of one vehicle that go on as one trip: found by place and time, joined with their shared stop once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.streaming.telemetry import shared_folder

_SAME = ("service", "block", "route", "shape")


def _kept(df: DataFrame) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/wayfold-chain-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def next_workings(workings: DataFrame, stops: DataFrame) -> DataFrame:
    """(trip, next): the working that goes on where and when a trip ends, of the same service, block, route and shape.

    Workings that end where they begin, or that take no time, go on as nothing and are the next of nothing. Of several that
    end or begin at one place and time, the first by id goes on as the first, and so on.
    """
    ends = stops.groupBy("trip").agg(F.min_by(F.struct("stop", "dep"), "seq").alias("a"), F.max_by(F.struct("stop", "arr"), "seq").alias("b"))
    own = workings.select("trip", *_SAME).join(ends, "trip").where((F.col("a.stop") != F.col("b.stop")) & (F.col("a.dep") < F.col("b.arr")))
    nth = lambda end, at: F.row_number().over(Window.partitionBy(*_SAME, f"{end}.stop", f"{end}.{at}").orderBy("trip"))
    before = own.withColumn("nth", nth("b", "arr")).select("trip", *_SAME, F.col("b.stop").alias("stop"), F.col("b.arr").alias("at"), "nth")
    after = own.withColumn("nth", nth("a", "dep")).select(F.col("trip").alias("next"), *_SAME, F.col("a.stop").alias("stop"), F.col("a.dep").alias("at"), "nth")
    return before.join(after, [*_SAME, "stop", "at", "nth"]).select("trip", "next")


def chain_workings(workings: DataFrame, stops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chained stops (trip, seq, arr, dep, stop, working, measure) and chains (trip, working, place) of workings (trip, service,
    block, route, shape) with stops (trip, seq, arr, dep, stop, measure).

    A chain goes by the id of its first working; merges are the rows of chains with a place above 0. Stops are numbered anew
    from 1; a shared stop is kept once, as the end of the earlier working with the later one's departure. Measures stay those
    of each working's own run along the shape. A working with a null in its service, block, route or shape stands alone, as
    does one without stops, which has no rows. Chains are resolved in rounds that double the way; workings of one block are
    never gathered.
    """
    links = _kept(next_workings(workings, stops))
    # Each working's way back to its chain's first: (trip, root, steps).
    now = links.select(F.col("next").alias("trip"), F.col("trip").alias("root"), F.lit(1).alias("steps"))
    while True:
        up = now.select(F.col("trip").alias("root"), F.col("root").alias("_root"), F.col("steps").alias("_steps"))
        now = _kept(now.join(up, "root", "left").select("trip", F.coalesce("_root", "root").alias("root"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.col("_root").isNotNull().alias("moved")))
        done = now.where("moved").isEmpty()
        now = now.drop("moved")
        if done:
            break
    held = workings.select("trip").join(now, "trip", "left")
    chains = held.select(F.coalesce("root", "trip").alias("trip"), F.col("trip").alias("working"), F.coalesce("steps", F.lit(0)).alias("place"))
    own = stops.withColumnRenamed("trip", "working").join(chains, "working")
    order = Window.partitionBy("trip").orderBy("place", "seq")
    last = (F.lead("place").over(order) > F.col("place"))
    first = (F.lag("place").over(order) < F.col("place"))
    own = own.withColumn("dep", F.when(F.coalesce(last, F.lit(False)), F.lead("dep").over(order)).otherwise(F.col("dep"))).withColumn("_again", F.coalesce(first, F.lit(False)))
    own = own.where("not _again").withColumn("seq", F.row_number().over(order))
    return own.select("trip", "seq", "arr", "dep", "stop", "working", "measure"), chains
