"""Readers and writers of timetables, schedules and telemetry files."""

from __future__ import annotations

import json
import math
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions.scalars import word_tokens

#: Fixed layout of a schedule document.
SCHEDULE = """
systems array<string>, groups array<struct<n:string,sy:array<int>>>,
routes array<struct<sy:int,n:string,id:string,c:string,t:string,rail:boolean>>,
shapes array<array<double>>, _nativeShapes int,
insets array<array<array<double>>>, insetRanges array<array<array<double>>>, insetRect array<double>,
patterns array<struct<s:int,d:array<double>,ir:array<int>,id:array<double>,u:array<double>>>,
trips array<array<double>>, tripDays array<int>, date string
"""


def read_table(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A GTFS text table, all columns as strings; a byte-order mark in the first header is taken off.

    Only the wanted columns are parsed. A file that is not there is an empty table of them.
    """
    try:
        df = spark.read.option("header", True).option("enforceSchema", False).csv(f"{folder}/{name}")
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error) and columns:
            return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))
        raise
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    return df.select(*columns) if columns else df


def shape_points(spark: SparkSession, folder: str, *, every: int = 4, places: int = 5) -> DataFrame:
    """(route_id, lon, lat): each route's distinct points, every n-th of each shape in order, rounded.

    A shape that trips of several routes have goes to the route of the last of these rows in the file.
    """
    trips = read_table(spark, folder, "trips.txt", ["shape_id", "route_id"]).withColumn("_at", F.monotonically_increasing_id())
    trips = trips.groupBy("shape_id").agg(F.max_by("route_id", "_at").alias("route_id"))
    pts = read_table(spark, folder, "shapes.txt", ["shape_id", "shape_pt_sequence", "shape_pt_lon", "shape_pt_lat"])
    n = F.row_number().over(Window.partitionBy("shape_id").orderBy(F.col("shape_pt_sequence").cast("int"))) - 1
    kept = pts.withColumn("_n", n).where(F.col("_n") % every == 0).join(trips, "shape_id")
    return kept.select("route_id", F.round(F.col("shape_pt_lon").cast("double"), places).alias("lon"), F.round(F.col("shape_pt_lat").cast("double"), places).alias("lat")).distinct()


def stop_places(spark: SparkSession, folder: str, *, west: float, south: float, east: float, north: float) -> DataFrame:
    """(stop_id, stop_name, lon, lat, tokens): the stops strictly within a box, with the distinct words of their names.

    A stop without a place, or with one that is no number, is in no box; one without a name has no words.
    """
    stops = read_table(spark, folder, "stops.txt", ["stop_id", "stop_name", "stop_lon", "stop_lat"])
    stops = stops.withColumns({"lon": F.expr("try_cast(stop_lon as double)"), "lat": F.expr("try_cast(stop_lat as double)")})
    inside = (F.col("lon") > west) & (F.col("lon") < east) & (F.col("lat") > south) & (F.col("lat") < north)
    return stops.where(inside).select("stop_id", "stop_name", "lon", "lat", word_tokens(F.coalesce("stop_name", F.lit(""))).alias("tokens"))


def read_schedule(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of schedule documents, with ids that are places in the document; `version` is the file's path.

    document and range_counts are what `violations` asks for. Trips come decoded: stop_times holds absolute seconds, summed over the deltas.
    """
    doc = spark.read.schema(SCHEDULE).option("multiLine", True).json(path).withColumn("version", F.input_file_name())
    pairs = lambda a: F.transform(F.sequence(F.lit(0), F.floor(F.size(a) / 2).cast("int") - 1), lambda k: F.struct(F.get(a, 2 * k).alias("x"), F.get(a, 2 * k + 1).alias("y")))
    rows = lambda c, *names: doc.select("version", F.posexplode(c).alias(*names))
    patterns = rows("patterns", "p", "v").select("version", "p", "v.*")
    stops = patterns.where("s is not null").select("version", "p", F.posexplode(F.arrays_zip("d", *[F.coalesce(c, F.array().cast(k)).alias(c) for c, k in (("ir", "array<int>"), ("id", "array<double>"), ("u", "array<double>"))])).alias("i", "v")).select("version", "p", "i", "v.*")
    trips = doc.select("version", F.posexplode(F.arrays_zip("trips", "tripDays")).alias("trip", "v"))
    trips = trips.select("version", "trip", F.get("v.trips", F.lit(0)).cast("int").alias("r"), F.get("v.trips", F.lit(1)).cast("int").alias("p"), F.slice("v.trips", F.lit(3), F.greatest(F.size("v.trips") - 2, F.lit(0))).alias("delta"), F.col("v.tripDays").alias("days"))
    upto = Window.partitionBy("version", "trip").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    times = trips.select("version", "trip", F.posexplode("delta").alias("i", "step")).select("version", "trip", "i", F.sum("step").over(upto).alias("t"))
    insets = rows("insets", "s", "runs").select("version", "s", F.posexplode("runs").alias("run", "a"))
    length = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    return {
        "document": doc.select("version", F.col("_nativeShapes").alias("native"), length("insets").alias("insets"), length("insetRanges").alias("ranges")),
        "range_counts": rows("insetRanges", "s", "a").select("version", "s", F.coalesce(F.size("a"), F.lit(0)).alias("n")),
        "systems": rows("systems", "sy", "name"),
        "groups": doc.select("version", F.explode("groups").alias("g")).select("version", "g.n", "g.sy"),
        "routes": rows("routes", "r", "v").select("version", "r", "v.*"),
        "shapes": rows("shapes", "s", "a").where(F.size("a") >= 2).select("version", "s", F.posexplode(pairs(F.col("a"))).alias("k", "p")).select("version", "s", "k", "p.x", "p.y"),
        "inset_runs": insets.where(F.size("a") >= 2).select("version", "s", "run", F.posexplode(pairs(F.col("a"))).alias("k", "p")).select("version", "s", "run", "k", "p.x", "p.y"),
        "patterns": patterns.select("version", "p", "s"),
        "pattern_stops": stops,
        "trips": trips.drop("delta"),
        "stop_times": times,
    }


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of newline-delimited JSON; blank and malformed lines are dropped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.where(F.col("r").isNotNull() & F.col("r._bad").isNull()).select("r.*").drop("_bad")


def write_report(df: DataFrame, folder: str, digits: int = 1) -> None:
    """A CSV report of one file with a header; doubles are rounded. For ranked reports, which are short."""
    rounded = [F.round(c, digits).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes]
    df.select(*rounded).coalesce(1).write.mode("overwrite").option("header", True).csv(folder)


def write_json(value: object, path: str) -> None:
    """One small JSON document, replaced in one step; NaN and infinities are rejected, and a failure leaves the old file."""
    def check(v: object) -> None:
        if isinstance(v, float) and not math.isfinite(v):
            raise ValueError("not finite")
        for x in v.values() if isinstance(v, dict) else v if isinstance(v, (list, tuple)) else ():
            check(x)

    check(value)
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), suffix=".part")
    try:
        with os.fdopen(handle, "w") as out:
            json.dump(value, out, allow_nan=False)
            out.flush()
            os.fsync(out.fileno())
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise
