"""Rules that name a route and say where its shapes and stops are to be."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators import geometry as G
from wayfold.operators.schedule import Schedule

#: A case has one of terminus, platform, stop (a point) and path (a corridor), and may bound its shapes' y.
FIXTURES = """
name string, system string, route string, terminus array<double>, platform array<double>, stop array<double>, path array<double>,
gate double, tolerance double, min_matches int, min_y double, max_y double
"""


def read_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """The cases of a JSON list; keys that are missing are null, others are ignored."""
    return spark.read.schema(FIXTURES).option("multiLine", True).json(path)


def fixture_failures(d: Schedule, cases: DataFrame, *, step: float) -> DataFrame:
    """(name, rule, s, hits): every case that does not hold, none for a sound schedule.

    d.systems has (sy, name) and d.routes (r, sy, n). terminus: at least min_matches shapes of the route end within the
    tolerance of the point; stop (or platform): so many of its patterns have a stop there; path: so many of its shapes have
    both ends of the corridor within the gate, and each of those is nowhere further off it than the tolerance, nor it from
    them; min_y, max_y: no shape passes the bound by more. s is the shape that fails (null: too few matches), hits
    the matches. A case whose route has no trips has no matches. Cases are few and are broadcast; corridors are shapes of their own.
    """
    routes = d.routes.join(d.systems, "sy").select("r", F.col("n").alias("route"), F.col("name").alias("system"))
    own = F.broadcast(cases).join(routes, ["route", "system"]).join(d.trips.select("r", "p").distinct(), "r").join(d.patterns.where("s is not null").select("p", "s"), "p")
    patterns = own.select("name", "p", "s").distinct()
    shapes = own.select("name", "s").distinct()
    few = lambda kind, hits: cases.where(kind).join(hits, "name", "left").select("name", F.coalesce("hits", F.lit(0)).alias("hits"), "min_matches").where("hits < min_matches")
    line = lambda rule, rows, s=F.lit(None): rows.select("name", F.lit(rule).alias("rule"), s.cast("long").alias("s"), F.col("hits").cast("long").alias("hits"))
    near = lambda x, y, at: F.hypot(F.col(x) - F.get(at, F.lit(0)), F.col(y) - F.get(at, F.lit(1))) <= F.col("tolerance")

    ends = d.shapes.groupBy("s").agg(*(f(c, "k").alias(f"{c}_{i}") for i, f in enumerate((F.min_by, F.max_by)) for c in "xy"), F.min("y").alias("low"), F.max("y").alias("high"))
    seen = shapes.join(F.broadcast(cases), "name").join(ends, "s")
    terminus = seen.where(near("x_0", "y_0", "terminus") | near("x_1", "y_1", "terminus")).groupBy("name").agg(F.count("*").alias("hits"))
    point = F.coalesce("platform", "stop")
    probes = d.pattern_stops.join(patterns, "p").select("name", "p", "s", F.col("d").alias("at"))
    stops = probes.join(G.point_at(d.shapes, probes.select("s", "at").distinct()), ["s", "at"]).join(F.broadcast(cases), "name")
    stops = stops.where(near("x", "y", point)).select("name", "p").distinct().groupBy("name").agg(F.count("*").alias("hits"))

    # A corridor is a line with an id below those of the shapes.
    number = -1 - F.pmod(F.xxhash64("name"), F.lit(1 << 62))
    corridors = cases.where("path is not null").select("name", number.alias("other"), "path", "gate", "tolerance")
    vertices = corridors.select(F.col("other").alias("s"), F.posexplode(F.sequence(F.lit(0), F.size("path") - 2, F.lit(2))).alias("k", "i"), "path").select("s", "k", F.get("path", F.col("i")).alias("x"), F.get("path", F.col("i") + 1).alias("y"))
    points = d.shapes.select(F.col("s").cast("long").alias("s"), F.col("k").cast("int").alias("k"), "x", "y").unionByName(vertices.select("s", F.col("k").cast("int").alias("k"), "x", "y"))
    pairs = shapes.join(F.broadcast(corridors.select("name", "other")), "name").select(F.col("s").cast("long").alias("s"), "other").distinct()
    gates = {r.other: r.gate for r in corridors.select("other", "gate").collect()}
    error = _errors(points, pairs, gates, step)
    met = error.where("off is not null").join(F.broadcast(corridors.select("name", "other", "tolerance")), "other")
    hits = met.groupBy("name").agg(F.count("*").alias("hits"))
    far = met.where(F.greatest("off", "uncovered") > F.col("tolerance")).join(hits, "name")
    bound = lambda rule, test: line(rule, seen.where(test).withColumn("hits", F.lit(0)), F.col("s"))
    out = [
        line("terminus", few("terminus is not null", terminus)),
        line("stop", few("terminus is null and coalesce(platform, stop) is not null", stops)),
        line("corridor", few("path is not null", hits)),
        line("corridor", far, F.col("s")),
        bound("min_y", F.col("low") < F.col("min_y") - F.col("tolerance")),
        bound("max_y", F.col("high") > F.col("max_y") + F.col("tolerance")),
    ]
    first = out[0]
    for more in out[1:]:
        first = first.unionByName(more)
    return first


def _errors(points: DataFrame, pairs: DataFrame, gates: dict[int, float], step: float) -> DataFrame:
    """(s, other, off, uncovered) of shapes and corridors, by each corridor's own gate."""
    out = None
    for gate in sorted(set(gates.values())) or [0.0]:
        mine = pairs.where(F.col("other").isin([o for o, g in gates.items() if g == gate]))
        got = G.by_pair(points, mine, lambda a, b, gate=gate: G.corridor_error(a, b, gate=gate, step=step), "off double, uncovered double")
        out = got if out is None else out.unionByName(got)
    return out
