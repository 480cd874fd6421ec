import json
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wayfold.functions import scalars as S
from wayfold.operators import geometry as G
from wayfold.operators import joins, schedule, telemetry


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_interval_buckets(spark):
    trips = spark.createDataFrame([(0, -100, 0), (1, 300, 600), (2, 86000, 90000), (3, 90000, 91000)], "trip int, t0 int, t1 int")
    index = joins.bucket_rows(trips, F.col("t0"), F.col("t1"), 300, first=0, last=287)
    probes = {0: 0, 300: 1, 600: 1, 86399: 2}
    for t, trip in probes.items():
        assert [r.trip for r in index.where(F.col("bucket") == t // 300).where(F.lit(t).between(F.col("t0"), F.col("t1"))).collect()] == [trip]
    assert index.where("trip = 3").count() == 0


def test_range_join_is_the_plain_join(spark):
    a = spark.range(200).select("id", (F.col("id") * 37 % 1000).alias("lo")).withColumn("hi", F.col("lo") + F.col("id") % 90)
    p = spark.range(300).select((F.col("id") * 7 % 1100).alias("t"))
    plain = a.join(p, F.col("t").between(F.col("lo"), F.col("hi")))
    assert rows(joins.range_join(a, p, "lo", "hi", "t", 50)) == rows(plain)


def test_as_of(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, 10, "b"), (2, 1, "c")], "k int, t int, n string")
    right = spark.createDataFrame([(1, 4, 40), (1, 10, 100), (2, 2, 20)], "k int, t int, v int")
    assert rows(joins.as_of_join(left, right, "k", "t", "v").select("n", "v").na.fill(-1)) == [("a", 40), ("b", 100), ("c", -1)]


def test_nearest_is_brute_force(spark):
    rng = np.random.default_rng(3)
    p, t = rng.integers(0, 500, (60, 2)), rng.integers(0, 500, (40, 2))
    make = lambda x: spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(x)], "id long, x long, y long")
    got = {r.id: (r.nn_id, r.d2) for r in joins.nearest(make(p), make(t), 20.0).collect()}
    for i, a in enumerate(p):
        d = ((t - a) ** 2).sum(1)
        assert got[i] == (int(d.argmin()), float(d.min()))


def test_point_at_on_a_loop(spark):
    loop = spark.createDataFrame([(0, k, x, y) for k, (x, y) in enumerate([(0, 0), (10, 0), (0, 0), (0, 10)])], "s int, k int, x int, y int")
    probes = spark.createDataFrame([(0, 15.0), (0, 25.0), (0, -1.0), (0, 99.0)], "s int, at double")
    assert rows(G.point_at(loop, probes)) == [(0, -1.0, 0.0, 0.0), (0, 15.0, 5.0, 0.0), (0, 25.0, 0.0, 5.0), (0, 99.0, 0.0, 10.0)]


def test_resample_ends(spark):
    line = spark.createDataFrame([(0, 0, 0.0, 0.0), (0, 1, 10.0, 0.0)], "s int, k int, x double, y double")
    assert [r.x for r in G.resample(line, 4).orderBy("k").collect()] == [0, 4, 8]
    assert [r.x for r in G.resample(line, 4, end="clamp").orderBy("k").collect()] == [0, 4, 8, 10]
    assert [r.x for r in G.resample(line, 5).orderBy("k").collect()] == [0, 5]


def test_trimmed_lead(spark):
    pts = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 200.0, 0.0), (2, 0, 0.0, 0.0), (2, 1, 5.0, 0.0), (3, 0, 0.0, 0.0), (3, 1, 5.0, 0.0)], "s int, k int, x double, y double")
    anchors = spark.createDataFrame([(9, 1, 40.0, 0.0), (8, 1, 90.0, 3.0), (7, 3, 6.0, 0.0)], "id int, s int, x double, y double")
    assert rows(G.trim_lead(pts, anchors)) == [(1, 0, 40.0, 0.0, 40.0), (1, 1, 200.0, 0.0, 40.0), (2, 0, 0.0, 0.0, 0.0), (2, 1, 5.0, 0.0, 0.0), (3, 0, 5.0, 0.0, 5.0)]
    assert rows(G.trim_lead(pts.limit(0), anchors)) == []


def test_corridor(spark):
    ref = [(0, 0), (0, 20), (20, 20), (20, 0)]
    line = lambda pts: spark.createDataFrame([(0, k, float(x), float(y)) for k, (x, y) in enumerate(pts)], "s int, k int, x double, y double")

    def off(a, b):
        q = G.resample(line(a), 1, end="clamp").select(F.col("k").alias("id"), "s", "x", "y")
        return G.feet(q, G.edges(line(b))).agg(F.max("dist")).first()[0]

    assert off(ref, ref) == 0
    assert off(ref, [(0, 0), (20, 0)]) > 15
    assert off([(0, 0), (5, 0), (5, 20), (20, 20), (20, 0)], ref) > 3


def test_change_boxes():
    pts = pd.DataFrame({"x": [0, 5, 10, 200, 205, 210, 500], "y": [0, 0, 0, 0, 0, 0, 0]})
    out = G.change_boxes(pts)
    assert out[["x0", "x1"]].values.tolist() == [[-8, 18], [192, 218]]
    assert G.change_boxes(pts.iloc[:0]).empty


def test_shortest_path():
    e = pd.DataFrame({"a": [0, 1, 0, 3], "b": [1, 2, 2, 4], "cost": [1.0, 1.0, 3.0, 1.0]})
    assert G.shortest_path(e, 0, 2) == (2.0, [0, 1, 2])
    assert G.shortest_path(e, 0, 4) is None


def test_merge_order(spark):
    shapes = spark.createDataFrame([("a", 0, True), ("a", 1, False), ("b", 0, True), ("b", 1, False)], "feed string, s int, native boolean")
    pats = shapes.select("feed", F.col("s").alias("p"), "s")
    _, p, _ = schedule.merge_feeds(shapes, pats, pats.select("feed", F.col("p").alias("trip"), "p"))
    assert [r.new_s for r in p.orderBy("new_p").collect()] == [0, 2, 1, 3]


def test_clock_and_labels(spark):
    df = spark.createDataFrame([(0, "0:05", "A-Line 7/9"), (43200, "25:10", " Red--Line! "), (86340, "x", "")], "t int, c string, l string")
    got = df.select(S.clock12(F.col("t")), S.parse_clock(F.col("c")), S.norm_line(F.col("l")), S.slug(F.col("l"))).collect()
    assert [tuple(r) for r in got] == [("12:00 AM", 300, "ALINE7/9", "a-line-7-9"), ("12:00 PM", 90600, "REDLINE!", "red-line"), ("11:59 PM", None, "", "")]


def test_watchdog_batch(spark):
    """A stall while visible, none while hidden, none for the absence before a return."""
    events = [(0, "view"), (10, "view"), (20_010, "view"), (20_020, "error"), (200_000, "signup"), (200_010, "view"), (206_000, "view")]
    r = spark.createDataFrame([(1, i, k, at) for i, (at, k) in enumerate(events)], "sid long, n long, kind string, at long")
    kind = F.col("kind")
    out = telemetry.stalls(r, frame=kind == "view", hidden=kind == "error", visible=kind == "signup", limit_ms=4000)
    assert [(x.n, x.silent_ms) for x in out.orderBy("n").collect()] == [(2, 20_000), (6, 5_990)]


def test_stall_records(spark):
    r = spark.createDataFrame([("a", 1, 0, 5, "x"), ("a", 2, 10, 5, "x"), ("a", 3, 20, 6, "x"), ("a", 4, 30, 6, "x"), ("b", 1, 40, None, "x"), ("c", 1, 50, 1, "x"), ("c", 2, 60, 2, "x"), ("c", 3, 70, 3, "up")], "sid string, n int, at int, v int, kind string")
    stalled = spark.createDataFrame([("a", 2, 10), ("a", 4, 30), ("b", 1, 40), ("c", 2, 60)], "sid string, n int, at int")
    kept = telemetry.stall_records(r, stalled, clock=F.col("v"), recovered=F.col("kind") == "up").select("sid", "n", "stalls", "last_at", "at_stall", "verdict", "slot")
    assert rows(kept) == [("a", 2, 2, 30, False, True, None), ("b", 1, 1, 40, None, None, 1), ("c", 2, 1, 60, True, None, 0)]


def test_coalescing(spark):
    ev = [(0, "wheel")] * 300 + [(2000, "wheel")]
    r = spark.createDataFrame([(1, i, k, at) for i, (at, k) in enumerate(ev)], "sid long, n long, kind string, at long")
    assert [x.n for x in telemetry.coalesce_events(r, join_ms=1000, keep=24).orderBy("run").collect()] == [300, 1]


def test_sound_schedule_has_no_violations(spark):
    mk = spark.createDataFrame
    d = schedule.Schedule(
        mk([(0,)], "sy int"), mk([(0, 0)], "r int, sy int"), mk([(0, 0, 0.0, 0.0), (0, 1, 100.0, 0.0)], "s int, k int, x double, y double"),
        mk([(0, 0), (1, None)], "p int, s int"), mk([(0, 0, 0.0, 0, 1.0, 0.1), (0, 1, 50.0, 0, 5.0, 0.6)], "p int, i int, d double, ir int, id double, u double"),
        mk([(0, 0, 0, 127)], "trip int, r int, p int, days int"), mk([(0, 0, -60.0), (0, 1, 0.0)], "trip int, i int, t double"),
        mk([(0, 0, 10.0, 0.1, 0.7)], "s int, run int, length double, u0 double, u1 double"),
    )
    assert rows(schedule.violations(d)) == []
    d.pattern_stops = mk([(0, 0, 60.0, 3, 1.0, 0.9), (0, 1, 50.0, 0, 50.0, 0.6)], "p int, i int, d double, ir int, id double, u double")
    assert {r[0] for r in rows(schedule.violations(d))} == {"V7", "V8", "V9"}


def broadcast_scans(df):
    """What a plan reads from files below its broadcasts."""
    found, depth = set(), None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        at = len(line) - len(line.lstrip(" :+-"))
        if depth is None or at <= depth:
            depth = at if "BroadcastExchange" in line else None
        elif depth is not None:
            found |= set(re.findall(r"ReadSchema: (.*)", line))
    return found


def test_no_large_table_of_a_schedule_is_broadcast(spark, tmp_path):
    """150,000 patterns are a file of less than a MB, far below Spark's threshold, but some 10 MB as a broadcast relation."""
    n, mk = 150_000, spark.createDataFrame
    spark.range(n).selectExpr("id as p", "id % 2 as s").write.parquet(f"{tmp_path}/patterns.parquet")
    spark.range(2 * n).selectExpr("id div 2 as p", "id % 2 as i", "if(id = 7, -1, id % 2) * 50.0D as d").write.parquet(f"{tmp_path}/stops.parquet")
    spark.range(n).selectExpr("id as trip", "0 as r", "if(id = 5, -1, id) as p", "if(id = 9, 128, 127) as days").write.parquet(f"{tmp_path}/trips.parquet")
    spark.range(2 * n).selectExpr("id div 2 as trip", "id % 2 as i", "if(id = 7, -9D, 60D * (id % 2)) as t").where("trip <> 8 or i = 0").write.parquet(f"{tmp_path}/times.parquet")
    patterns, stops, trips, times = (spark.read.parquet(f"{tmp_path}/{f}.parquet") for f in ("patterns", "stops", "trips", "times"))
    shapes = mk([(s, k, 100.0 * k, 0.0) for s in (0, 1) for k in (0, 1)], "s long, k int, x double, y double")
    found = schedule.violations(schedule.Schedule(mk([(0,)], "sy int"), mk([(0, 0)], "r int, sy int"), shapes, patterns, stops, trips, times))
    assert broadcast_scans(found) == set()
    want = [("V7", 3, "backward"), ("V7", 3, "outside shape"), ("V10", 3, "backward times"), ("V10", 5, "pattern"), ("V10", 8, "stop count"), ("V10", 9, "days")]
    assert rows(found) == sorted(want)


def test_counts_of_a_document(spark):
    mk = spark.createDataFrame
    ok = dict(systems=mk([(0,)], "sy int"), routes=mk([(0, 0)], "r int, sy int"), shapes=mk([(0, 0, 0.0, 0.0), (0, 1, 100.0, 0.0)], "s int, k int, x double, y double"), patterns=mk([(0, 0)], "p int, s int"), pattern_stops=mk([(0, 0, 0.0), (0, 1, 50.0)], "p int, i int, d double"), trips=mk([(0, 0, 0, 127)], "trip int, r int, p int, days int"), stop_times=mk([(0, 0, 0.0), (0, 1, 9.0)], "trip int, i int, t double"), inset_runs=mk([(0, 0, 10.0, 0.1, 0.7)], "s int, run int, length double, u0 double, u1 double"))
    doc = lambda *r: mk([r], "native long, insets int, ranges int")
    counts = lambda n: mk([(0, n)], "s int, n int")
    ask = lambda **more: [r[0] for r in rows(schedule.violations(schedule.Schedule(**(ok | more))))]
    assert ask(document=doc(1, 1, 1), range_counts=counts(1)) == [] and ask(document=doc(None, 1, None)) == []
    assert ask(document=doc(2, 1, None)) == ["V3"] and ask(document=doc(-1, 0, 3)) == ["V3", "V4", "V4"] and ask(range_counts=counts(2)) == ["V4"]
    none = mk([], "r int, sy int"), mk([], "trip int, r int, p int, days int")
    assert ask(routes=none[0])[0] == "V1" and "V1" in ask(trips=none[1])
    assert "V2" in ask(shapes=mk([(0, 0, 0.0, 0.0), (0, 1, float("nan"), 0.0)], "s int, k int, x double, y double"))
    short = mk([(0, 0, 0.0, 0, 1.0, 0.1), (0, 1, 50.0, 0, 5.0, 0.6)], "p int, i int, d double, ir int, id double, u double")
    assert ask(pattern_stops=short, inset_runs=mk([(0, 0, 10.0, 0.7, 0.1)], "s int, run int, length double, u0 double, u1 double")) == ["V5"]


def test_fixtures(spark, tmp_path):
    from wayfold.operators import fixtures

    mk = spark.createDataFrame
    d = schedule.Schedule(
        mk([(0, "Metro")], "sy int, name string"), mk([(0, 0, "A"), (1, 0, "B")], "r int, sy int, n string"),
        mk([(s, k, 100.0 * k, 10.0 * s) for s in range(3) for k in range(4)], "s int, k int, x double, y double"),
        mk([(0, 0), (1, 1), (2, 2), (3, None)], "p int, s int"), mk([(p, i, 150.0 * i) for p in range(3) for i in range(3)], "p int, i int, d double"),
        mk([(0, 0, 0, 127), (1, 0, 1, 127), (2, 1, 2, 127)], "trip int, r int, p int, days int"), mk([], "trip int, i int, t double"),
    )
    base = {"system": "Metro", "route": "A", "tolerance": 12, "min_matches": 2}
    cases = [
        base | {"name": "end", "terminus": [300, 5]}, base | {"name": "no end", "terminus": [200, 5]}, base | {"name": "stop", "stop": [150, 5], "max_y": 0, "min_y": 0}, base | {"name": "far stop", "platform": [100, 5]},
        base | {"name": "way", "path": [50, 0, 250, 0], "gate": 20}, base | {"name": "off", "path": [50, -5, 250, -5], "gate": 20}, base | {"name": "gone", "path": [50, 900, 250, 900], "gate": 20}, base | {"name": "other", "route": "C", "stop": [0, 0], "tolerance": 1}, base | {"name": "south", "route": "B", "stop": [0, 20], "min_matches": 1, "max_y": 7, "min_y": 33},
    ]
    (tmp_path / "f.json").write_text(json.dumps(cases))
    got = rows(fixtures.fixture_failures(d, fixtures.read_fixtures(spark, str(tmp_path / "f.json")), step=10.0).select("name", "rule", F.coalesce("s", F.lit(-1)), "hits"))
    assert got == [("far stop", "stop", -1, 0), ("gone", "corridor", -1, 0), ("no end", "terminus", -1, 0), ("off", "corridor", 1, 2), ("other", "stop", -1, 0), ("south", "max_y", 2, 0), ("south", "min_y", 2, 0)]


def test_read_schedule(spark, tmp_path):
    from wayfold.sources.schedule import read_schedule

    doc = {"systems": ["A"], "routes": [{"sy": 0, "n": "1", "id": "r1", "rail": True}], "shapes": [[0, 0, 3, 4]], "insets": [None], "patterns": [{"s": 0, "d": [0, 5]}, None], "trips": [[0, 0, 60, 30]], "tripDays": [3]}
    (tmp_path / "s.json").write_text(json.dumps(doc))
    t = read_schedule(spark, str(tmp_path / "s.json"))
    assert [r.t for r in t["stop_times"].orderBy("i").collect()] == [60, 90]
    assert [(r.x, r.y) for r in t["shapes"].orderBy("k").collect()] == [(0, 0), (3, 4)]
    assert [r.d for r in t["pattern_stops"].orderBy("i").collect()] == [0, 5]


def test_gtfs_tables(spark, tmp_path):
    from wayfold.sources.schedule import read_table, shape_points

    (tmp_path / "trips.txt").write_text("﻿route_id,shape_id\nr,s\n")
    (tmp_path / "shapes.txt").write_text("shape_id,shape_pt_sequence,shape_pt_lon,shape_pt_lat\n" + "".join(f"s,{k},{k}.123456,1\n" for k in range(12)))
    assert rows(shape_points(spark, str(tmp_path))) == [("r", 0.12346, 1.0), ("r", 4.12346, 1.0), ("r", 8.12346, 1.0)]
    assert read_table(spark, str(tmp_path), "none.txt", ["a"]).count() == 0
    # A shape of several routes is that of the last row.
    (tmp_path / "trips.txt").write_text("route_id,shape_id\nz,s\na,s\nm,s\n")
    assert {r[0] for r in shape_points(spark, str(tmp_path)).collect()} == {"m"}


def test_stop_places(spark, tmp_path):
    from wayfold.sources.schedule import stop_places

    box = {"west": 1.0, "south": 1.0, "east": 3.0, "north": 3.0}
    assert stop_places(spark, str(tmp_path), **box).count() == 0
    lines = ["1,Main / 7th & Main,2,2", "2,edge,1,2", "3,,2.5,2", "4,nowhere,,2", "5,odd,x,2", "6,out,2,9"]
    (tmp_path / "stops.txt").write_text("﻿stop_id,stop_name,stop_lon,stop_lat\n" + "\n".join(lines) + "\n")
    assert rows(stop_places(spark, str(tmp_path), **box).select("stop_id", "lon", "lat", "tokens")) == [("1", 2.0, 2.0, ["MAIN", "7TH"]), ("3", 2.5, 2.0, [])]


def test_live_clock(spark):
    """Midnight moves the day on by one; the hour that is gone or comes twice with the season doesn't."""
    from wayfold.operators.telemetry import live_clock

    zone = "America/Los_Angeles"
    at = ["2026-03-08 09:59:00", "2026-03-08 10:00:00", "2026-03-09 06:59:59", "2026-03-09 07:00:00", "2026-11-01 08:59:00", "2026-11-01 09:00:00", "2026-11-04 07:00:00"]
    df = spark.createDataFrame([("s", i, a, 0) for i, a in enumerate(at)] + [("q", 0, at[3], 0), ("n", 0, None, 0)], "sid string, n long, a string, day int").withColumn("ts", F.to_timestamp_ntz("a"))
    got = {(r.sid, r.n): (r.t, r.day) for r in live_clock(df, zone=zone).collect()}
    hm = lambda h, m=0, s=0: h * 3600 + m * 60 + s
    assert [got["s", i] for i in range(7)] == [(hm(1, 59), 0), (hm(3), 0), (hm(23, 59, 59), 0), (0, 1), (hm(1, 59), 1), (hm(1), 1), (hm(23), 1)]
    assert got["q", 0] == (0, 1) and got["n", 0] == (None, None)
    assert live_clock(df.limit(0), zone=zone).count() == 0


def test_json_is_replaced_whole_or_not_at_all(tmp_path):
    from wayfold.sources.schedule import write_json

    path = tmp_path / "x.json"
    write_json({"a": 1}, str(path))
    with pytest.raises(ValueError):
        write_json({"a": float("nan")}, str(path))
    assert json.loads(path.read_text()) == {"a": 1} and len(list(tmp_path.iterdir())) == 1


def test_results(spark, tmp_path):
    from wayfold.sources.results import Results, key_of

    k = lambda **x: key_of(**{"inputs": {"f": "1"}, "code": "c", "settings": {}, "tables": {"t": {("a", 1): 2, ("b", 1): 3}}, "group": "a"} | x)
    assert k() == k(tables={"t": {("a", 1): 2, ("b", 1): 4}})
    assert len({k(), k(code="d"), k(inputs={"f": "2"}), k(tables={"t": {("a", 1): 5}})}) == 4
    store, made = Results(spark, str(tmp_path / "r")), []
    make = lambda: made.append(1) or spark.range(3).toDF("id")
    assert store.get("a", "k1", make).count() == 3 and store.get("a", "k1", make).count() == 3 and len(made) == 1
    damaged = sorted((tmp_path / "r/group=a/key=k1").glob("part-*.parquet"))[-1]  # partitions without rows come first
    kept = damaged.read_bytes()
    damaged.unlink()
    assert store.read("a", "k1") is None
    damaged.write_bytes(kept)
    assert store.read("a", "k1").count() == 3
    (tmp_path / "r/group=a/key=k1/_SUCCESS").unlink()
    assert store.read("a", "k1") is None and store.read("a", "k2") is None


def test_ingest_stream(spark, tmp_path):
    from wayfold.streaming.telemetry import ingest, keep_first, run_available

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text('{"t":"open","sid":"s","at":1}\n\nnot json\n[1]\n{"t":"final","sid":"s","at":5}\n')
    out = run_available(ingest(spark, str(tmp_path / "in")), "ingest")
    assert sorted((r.t or "", r.raw or "") for r in out.collect()) == [("", "[1]"), ("", "not json"), ("final", ""), ("open", "")]
    up = keep_first(spark, str(tmp_path / "store"))
    b = lambda x: spark.createDataFrame(x, "sid string, at long, n long, kind string")
    up(b([("s", 3, 1, "stall")]), 0)
    up(b([("s", 9, 2, "stall"), ("q", 1, 3, "stall")]), 1)
    up(b([("s", 9, 2, "stall"), ("q", 1, 3, "stall")]), 1)
    assert rows(spark.read.parquet(str(tmp_path / "store/version=1")).select("sid", "first.at", "count")) == [("q", 1, 1), ("s", 3, 2)]


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["k3_positions", "j2_as_of", "a2_fastest_segment", "k4_detie", "k11_roughness", "j4_nearest", "u3_merge_rebase", "t2_watchdog_stream", "w6b_pile", "t7_stall_verdicts", "k25_trim_lead", "f10_speed", "f23_getters", "t9_live_clock"])
def test_oracles(spark, name):
    import os

    import __spark_entry__ as entry

    if not os.path.isdir(SF):
        pytest.skip("no test data")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    df = entry.queries()[name](spark, SF)
    want = con.sql(entry.oracle_sql()[name])
    cols = sorted(df.columns)
    at = [[d[0] for d in want.description].index(c) for c in cols]
    order = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=order) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=order)


def test_registry():
    import __spark_entry__ as entry

    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 100


def test_registry_without_the_corpus_operators(tmp_path):
    """A copy without the optional subpackage imports and registers the other queries, with and without the pipeline's file."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "wayfold", tmp_path / "wayfold", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    ask = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n.startswith('op') or n == 'pipeline' for n in q), set(e.oracle_sql()) <= set(q))"
    for pipeline in (True, False):
        if pipeline and (root / "corpus_pipeline.py").exists():
            shutil.copy(root / "corpus_pipeline.py", tmp_path)
        said = subprocess.run([sys.executable, "-c", ask], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
        assert int(said[0]) > 100 and said[1:] == ["0", "True"]
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
