"""Queries over whole tables against brute force or their SQL."""

import os

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from wayfold.operators import geometry as G
from wayfold.operators import placement

SF = "/root/testdata/sf0.001"


def shapes(spark, n=9, vertices=12, gap=4):
    """Random lines of ids 0 to n but `gap`, and the same as arrays."""
    rng = np.random.default_rng(8)
    lines = {s: rng.integers(-120, 120, (vertices, 2)) for s in range(n) if s != gap}
    return spark.createDataFrame([(s, k, int(x), int(y)) for s, p in lines.items() for k, (x, y) in enumerate(p)], "s long, k int, x long, y long"), lines


def test_every_shape_has_a_next_one(spark):
    pts, lines = shapes(spark)
    got = {r.s: r.other for r in G.next_shapes(pts).collect()}
    assert got == {s: s + 1 if s + 1 in lines else 0 for s in lines}


def test_drift_of_all_is_drift_of_each(spark):
    pts, _ = shapes(spark)
    pairs = {r.s: r.other for r in G.next_shapes(pts).collect()}
    got = G.by_pair(pts, G.next_shapes(pts), lambda a, b: G.pair_drift(G.sample_line(a, 40), b, step=40, off=12, far=60), "arc double, drift double, beyond double, p90 double, median double, worst double")
    got = {r.s: tuple(r)[2:] for r in got.collect()}
    assert set(got) == set(pairs)
    for s, other in list(pairs.items())[:3]:
        ink = pts.where(F.col("s") == other).select(F.struct("s", "k").alias("id"), "x", "y")
        want = G.drift(G.resample(pts.where(F.col("s") == s), 40), ink, step=40, off=12, far=60).collect()
        assert np.allclose(got[s], tuple(want[0])[1:]) if want else got[s] == (None,) * 6


def test_rejoins_of_pairs(spark):
    """Two paths over one stroke each, the second one not in a tenth that any filter chose; other strokes do not count."""
    ink = spark.createDataFrame([(sid, n, float(n), float(n), 0.0) for sid in (3, 4, 5) for n in range(300)], "sid long, n int, arc double, x double, y double")
    path = [(k, float(4 * k), 0.0 if k < 20 or k > 30 else 15.0) for k in range(60)]
    s = spark.createDataFrame([(i, *p) for i in (7, 8) for p in path], "s long, k int, x double, y double")
    out = placement.rejoins(s, ink, step=4, pairs=spark.createDataFrame([(7, 4), (8, 5)], "s long, sid long")).collect()
    assert sorted((r.s, r.sid, r.k0, r.k1, r.off) for r in out) == [(7, 4, 19, 31, 15.0), (8, 5, 19, 31, 15.0)]


def test_all_shapes_and_records_take_part(spark):
    import __spark_entry__ as entry

    if not os.path.isdir(SF):
        pytest.skip("no test data")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    for name in ("w7_turns", "p12_occlusion", "t15_triage", "j13_crossings", "k10_corridor_score"):
        want = con.sql(entry.oracle_sql()[name])
        got = entry.queries()[name](spark, SF).select([d[0] for d in want.description])
        assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_corridor_windows():
    """A route that runs on past both ends of its corridor: only the stretch between them counts."""
    corridor = np.array([(0, 0), (100, 0)], float)
    route = np.array([(0, 300), (0, 2), (50, 2), (50, 30), (60, 30), (60, 2), (100, 2), (100, 400)], float)
    off, uncovered = G.corridor_error(route, corridor, gate=10, step=1)
    assert abs(off - 30) < 1e-9 and abs(uncovered - 5.385) < 0.01
    assert G.corridor_error(route[::-1], corridor, gate=10, step=1) == pytest.approx((off, uncovered))
    assert G.corridor_error(route + [0, 50], corridor, gate=10, step=1) == (None, None)
    assert G.corridor_error(np.array([(0, 0), (40, 0)], float), corridor, gate=10, step=1) == (None, None)


def test_corridor_scores(spark):
    """The same route in samples, one far away, and one that meets both ends with one sample."""
    corridor = np.array([(0, 0), (100, 0)], float)
    route = np.array([(0, 300), (0, 2), (50, 2), (50, 30), (60, 30), (60, 2), (100, 2), (100, 400)], float)
    lines = {1: G.sample_line(route, 2), 2: G.sample_line(corridor, 2), 3: G.sample_line(route, 2) + [0, 5000], 4: np.array([(50.0, 9.0)])}
    samples = spark.createDataFrame([(s, k, float(x), float(y)) for s, p in lines.items() for k, (x, y) in enumerate(p)], "s long, k long, x double, y double").repartition(3)
    pairs = spark.createDataFrame([(1, 2), (3, 2), (4, 2), (2, 2)], "s long, other long")
    got = {r.s: r for r in G.corridor_scores(samples, pairs, reach=150, cover=3).collect()}
    d = np.hypot(*np.moveaxis(lines[1][:, None] - lines[2][None], 2, 0))
    lo, hi = sorted((d[:, 0].argmin(), d[:, -1].argmin()))
    own = d[lo : hi + 1]
    assert got[1].n == hi - lo + 1 < len(d) / 4 and 29 < got[1].mx < 31 and 0.8 < got[1].cover < 1
    assert np.allclose([got[1].p50, got[1].p90, got[1].mx], np.quantile(own.min(axis=1), [0.5, 0.9, 1])) and abs(got[1].cover - (own.min(axis=0) < 3).mean()) < 1e-12
    assert tuple(got[3])[2:] == tuple(got[4])[2:] == (None,) * 5 and (got[2].mx, got[2].cover) == (0, 1)


def test_feet_of_lines_are_the_joins(spark):
    pts, lines = shapes(spark)
    probes = [(i, 1, float(x), float(y)) for i, (x, y) in enumerate(lines[0])]
    want = G.feet(spark.createDataFrame(probes, "id int, s long, x double, y double"), G.edges(pts)).orderBy("id").collect()
    dist, arc = G.line_feet(lines[0].astype(float), lines[1].astype(float))
    assert np.allclose(dist, [r.dist for r in want]) and np.allclose(arc, [r.arc for r in want])


def test_corridors_of_all_shapes(spark):
    import __spark_entry__ as entry

    if not os.path.isdir(SF):
        pytest.skip("no test data")
    q = entry.queries()
    n = q["k22_fly_to"](spark, SF).count()
    for name in ("k9_corridor_error", "k10_corridor_score"):
        assert q[name](spark, SF).select("s").distinct().count() == n
    assert q["k17_fit_robust"](spark, SF).count() == 6


def test_cheapest_way_is_the_least_of_all(spark):
    import itertools

    import __spark_entry__ as entry

    rng = np.random.default_rng(1)
    for _ in range(20):
        p = rng.integers(-200, 200, (7, 2)).astype(float)
        hop = lambda a, b: (w := float(np.hypot(*(p[a] - p[b])))) * (3 if w > 150 else 1)
        ways = [(0, *mid, 6) for n in range(6) for mid in itertools.permutations(range(1, 6), n)]
        assert abs(G.cheapest_way(p, long=150, times=3) - min(sum(map(hop, w, w[1:])) for w in ways)) < 1e-6
    if os.path.isdir(SF):
        q = entry.queries()
        assert q["k15_shortest_path"](spark, SF).count() == q["k22_fly_to"](spark, SF).count()


def test_matches_of_all_shapes_are_brute_force(spark):
    pts, lines = shapes(spark, n=14)
    got = {r.s: (r.other, r.score) for r in G.match_shapes(pts, step=30, radius=20).collect()}
    assert set(got) == set(lines)
    for s, p in lines.items():
        score, other = min((G.match_score(p.astype(float), q.astype(float), step=30)[1], o) for o, q in lines.items() if o != s)
        assert got[s][0] == other and abs(got[s][1] - score) < 1e-9
    odd = spark.createDataFrame([(70, 0, None, 0.0), (70, 1, 1.0, 1.0), (71, 0, float("nan"), 0.0), (71, 1, 1.0, 1.0)], "s long, k long, x double, y double")
    some = pts.where("s < 3").select(F.col("s").cast("long"), F.col("k").cast("long"), F.col("x").cast("double"), F.col("y").cast("double"))
    assert {r.s for r in G.match_shapes(some.union(odd), step=30, radius=20).collect()} == {s for s in lines if s < 3}
    assert G.match_shapes(pts.where("s = 1"), step=30, radius=20).count() == 0


def test_a_fit_that_matches_anew_finds_the_planted_transform(spark):
    from wayfold.plans import placement as plans
    from wayfold.plans.registry import QUERIES

    if not os.path.isdir(SF):
        pytest.skip("no test data")
    got = QUERIES["k17_fit_nearest"](spark, SF).orderBy("term").collect()
    assert np.allclose([[r.cx for r in got], [r.cy for r in got]], plans.PLANTED, atol=0.01)


def same_as_sql(spark, folder, name):
    """Rows of a query that its SQL hasn't, and the other way round, over the Parquet tables of a folder."""
    import __spark_entry__ as entry

    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"create view {f.split('.')[0]} as select * from '{folder}/{f}'")
    want = con.sql(entry.oracle_sql()[name])
    got = set(map(tuple, entry.queries()[name](spark, str(folder)).select([d[0] for d in want.description]).collect()))
    want = set(want.fetchall())
    assert want
    return got - want, want - got


def test_ratios_near_the_pole_are_rounded_as_in_sql(spark, tmp_path):
    value = "case when i % 7 = 0 then i / 100.0 when i < 4000 then 5 + pow(10, -9 + i / 500.0) end"
    duckdb.sql(f"copy (select i as event_id, timestamp '2024-01-01' as ts, i as user_id, 'view' as event_type, {value} as value, '{{}}' as props from range(6000) t(i)) to '{tmp_path}/events.parquet'")
    assert same_as_sql(spark, tmp_path, "f9_safe_ratio") == (set(), set())


def folded(path, n=400):
    """Shapes that go to and fro on lines of few directions, up to the last vertex: there the sign of 180 degrees is one of last bits."""
    rng = np.random.default_rng(3)
    ways = np.array([(0, 1), (1, 0), (1, 1), (1, 2), (2, 1), (3, 1), (-1, 2), (3, 4), (7, 3), (5, -2)])
    turn = np.where(rng.random((n, 31)) < 0.45, rng.choice([-1, 1], (n, 31)), 0)
    way, steps = ways[rng.integers(len(ways), size=n)], []
    for k in range(31):
        way = np.where(turn[:, k : k + 1] != 0, ways[rng.integers(len(ways), size=n)] * turn[:, k : k + 1], -way)
        steps.append(way * rng.integers(5, 60, (n, 1)))
    points = np.cumsum(np.stack([np.zeros((n, 2), int), *steps], 1), axis=1).reshape(n, 64)
    pq.write_table(pa.table({"vec_id": pa.array(range(n), pa.int64()), "embedding": pa.array((points / 1000).tolist(), pa.list_(pa.float32())), "label": pa.array([0] * n, pa.int32())}), path)


@pytest.mark.parametrize("name", ["w7_turns", "w7b_zigzag", "k11_roughness"])
def test_turns_of_lines_that_double_back_are_those_of_sql(spark, tmp_path, name):
    folded(tmp_path / "embeddings.parquet")
    assert same_as_sql(spark, tmp_path, name) == (set(), set())


def test_rejoins_by_pair_are_those_of_the_joins(spark, tmp_path, monkeypatch):
    """Both ways of the join of lines; beyond the bound no line is broadcast."""
    from wayfold.operators import relations as R
    from wayfold.plans.catalogue import QUERIES

    folded(tmp_path / "embeddings.parquet", n=60)
    pts = R.shape_points(spark, str(tmp_path))
    samples = G.resample(pts, 10)
    ink = samples.select(F.col("s").alias("sid"), F.col("k").alias("n"), (F.col("k") * 10.0).alias("arc"), "x", "y")
    want = placement.rejoins(samples, ink, step=10, contact=30, ride=20, leave=40, rejoin=400, pairs=G.next_shapes(pts).withColumnRenamed("other", "sid"))
    want = sorted((r.s, r.sid, r.k0, r.k1, r.off) for r in want.collect())
    for bound in (10**6, 100):
        monkeypatch.setattr(G, "SMALL_VERTICES", bound, raising=False)
        monkeypatch.setattr(placement, "_TILE", bound, raising=False)
        found = QUERIES["k13_rejoins"](spark, str(tmp_path))
        got = sorted((r.s, r.sid, r.k0, r.k1, r.off) for r in found.collect())
        assert want and [g[:4] for g in got] == [w[:4] for w in want] and np.allclose([g[4] for g in got], [w[4] for w in want], rtol=1e-12)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
