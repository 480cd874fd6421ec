import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.operators import fitting, placement


def place(spark, ra, rb, da, db, ua, ub, f, ranges=True):
    rows = spark.createDataFrame([(0, 0, ra, rb, da, db, ua, ub, f)], "id int, s int, ra int, rb int, da double, db double, ua double, ub double, f double")
    runs = spark.createDataFrame([(0, 0, 0.1 if ranges else None, 0.3 if ranges else None, 10.0), (0, 1, 0.7 if ranges else None, 0.9 if ranges else None, 10.0)], "s int, run int, u0 double, u1 double, length double")
    r = placement.inset_place(rows, runs).first()
    return None if r.run is None else (r.run, round(r.dist, 3))


def test_inset_place(spark):
    across = (0, 1, 5.0, 5.0, 0.2, 0.8)
    assert place(spark, *across, 0.0) == (0, 5.0)
    assert place(spark, *across, 1.0) == (1, 5.0)
    assert place(spark, *across, 0.5) is None
    assert place(spark, *across, 0.1)[1] > 5 and place(spark, *across, 0.9)[1] < 5
    assert place(spark, -1, -1, 0.0, 0.0, 0.0, 1.0, 0.2) == (0, 5.0)
    assert place(spark, -1, 0, 0.0, 5.0, 0.0, 0.2, 0.25) is None
    assert place(spark, -1, 0, 0.0, 5.0, 0.0, 0.2, 0.75) == (0, 2.5)
    assert place(spark, 0, -1, 5.0, 0.0, 0.2, 0.5, 0.75) is None
    assert place(spark, 0, -1, 5.0, 0.0, 0.2, 0.5, 0.25)[1] > 5
    assert place(spark, 0, 0, 2.0, 6.0, None, None, 0.5) == (0, 4.0)
    assert place(spark, -1, 1, 0.0, 8.0, None, None, 0.5, ranges=False) == (1, 4.0)
    assert place(spark, 0, -1, 4.0, 0.0, None, None, 0.5, ranges=False) == (0, 7.0)


def test_inset_stops(spark):
    stops = spark.createDataFrame([(0, 0.2, 5.0, 0.0), (1, 0.5, 5.0, 0.0), (2, 0.8, 5.0, 0.0)], "id int, u double, x double, y double")
    runs = spark.createDataFrame([(0, 0.1, 0.3), (1, 0.7, 0.9)], "run int, u0 double, u1 double")
    pts = spark.createDataFrame([(r, k, 10.0 * k, 0.0) for r in (0, 1) for k in (0, 1)], "run int, k int, x double, y double")
    assert [(r.run, r.d) for r in placement.inset_stops(stops, runs, pts).orderBy("id").collect()] == [(0, 5.0), (-1, 0.0), (1, 5.0)]


@pytest.mark.parametrize(
    ("shape_m", "stop_m", "want"),
    [([0, 100, 200], [50, 150], [0.25, 0.75]), ([0, 100, 200], [150, 50], None), ([0, 100, 200], [500, 1500], None), ([0, 100, 200], [0, 200], None), ([0, 0, 200], [50, 150], None), ([0, None, 200], [50, 150], None)],
)
def test_measures(spark, shape_m, stop_m, want):
    shape = spark.createDataFrame([(0, k, lon, 34.0, float(m) if m is not None else None) for k, (lon, m) in enumerate(zip([-118.0, -117.99, -118.0], shape_m))], "key int, k int, lon double, lat double, m double")
    stops = spark.createDataFrame([(0, i, -117.995, 34.0, float(m)) for i, m in enumerate(stop_m)], "key int, i int, lon double, lat double, m double")
    got = [r.u for r in placement.measured_positions(shape, stops).orderBy("i").collect()]
    assert got == [None, None] if want is None else np.allclose(got, want)


def test_rejoins(spark):
    ink = spark.createDataFrame([(0, n, float(n), float(n), 0.0) for n in range(300)], "sid int, n int, arc double, x double, y double")
    path = [(k, float(4 * k), 0.0 if k < 20 or k > 30 else 15.0) for k in range(60)]
    s = spark.createDataFrame([(0, *p) for p in path], "s int, k int, x double, y double")
    out = placement.rejoins(s, ink, step=4).collect()
    assert [(r.k0, r.k1, r.off) for r in out] == [(19, 31, 15.0)]
    assert placement.rejoins(s.withColumn("y", F.lit(0.0)), ink, step=4).count() == 0


def test_fits_recover_coefficients(spark):
    rng = np.random.default_rng(0)
    p = rng.uniform(-1, 1, (300, 2))
    cx, cy = [100.0, 40.0, 3.0, 1.0, -0.5, 0.3], [50.0, -2.0, 35.0, 0.2, 0.4, -0.1]
    b = np.stack([np.ones(300), p[:, 0], p[:, 1], p[:, 0] ** 2, p[:, 0] * p[:, 1], p[:, 1] ** 2], 1)
    t = np.stack([b @ cx, b @ cy], 1)
    rows = [(i, *map(float, p[i]), *map(float, t[i])) for i in range(300)]
    m = spark.createDataFrame(rows, "id long, lon double, lat double, tx double, ty double")
    fx, fy = fitting.fit_poly2(m, 0.0, 0.0, ridge=0.0)
    assert np.allclose(fx, cx) and np.allclose(fy, cy)
    noisy = m.withColumn("tx", F.when(F.col("id") % 10 == 0, F.col("tx") + 300).otherwise(F.col("tx")))
    rx, _ = fitting.fit_robust(noisy, 0.0, 0.0)
    lx, _ = fitting.fit_poly2(noisy, 0.0, 0.0)
    assert abs(rx[0] - cx[0]) < abs(lx[0] - cx[0]) / 3
    off = [v + d for v, d in zip(cx, (0.4, 0.3, 0, 0, 0, 0))]
    ix, iy = fitting.fit_nearest(m.select("id", "lon", "lat"), m.select("id", F.col("tx").alias("x"), F.col("ty").alias("y")), 0.0, 0.0, off, cy, cap=4.0, rounds=4)
    assert np.allclose(ix, cx, atol=0.05) and np.allclose(iy, cy, atol=0.05)
