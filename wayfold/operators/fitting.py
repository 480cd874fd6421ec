"""Fits of map transforms: sums on the cluster, small solves on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.scalars import poly2
from wayfold.operators.joins import nearest_within


def _basis(lon0: float, lat0: float) -> list[Column]:
    a, b = F.col("lon") - lon0, F.col("lat") - lat0
    return [F.lit(1.0), a, b, a * a, a * b, b * b]


def normal_equations(matches: DataFrame, lon0: float, lat0: float, weight: Column | None = None) -> tuple[np.ndarray, np.ndarray]:
    """B'WB (6, 6) and B'Wt (6, 2) of matches (lon, lat, tx, ty): one aggregate of 33 sums, whatever the input."""
    basis, w = _basis(lon0, lat0), weight if weight is not None else F.lit(1.0)
    upper = [(i, j) for i in range(6) for j in range(i, 6)]
    sums = [F.sum(w * basis[i] * basis[j]) for i, j in upper] + [F.sum(w * basis[i] * F.col(t)) for i in range(6) for t in ("tx", "ty")]
    got = [float(v or 0.0) for v in matches.agg(*[s.alias(f"c{n}") for n, s in enumerate(sums)]).first()]
    m = np.zeros((6, 6))
    for (i, j), v in zip(upper, got):
        m[i, j] = m[j, i] = v
    return m, np.array(got[len(upper) :]).reshape(6, 2)


def fit_poly2(matches: DataFrame, lon0: float, lat0: float, *, ridge: float = 1.0, weight: Column | None = None) -> tuple[list[float], list[float]]:
    """Second-order transform with a ridge on the quadratic terms."""
    m, t = normal_equations(matches, lon0, lat0, weight)
    c = np.linalg.solve(m + ridge * np.diag([0.0, 0, 0, 1, 1, 1]), t)
    return c[:, 0].tolist(), c[:, 1].tolist()


def fit_robust(matches: DataFrame, lon0: float, lat0: float, *, scale: float = 8.0, rounds: int = 8) -> tuple[list[float], list[float]]:
    """The same with soft-L1 weights 1 / sqrt(1 + (r / scale)^2), re-weighted a fixed number of times."""
    cx, cy = fit_poly2(matches, lon0, lat0)
    for _ in range(rounds):
        x, y = poly2(F.col("lon"), F.col("lat"), lon0, lat0, cx, cy)
        r2 = F.pow(x - F.col("tx"), 2) + F.pow(y - F.col("ty"), 2)
        cx, cy = fit_poly2(matches, lon0, lat0, weight=1 / F.sqrt(1 + r2 / scale**2))
    return cx, cy


def fit_nearest(points: DataFrame, targets: DataFrame, lon0: float, lat0: float, cx: list[float], cy: list[float], *, cap: float = 45.0, rounds: int = 6) -> tuple[list[float], list[float]]:
    """Iterative closest points: points (id, lon, lat) are placed, matched to targets (id, x, y) within `cap`, and refitted.

    Coefficients alone pass between rounds, so no plan grows with them.
    """
    for _ in range(rounds):
        x, y = poly2(F.col("lon"), F.col("lat"), lon0, lat0, cx, cy)
        near = nearest_within(points.select("id", x.alias("x"), y.alias("y")), targets, cap).select("id", "nn_id")
        goal = targets.select(F.col("id").alias("nn_id"), F.col("x").alias("tx"), F.col("y").alias("ty"))
        cx, cy = fit_poly2(points.join(near, "id").join(goal, "nn_id"), lon0, lat0, ridge=1e-3)
    return cx, cy
