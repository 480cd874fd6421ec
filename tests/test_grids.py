"""Components of cells against a flood fill, distances against all pairs."""

import random
from collections import Counter

import numpy as np
import pytest

from wayfold.operators import grids


def flood(cells):
    left, out = set(cells), {}
    while left:
        stack, own = [left.pop()], []
        while stack:
            x, y = stack.pop()
            own.append((x, y))
            for n in [(x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if n in left:
                    left.remove(n)
                    stack.append(n)
        out.update({c: frozenset(own) for c in own})
    return out


def snake(n):
    """One component that winds to and fro through many rows and stripes."""
    out = []
    for row in range(n):
        out += [(x, 2 * row) for x in range(-n, n)]
        out.append((n if row % 2 else -n - 1, 2 * row + 1))
    return out


@pytest.mark.parametrize("wide", [4096, 7])
def test_components_are_those_of_a_flood_fill(spark, wide):
    rng = random.Random(4)
    cells = {(rng.randrange(-30, 30), rng.randrange(-30, 30)) for _ in range(900)} | {(100 + x, y) for x, y in snake(12)} | {(500, 500), (501, 501), (7000, -5)}
    rows = [*cells, *list(cells)[:50], (None, 3), (3, None)]
    got = grids.large_components(spark.createDataFrame(rows, "x long, y long").repartition(3), least=1, wide=wide).collect()
    want = flood(cells)
    assert sorted((r.x, r.y, r["size"]) for r in got) == sorted((x, y, len(c)) for (x, y), c in want.items())
    label = {(r.x, r.y): r.label for r in got}
    assert len(set(label.values())) == len(set(want.values())) and all(len({label[c] for c in own}) == 1 for own in set(want.values()))


def test_small_components_go(spark):
    cells = [(x, 0) for x in range(63)] + [(x, 10) for x in range(64)] + [(200 + x // 2, 20 + x) for x in range(70)]
    got = Counter(r.y >= 20 for r in grids.large_components(spark.createDataFrame(cells, "x long, y long")).collect())
    assert got == {False: 64, True: 70}
    assert grids.large_components(spark.createDataFrame([], "x long, y long")).count() == 0


def test_lower_envelope():
    rng = np.random.default_rng(2)
    for n in (1, 2, 30):
        at = np.sort(rng.choice(np.arange(-40, 40), n, replace=False)).astype(float)
        height = rng.integers(0, 400, n).astype(float)
        probes = np.arange(-60, 61).astype(float)
        d2, which = grids.lower_envelope(at, height, probes)
        every = height[None] + (probes[:, None] - at[None]) ** 2
        assert (d2 == every.min(axis=1)).all() and (every[np.arange(len(probes)), which] == d2).all()


@pytest.mark.parametrize("columns", [64, 5])
def test_distances_are_those_of_all_pairs(spark, columns):
    rng = random.Random(7)
    cells = [(rng.randrange(-60, 40), rng.randrange(-35, 60)) for _ in range(40)]
    got = grids.distances(spark.createDataFrame([*cells, cells[0], (None, 1)], "x int, y int").repartition(2), (-20, -10, 30, 25), columns=columns).collect()
    want = {(x, y): min((x - a) ** 2 + (y - b) ** 2 for a, b in cells) for x in range(-20, 31) for y in range(-10, 26)}
    assert {(r.x, r.y): r.d2 for r in got} == want and len(got) == len(want)
    assert grids.distances(spark.createDataFrame([], "x int, y int"), (0, 0, 3, 3)).count() == 0
    assert sorted(r.d2 for r in grids.distances(spark.createDataFrame([(9, 0)], "x int, y int"), (0, 0, 1, 1)).collect()) == [64, 65, 81, 82]
