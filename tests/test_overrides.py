"""Redrawn stretches of shapes: the contract's vectors, passes, directions, corners and refusals."""

import pytest

from wayfold.operators import overrides

POINTS = "s long, k long, x double, y double, wx double, wy double, note string"
PRIOR = [(0, 0), (2, 0), (3, 0), (10, 0)]


def shapes(spark, by_id):
    rows = [(s, k, float(x), float(y), float(x), float(y), f"n{s}") for s, pts in by_id.items() for k, (x, y) in enumerate(pts)]
    return spark.createDataFrame(rows, POINTS).repartition(3)


def spec(key, box, path, *, waypoints=None, ids=None, nth=None, forward=None, exact=None, number=1):
    pts = lambda ps: [tuple(map(float, p)) for p in ps]
    return (key, number, tuple(map(float, box)), pts(path), waypoints and [tuple(map(float, (*w, *p))) for w, p in waypoints], ids, nth, forward, exact)


def drawn(spark, by_id, *specs, key="s"):
    got = overrides.override_paths(shapes(spark, by_id), spark.createDataFrame(list(specs), f"{key} {'string' if key == 'note' else 'long'}, {overrides.SPEC}"), key)
    assert got.columns == ["s", "k", "x", "y", "wx", "wy", "note"]
    out = {}
    for r in sorted(got.collect(), key=lambda r: (r.s, r.k)):
        assert r.note == f"n{r.s}" and r.k == len(out.get(r.s, []))
        out.setdefault(r.s, []).append((round(r.x, 6), round(r.y, 6)))
    return out


def test_waypoints_keep_stops_on_their_street(spark):
    one = spec(1, (0, -1, 10, 1), [(0, 0), (0, 10), (10, 10)], waypoints=[((2, 0), (0, 10))], forward=True)
    assert drawn(spark, {1: PRIOR, 2: PRIOR}, one) == {1: [(0, 0), (0, 10), (1.25, 10), (10, 10)], 2: PRIOR}


def test_falling_waypoints_are_refused(spark):
    bad = spec(1, (0, -1, 10, 1), [(0, 0), (0, 10), (10, 10)], waypoints=[((8, 0), (0, 5)), ((2, 0), (5, 10))], forward=True)
    with pytest.raises(Exception, match="waypoints must follow"):
        drawn(spark, {1: PRIOR}, bad)
    standing = spec(1, (0, -1, 10, 1), [(0, 0), (0, 10), (10, 10)], waypoints=[((2, 0), (0, 5)), ((3, 0), (0, 5))], forward=True)
    with pytest.raises(Exception, match="waypoints must follow"):
        drawn(spark, {1: PRIOR}, standing)


def test_shape_ids_name_the_variants(spark):
    full = [(0, 0), (5, 0), (10, 0)]
    some = spec("n1", (0, -1, 10, 1), [(0, 1), (10, 1)], ids=[1])
    both = {"n1": some}
    assert drawn(spark, {1: full, 2: full}, both["n1"], key="note") == {1: [(0, 1), (5, 1), (10, 1)], 2: full}
    not_it = spec("n1", (0, -1, 10, 1), [(0, 1), (10, 1)], ids=[7])
    assert drawn(spark, {1: full}, not_it, key="note") == {1: full}


def test_one_path_serves_both_directions_unless_forward(spark):
    there, back, box, path = [(0, 0), (4, 0), (10, 0)], [(10, 0), (4, 0), (0, 0)], (-1, -1, 11, 1), [(0, 2), (10, 2)]
    specs = [spec(1, box, path), spec(2, box, path), spec(3, box, path, forward=True)]
    specs += [spec(s, box, path, waypoints=[((4, 0), (8, 2))]) for s in (4, 5)]
    assert drawn(spark, {1: there, 2: back, 3: back, 4: there, 5: back}, *specs) == {
        1: [(0, 2), (4, 2), (10, 2)],
        2: [(10, 2), (4, 2), (0, 2)],
        3: [(0, 2), (6, 2), (10, 2)],
        4: [(0, 2), (8, 2), (10, 2)],
        5: [(10, 2), (8, 2), (0, 2)],
    }


def test_passes_of_a_circuit(spark):
    loop, box, path = [(0, 0), (5, 0), (20, 0), (20, 9), (5, 1), (0, 1)], (-1, -1, 6, 2), [(0, 5), (9, 5)]
    got = drawn(spark, {s: loop for s in (1, 2, 3, 4)}, spec(1, box, path, nth=0), spec(2, box, path, nth=-1), spec(3, box, path, nth=7), spec(4, box, path, forward=True))
    assert got[1] == [(0, 5), (9, 5), *loop[2:]] and got[2] == [*loop[:4], (9, 5), (0, 5)] and got[3] == loop
    # A second pass through the box swallows what lies between.
    assert got[4][0] == (0, 5) and got[4][-1] == (9, 5) and all(y == 5 for _, y in got[4])


def test_exact_keeps_corners_and_their_places_on_the_warp(spark):
    got = overrides.override_paths(
        shapes(spark, {1: [(-5, 0), (0, 0), (8, 0), (16, 0)]}), spark.createDataFrame([spec(1, (0, -1, 16, 1), [(0, 0), (0, 4), (4, 4), (4, 0)], exact=True, forward=True)], f"s long, {overrides.SPEC}")
    )
    rows = [(r.k, r.x, r.y, round(r.wx, 6)) for r in sorted(got.collect(), key=lambda r: r.k)]
    assert rows == [(0, -5, 0, -5), (1, 0, 0, 0), (2, 0, 4, round(16 / 3, 6)), (3, 2, 4, 8), (4, 4, 4, round(32 / 3, 6)), (5, 4, 0, 16)]


def test_a_corner_that_a_point_stands_on_is_not_doubled(spark):
    one = spec(1, (0, -1, 10, 1), [(0, 0), (0, 5), (5, 5)], exact=True, forward=True)
    assert drawn(spark, {1: [(0, 0), (5, 0), (10, 0)]}, one) == {1: [(0, 0), (0, 5), (5, 5)]}


def test_specifications_apply_in_their_order(spark):
    first = spec(1, (0, -1, 10, 1), [(0, 2), (10, 2)], number=1)
    second = spec(1, (0, -1, 5, 1), [(0, 7), (5, 7)], number=2)
    assert drawn(spark, {1: [(0, 0), (5, 0), (10, 0)]}, second, first) == {1: [(0, 7), (5, 7), (10, 2)]}


def test_nothing_to_redraw(spark):
    one = spec(1, (50, 50, 60, 60), [(0, 2), (10, 2)])
    assert drawn(spark, {1: PRIOR}, one) == {1: PRIOR}
    assert overrides.override_paths(shapes(spark, {1: PRIOR}), spark.createDataFrame([], f"s long, {overrides.SPEC}")).count() == 4
    assert drawn(spark, {1: [(0, 0), (9, 9)]}, spec(1, (-1, -1, 1, 1), [(3, 3), (4, 4)]))[1] == [(3, 3), (9, 9)]
    assert overrides.override_paths(shapes(spark, {1: PRIOR}).limit(0), spark.createDataFrame([one], f"s long, {overrides.SPEC}")).count() == 0
