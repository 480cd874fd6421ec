"""Chained workings: the contract's six, ties, nulls, long chains."""

from wayfold.operators import chaining

WORKINGS = "trip string, service string, block string, route string, shape string"
STOPS = "trip string, seq long, arr long, dep long, stop string, measure double"


def chained(spark, workings, stops):
    s, c = chaining.chain_workings(spark.createDataFrame(workings, WORKINGS).repartition(2), spark.createDataFrame(stops, STOPS).repartition(3))
    out = {}
    for r in sorted(s.collect(), key=lambda r: (r.trip, r.seq)):
        out.setdefault(r.trip, []).append((r.seq, r.arr, r.dep, r.stop, r.working))
    return out, sum(r.place > 0 for r in c.collect())


def test_the_contract(spark):
    legs = {"a": "xy", "b": "yz", "c": "zw", "reverse": "wx", "loop": "xx", "next-loop": "xx"}
    stops = [r for k, (t, (p, q)) in enumerate(legs.items()) for r in ((t, 1, 10 * k + 10, 10 * k + 10, p, 0.0), (t, 2, 10 * k + 20, 10 * k + 20, q, 10.0))]
    workings = [(t, "service", "block", "route", "other-shape" if t == "reverse" else "shape") for t in legs]
    got, merges = chained(spark, workings, stops)
    assert merges == 2 and set(got) == {"a", "reverse", "loop", "next-loop"}
    assert got["a"] == [(1, 10, 10, "x", "a"), (2, 20, 20, "y", "a"), (3, 30, 30, "z", "b"), (4, 40, 40, "w", "c")]


def test_blocks_services_and_times_hold_workings_apart(spark):
    stops = [("a", 5, 0, 1, "x", 0.0), ("a", 9, 8, 9, "y", 1.0)]
    others = {"time": 9, "block": 8, "service": 8, "null": 8}
    for t, at in others.items():
        stops += [(t, 1, at - 1, at, "y", 0.0), (t, 2, 30, 31, "z", 0.0)]
    workings = [("a", "s", "k", "r", "h"), ("time", "s", "k", "r", "h"), ("block", "s", "other", "r", "h"), ("service", "t", "k", "r", "h"), ("null", None, "k", "r", "h")]
    got, merges = chained(spark, workings, stops)
    assert merges == 0 and len(got) == 5
    got, merges = chained(spark, [*workings, ("b", "s", "k", "r", "h")], [*stops, ("b", 1, 7, 8, "y", 0.0), ("b", 2, 30, 31, "z", 0.0)])
    assert merges == 1 and got["a"] == [(1, 0, 1, "x", "a"), (2, 8, 8, "y", "a"), (3, 30, 31, "z", "b")]


def test_two_workings_at_one_place_and_time_go_on_one_each(spark):
    stops = [r for t in ("a1", "a2", "a3") for r in ((t, 1, 0, 0, "x", 0.0), (t, 2, 5, 5, "y", 0.0))] + [r for t in ("b1", "b2") for r in ((t, 1, 5, 5, "y", 0.0), (t, 2, 9, 9, "z", 0.0))]
    got, merges = chained(spark, [(t, "s", "k", "r", "h") for t in ("a1", "a2", "a3", "b1", "b2", "empty")], stops)
    assert merges == 2 and {t: [s[3] for s in v] for t, v in got.items()} == {"a1": ["x", "y", "z"], "a2": ["x", "y", "z"], "a3": ["x", "y"]}


def test_a_long_chain_and_workings_without_time(spark):
    n = 37
    stops = [r for k in range(n) for r in ((f"w{k:02}", 1, k, k, f"s{k}", 0.0), (f"w{k:02}", 2, k + 1, k + 1, f"s{k + 1}", 0.0))]
    still = [r for a, b in ("pq", "qp") for r in ((f"still{a}", 1, 5, 5, a, 0.0), (f"still{a}", 2, 5, 5, b, 0.0))]
    got, merges = chained(spark, [(t, "s", "k", "r", "h") for t in sorted({r[0] for r in stops + still})], stops + still)
    assert merges == n - 1 and [s[3] for s in got["w00"]] == [f"s{k}" for k in range(n + 1)] and set(got) == {"w00", "stillp", "stillq"}
    assert chained(spark, [], [])[1] == 0
