"""Silences told by timers: rules on a fake clock, streams against them."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from wayfold.operators import telemetry as T
from wayfold.streaming import watch


class Clock:
    """Records of one session on a clock that starts above 0."""

    def __init__(self, rule, start=100_000):
        self.rule, self.state, self.now, self.n, self.records, self.told = rule, rule.begin(), start, 0, [], []

    def say(self, kind, up=None):
        self.n += 1
        self.told += watch.fold(self.rule, self.state, [(self.n, kind, self.now, up)], self.now - 1)
        self.records.append((self.n, kind, self.now, up))
        return self

    def wait(self, ms):
        self.now += ms
        self.told += watch.fold(self.rule, self.state, [], self.now)
        return self

    def frames(self, count, ms=16):
        for _ in range(count):
            self.say("frame").wait(ms)
        return self

    def whats(self):
        return [r[0] for r in self.told]


def test_frames_and_hidden_time_are_no_stall():
    c = Clock(watch.StallRule()).frames(60)
    assert c.told == []
    c = Clock(watch.StallRule()).frames(5).say("hidden").wait(120_000)
    assert c.told == []
    c.say("visible").frames(400)
    assert c.told == []


def test_ten_seconds_without_a_frame_are_one():
    c = Clock(watch.StallRule()).frames(60).wait(10_000)
    assert c.whats() == ["stall", "verdict"]


def test_a_stall_is_told_once_at_a_tick_with_its_verdict():
    c = Clock(watch.StallRule()).frames(5)
    last = c.records[-1][2]
    c.wait(6000)
    (what, at, n, ms, _), (verdict, later, _, _, rendering) = c.told
    assert (what, n, verdict) == ("stall", 5, "verdict")
    assert at % 1000 == 0 and round((at - last) / 1000) in (4, 5) and 4000 <= ms < 5000 and later == at + 1000 and rendering is False
    c.wait(6000)
    assert len(c.told) == 2
    c.say("frame").wait(6000)
    assert c.whats() == ["stall", "verdict", "resume", "stall", "verdict"]
    assert c.told[2][3] == c.records[-1][2] - at


def test_hidden_time_in_a_stall_is_frozen_and_showing_ends_it():
    c = Clock(watch.StallRule()).frames(1, 4500)
    c.wait(400)
    assert c.whats() == ["stall"]
    at = c.told[0][1]
    c.say("hidden").wait(60_000).say("visible").say("frame").wait(1000)
    resume = [r for r in c.told if r[0] == "resume"]
    assert len(resume) == 1 and resume[0][3] == 104_900 - at == 900


def test_a_beat_tells_whose_stall_it_is():
    c = Clock(watch.StallRule()).frames(3)
    for _ in range(80):
        c.say("beat").wait(100)
    assert [r[4] for r in c.told] == [True, True]


def test_a_silence_that_grew_ripe_before_hiding_is_told_at_the_tick():
    c = Clock(watch.StallRule(), start=100_100).say("frame").wait(4200).say("hidden").wait(5000)
    assert c.told[0][:4] == ("stall", 105_000, 1, 4200)


def test_heartbeat_stalls_resumes_and_forgets():
    c = Clock(watch.HeartbeatRule()).say("sample", 0).wait(1600)
    assert c.told == []
    c.wait(10_000)
    assert c.told == [("stall", 101_601, 1, 1601, None)]
    c.say("sample", 11_600)
    assert c.told[1:] == [("resume", 111_600, 2, 11_600, False)]
    c.wait(4_000_000)
    assert [r[:2] for r in c.told[2:]] == [("stall", 113_201), ("gone", 3_711_600)] and c.state == c.rule.begin()
    c.say("sample", 5)
    assert len(c.told) == 4


def test_heartbeat_tells_a_suspension_from_a_silence():
    c = Clock(watch.HeartbeatRule()).say("sample", 50).wait(9000).say("sample", 60)
    assert c.told[-1] == ("resume", 109_000, 2, 9000, True)
    c.wait(9000).say("sample")
    assert c.told[-1][4] is None


def test_heartbeat_out_of_view_is_throttled():
    c = Clock(watch.HeartbeatRule()).say("sample").wait(100).say("hidden").wait(50_000)
    assert [(r[0], r[1]) for r in c.told] == [("throttled", 101_601 + 15_000 * k) for k in range(4)]
    c.say("sample").wait(100)  # a word in between does not loosen the limit
    c.wait(12_000)
    assert [r[0] for r in c.told[4:]] == ["resume", "throttled"] and c.told[5][1] == 101_601 + 60_000
    c.say("visible")
    c.wait(1)
    assert c.told[-1][:2] == ("stall", c.now - 1)


def test_rates_restart_where_a_counter_falls():
    c = Clock(watch.RateRule())
    for wait, up in ((0, 10), (1000, 30), (500, None), (500, 130), (2000, 8), (0, 9), (1000, 9)):
        c.wait(wait).say("sample", up)
    assert [(r[3], r[4]) for r in c.told] == [(20_000, False), (100_000, False), (4000, True), (0, False), (0, False)]


def history(seed, sessions=5, n=60):
    rng = random.Random(seed)
    out, number = [], 0
    for sid in range(sessions):
        at, up = 1_000_000 + rng.randrange(5000), 0
        for _ in range(n if sid else 3 * n):
            number += 1
            step = rng.choice([16, 300, 1000, 2500, 6000, 20_000])
            at, up = at + step, up + step // rng.choice([1, 1, 3])
            out.append((sid, number, rng.choices(["frame", "beat", "hidden", "visible"], [8, 3, 1, 2])[0], at, up if number % 7 else None))
    return out


def folded(rule, rows, until):
    out = []
    for sid in {r[0] for r in rows}:
        own = sorted({r[1:] for r in rows if r[0] == sid and r[3] <= until}, key=lambda r: (r[2], r[0]))
        out += [(sid, *t) for t in watch.fold(rule, rule.begin(), own, until)]
    return sorted(out, key=str)


@pytest.mark.parametrize("rule", [watch.StallRule(), watch.HeartbeatRule(forget=300_000), watch.StallRule(limit=2500, tick=1), watch.RateRule()])
def test_stream_of_late_doubled_and_mixed_records_is_the_ordered_fold(spark, tmp_path, rule):
    rows = history(3)
    rng = random.Random(1)
    sent = sorted([(r[3] + rng.randrange(8000), r) for r in rows] + [(r[3] + rng.randrange(8000), r) for r in rows[::4]], key=str)
    sent = [r for _, r in sorted(sent, key=lambda x: x[0])] + [(None, 1, "frame", 5, 5), (1, 2, None, 5, 5), (2, 3, "frame", None, 5)]
    for k in range(3):
        part = sent[k * len(sent) // 3 : (k + 1) * len(sent) // 3]
        spark.createDataFrame(part, watch.RECORD).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = watch.run_watch(watch.watched(watch.file_stream(spark, str(tmp_path / "in")), rule, late_ms=10_000), "test")
    until = max(r[3] for r in rows) - 10_000
    assert sorted(map(tuple, got.collect()), key=str) == folded(rule, rows, until)


def test_what_is_later_than_the_watermark_is_dropped(spark, tmp_path):
    early = [(1, 1, "frame", 1_000_000, None), (2, 2, "frame", 1_500_000, None)]
    for rows in (early, [(1, 3, "frame", 1_001_000, None)], [(2, 4, "frame", 2_000_000, None)]):
        spark.createDataFrame(rows, watch.RECORD).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = watch.run_watch(watch.watched(watch.file_stream(spark, str(tmp_path / "in")), watch.StallRule(tick=1)), "test").where("sid = 1").collect()
    assert [(r.what, r.at) for r in got] == [("stall", 1_004_000), ("verdict", 1_004_001)]


def test_batch_twin_is_the_fold(spark):
    rows = history(9)
    until = max(r[3] for r in rows) - 3000
    kind = F.col("kind")
    df = spark.createDataFrame(rows, watch.RECORD).repartition(3)
    got = T.timed_stalls(df, frame=kind == "frame", hidden=kind == "hidden", visible=kind == "visible", limit_ms=4000, until=until)
    want = [(sid, what, at, n, ms) for sid, what, at, n, ms, _ in folded(watch.StallRule(tick=1), rows, until) if what != "verdict"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and len(want) > 20
    assert T.timed_stalls(df.limit(0), frame=kind == "frame", hidden=kind == "hidden", visible=kind == "visible", limit_ms=4000, until=0).count() == 0


def test_few_calls_to_the_state():
    """A group's call is one value read, one written and timers only where the next one changes: each is a message to the JVM."""
    from wayfold.streaming import watch

    class Handle:
        value, timers, calls = None, set(), []

        def getValueState(self, *_):
            return self

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, value):
            self.calls.append("update")
            self.value = value

        def registerTimer(self, t):
            self.calls.append("register")
            self.timers.add(t)

        def deleteTimer(self, t):
            self.calls.append("delete")
            self.timers.remove(t)

    class Times:
        def __init__(self, watermark):
            self.getCurrentWatermarkInMs = lambda: watermark

    handle = Handle()
    w = watch.Watch(watch.HeartbeatRule(quiet=100, forget=1000))
    w.init(handle)
    part = lambda *at: iter([pd.DataFrame({"n": at, "kind": ["beat"] * len(at), "at": at, "up": [None] * len(at)})])
    assert list(w.handleInputRows((7,), part(10, 30), Times(0))) == [] and handle.calls == ["get", "register", "update"] and handle.timers == {10}
    handle.calls.clear()
    assert list(w.handleInputRows((7,), part(20, 30), Times(0))) == [] and handle.calls == ["get", "update"]
    (out,) = w.handleInputRows((7,), part(300, 40, 5), Times(200))
    assert out.to_dict("records") == [{"sid": 7, "what": "stall", "at": 131, "n": 30, "ms": 101, "flag": None}] and handle.timers == {300}
