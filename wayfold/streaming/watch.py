"""Watching sessions by timers: silences are told when they last too long, not when the next record comes."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wayfold.streaming.telemetry import shared_folder

RECORD = "sid long, n long, kind string, at long, up long"
REPORT = "sid long, what string, at long, n long, ms long, flag boolean"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
Report = tuple[str, int, int | None, int | None, bool | None]


class StallRule:
    """A session stalls when it was visible for `limit` ms without a frame: told at the next tick, once.

    Reports: `stall` (n: the last frame; ms: visible silence so far; flag: was there a beat in the tick before), `verdict` one tick
    later if it is still stalled (flag: was there a beat since), `resume` at the next frame or where a hidden session is shown (ms:
    visible time since the stall). Hidden time never counts, and showing begins the silence anew. A session begins visible.
    """

    def __init__(self, *, limit: int = 4000, tick: int = 1000, frames: tuple[str, ...] = ("frame",), beats: tuple[str, ...] = ("beat",), hidden: str = "hidden", visible: str = "visible"):
        self.limit, self.tick, self.frames, self.beats, self.hidden, self.visible = limit, tick, frames, beats, hidden, visible

    def begin(self) -> dict:
        return {"at": None, "clock": 0, "seen": None, "shown": True, "frame": None, "stalled": None, "ripe": None, "verdict": None, "beat": None}

    def _move(self, s: dict, at: int) -> None:
        if s["at"] is not None and s["shown"]:
            s["clock"] += at - s["at"]
        s["at"] = at

    def _ripens(self, s: dict) -> int | None:
        """When the silence is long enough if nothing else happens."""
        if s["ripe"] is not None or s["stalled"] is not None or s["seen"] is None or not s["shown"]:
            return s["ripe"]
        return s["at"] + self.limit - (s["clock"] - s["seen"])

    def due(self, s: dict) -> int | None:
        """When the session has something to tell if nothing else happens."""
        ripe = s["verdict"] if s["verdict"] is not None else self._ripens(s)
        return None if ripe is None else -(-ripe // self.tick) * self.tick

    def fire(self, s: dict, at: int) -> list[Report]:
        self._move(s, at)
        beat = s["beat"] is not None and at - self.tick < s["beat"] <= at
        if s["verdict"] is not None:
            s["verdict"] = None
            return [("verdict", at, s["frame"], None, beat)]
        s.update(stalled=s["clock"], verdict=at + self.tick, ripe=None)
        return [("stall", at, s["frame"], s["clock"] - s["seen"], beat)]

    def take(self, s: dict, n: int, kind: str, at: int, up: int | None) -> list[Report]:
        # A silence that grew ripe before this record is told at the next tick, even if the session is hidden by then.
        ripe = self._ripens(s)
        s["ripe"] = ripe if ripe is not None and ripe <= at else None
        self._move(s, at)
        showing = kind == self.visible and not s["shown"]
        if kind in self.beats:
            s["beat"] = at
        if kind in (self.hidden, self.visible):
            s["shown"] = kind == self.visible
        if not (kind in self.frames or showing and s["seen"] is not None):
            return []
        out = [] if s["stalled"] is None else [("resume", at, n, s["clock"] - s["stalled"], None)]
        s.update(seen=s["clock"], frame=s["frame"] if showing else n, stalled=None, verdict=None, ripe=None)
        return out

    def ends(self, s: dict) -> bool:
        return False


class HeartbeatRule:
    """A session is silent when no message came for more than `quiet` ms.

    Reports: `stall` once for a silence in view (n: the last message), `throttled` for one out of view, then again every `throttle`
    ms at most; `resume` at the next message (ms: the silence; flag: the wall clock went on `suspended` ms or more further than the
    session's own clock, so the machine slept); `gone` after `forget` ms, which ends the session's state. Changes of
    visibility are no messages.
    """

    def __init__(self, *, quiet: int = 1600, throttle: int = 15_000, forget: int = 3_600_000, suspended: int = 1000, hidden: str = "hidden", visible: str = "visible"):
        self.quiet, self.throttle, self.forget, self.suspended, self.hidden, self.visible = quiet, throttle, forget, suspended, hidden, visible

    def begin(self) -> dict:
        return {"last": None, "n": None, "up": None, "shown": True, "since": 0, "told": False, "stalled": False, "throttled": None}

    def due(self, s: dict) -> int | None:
        if s["last"] is None:
            return None
        gone, ripe = s["last"] + self.forget, max(s["last"] + self.quiet + 1, s["since"])
        if s["shown"]:
            return gone if s["stalled"] else min(ripe, gone)
        return min(gone, ripe if s["throttled"] is None else max(ripe, s["throttled"] + self.throttle))

    def fire(self, s: dict, at: int) -> list[Report]:
        silent = at - s["last"]
        if silent >= self.forget:
            n = s["n"]
            s.clear()
            s.update(self.begin())
            return [("gone", at, n, silent, None)]
        s["told"] = True
        if s["shown"]:
            s["stalled"] = True
            return [("stall", at, s["n"], silent, None)]
        s["throttled"] = at
        return [("throttled", at, s["n"], silent, None)]

    def take(self, s: dict, n: int, kind: str, at: int, up: int | None) -> list[Report]:
        if kind in (self.hidden, self.visible):
            s.update(shown=kind == self.visible, since=at)
            return []
        out: list[Report] = []
        if s["told"]:
            drift = (at - s["last"]) - (up - s["up"]) if up is not None and s["up"] is not None else None
            out.append(("resume", at, n, at - s["last"], None if drift is None else drift >= self.suspended))
        s.update(last=at, n=n, up=up, told=False, stalled=False)
        return out

    def ends(self, s: dict) -> bool:
        return s["last"] is None and s["shown"]


class RateRule:
    """How fast a session's counter (up) grows since the last record that had one: `rate` reports of n, with ms as thousandths a
    second, rounded down (0 where no time passed). Where the counter fell it was reset: it counts from 0, and flag tells so."""

    def begin(self) -> dict:
        return {"at": None, "up": None}

    def due(self, s: dict) -> int | None:
        return None

    def fire(self, s: dict, at: int) -> list[Report]:
        return []

    def take(self, s: dict, n: int, kind: str, at: int, up: int | None) -> list[Report]:
        if up is None:
            return []
        out: list[Report] = []
        if s["at"] is not None:
            fell, passed = up < s["up"], at - s["at"]
            out.append(("rate", at, n, (up if fell else up - s["up"]) * 1_000_000 // passed if passed else 0, fell))
        s.update(at=at, up=up)
        return out

    def ends(self, s: dict) -> bool:
        return False


Rule = StallRule | HeartbeatRule | RateRule


def fold(rule: Rule, state: dict, records: list[tuple], until: int) -> list[Report]:
    """Take records (n, kind, at, up) in order of time, and tell everything that is due before each of them and by `until`."""
    out = []
    for n, kind, at, up in records:
        while (t := rule.due(state)) is not None and t < at:
            out += rule.fire(state, t)
        out += rule.take(state, n, kind, at, up)
    while (t := rule.due(state)) is not None and t <= until:
        out += rule.fire(state, t)
    return out


def _order(r: tuple) -> tuple:
    """Of records (n, kind, at, up): those without up come first."""
    return *r[:3], r[3] is not None, r[3] or 0


class Watch(StatefulProcessor):
    """A rule for each session, in event time: records wait until the watermark has passed them, are put in order and rid of
    doubles, and timers stand where the next of them or the next report is due. What comes behind the watermark is late and
    dropped. State is what the rule holds and the records that wait."""

    def __init__(self, rule: Rule):
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "through long, timer long, own string, waiting string")

    def _advance(self, key: tuple, fresh: list[tuple], watermark: int, fired: int | None = None) -> Iterator[pd.DataFrame]:
        """Each call to the state or the timers is a message to the JVM and back, so there is one value with all, read and written once."""
        through, timer, own, waiting = self.state.get() or (-1, None, None, None)
        own, timer = json.loads(own) if own else self.rule.begin(), None if timer == fired else timer
        held = {tuple(r) for r in json.loads(waiting)} if waiting else set()
        held |= {r for r in fresh if r[2] > max(through, watermark)}
        through = max(through, watermark)
        ready = sorted({r[0]: r for r in sorted((r for r in held if r[2] <= through), key=_order, reverse=True)}.values(), key=lambda r: (r[2], r[0]))
        rest = sorted((r for r in held if r[2] > through), key=_order)
        out = fold(self.rule, own, ready, through)
        due = min((t for t in (self.rule.due(own), min((r[2] for r in rest), default=None)) if t is not None), default=None)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        if not rest and self.rule.ends(own):
            self.state.clear()
        else:
            self.state.update((through, due, json.dumps(own), json.dumps(rest) if rest else None))
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=["sid", "what", "at", "n", "ms", "flag"], dtype=object)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = []
        for part in rows:
            columns = (part[c].tolist() for c in ("n", "kind", "at", "up"))
            fresh += [(int(n), str(k), int(a), None if u is None or u != u else int(u)) for n, k, a, u in zip(*columns)]
        yield from self._advance(key, fresh, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, [], timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def watched(records: DataFrame, rule: Rule, *, late_ms: int = 10_000) -> DataFrame:
    """Reports (sid, what, at, n, ms, flag) of a stream (sid, n, kind, at, up) by a rule, times in milliseconds.

    Records may come in any order and more than once within `late_ms` of the newest one. Null sids, kinds or times are left
    out. The stream is to be started by `run_watch` or with RocksDB as the state store.
    """
    own = records.select("sid", "n", "kind", "at", F.col("up").cast("long")).where("sid is not null and n is not null and kind is not null and at is not null")
    own = own.withColumn("when", F.timestamp_millis("at")).withWatermark("when", f"{late_ms} milliseconds")
    return own.groupBy("sid").transformWithStateInPandas(Watch(rule), REPORT, "Append", "EventTime")


def run_watch(reports: DataFrame, tag: str) -> DataFrame:
    """Run a watched stream over what its source holds now, and read its reports from the shared folder."""
    spark = reports.sparkSession
    top = f"{shared_folder(spark)}/wayfold-{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        reports.writeStream.format("parquet").option("checkpointLocation", f"{top}/checkpoint").option("path", f"{top}/out").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)
    return spark.read.schema(REPORT).parquet(f"{top}/out")


def file_stream(spark: SparkSession, folder: str, *, files_per_batch: int = 1) -> DataFrame:
    """Record files of a folder as a stream, in the order in which they were written."""
    return spark.readStream.schema(RECORD).option("maxFilesPerTrigger", str(files_per_batch)).parquet(folder)
