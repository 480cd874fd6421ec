"""The store of stall records: amended, first kept, one step back, the same after a batch that is run again."""

import random

from wayfold.streaming import records, watch

ROW = records.REPORTS


def plain(reports):
    """One report after another, as a device would keep them: the newest record and the one before it."""
    kept = {}
    for owner, session, what, at, n, ms, flag in sorted(reports, key=lambda r: r[3]):
        if owner is None or session is None:
            continue
        slots = kept.setdefault(owner, [])
        own = next((r for r in slots if r["session"] == session), None)
        if what == "stall" and own is None:
            slots.insert(0, {"session": session, "first": (at, n, flag), "stalls": 1, "last": at, "verdict": None, "recovered": None})
            del slots[2:]
        elif what == "stall":
            own["stalls"], own["last"] = own["stalls"] + 1, at
        elif own is not None:
            own["verdict" if what == "verdict" else "recovered"] = (at, flag if what == "verdict" else ms)
    return sorted((o, r["session"], r["first"], r["stalls"], r["last"], r["verdict"], r["recovered"], k) for o, s in kept.items() for k, r in enumerate(s))


def held(store):
    t = lambda r: None if r is None else tuple(r)
    return sorted((r.owner, r.session, t(r["first"]), r.stalls, r.last_at, t(r.verdict), t(r.recovered), r.slot) for r in store.read().collect())


def reports(seed, owners=30, n=40):
    rng = random.Random(seed)
    out = []
    for owner in range(owners):
        at, session = 0, 0
        for k in range(n if owner else 4 * n):
            at += rng.randrange(1, 50)
            session += rng.random() < 0.15
            what = rng.choice(["stall", "verdict", "resume"])
            out.append((owner, session, what, at * 1000 + owner, k, rng.randrange(900), what != "resume" and rng.random() < 0.5))
    return out + [(None, 1, "stall", 5, 5, 5, None), (1, None, "stall", 5, 5, 5, None)]


def test_batches_amend_as_one_report_after_another(spark, tmp_path):
    rows = sorted(reports(1), key=lambda r: r[3])
    store = records.RecordStore(spark, str(tmp_path / "store"), buckets=7)
    assert store.read().count() == 0
    cuts = [0, 300, 301, 800, len(rows)]
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        batch = spark.createDataFrame(rows[a:b], ROW).repartition(3)
        store.upsert(batch, k)
        assert held(store) == plain(rows[:b])
        store.upsert(batch, k)  # as after a lost driver
        assert held(store) == plain(rows[:b])
    store.upsert(spark.createDataFrame([], ROW), 4)
    assert held(store) == plain(rows)


def test_only_touched_buckets_are_written(spark, tmp_path):
    rows = reports(2)
    store = records.RecordStore(spark, str(tmp_path / "store"), buckets=16)
    store.upsert(spark.createDataFrame(rows, ROW), 0)
    store.upsert(spark.createDataFrame([(3, 99, "stall", 10**9, 1, 2, True)], ROW), 1)
    assert len(list((tmp_path / "store/data/batch=0").glob("bucket=*"))) > 8
    assert len(list((tmp_path / "store/data/batch=1").glob("bucket=*"))) == 1
    assert held(store) == plain([*rows, (3, 99, "stall", 10**9, 1, 2, True)])


def test_a_batch_without_an_index_does_not_count(spark, tmp_path):
    rows = reports(3)
    store = records.RecordStore(spark, str(tmp_path / "store"), buckets=4)
    store.upsert(spark.createDataFrame(rows[:200], ROW), 0)
    # A batch that was lost after its data and before its index.
    records.merged(records.session_records(spark.createDataFrame(rows, ROW))).selectExpr("*", "0 as bucket").write.partitionBy("bucket").parquet(str(tmp_path / "store/data/batch=1"))
    assert held(store) == plain(rows[:200])
    store.upsert(spark.createDataFrame(rows[200:], ROW), 1)
    assert held(store) == plain(rows)


def test_contract_of_the_previous_slot(spark, tmp_path):
    store = records.RecordStore(spark, str(tmp_path / "store"))
    store.upsert(spark.createDataFrame([(1, 1, "stall", 1, 1, 0, None)], ROW), 0)
    store.upsert(spark.createDataFrame([(1, 2, "stall", 50, 9, 0, False), (1, 2, "verdict", 51, 9, None, False)], ROW), 1)
    assert [(r[1], r[2][0], r[3], r[7]) for r in held(store)] == [(1, 1, 1, 1), (2, 50, 1, 0)]
    store.upsert(spark.createDataFrame([(1, 2, "stall", 70, 12, 0, True), (1, 2, "resume", 80, 13, 10, None)], ROW), 2)
    assert held(store) == [(1, 1, (1, 1, None), 1, 1, None, None, 1), (1, 2, (50, 9, False), 2, 70, (51, False), (80, 10), 0)]


def test_reports_of_a_watch_reach_the_store_through_a_stream(spark, tmp_path):
    rows = [(s, k, "frame", 1_000_000 + 700 * k + (9000 if k > 5 else 0) + (9000 if k > 12 else 0), None) for s in (1, 2, 3) for k in range(20)]
    spark.createDataFrame(rows, watch.RECORD).coalesce(1).write.parquet(str(tmp_path / "in"))
    told = watch.run_watch(watch.watched(watch.file_stream(spark, str(tmp_path / "in")), watch.StallRule(), late_ms=1000), "store")
    # Files in order of time, as a watch tells its reports.
    for half in ("at < 1010000", "at >= 1010000"):
        told.where(half).selectExpr("sid as owner", "7L as session", "what", "at", "n", "ms", "flag").coalesce(1).write.mode("append").parquet(str(tmp_path / "told"))
    store = records.RecordStore(spark, str(tmp_path / "store"))
    source = spark.readStream.schema(ROW).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "told"))
    source.writeStream.foreachBatch(store.upsert).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    got = held(store)
    assert [(r[0], r[3], r[7]) for r in got] == [(1, 2, 0), (2, 2, 0), (3, 2, 0)] and all(r[5][1] is False and r[6] is not None for r in got)
