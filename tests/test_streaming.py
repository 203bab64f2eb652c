"""Streaming jobs: decode, state, publish, landing, parity with batch."""
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from turnstile.operators import realtime as R
from turnstile.plans import views as V
from turnstile.streaming import jobs as J
from turnstile.streaming import online as O


def _dir(name):
    return tempfile.mkdtemp(prefix=f"ts-{name}-", dir="/tmp")


def test_parse_drops_malformed_and_fills_defaults(spark):
    msgs = spark.createDataFrame([('{"user_id": "user_12", "event_id": 3, "total_amount": 2.5}',),
                                  ('not json',), ('{"user_id": 7',), (None,), ('{"user_id": " 9 "}',)], "value string")
    out = J.parse_transactions(msgs, observe_as="parse_stats").collect()
    assert [r.user_id for r in out] == [12, 9]
    assert out[0].event_id == 3 and out[0].total_amount == 2.5 and out[0].payment_status == "" and out[0].is_bot is False
    assert out[1].total_amount == 0.0 and out[1].event_id == 0


def test_encode_drops_rows_missing_keys(spark):
    df = spark.createDataFrame([(1, 2, 3.0, "t"), (None, 2, 3.0, "t"), (1, 2, None, "t")],
                               "user_id long, event_id long, total_amount double, timestamp string")
    out = J.encode_transactions(df, scenario="flash").collect()
    assert len(out) == 1 and out[0].key == "1" and '"_scenario":"flash"' in out[0].value
    back = J.parse_transactions(spark.createDataFrame([(out[0].value,)], "value string")).collect()[0]
    assert (back.user_id, back.event_id, back.total_amount) == (1, 2, 3.0)


def _raw_stream(spark, d):
    schema = V.table(spark, d, "events").schema
    e = J.file_stream(spark, d, schema, glob="events.parquet")
    return e.select("user_id", F.col("event_type").alias("event_id"), F.col("value").alias("total_amount"),
                    F.col("ts").alias("timestamp"))


def test_stream_publish_matches_batch(spark, sf_dir):
    root, ck = _dir("online"), _dir("ckpt")
    J.run_until_done(J.publish_user_features(J.stream_user_aggregates(_raw_stream(spark, sf_dir)), root, ck,
                                             trigger={"availableNow": True}))
    online = J.read_online(spark, root)
    batch = R.user_realtime_features(V.raw_events(spark, sf_dir))
    r = R.feature_parity(online, batch, R.FEATURES).collect()[0]
    assert r.parity and r.n_stream == r.n_batch > 0


def test_land_stream_partitions_by_row_date(spark, sf_dir):
    out, ck = _dir("land"), _dir("land-ck")
    s = _raw_stream(spark, sf_dir)
    J.run_until_done(J.land_stream(s, out, ck, trigger={"availableNow": True}))
    landed = spark.read.parquet(out)
    assert landed.count() == V.raw_events(spark, sf_dir).count()
    assert landed.where(F.to_date("timestamp") != F.col("dt")).count() == 0
    assert any(n.startswith("dt=") for n in os.listdir(out))


def test_online_changelog_compaction(spark):
    root = _dir("changelog")
    J.write_online_batch(spark.createDataFrame([(1, 1.0), (2, 2.0)], "user_id long, f double"), 0, root)
    J.write_online_batch(spark.createDataFrame([(1, 5.0)], "user_id long, f double"), 1, root)
    J.write_online_batch(spark.createDataFrame([(1, 5.0)], "user_id long, f double"), 1, root)  # replayed batch
    assert {r.user_id: r.f for r in J.read_online(spark, root).collect()} == {1: 5.0, 2: 2.0}
    J.compact_online(spark, root)
    J.write_online_batch(spark.createDataFrame([(2, 9.0)], "user_id long, f double"), 2, root)
    assert {r.user_id: r.f for r in J.read_online(spark, root).collect()} == {1: 5.0, 2: 9.0}


def test_unreadable_base_is_an_error(spark):
    root = _dir("broken")
    J.write_online_batch(spark.createDataFrame([(1, 1.0)], "user_id long, f double"), 0, root)
    J.compact_online(spark, root)
    for folder, _, names in os.walk(f"{root}/base"):
        for n in names:
            if n.endswith(".parquet"):
                with open(os.path.join(folder, n), "wb") as f:
                    f.write(b"not parquet")
    J.write_online_batch(spark.createDataFrame([(2, 2.0)], "user_id long, f double"), 1, root)
    with pytest.raises(Exception, match="(?i)parquet"):
        J.read_online(spark, root).collect()
    with pytest.raises(FileNotFoundError):
        J.read_online(spark, _dir("nothing"))


def test_new_checkpoint_beats_an_older_run(spark):
    """Batch 0 of a new run is newer than batch 5 of the old one, and leaves
    the old run's other rows alone."""
    root = _dir("fresh")
    schema = "user_id long, f double"
    J.write_online_batch(spark.createDataFrame([(1, 1.0), (2, 2.0)], schema), 0, root, run_id="old")
    J.write_online_batch(spark.createDataFrame([(1, 1.5)], schema), 5, root, run_id="old")
    J.compact_online(spark, root)
    J.write_online_batch(spark.createDataFrame([(1, 9.0)], schema), 0, root, run_id="new")
    want = {1: 9.0, 2: 2.0}
    assert {r.user_id: r.f for r in J.read_online(spark, root).collect()} == want
    J.compact_online(spark, root)
    assert {r.user_id: r.f for r in J.read_online(spark, root).collect()} == want


def test_a_crash_at_any_step_keeps_every_row(spark, monkeypatch):
    """Rows written but no manifest; manifest but no vacuum; vacuum cut short."""
    root = _dir("midway")
    write = lambda rows, n: J.write_online_batch(spark.createDataFrame(rows, "user_id long, f double"), n, root)
    read = lambda: {r.user_id: r.f for r in J.read_online(spark, root).collect()}
    write([(k, 0.0) for k in range(40)], 0)
    want = {k: 0.0 for k in range(40)}
    for n in range(1, 6):
        write([(n, float(n)), (100 + n, 1.0)], n)
        want |= {n: float(n), 100 + n: 1.0}
        O.write_base(spark, root, buckets=8)  # crash: no manifest
        assert read() == want
        before = O.current(spark, root).version
        J.compact_online(spark, root, buckets=8)  # the unfinished version is replaced
        assert O.current(spark, root).version == before + 1 and read() == want
        if n == 3:  # crash after one removal of a vacuum
            removed, real = [], O.delete_path

            def once(spark, path):
                if removed:
                    raise RuntimeError("lost")
                removed.append(path)
                real(spark, path)
            monkeypatch.setattr(O, "delete_path", once)
            with pytest.raises(RuntimeError, match="lost"):
                J.vacuum_online(spark, root)
            monkeypatch.setattr(O, "delete_path", real)
            assert read() == want
            J.vacuum_online(spark, root)
            assert read() == want
    assert J.compact_online(spark, root) is None  # nothing new
    J.vacuum_online(spark, root, keep=1)
    assert read() == want
    assert not [f for f, _, names in os.walk(f"{root}/changes") if "_SUCCESS" in names]  # all were folded
    assert len(os.listdir(f"{root}/manifest")) == 1
    write([(1, 50.0)], 9)
    assert read() == want | {1: 50.0}


def test_compaction_rewrites_touched_buckets_only(spark):
    root = _dir("partial")
    J.write_online_batch(spark.range(4000).selectExpr("id AS user_id", "0.0D AS f"), 0, root)
    J.compact_online(spark, root, buckets=100)
    assert len(O.current(spark, root).held) == 100
    J.write_online_batch(spark.createDataFrame([(7, 1.0)], "user_id long, f double"), 1, root)
    J.compact_online(spark, root)
    now = O.current(spark, root)
    assert sorted(now.held.values()) == [0] * 99 + [1]
    assert len([n for n in os.listdir(f"{root}/base/version=0000000001") if n.startswith("bucket=")]) == 1
    assert J.read_online(spark, root).where("f = 1").count() == 1 and J.read_online(spark, root).count() == 4000
    # A reader of the version before still finds all that it needs after a vacuum.
    J.vacuum_online(spark, root, keep=2)
    assert O._rows(spark, root, O._load(spark, O.manifests(spark, root)[0]).held, []).count() == 4000
    J.vacuum_online(spark, root, keep=1)
    assert J.read_online(spark, root).count() == 4000


def test_streams_carry_their_run(spark, sf_dir):
    """Two checkpoints over one root write two runs."""
    root = _dir("runs")
    for _ in range(2):
        J.run_until_done(J.publish_user_features(J.stream_user_aggregates(_raw_stream(spark, sf_dir)), root,
                                                 _dir("runs-ck"), trigger={"availableNow": True}))
    assert len([n for n in os.listdir(f"{root}/changes") if n.startswith("run_id=")]) == 2


def test_null_rewards_say_nothing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", float("nan"))], "arm string, reward double")
    assert [tuple(r) for r in J.stream_arm_updates(df).collect()] == [("a", 2.0, 1.0)]


def _write_src(spark, folder, rows):
    spark.createDataFrame(rows, "user_id long, event_id string, total_amount double, timestamp timestamp") \
        .write.mode("append").parquet(folder)


def test_restart_from_checkpoint_counts_each_row_once(spark):
    import datetime as dt
    src, root, ck = _dir("replay-src") + "/t", _dir("replay-online"), _dir("replay-ck")
    t0 = dt.datetime(2024, 1, 1)
    _write_src(spark, src, [(1, "a", 1.0, t0), (2, "b", 2.0, t0)])
    schema = spark.read.parquet(src).schema
    run = lambda: J.run_until_done(J.publish_user_features(J.stream_user_aggregates(J.file_stream(spark, src, schema)),
                                                           root, ck, trigger={"availableNow": True}))
    run()
    _write_src(spark, src, [(1, "c", 4.0, t0)])
    run()  # restarted query: resumes from the checkpoint, only the new file is read
    run()  # nothing new: no change
    got = {r.user_id: (r.user_txn_count_1h, r.user_txn_amount_1h, r.user_distinct_events_1h)
           for r in J.read_online(spark, root).collect()}
    assert got == {1: (2, 5.0, 2), 2: (1, 2.0, 1)}


def test_rows_behind_the_watermark_are_dropped(spark):
    import datetime as dt
    src, out, ck = _dir("late-src") + "/t", _dir("late-out") + "/o", _dir("late-ck")
    t0 = dt.datetime(2024, 1, 1, 12)
    schema = "user_id long, event_id string, total_amount double, timestamp timestamp"
    spark.createDataFrame([(1, "a", 1.0, t0), (1, "b", 1.0, t0 + dt.timedelta(hours=3))], schema) \
        .coalesce(1).write.mode("append").parquet(src)
    sch = spark.read.parquet(src).schema
    run = lambda: J.run_until_done(J.write_to_table(
        J.windowed_user_features(J.file_stream(spark, src, sch, max_files=1)), out, ck, mode="append"))
    run()  # watermark is now 15:00 - 10 min
    spark.createDataFrame([(1, "late", 100.0, t0 + dt.timedelta(minutes=1))], schema) \
        .coalesce(1).write.mode("append").parquet(src)
    run()
    rows = spark.read.parquet(out).collect()
    # the 12:00 row's twelve windows are closed and emitted; the late row adds to none of them
    assert len(rows) == 12 and all(r.user_txn_amount_1h == 1.0 and r.user_txn_count_1h == 1 for r in rows)


def test_windows_with_trailing_mean_match_brute_force(spark):
    """One busy user, one quiet one, two runs of the stream; every closed window against the rows."""
    import datetime as dt
    import random
    rnd = random.Random(5)
    src, out, ck = _dir("win-src") + "/t", _dir("win-out") + "/o", _dir("win-ck")
    t0 = dt.datetime(2024, 1, 1)
    rows = [(rnd.choice([1, 1, 1, 1, 2]), rnd.choice(["a", "b", "c", None]), rnd.choice([1.0, 2.5, None]),
             t0 + dt.timedelta(seconds=rnd.randrange(40 * 3600))) for _ in range(300)]
    rows += [(3, "a", 1.0, t0 + dt.timedelta(hours=h)) for h in (0, 1, 30)]  # idle for longer than a day
    rows.sort(key=lambda r: r[3])
    _write_src(spark, src, rows[:200])
    sch = spark.read.parquet(src).schema
    run = lambda: J.run_until_done(J.write_to_table(J.windowed_user_features(J.file_stream(spark, src, sch)), out, ck))
    run()
    _write_src(spark, src, rows[200:])
    run()
    closed = rows[-1][3] - dt.timedelta(minutes=10)
    want = {}
    for user in (1, 2, 3):
        own = [r for r in rows if r[0] == user]
        for k in range(-12, 41 * 12):
            start = t0 + dt.timedelta(minutes=5 * k)
            end = start + dt.timedelta(hours=1)
            hour = [r for r in own if start <= r[3] < end]
            day = [r[2] or 0.0 for r in own if end - dt.timedelta(hours=24) <= r[3] < end]
            if hour and end <= closed:
                want[user, start] = (len(hour), sum(r[2] or 0.0 for r in hour), len({r[1] for r in hour} - {None}),
                                     sum(day) / len(day))
    got = {(r[0], r[1]): (r[3], r[4], r[5], pytest.approx(r[6])) for r in spark.read.parquet(out).select(
        "user_id", F.col("window_start").cast("timestamp_ntz"), "window_end", "user_txn_count_1h", "user_txn_amount_1h",
        "user_distinct_events_1h", "user_avg_amount_24h").collect()}
    assert len(got) > 500 and got == want
