"""C5 in a session that a launcher has made, without this package beside the driver."""
import os
import subprocess
import sys

from pyspark import cloudpickle

from turnstile.streaming import jobs as J

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def test_the_processor_loads_without_the_package():
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    load = "import pickle, sys; pickle.load(sys.stdin.buffer); assert 'turnstile' not in sys.modules"
    subprocess.run([sys.executable, "-c", load], input=cloudpickle.dumps(J.trailing_mean(10)), cwd="/", env=env, check=True)


def test_windows_keep_state_where_the_processor_can(spark, tmp_path):
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        src, out = str(tmp_path / "src"), str(tmp_path / "out")
        rows = [(1, "a", 2.0, "2024-01-01 12:00:00"), (1, "b", 4.0, "2024-01-01 15:00:00")]
        spark.createDataFrame(rows, "user_id long, event_id string, total_amount double, timestamp string") \
             .write.parquet(src)
        stream = J.file_stream(spark, src, spark.read.parquet(src).schema)
        J.run_until_done(J.write_to_table(J.windowed_user_features(stream), out, str(tmp_path / "ck")))
        found = spark.read.parquet(out).collect()
    finally:
        spark.conf.set(PROVIDER, before)
    assert len(found) == 12 and {r.user_avg_amount_24h for r in found} == {2.0}


def _rows(at, src, spark, rows):
    spark.createDataFrame([(u, e, 1.0, f"2024-01-01 {t}") for u, e, t in rows],
                          "user_id long, event_id long, total_amount double, timestamp string").write.mode(at).parquet(src)


def test_windows_are_worked_out_not_kept(spark, tmp_path):
    """State takes a row per pane and event and one per user, not twelve windows of each."""
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    _rows("error", src, spark, [(k % 5, k % 3, f"{8 + k // 60:02d}:{k % 60:02d}:00") for k in range(240)])
    q = J.write_to_table(J.windowed_user_features(J.file_stream(spark, src, spark.read.parquet(src).schema)), out, str(tmp_path / "ck"))
    J.run_until_done(q)
    assert spark.read.parquet(out).count() > 200
    operators = [op for p in q.recentProgress for op in p.stateOperators]
    assert sum(op.numRowsUpdated for op in operators) < 2 * 240
    assert len({op.operatorName for op in operators}) == 2


def test_windows_close_without_new_rows_of_the_user(spark, tmp_path):
    """A window that ends when the watermark gets there is emitted, by new rows or by the clock, once; whole-number
    events beside nulls are told apart."""
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    big = 2 ** 53
    found = lambda: sorted((str(r.e), r.n, r.d) for r in spark.read.parquet(out).where("user_id = 1").selectExpr(
        "date_format(window_end, 'HH:mm') AS e", "user_txn_count_1h AS n", "user_distinct_events_1h AS d").collect())

    def more(*rows):
        _rows("append", src, spark, rows)
        J.run_until_done(J.write_to_table(J.windowed_user_features(
            J.file_stream(spark, src, spark.read.parquet(src).schema)), out, str(tmp_path / "ck")))
        return found()
    first = more((1, big, "12:00:00"), (1, big + 1, "12:01:00"), (1, None, "12:02:00"), (2, 1, "12:20:00"))
    assert first == [("12:05", 3, 2), ("12:10", 3, 2)]
    second = more((2, 1, "12:50:00"))  # watermark 12:40, nothing new of user 1
    assert second == [(f"12:{m:02d}", 3, 2) for m in range(5, 45, 5)]
    third = more((1, big + 1, "12:52:00"), (2, 1, "13:40:00"))  # watermark 13:30; the new pane ends at 12:55
    assert third == [(f"12:{m:02d}", 3, 2) for m in range(5, 55, 5)] + [("12:55", 4, 2)] \
        + [("13:00", 4, 2)] + [(f"13:{m:02d}", 1, 1) for m in range(5, 35, 5)]
    assert more((2, 1, "23:00:00"))[-1] == ("13:50", 1, 1)


def test_null_users_are_skipped_and_move_the_watermark(spark, tmp_path):
    """They failed the query: their key made the keys beside it floats."""
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    _rows("error", src, spark, [(k % 7 or None, k % 3, f"12:{k:02d}:00") for k in range(40)] + [(None, 1, "15:00:00")])
    J.run_until_done(J.write_to_table(J.windowed_user_features(
        J.file_stream(spark, src, spark.read.parquet(src).schema)), out, str(tmp_path / "ck")))
    got = {(r.user_id, str(r.e)): r.n for r in spark.read.parquet(out).selectExpr(
        "user_id", "date_format(window_end, 'HH:mm') AS e", "user_txn_count_1h AS n").collect()}
    want = {}
    for user in range(1, 7):
        for end in range(5, 105, 5):
            n = sum(k % 7 == user and end - 60 <= k < end for k in range(40))
            if n:
                want[user, f"{12 + end // 60}:{end % 60:02d}"] = n
    assert len(want) > 70 and got == want
