"""Compaction beside a running sink; A5: malformed messages on record."""
import datetime as dt
import os

import pytest

from turnstile.streaming import jobs as J
from turnstile.streaming import landing as L

SCHEMA = "id long, timestamp timestamp"


def _source(spark, folder, n, days=2):
    t0 = dt.datetime(2024, 1, 1)
    lo = 1000 * n
    spark.createDataFrame([(lo + k, t0 + dt.timedelta(days=k % days)) for k in range(20)], SCHEMA) \
        .repartition(3).write.mode("append").parquet(folder)


def _land(spark, src, root, ck):
    J.run_until_done(L.land_batches(J.file_stream(spark, src, SCHEMA), root, ck, trigger={"availableNow": True}))


def _ids(df):
    return sorted(r.id for r in df.collect())


def _files(folder):
    return [os.path.join(f, n) for f, _, names in os.walk(folder) for n in names if n.endswith(".parquet")]


def test_no_row_is_lost_or_doubled_at_any_step(spark, tmp_path):
    src, root, ck = (str(tmp_path / n) for n in ("src", "root", "ck"))
    want = []
    for n in range(6):
        _source(spark, src, n)
        want = sorted(want + [1000 * n + k for k in range(20)])
        _land(spark, src, root, ck)
        assert _ids(L.read_landed(spark, root)) == want
        old = L.read_landed(spark, root)  # a reader that began before the compaction
        if n % 2:
            landed = L.write_parts(spark, root)  # crash: no manifest
            assert _ids(L.read_landed(spark, root)) == want
            _source(spark, src, 100 + n)  # the sink goes on meanwhile
            _land(spark, src, root, ck)
            want = sorted(want + [1000 * (100 + n) + k for k in range(20)])
            L.commit(spark, root, landed)  # the first attempt is committed after all: the new batch is not in it
            assert _ids(L.read_landed(spark, root)) == want
            assert len(_ids(old)) == len(want) - 20  # still whole
            L.vacuum_landed(spark, root, keep=1)
            assert _ids(L.read_landed(spark, root)) == want
    L.compact_landed(spark, root)
    L.vacuum_landed(spark, root, keep=1)
    assert L.compact_landed(spark, root) is None
    assert _ids(L.read_landed(spark, root)) == want
    assert not _files(f"{root}/batches") and len(_files(f"{root}/parts")) == 2  # a file a day
    days = {r.dt for r in L.read_landed(spark, root).select("dt").distinct().collect()}
    assert days == {dt.date(2024, 1, 1), dt.date(2024, 1, 2)}


def test_parts_of_the_target_size_are_left_alone(spark, tmp_path):
    src, root, ck = (str(tmp_path / n) for n in ("src", "root", "ck"))
    for n in range(3):
        _source(spark, src, n, days=1)
        _land(spark, src, root, ck)
        L.compact_landed(spark, root, target_bytes=1)  # every part is full
    assert sorted(v for _, v in L.current(spark, root).parts) == [0, 1, 2]
    assert len(_ids(L.read_landed(spark, root))) == 60
    L.vacuum_landed(spark, root, keep=1)
    assert len(_ids(L.read_landed(spark, root))) == 60
    with pytest.raises(FileNotFoundError):
        L.read_landed(spark, str(tmp_path / "nothing"))


def test_good_and_bad_messages_are_all_messages(spark, tmp_path):
    src, root, ck = (str(tmp_path / n) for n in ("src", "root", "ck"))
    good = '{"user_id": "user_12", "event_id": 3, "total_amount": 2.5}'
    rows = [("a", good), ("b", "not json"), ("c", '{"user_id": 7'), ("d", None), ("e", good), (None, "{}")]
    for _ in range(2):
        spark.createDataFrame(rows, "key string, value string").coalesce(1).write.mode("append").parquet(src)
        J.run_until_done(L.land_transactions(J.file_stream(spark, src, "key string, value string"), root, ck,
                                             trigger={"availableNow": True}))
    assert sorted((r.key or "", r.user_id, r.total_amount) for r in L.read_good(spark, root).collect()) == \
        sorted([("a", 12, 2.5), ("e", 12, 2.5), ("", 0, 0.0)] * 2)
    assert sorted((r.key, r.malformed or "") for r in L.read_bad(spark, root).collect()) == \
        sorted([("b", "not json"), ("c", '{"user_id": 7'), ("d", "")] * 2)
    counts = L.read_counts(spark, root).collect()
    assert [(r.messages, r.malformed) for r in counts] == [(6, 3)] * 2 and len({r.run_id for r in counts}) == 1
