"""A topic of files, replayed by offsets."""
import os

import pytest
from pyspark.sql import functions as F

from turnstile.sources import topic as A
from turnstile.streaming import jobs as J


def _records(spark, lo, hi, key="k"):
    return spark.range(lo, hi).select(F.concat(F.lit(key), (F.col("id") % 7).cast("string")).alias("key"),
                                      F.col("id").cast("string").alias("value"))


def _consume(spark, path, out, ck, **how):
    J.run_until_done(J.write_to_table(A.topic_source(spark, path, with_offsets=True, **how), out, ck))
    return spark.read.parquet(out).collect() if os.path.exists(out) else []


def test_replay_restart_and_independent_consumers(spark, tmp_path):
    path, out, ck = (str(tmp_path / n) for n in ("topic", "out", "ck"))
    A.write_topic(_records(spark, 0, 500).repartition(3), path, partitions=4)
    first = _consume(spark, path, out, ck)
    assert sorted(int(r.value) for r in first) == list(range(500))
    A.write_topic(_records(spark, 500, 800), path, partitions=4)
    both = _consume(spark, path, out, ck)  # restarted: only what is new
    assert sorted(int(r.value) for r in both) == list(range(800))
    assert sorted(int(r.value) for r in _consume(spark, path, out, ck)) == list(range(800))  # nothing new
    # Offsets are dense in every partition, and a key stays in its partition.
    for p in {r.partition for r in both}:
        own = sorted(r.offset for r in both if r.partition == p)
        assert own == list(range(len(own)))
    assert len({(r.key, r.partition) for r in both}) == 7
    # Another consumer has its own offsets.
    other = _consume(spark, path, str(tmp_path / "out2"), str(tmp_path / "ck2"))
    assert sorted(map(tuple, other)) == sorted(map(tuple, both))
    assert _consume(spark, path, str(tmp_path / "out3"), str(tmp_path / "ck3"), starting="latest") == []
    A.write_topic(_records(spark, 800, 810), path, partitions=4)
    late = _consume(spark, path, str(tmp_path / "out3"), str(tmp_path / "ck3"), starting="latest")
    assert sorted(int(r.value) for r in late) == list(range(800, 810))


def test_unfinished_append_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "topic")
    A.write_topic(_records(spark, 0, 10), path, partitions=2)
    A.write_topic(_records(spark, 10, 20), path, partitions=2)
    os.unlink(f"{path}/index/append=0000000001/_SUCCESS")
    assert sum(rows for *_, rows in A._index(path)) == 10
    A.write_topic(_records(spark, 20, 25), path, partitions=2)  # takes the unfinished one's place
    got = _consume(spark, path, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(int(r.value) for r in got) == [*range(10), *range(20, 25)]


@pytest.mark.parametrize("start,end,want", [({}, {"0": 4}, 4), ({"0": 2}, {"0": 9}, 7), ({"0": 9}, {"0": 9}, 0)])
def test_spans_cut_segments(spark, tmp_path, start, end, want):
    path = str(tmp_path / "topic")
    for lo in (0, 5):
        A.write_topic(_records(spark, lo, lo + 5), path, partitions=1)
    reader = A.TopicReader({"path": path})
    spans = reader.partitions(start, end)
    rows = [r for s in spans for r in reader.read(s)]
    assert len(rows) == want and [r[3] for r in rows] == list(range(start.get("0", 0), start.get("0", 0) + want))
    assert reader.latestOffset() == {"0": 10} and reader.initialOffset() == {}
