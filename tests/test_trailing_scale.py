"""Rows are shuffled once, whatever the bucket of time."""
import datetime as dt
import random

import pytest

from turnstile.operators import realtime as R

SCHEMA = "transaction_id long, user_id long, event_id string, event_timestamp timestamp_ntz, total_amount double"
HOUR = dt.timedelta(hours=1)
TICK = dt.timedelta(microseconds=1)


def _rows(start):
    """Random times, and times a microsecond beside the hour and the day after others; ids repeat."""
    rnd = random.Random(11)
    at = [start + dt.timedelta(seconds=rnd.randrange(4 * 86400)) for _ in range(60)]
    at += [t + w + x for t in at[:20] for w in (HOUR, 24 * HOUR) for x in (-TICK, TICK * 0, TICK)]
    return [(k % 90, rnd.choice([1, 1, 2, None]), rnd.choice(["a", "b", None]), t, rnd.choice([1.0, 2.5, None]))
            for k, t in enumerate(at)]


def _brute(rows):
    found = []
    for tid, user, _, ts, _ in rows:
        hour, day = ([r for r in rows if r[1] == user and ts - w < r[3] <= ts] for w in (HOUR, 24 * HOUR))
        found.append((tid, user, ts, len(hour), sum(r[4] or 0.0 for r in hour), len({r[2] for r in hour} - {None}),
                      round(sum(r[4] or 0.0 for r in day) / len(day), 6)))
    return sorted(found, key=str)


@pytest.mark.parametrize("hours,start", [(1, "2024-01-01"), (5, "2024-01-01"), (24, "2024-01-01 13:00"), (100, "2024-01-01"),
                                         (24, "1969-12-30")])
def test_trailing_features_of_any_bucket(spark, hours, start):
    rows = _rows(dt.datetime.fromisoformat(start))
    timeless = (1000, 1, "a", None, 1.0)  # belongs to no window and has none
    df = spark.createDataFrame([*rows, timeless], SCHEMA)
    got = [(*r[:6], round(r[6], 6)) for r in map(tuple, R.trailing_user_features(df, bucket_hours=hours).collect())]
    assert sorted(got, key=str) == _brute(rows)


def test_rows_are_shuffled_once(spark):
    df = spark.createDataFrame(_rows(dt.datetime(2024, 1, 1)), SCHEMA)
    found = R.trailing_user_features(df)
    found.collect()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    physical = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Window ") == physical.count("Window ") == 2 and "Join" not in plan
    assert found._jdf.queryExecution().executedPlan().initialPlan().toString().count("Exchange ") == 1
