"""C realtime features and F drift operators."""
import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnstile.functions.ordered import COARSE, FINE, value_bucket
from turnstile.operators import drift as D
from turnstile.operators import realtime as R
from turnstile.sources import files as A

T0 = dt.datetime(2024, 1, 1)


def test_user_realtime_features_nulls(spark):
    raw = spark.createDataFrame([(1, "e1", 10.0, T0), (1, "e1", None, T0), (1, "e2", 5.0, T0),
                                 (None, "e3", 99.0, T0), (2, "e9", None, T0)],
                                "user_id long, event_id string, total_amount double, timestamp timestamp_ntz")
    out = {r.user_id: r for r in R.user_realtime_features(raw).collect()}
    assert set(out) == {1, 2}
    assert (out[1].user_txn_count_1h, out[1].user_txn_amount_1h, out[1].user_distinct_events_1h) == (3, 15.0, 2)
    assert out[1].user_avg_amount_24h == pytest.approx(5.0)
    assert out[2].user_txn_amount_1h == 0.0 and out[2].event_timestamp == T0


def test_filter_recent_inclusive_and_skips(spark):
    raw = spark.createDataFrame([("2024-01-02T00:00:00Z",), ("2024-01-01T00:00:00Z",), ("2023-12-31T23:59:59Z",), ("bad",)],
                                "timestamp string")
    as_of = dt.datetime(2024, 1, 2)
    assert A.filter_recent(raw, "timestamp", as_of, 24).count() == 2
    assert A.filter_recent(raw, "timestamp", as_of, 0).count() == 4
    assert A.filter_recent(raw, "missing", as_of, 24).count() == 4


def test_trailing_features_match_brute_force(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(500):
        u = rnd.choice([1, 1, 2])
        ts = T0 + dt.timedelta(minutes=rnd.randint(0, 60 * 50))
        rows.append((i, u, rnd.choice(["a", "b", "c", "d"]), ts, float(rnd.randint(1, 500)) / 4))
    df = spark.createDataFrame(rows, "transaction_id long, user_id long, event_id string, event_timestamp timestamp_ntz, total_amount double")
    got = {r.transaction_id: r for r in R.trailing_user_features(df).collect()}
    for tid, u, e, ts, amt in rows:
        h = [x for x in rows if x[1] == u and ts - dt.timedelta(hours=1) < x[3] <= ts]
        d = [x for x in rows if x[1] == u and ts - dt.timedelta(hours=24) < x[3] <= ts]
        r = got[tid]
        assert r.user_txn_count_1h == len(h)
        assert r.user_txn_amount_1h == pytest.approx(sum(x[4] for x in h))
        assert r.user_distinct_events_1h == len({x[2] for x in h})
        assert r.user_avg_amount_24h == pytest.approx(sum(x[4] for x in d) / len(d))


def test_feature_parity(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "user_id long, f double")
    b = spark.createDataFrame([(1, 1.0), (2, 2.5), (4, 4.0)], "user_id long, f double")
    r = R.feature_parity(a, b, ["f"]).collect()[0]
    assert (r.missing_in_stream, r.missing_in_batch, r.mismatched, r.parity) == (1, 1, 1, False)


def _frame(spark, vals):
    return spark.createDataFrame([(float(v), int(v), bool(v > 0)) for v in vals], "x double, k long, flag boolean")


def test_drift_identical_is_zero_and_shift_detected(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(10, 2, 400)
    ref = _frame(spark, base)
    same = D.mean_shift_drift(ref, _frame(spark, base)).collect()[0]
    assert same.drift_score == 0.0 and not same.drift_detected and same.n_columns == 2  # bool excluded
    shifted = D.mean_shift_drift(ref, _frame(spark, base + 10)).collect()[0]
    assert shifted.drift_score >= 0.3 and shifted.drift_detected


def test_drift_constant_reference_uses_unit_std(spark):
    ref = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    cur = spark.createDataFrame([(1.5,)], "x double")
    assert D.mean_shift_scores(ref, cur).collect()[0].score == pytest.approx(0.5, rel=1e-6)


def test_ratio_drift_edges(spark):
    ref = spark.createDataFrame([(-2.0, 0.0)], "a double, b double")
    cur = spark.createDataFrame([(-3.0, 5.0)], "a double, b double")
    r = D.ratio_drift(ref, cur, ["a", "b"]).collect()[0]
    # a: |-3+2| / -2 = -0.5 (signed denominator), b: 5/1 → mean 2.25 capped at 1
    assert r.drift_score == 1.0 and not r.passed
    empty = D.ratio_drift(ref.where("a > 0"), cur, ["a"]).collect()[0]
    assert empty.drift_score == 0.0 and empty.passed and empty.reason == "insufficient data"


def test_ks_statistic_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    a, b = np.round(rng.normal(0, 1, 300), 2), np.round(rng.normal(0.3, 1, 200), 2)
    ref = spark.createDataFrame([(float(x),) for x in a], "x double")
    cur = spark.createDataFrame([(float(x),) for x in b], "x double")
    r = D.distribution_tests(ref, cur).collect()[0]
    grid = np.union1d(a, b)
    brute = max(abs((a <= g).mean() - (b <= g).mean()) for g in grid)
    assert r.statistic == pytest.approx(brute) and r.kind == "ks"
    assert r.drifted == (brute > r.threshold)


def test_accuracy_and_alerts(spark):
    ref = spark.createDataFrame([(1, 1), (0, 0), (1, None)], "target int, prediction int")
    cur = spark.createDataFrame([(1, 0), (0, 0)], "target int, prediction int")
    p = D.compare_performance(ref, cur).collect()[0]
    assert p.accuracy_reference == pytest.approx(2 / 3) and p.accuracy_current == 0.5
    row = spark.createDataFrame([(0.1, 0.9, 0.7)], "d double, r double, c double")
    assert row.select(D.alert_decision(F.col("d"), F.col("r"), F.col("c")).alias("a")).collect()[0].a
    assert not row.select(D.alert_decision(F.col("d"), F.col("r"), F.col("r")).alias("a")).collect()[0].a
    missing = D.compare_performance(ref.select("target"), cur).collect()[0]
    assert missing.accuracy_reference == 0.0


def test_split_variants_equal_two_frame_forms(spark):
    rng = np.random.default_rng(4)
    rows = [(bool(i % 3 == 0), float(np.round(rng.normal(i % 5, 1), 2)), int(rng.integers(0, 4)),
             ["x", "y", "z"][i % 3 if i % 2 else 0]) for i in range(600)]
    df = spark.createDataFrame(rows, "is_ref boolean, a double, b long, c string")
    ref, cur = df.where("is_ref"), df.where("NOT is_ref")
    two = {r.column: r.score for r in D.mean_shift_scores(ref, cur, ["a", "b"]).collect()}
    one = {r.column: r.score for r in D.mean_shift_scores_split(df, F.col("is_ref"), ["a", "b"]).collect()}
    assert two == pytest.approx(one)
    t2 = {r.column: r.statistic for r in D.distribution_tests(ref, cur, ["a", "b", "c"]).collect()}
    t1 = {r.column: r.statistic for r in D.distribution_tests_split(df, F.col("is_ref"), ["a", "b", "c"]).collect()}
    assert t2 == pytest.approx(t1) and set(t1) == {"a", "b", "c"}


def test_drift_score_grows_with_injected_level(spark):
    from turnstile.operators import metrics as M
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(float(x), int(y)) for x, y in zip(rng.normal(50, 10, 500), rng.integers(1, 10, 500))],
                               "price double, qty long")
    scores = [D.mean_shift_drift(df, M.inject_drift(df, lvl, ["price", "qty"])).collect()[0].drift_score
              for lvl in (0.0, 0.1, 0.5, 0.9)]
    assert scores[0] == 0.0 and scores == sorted(scores) and scores[-1] >= 0.3


def test_distribution_tests_with_an_empty_side(spark):
    """No data on a side is no test; the summary then falls back to F1."""
    ref = spark.createDataFrame([(1.0, "x"), (2.0, "y")], "a double, c string")
    for cur in (ref.limit(0), spark.createDataFrame([(None, None)], "a double, c string")):
        got = {r.column: (r.kind, r.statistic, r.drifted) for r in D.distribution_tests(ref, cur, ["a"]).collect()}
        assert got == {"a": ("no data", None, False)}
        r = D.drifted_share(ref, cur, ["a"]).collect()[0]
        f1 = D.mean_shift_drift(ref, cur, ["a"]).collect()[0]
        assert r.n_columns == 0 and r.drift_score == f1.drift_score
    assert {r.kind for r in D.distribution_tests(ref, ref.limit(0)).collect()} == {"no data"}


@pytest.mark.parametrize("seed", range(3))
def test_ks_with_infinities_and_ties(spark, seed):
    rnd = random.Random(seed)
    pool = [float("-inf"), -3.0, -1e-9, 0.0, 1.0, 1.001, 1.002, 1.003, 50.0, float("inf")]
    a, b = [[rnd.choice(pool[k:]) for _ in range(60)] for k in (0, 2)]
    r = D.distribution_tests(spark.createDataFrame([(x,) for x in a], "x double"),
                             spark.createDataFrame([(x,) for x in b], "x double")).collect()[0]
    brute = max(abs(sum(x <= g for x in a) - sum(x <= g for x in b)) / 60 for g in pool)
    assert r.statistic == pytest.approx(brute)


def test_trailing_features_with_ties_and_nulls(spark):
    """Equal times see each other; the window's far edge is open; null events
    and amounts count as rows only."""
    at = lambda m: T0 + dt.timedelta(minutes=m)
    rows = [(1, 1, "a", at(0), 1.0), (2, 1, "a", at(0), 2.0), (3, 1, None, at(30), None), (4, 1, "b", at(60), 4.0),
            (5, 1, "a", at(60), 8.0), (6, None, "a", at(61), 1.0), (7, 1, "a", at(24 * 60), 1.0),
            (8, 1, "b", at(24 * 60 + 1), 1.0)]
    df = spark.createDataFrame(rows, "transaction_id long, user_id long, event_id string, "
                                     "event_timestamp timestamp_ntz, total_amount double")
    got = {r.transaction_id: (r.user_txn_count_1h, r.user_txn_amount_1h, r.user_distinct_events_1h)
           for r in R.trailing_user_features(df).collect()}
    assert got == {1: (2, 3.0, 1), 2: (2, 3.0, 1), 3: (3, 3.0, 1), 4: (3, 12.0, 2), 5: (3, 12.0, 2), 6: (1, 1.0, 1),
                   7: (1, 1.0, 1), 8: (2, 2.0, 2)}


def test_collect_drift_without_history(spark, tmp_path):
    import json
    preds = spark.createDataFrame([(0.9, 0.0), (0.1, 0.0)], "prediction double, label double")
    missing = D.collect_drift(spark, str(tmp_path / "none"), preds).collect()[0]
    assert (missing.source, missing.drift_score) == ("calibration_gap", 0.5)
    (tmp_path / "empty").mkdir()
    assert D.collect_drift(spark, str(tmp_path / "empty"), preds).collect()[0].source == "calibration_gap"
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "a.json").write_text("\n".join(json.dumps(
        {"drift_score": s, "drift_detected": s > .3, "run_ts": f"2024-01-0{k}T00:00:00Z"}) for k, s in ((1, .9), (2, .1))))
    assert D.collect_drift(spark, str(tmp_path / "h"), preds).collect()[0].drift_score == 0.1


def test_hourly_job_publishes_nothing_when_the_gate_fails(spark, tmp_path):
    from turnstile.plans import workflows as W
    raw = spark.createDataFrame([(1, "a", 1.0, T0)], "user_id long, event_id string, total_amount double, timestamp timestamp_ntz")
    bad = spark.createDataFrame([], "event_id long, avg_ticket_price double, event_timestamp timestamp_ntz, "
                                    "total_tickets_sold long, promoter_success_rate double")
    with pytest.raises(W.ValidationFailed, match="empty"):
        W.hourly_features(spark, raw, bad, raw, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_daily_job_writes_its_summary(spark, tmp_path):
    from turnstile.plans import workflows as W
    preds = spark.createDataFrame([(0.9, 0.0), (0.1, 0.0)], "prediction double, label double")
    dec = W.daily_monitoring(spark, None, preds, daily_path=str(tmp_path / "daily")).collect()[0]
    assert dec.needs_retrain
    back = spark.read.json(str(tmp_path / "daily")).collect()
    assert [(r.drift_score, r.source) for r in back] == [(0.5, "calibration_gap")]


@pytest.mark.parametrize("shift", [0.0, 0.3])
def test_ks_opens_few_rows(spark, shift):
    """Two equal halves of one distribution, and a shifted one: under 5 % of the rows are looked at by value."""
    n = 1_000_000
    x = spark.range(n).select((F.col("id") % 2).cast("int").alias("rc"), (F.rand(3) + 0.5).alias("u")) \
        .select("rc", (1 - F.col("rc")).alias("cc"), (F.col("u") + shift * F.col("rc")).alias("v"), F.lit("x").alias("column"))
    values = x.withColumn("b", value_bucket(F.col("v"), COARSE)).withColumn("f", value_bucket(F.col("v"), FINE))
    opened = D._ks_opened(D._ks_buckets(values)).select("b", "f")
    assert values.join(opened, ["b", "f"], "left_semi").count() < 0.05 * n


def test_ks_of_few_values_opens_nothing(spark):
    x = spark.range(1000).select((F.col("id") % 2).cast("int").alias("rc"), (F.col("id") % 7).cast("double").alias("v"),
                                 F.lit("x").alias("column")).withColumn("cc", 1 - F.col("rc"))
    values = x.withColumn("b", value_bucket(F.col("v"), COARSE)).withColumn("f", value_bucket(F.col("v"), FINE))
    assert D._ks_opened(D._ks_buckets(values)).isEmpty()
