"""Edge cases of the request-log operators (I3-I18) on hand-built logs."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from turnstile.operators import requests as I

T0 = dt.datetime(2024, 1, 1)


def test_error_rules_and_missing_status(spark):
    log = spark.createDataFrame([(200,), (404,), (None,), (599,), (302,)], "status int")
    assert I.error_rate(log).collect()[0].errors == 2            # >= 400, missing = 200
    assert I.error_rate(log, rule="non2xx").collect()[0].errors == 3  # 404, 599, 302
    assert I.error_rate(spark.createDataFrame([(1,)], "x int")).collect()[0].errors == 0  # no status column


def test_fraud_rates_zero_denominators(spark):
    log = spark.createDataFrame([(False, False), (False, False)], "blocked boolean, is_fraud boolean")
    r = I.fraud_rates(log).collect()[0]
    assert (r.fraud_recall, r.fraud_precision, r.fraud_detected_pct) == (0.0, 0.0, 0.0)


def test_business_metrics(spark):
    log = spark.createDataFrame([(True, True), (False, True), (True, False), (False, False)],
                                "blocked boolean, is_fraud boolean")
    tx = spark.createDataFrame([(10.0, "completed"), (30.0, "completed"), (99.0, "failed")],
                               "total_amount double, payment_status string")
    r = I.business_metrics(log, tx).collect()[0]
    assert r.fraud_recall == 0.5 and r.fraud_blocked_pct == 50.0 and r.revenue_impact == 20.0 and not r.passed
    e = I.business_metrics(log.where("false")).collect()[0]
    assert not e.passed and e.reason == "no responses"


def test_fallback_share_missing_latency(spark):
    log = spark.createDataFrame([(250.0,), (None,), (10.0,), (201.0,)], "latency_ms double")
    assert I.fallback_share(log).collect()[0].fallback_used_pct == 50.0


def test_check_expectations(spark):
    actual = spark.createDataFrame([("a", 105.0), ("b", 0.5)], "metric string, value double")
    expected = spark.createDataFrame([("a", 100.0), ("b", 0.0), ("c", 1.0)], "metric string, expected double")
    out = {r.metric: r for r in I.check_expectations(actual, expected).collect()}
    assert out["a"].passed and not out["b"].passed and not out["c"].passed
    assert out["c"].failure == "Metric 'c' not found in results"
    assert out["b"].relative_error == 0.5  # expected 0 → denominator 1
    overall = I.expectations_passed(I.check_expectations(actual, expected)).collect()[0]
    assert not overall.passed and overall.n_failures == 2


def test_parse_predictions_defaults(spark):
    raw = spark.createDataFrame([(1, '{"predictions": [{"fraud_score": 0.9}]}'),
                                 (2, '{"predictions": [{"fraud_score": 0.2, "is_fraud": true}]}'),
                                 (3, '{"predictions": []}'), (4, 'oops')], "id long, body string")
    out = {r.id: r for r in I.parse_predictions(raw).collect()}
    assert out[1].blocked and out[1].predicted_is_fraud
    assert not out[2].blocked and out[2].predicted_is_fraud
    assert out[3].fraud_score == 0.0 and not out[3].predicted_is_fraud
    assert out[4].fraud_score == 0.0


def test_report_row_precedence_and_timeouts(spark):
    m = spark.createDataFrame([(0.8, 0.5, 3, True)], "fraud_precision double, fraud_recall double, "
                                                     "timeout_count long, passed boolean")
    r = I.report_row(m).collect()[0]
    assert r.fraud_metric_label == "Fraud Precision" and r.fraud_metric_value == pytest.approx(80.0)
    assert not r.passed and r.failures == "timeouts: expected 0, got 3"
    r2 = I.report_row(spark.createDataFrame([(12.5,)], "fraud_detected_pct double")).collect()[0]
    assert r2.fraud_metric_label == "Fraud Detected" and r2.fraud_metric_value == 12.5 and r2.passed


def test_combine_runs_fills_missing_columns(spark):
    a = spark.createDataFrame([(T0, 200, "x")], "ts timestamp_ntz, status int, error string")
    b = spark.createDataFrame([(T0, 503)], "ts timestamp_ntz, status int")
    out = I.combine_runs({"a": a, "b": b})
    assert set(out.columns) == {"ts", "status", "error", "run"} and out.where("error IS NULL").count() == 1
    er = {r.run: r.errors for r in I.error_rate(out, by=["run"]).collect()}
    assert er == {"a": 0, "b": 1}


def test_throughput_mean_and_peak(spark):
    log = spark.createDataFrame([(T0,), (T0,), (T0 + dt.timedelta(seconds=9),)], "ts timestamp_ntz")
    r = I.throughput(log).collect()[0]
    assert r.duration_seconds == 9.0 and r.mean_rps == pytest.approx(3 / 9) and r.peak_rps == 2


def test_request_rate_sliding_counts_each_row_per_window(spark):
    log = spark.createDataFrame([(T0 + dt.timedelta(minutes=7), 1)], "ts timestamp_ntz, service int")
    rows = I.request_rate(log, slide="1 minute").collect()
    assert len(rows) == 5 and all(r.requests == 1 for r in rows)
