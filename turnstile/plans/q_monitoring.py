"""Queries for group F (drift and monitoring).

Reference/current split: transactions before 1998-01-01 vs after (txns),
and request-log rows before vs from 2024-01-16 (events).
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from turnstile.operators import drift as D
from turnstile.operators import realtime as R
from turnstile.plans import views as V
from turnstile.plans.registry import register, round_doubles
from turnstile.plans.views import with_views
from turnstile.session import reuse, scratch_path
from turnstile.sources import files as A

SPLIT_TXNS = "1998-01-01 00:00:00"
SPLIT_LOG = "2024-01-16 00:00:00"
DRIFT_COLS = ["quantity", "ticket_price", "total_amount"]


def _txn_sides(spark, d, enrich=False):
    t = _txn_table(spark, d, enrich)
    cut = F.lit(SPLIT_TXNS).cast("timestamp_ntz")
    return t.where(F.col("event_timestamp") < cut), t.where(F.col("event_timestamp") >= cut)


def _txn_table(spark, d, enrich=False):
    t = V.txns(spark, d)
    if enrich:
        t = t.join(V.users(spark, d).select("user_id", "loyalty_tier"), "user_id", "left")
    return t


def _is_ref_txn():
    """Reference side = transactions before the split date (one pass over the table)."""
    return F.col("event_timestamp") < F.lit(SPLIT_TXNS).cast("timestamp_ntz")


def _log_sides(spark, d):
    log = V.request_log(spark, d)
    cut = F.lit(SPLIT_LOG).cast("timestamp_ntz")
    return log.where(F.col("ts") < cut), log.where(F.col("ts") >= cut)


SQL_SIDES = f"""
WITH ref AS (SELECT * FROM txns WHERE event_timestamp < TIMESTAMP '{SPLIT_TXNS}'),
cur AS (SELECT * FROM txns WHERE event_timestamp >= TIMESTAMP '{SPLIT_TXNS}')"""


def _sql_mean_shift(cols, ref="ref", cur="cur"):
    r = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS rm_{c}, stddev_samp(CAST({c} AS DOUBLE)) AS rs_{c}" for c in cols)
    k = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS cm_{c}" for c in cols)
    rows = "\n    UNION ALL ".join(
        f"""SELECT '{c}' AS "column", rm_{c} AS ref_mean, cm_{c} AS cur_mean, rs_{c} AS ref_std,
           least(1.0, abs(cm_{c} - rm_{c}) / (CASE WHEN rs_{c} IS NULL OR rs_{c} = 0 OR isnan(rs_{c}) THEN 1.0
                                                ELSE rs_{c} END + 1e-8)) AS score FROM r, k"""
        for c in cols)
    return f"""r AS (SELECT {r} FROM {ref}), k AS (SELECT {k} FROM {cur}),
ms AS ({rows})"""


# ------------------------------------------------------------------ F1
register("f1_mean_shift_scores", with_views(SQL_SIDES + ",\n" + _sql_mean_shift(DRIFT_COLS) + """
SELECT "column", round(ref_mean, 4) AS ref_mean, round(cur_mean, 4) AS cur_mean, round(ref_std, 4) AS ref_std,
       round(score, 4) AS score FROM ms""", "txns"))(
    lambda spark, d: round_doubles(D.mean_shift_scores_split(_txn_table(spark, d), _is_ref_txn(), DRIFT_COLS)))

SQL_F1_SUMMARY = with_views(SQL_SIDES + ",\n" + _sql_mean_shift(DRIFT_COLS) + """,
s AS (SELECT coalesce(avg(score), 0.0) AS drift_score, count(*) AS n_columns FROM ms)
SELECT round(drift_score, 4) AS drift_score, n_columns, drift_score >= 0.3 AS drift_detected FROM s""", "txns")


@register("f1_mean_shift_drift", SQL_F1_SUMMARY)
def q_f1_summary(spark, d):
    return round_doubles(D.mean_shift_drift_split(_txn_table(spark, d), _is_ref_txn(), DRIFT_COLS)
                         .drop("column_scores"))


# ------------------------------------------------------------------ F2
register("f2_drift_decision", with_views(SQL_SIDES + ",\n" + _sql_mean_shift(DRIFT_COLS) + """
SELECT "column", round(score, 4) AS score, score >= 0.3 AS drift_detected FROM ms""", "txns"))(
    lambda spark, d: round_doubles(D.mean_shift_scores_split(_txn_table(spark, d), _is_ref_txn(), DRIFT_COLS).select(
        "column", "score", D.drift_decision(F.col("score")).alias("drift_detected"))))

# ------------------------------------------------------------------ F3
_F3_PARTS = " UNION ALL ".join(
    f"SELECT CASE WHEN rm_{c} IS NOT NULL AND cm_{c} IS NOT NULL THEN abs(cm_{c} - rm_{c}) / "
    f"(CASE WHEN rm_{c} <> 0 THEN rm_{c} ELSE 1.0 END) END AS s FROM r, k" for c in DRIFT_COLS)
register("f3_ratio_drift", with_views(SQL_SIDES + f""",
r AS (SELECT count(*) AS rn, {", ".join(f"avg(CAST({c} AS DOUBLE)) AS rm_{c}" for c in DRIFT_COLS)} FROM ref),
k AS (SELECT count(*) AS cn, {", ".join(f"avg(CAST({c} AS DOUBLE)) AS cm_{c}" for c in DRIFT_COLS)} FROM cur),
p AS ({_F3_PARTS}),
a AS (SELECT coalesce(avg(s), 0.0) AS m, count(s) AS n FROM p),
z AS (SELECT CASE WHEN rn = 0 OR cn = 0 THEN 0.0 ELSE least(1.0, m) END AS score, rn, cn, n FROM a, r, k)
SELECT round(score, 4) AS drift_score, score < 0.3 AS passed,
       CASE WHEN rn = 0 OR cn = 0 THEN 'insufficient data' END AS reason, CAST(n AS INTEGER) AS n_columns FROM z""",
    "txns"))(
    lambda spark, d: round_doubles(D.ratio_drift(*_txn_sides(spark, d), DRIFT_COLS)))

# ------------------------------------------------------------------ F4
KS_C = repr(math.sqrt(-math.log(D.KS_ALPHA / 2) / 2))
_F4_NUM = " UNION ALL ".join(
    f"SELECT '{c}' AS col, CAST({c} AS DOUBLE) AS v, {rc} AS rc, {cc} AS cc FROM {side}"
    for c in DRIFT_COLS for side, rc, cc in (("ref", 1, 0), ("cur", 0, 1)))
SQL_F4 = with_views(f"""
WITH et AS (SELECT t.*, u.loyalty_tier FROM txns t LEFT JOIN users u USING (user_id)),
ref AS (SELECT * FROM et WHERE event_timestamp < TIMESTAMP '{SPLIT_TXNS}'),
cur AS (SELECT * FROM et WHERE event_timestamp >= TIMESTAMP '{SPLIT_TXNS}'),
g AS (SELECT col, v, sum(rc) AS rc, sum(cc) AS cc FROM ({_F4_NUM}) WHERE v IS NOT NULL GROUP BY col, v),
c AS (SELECT col, v, sum(rc) OVER (PARTITION BY col ORDER BY v) AS crc, sum(cc) OVER (PARTITION BY col ORDER BY v) AS ccc,
             sum(rc) OVER (PARTITION BY col) AS nr, sum(cc) OVER (PARTITION BY col) AS nc FROM g),
ks AS (SELECT col, 'ks' AS kind, max(abs(crc / nr - ccc / nc)) AS statistic,
              CAST('{KS_C}' AS DOUBLE) * sqrt((CAST(nr AS DOUBLE) + nc) / (CAST(nr AS DOUBLE) * nc)) AS threshold
       FROM c GROUP BY col, nr, nc),
g2 AS (SELECT col, v, sum(rc) AS rc, sum(cc) AS cc FROM (
          SELECT 'loyalty_tier' AS col, loyalty_tier AS v, 1 AS rc, 0 AS cc FROM ref
          UNION ALL SELECT 'loyalty_tier', loyalty_tier, 0, 1 FROM cur) GROUP BY col, v),
n2 AS (SELECT col, sum(rc) AS nr, sum(cc) AS nc FROM g2 GROUP BY col),
pq AS (SELECT g2.col, rc / nr AS p, cc / nc AS q, (rc / nr + cc / nc) / 2 AS m FROM g2 JOIN n2 USING (col)),
js AS (SELECT col, 'jensen_shannon' AS kind,
              sqrt(greatest(0.0, 0.5 * sum(CASE WHEN p > 0 THEN p * log2(p / m) ELSE 0.0 END)
                               + 0.5 * sum(CASE WHEN q > 0 THEN q * log2(q / m) ELSE 0.0 END))) AS statistic,
              0.1 AS threshold FROM pq GROUP BY col),
t AS (SELECT * FROM ks UNION ALL SELECT * FROM js)
SELECT col AS "column", kind, round(statistic, 4) AS statistic, round(threshold, 4) AS threshold,
       statistic > threshold AS drifted FROM t""", "txns", "users")

def _f4_tests(spark, d):
    """F4 over a derived table: its columns are written once, as F4 reads them several times."""
    cols = DRIFT_COLS + ["loyalty_tier"]
    rows = reuse(_txn_table(spark, d, enrich=True).select(_is_ref_txn().alias("is_ref"), *cols))
    return D.distribution_tests_split(rows, F.col("is_ref"), cols)


register("f4_distribution_tests", SQL_F4)(lambda spark, d: round_doubles(_f4_tests(spark, d)))


@register("f4_drifted_share", SQL_F4.replace(
    'SELECT col AS "column", kind, round(statistic, 4) AS statistic, round(threshold, 4) AS threshold,\n'
    '       statistic > threshold AS drifted FROM t',
    "SELECT count(*) AS n_columns, count(*) FILTER (WHERE statistic > threshold) AS n_drifted,\n"
    "       round(coalesce(count(*) FILTER (WHERE statistic > threshold) / count(*), 0.0), 4) AS drift_score,\n"
    "       coalesce(count(*) FILTER (WHERE statistic > threshold) / count(*), 0.0) >= 0.3 AS drift_detected FROM t"))
def q_drifted_share(spark, d):
    return round_doubles(D.drifted_share(None, None, tests=_f4_tests(spark, d)))


# ------------------------------------------------------------------ F5 / F6
SQL_LOG_SIDES = f"""
WITH ref AS (SELECT * FROM request_log WHERE ts < TIMESTAMP '{SPLIT_LOG}'),
cur AS (SELECT * FROM request_log WHERE ts >= TIMESTAMP '{SPLIT_LOG}')"""

register("f5_prediction_drift", with_views(SQL_LOG_SIDES + ",\n" + _sql_mean_shift(["fraud_score"]) + """,
s AS (SELECT coalesce(avg(score), 0.0) AS drift_score, count(*) AS n_columns FROM ms)
SELECT round(drift_score, 4) AS drift_score, n_columns, drift_score >= 0.3 AS drift_detected FROM s""",
    "request_log"))(
    lambda spark, d: round_doubles(D.prediction_drift(*_log_sides(spark, d), "fraud_score").drop("column_scores")))

SQL_F6 = """a AS (SELECT coalesce(avg(CAST(coalesce(is_fraud = blocked, false) AS DOUBLE)), 0.0) AS accuracy_reference FROM ref),
b AS (SELECT coalesce(avg(CAST(coalesce(is_fraud = blocked, false) AS DOUBLE)), 0.0) AS accuracy_current FROM cur)"""
register("f6_compare_performance", with_views(SQL_LOG_SIDES + ",\n" + SQL_F6 + """
SELECT round(accuracy_reference, 4) AS accuracy_reference, round(accuracy_current, 4) AS accuracy_current
FROM a, b""", "request_log"))(
    lambda spark, d: round_doubles(D.compare_performance(*_log_sides(spark, d), "is_fraud", "blocked")))


# ------------------------------------------------------------------ F7
@register("f7_alert_decision", with_views(SQL_SIDES + ",\n" + _sql_mean_shift(DRIFT_COLS) + """,
s AS (SELECT coalesce(avg(score), 0.0) AS drift_score FROM ms),
lref AS (SELECT * FROM request_log WHERE ts < TIMESTAMP '""" + SPLIT_LOG + """'),
lcur AS (SELECT * FROM request_log WHERE ts >= TIMESTAMP '""" + SPLIT_LOG + """'),
a AS (SELECT coalesce(avg(CAST(coalesce(is_fraud = blocked, false) AS DOUBLE)), 0.0) AS pr FROM lref),
b AS (SELECT coalesce(avg(CAST(coalesce(is_fraud = blocked, false) AS DOUBLE)), 0.0) AS pc FROM lcur)
SELECT round(drift_score, 4) AS drift_score, round(pr, 4) AS accuracy_reference, round(pc, 4) AS accuracy_current,
       drift_score >= 0.3 OR coalesce(CASE WHEN pr > 0 THEN (pr - pc) / pr END >= 0.1, false) AS alert
FROM s, a, b""", "txns", "request_log"))
def q_alert(spark, d):
    s = D.mean_shift_drift_split(_txn_table(spark, d), _is_ref_txn(), DRIFT_COLS).select("drift_score")
    p = D.compare_performance(*_log_sides(spark, d), "is_fraud", "blocked")
    j = s.crossJoin(p)
    return round_doubles(j.withColumn("alert", D.alert_decision(
        F.col("drift_score"), F.col("accuracy_reference"), F.col("accuracy_current"))))


# ------------------------------------------------------------------ F8
register("f8_drift_metrics", with_views(SQL_SIDES + ",\n" + _sql_mean_shift(DRIFT_COLS) + """,
s AS (SELECT coalesce(avg(score), 0.0) AS drift_score FROM ms)
SELECT 'ml_data_drift_score' AS metric, round(drift_score, 4) AS value FROM s
UNION ALL SELECT 'ml_drift_detected', CASE WHEN drift_score >= 0.3 THEN 1.0 ELSE 0.0 END FROM s""", "txns"))(
    lambda spark, d: round_doubles(D.drift_metrics(D.mean_shift_drift_split(_txn_table(spark, d), _is_ref_txn(),
                                                                            DRIFT_COLS))))


# ------------------------------------------------------------------ F9 / F11
def _write_summary(spark, d):
    summary = D.mean_shift_drift_split(_txn_table(spark, d), _is_ref_txn(), DRIFT_COLS)
    run_ts = V.table(spark, d, "orders").agg(F.max("o_orderdate").alias("run_ts"))
    rec = D.drift_summary_record(summary.crossJoin(run_ts), F.col("run_ts"))
    return D.write_drift_summary(rec, scratch_path(spark, "drift_summary") + "/h")


SQL_F9 = with_views(SQL_SIDES + ",\n" + _sql_mean_shift(DRIFT_COLS) + """,
s AS (SELECT coalesce(avg(score), 0.0) AS drift_score FROM ms)
SELECT round(drift_score, 4) AS drift_score, drift_score >= 0.3 AS drift_detected,
       'seed_regenerated' AS reference_source, CAST(24 AS BIGINT) AS target_window_hours FROM s""", "txns")


@register("f9_write_drift_summary", SQL_F9)
def q_write_summary(spark, d):
    path = _write_summary(spark, d)
    return round_doubles(spark.read.json(path).select("drift_score", "drift_detected", "reference_source",
                                                      "target_window_hours"))


@register("f11_collect_drift", SQL_F9.replace(
    "CAST(24 AS BIGINT) AS target_window_hours", "'feature_pipeline' AS source"))
def q_collect(spark, d):
    path = _write_summary(spark, d)
    return round_doubles(D.collect_drift(spark, path).select("drift_score", "drift_detected", "reference_source",
                                                             "source"))


register("f11_collect_drift_fallback", with_views("""
SELECT round(abs(avg(fraud_score) - avg(CAST(is_fraud AS DOUBLE))), 4) AS drift_score,
       abs(avg(fraud_score) - avg(CAST(is_fraud AS DOUBLE))) >= 0.3 AS drift_detected,
       'calibration_gap' AS source FROM request_log""", "request_log"))(
    lambda spark, d: round_doubles(D.collect_drift(spark, None, V.request_log(spark, d), "fraud_score", "is_fraud")
                                   .select("drift_score", "drift_detected", "source")))

# ------------------------------------------------------------------ F10
register("f10_retrain_decision", with_views(SQL_SIDES + ",\n" + _sql_mean_shift(DRIFT_COLS) + """,
s AS (SELECT coalesce(avg(score), 0.0) AS drift_score, count(*) AS n_columns FROM ms)
SELECT round(drift_score, 4) AS drift_score, 0.3::DOUBLE AS drift_threshold, drift_score >= 0.3 AS needs_retrain,
       CASE WHEN drift_score >= 0.3 THEN 'trigger_retraining' ELSE 'skip_retraining' END AS action,
       n_columns, drift_score >= 0.3 AS drift_detected FROM s""", "txns"))(
    lambda spark, d: round_doubles(D.retrain_decision(
        D.mean_shift_drift_split(_txn_table(spark, d), _is_ref_txn(), DRIFT_COLS).drop("column_scores"))))

# ------------------------------------------------------------------ F12
_C1_SQL = """cur AS (
  SELECT user_id, CAST(count(user_id) AS DOUBLE) AS user_txn_count_1h,
         coalesce(sum(CAST(round(total_amount * 100) AS BIGINT)) / 100.0, 0.0) AS user_txn_amount_1h,
         CAST(count(DISTINCT event_id) AS DOUBLE) AS user_distinct_events_1h,
         coalesce(sum(CAST(round(total_amount * 100) AS BIGINT)) / 100.0, 0.0) / greatest(count(user_id), 1)
           AS user_avg_amount_24h
  FROM raw_events
  WHERE user_id IS NOT NULL AND "timestamp" >= (SELECT max("timestamp") FROM raw_events) - INTERVAL 24 HOUR
  GROUP BY user_id),
ref AS (
  SELECT user_id, CAST(count(user_id) AS DOUBLE) AS user_txn_count_1h,
         coalesce(sum(CAST(round(total_amount * 100) AS BIGINT)) / 100.0, 0.0) AS user_txn_amount_1h,
         CAST(count(DISTINCT event_id) AS DOUBLE) AS user_distinct_events_1h,
         coalesce(sum(CAST(round(total_amount * 100) AS BIGINT)) / 100.0, 0.0) / greatest(count(user_id), 1)
           AS user_avg_amount_24h
  FROM txns WHERE user_id IS NOT NULL GROUP BY user_id)"""

register("f12_check_feature_drift", with_views("WITH " + _C1_SQL + ",\n" + _sql_mean_shift(D.FEATURE_COLUMNS) + """,
s AS (SELECT coalesce(avg(score), 0.0) AS drift_score, count(*) AS n_columns FROM ms),
z AS (SELECT (SELECT count(*) FROM ref) AS n_reference, (SELECT count(*) FROM cur) AS n_current)
SELECT round(CASE WHEN n_reference = 0 OR n_current = 0 THEN 0.0 ELSE drift_score END, 4) AS drift_score,
       CASE WHEN n_reference = 0 OR n_current = 0 THEN false ELSE drift_score >= 0.3 END AS drift_detected,
       n_columns, CASE WHEN n_reference = 0 OR n_current = 0 THEN 'reference or current empty' END AS note,
       n_reference, n_current FROM s, z""", "txns", "raw_events"))(
    lambda spark, d: round_doubles(D.check_feature_drift(
        R.user_realtime_features(A.filter_recent(V.raw_events(spark, d), "timestamp", None, 24, keep_bound="_as_of"),
                                 as_of="_as_of"),
        R.reference_features(V.txns(spark, d))).drop("column_scores")))
