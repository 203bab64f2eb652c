"""Queries for the composite jobs P1-P6."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnstile.operators import metrics as M
from turnstile.operators import pricing as H
from turnstile.operators import realtime as R
from turnstile.operators import store as S
from turnstile.operators import training as G
from turnstile.plans import q_features, q_models, q_monitoring, q_streaming
from turnstile.plans import views as V
from turnstile.plans import workflows as W
from turnstile.plans.registry import register, round_doubles
from turnstile.plans.views import with_views
from turnstile.session import reuse, scratch_path
from turnstile.sources import files as A
from turnstile.streaming import jobs as J


# ------------------------------------------------------------------ P1
@register("p1_hourly_features", q_features.SQL_C1)
def q_hourly(spark, d):
    return round_doubles(_hourly(spark, d)["online"])


def _hourly(spark, d):
    raw = A.read_raw_events(spark, f"{d}/events.parquet").select(
        "user_id", F.col("event_type").alias("event_id"), F.col("value").alias("total_amount"),
        F.col("ts").alias("timestamp"))
    em = M.event_metrics(V.ticket_events(spark, d), V.txns(spark, d), sort=False)
    return W.hourly_features(spark, raw, em, V.txns(spark, d), scratch_path(spark, "hourly"))


_F12 = ["user_txn_count_1h", "user_txn_amount_1h", "user_distinct_events_1h", "user_avg_amount_24h"]


def _moments_sql(side: str) -> str:
    return ", ".join(f"avg({c}) AS m_{k}, stddev_samp({c}) AS s_{k}" for k, c in enumerate(_F12)) + f" FROM {side}"


# The job's decision in one row: gate, published rows, drift summary as written.
@register("p1_hourly_decision", f"""
WITH cur AS (SELECT user_id, count(*) AS user_txn_count_1h,
                    coalesce(sum(CAST(round(value * 100) AS BIGINT)) / 100.0, 0.0) AS user_txn_amount_1h,
                    count(DISTINCT event_type) AS user_distinct_events_1h,
                    coalesce(sum(CAST(round(value * 100) AS BIGINT)) / 100.0, 0.0) / count(*) AS user_avg_amount_24h
             FROM events WHERE user_id IS NOT NULL AND ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR
             GROUP BY user_id),
ref AS (SELECT o_custkey AS user_id, count(*) AS user_txn_count_1h,
               sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / 100.0 AS user_txn_amount_1h,
               count(DISTINCT l_partkey) AS user_distinct_events_1h,
               sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / 100.0 / count(*) AS user_avg_amount_24h
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey),
r AS (SELECT count(*) AS n, {_moments_sql('ref')}),
c AS (SELECT count(*) AS n, {_moments_sql('cur')}),
s AS (SELECT ({' + '.join(f"least(1.0, abs(c.m_{k} - r.m_{k}) / (CASE WHEN coalesce(r.s_{k}, 0) = 0 THEN 1.0 ELSE r.s_{k} END + 1e-8))" for k in range(4))}) / 4 AS score
      FROM r, c)
SELECT true AS published, (SELECT count(*) FROM cur) AS online_rows, round(score, 4) AS drift_score,
       score >= 0.3 AS drift_detected, 24 AS target_window_hours, (SELECT n FROM r) AS n_reference,
       (SELECT n FROM c) AS n_current FROM s""")
def q_hourly_decision(spark, d):
    out = _hourly(spark, d)
    gate = out["validation"].agg(F.bool_and("passed").alias("published"))
    online = out["online"].agg(F.count(F.lit(1)).alias("online_rows"))
    summary = spark.read.json(out["drift_summary_path"]).select(
        "drift_score", "drift_detected", F.col("target_window_hours").cast("int").alias("target_window_hours"))
    sides = out["drift"].select("n_reference", "n_current")
    return round_doubles(gate.crossJoin(online).crossJoin(summary).crossJoin(sides))


# ------------------------------------------------------------------ P2
@register("p2_daily_monitoring", with_views(q_monitoring.SQL_SIDES + ",\n" + q_monitoring._sql_mean_shift(
    q_monitoring.DRIFT_COLS) + f""",
s AS (SELECT coalesce(avg(score), 0.0) AS drift_score FROM ms),
lref AS (SELECT * FROM request_log WHERE ts < TIMESTAMP '{q_monitoring.SPLIT_LOG}'),
lcur AS (SELECT * FROM request_log WHERE ts >= TIMESTAMP '{q_monitoring.SPLIT_LOG}'),
a AS (SELECT coalesce(avg(CAST(coalesce(is_fraud = blocked, false) AS DOUBLE)), 0.0) AS pr FROM lref),
b AS (SELECT coalesce(avg(CAST(coalesce(is_fraud = blocked, false) AS DOUBLE)), 0.0) AS pc FROM lcur)
SELECT round(drift_score, 4) AS drift_score, 0.3::DOUBLE AS drift_threshold, drift_score >= 0.3 AS needs_retrain,
       CASE WHEN drift_score >= 0.3 THEN 'trigger_retraining' ELSE 'skip_retraining' END AS action,
       drift_score >= 0.3 AS drift_detected, 'feature_pipeline' AS source, 'seed_regenerated' AS reference_source,
       round(pr, 4) AS accuracy_reference, round(pc, 4) AS accuracy_current,
       drift_score >= 0.3 OR coalesce(CASE WHEN pr > 0 THEN (pr - pc) / pr END >= 0.1, false) AS alert
FROM s, a, b""", "txns", "request_log"))
def q_monitor(spark, d):
    path = q_monitoring._write_summary(spark, d)
    ref, cur = q_monitoring._log_sides(spark, d)
    daily = scratch_path(spark, "daily_summary")
    out = W.daily_monitoring(spark, path, perf_reference=ref, perf_current=cur, target="is_fraud", pred="blocked",
                             daily_path=daily)
    # The decision rests on what the job has put on record.
    stored = spark.read.json(daily).select(F.col("drift_score").alias("_stored"))
    return round_doubles(out.drop("run_ts").join(stored, F.col("drift_score") == F.col("_stored")).drop("_stored"))


# ------------------------------------------------------------------ P3 (rows-only: model search)
@register("p3_weekly_training")
def q_weekly(spark, d):
    um = M.user_metrics(V.users(spark, d), V.txns(spark, d), V.ticket_events(spark, d), sort=False)
    return W.weekly_training(um)["gate"]


# ------------------------------------------------------------------ P4 (rows-only: model scoring)
@register("p4_batch_fraud_scoring")
def q_scoring(spark, d):
    tx = V.txns(spark, d)
    requests = tx.select(F.col("transaction_id").alias("request_id"),
                         F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("user_id"),
                         F.col("event_id").cast("string").alias("event_id"), "is_fraud")
    snaps = {S.USER_REALTIME: R.user_realtime_features(V.raw_events(spark, d)),
             S.USER_PURCHASE: M.user_metrics(V.users(spark, d), tx, V.ticket_events(spark, d), sort=False)}
    cols = [r.replace(":", "__") for r in S.FRAUD_REFS]
    train = S.build_feature_frame(
        S.get_online_features(S.normalize_ids(requests, ["user_id", "event_id"]), snaps, S.FRAUD_REFS), cols, null_as=0.0) \
        .join(requests.select("request_id", F.col("is_fraud").cast("double").alias("_label")).dropDuplicates(
            ["request_id"]), "request_id")
    model = G.fit_boosted_trees(train, cols, "_label", seed=42)
    return W.batch_fraud_scoring(requests.drop("is_fraud"), snaps, model)


# P3 saves and registers, P4 loads by URI in another session: its scores are those of the model that was trained.
# The label is a threshold on a feature, so the model is accepted wherever both classes exist.
@register("p4_registered_model", with_views("""
WITH g AS (SELECT count(DISTINCT coalesce(fraud_risk_score >= 0.05, false)) = 2 AS ok FROM user_metrics),
n AS (SELECT count(*) AS n FROM txns)
SELECT CASE WHEN ok THEN 'models:/fraud_detection/1' END AS model_uri, CASE WHEN ok THEN 'Staging' END AS stage,
       CASE WHEN ok THEN n ELSE 0 END AS scored, CAST(0 AS BIGINT) AS other_scores FROM g, n""",
    "txns", "ticket_events", "users", "user_metrics"))
def q_registered(spark, d):
    root = scratch_path(spark, "registry")
    tx = V.txns(spark, d)
    um = reuse(M.user_metrics(V.users(spark, d), tx, V.ticket_events(spark, d), sort=False))
    trained = W.weekly_training(um, trials=1, registry_path=f"{root}/table", models_root=f"{root}/models")
    if not trained["registered"]:
        return spark.sql("SELECT CAST(NULL AS STRING) AS model_uri, CAST(NULL AS STRING) AS stage, 0L AS scored, "
                         "0L AS other_scores")
    registry = spark.newSession().read.parquet(f"{root}/table")
    row = G.resolve_model(registry, "models:/fraud_detection/Production")
    uri = f"models:/fraud_detection/{row['version']}"
    requests = tx.select(F.col("transaction_id").alias("request_id"),
                         F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("user_id"))
    refs = ("user_purchase_behavior:lifetime_purchases", "user_purchase_behavior:fraud_risk_score")
    by = {"model": trained["model"], "loaded": uri}
    one, other = (W.batch_fraud_scoring(requests, {S.USER_PURCHASE: um}, m, refs, registry=registry)
                  .groupBy("request_id").agg(F.max("fraud_score").alias(k), F.count(F.lit(1)).alias(f"n_{k}"))
                  for k, m in by.items())
    return one.join(other, "request_id", "full").agg(
        F.lit(uri).alias("model_uri"), F.lit(row["stage"]).alias("stage"), F.sum("n_loaded").alias("scored"),
        F.count_if(~F.col("model").eqNullSafe(F.col("loaded"))).alias("other_scores"))


# ------------------------------------------------------------------ P5
@register("p5_batch_pricing", with_views(q_models.SQL_H3 + """,
best AS (SELECT arg_max(arm, (alpha / (alpha + beta), -arm_order)) AS a FROM u),
req AS (SELECT transaction_id AS request_id,
               CASE WHEN quantity % 10 = 0 THEN event_id + 1000000000 ELSE event_id END AS event_id,
               ticket_price AS current_price,
               CASE WHEN ticket_price > 2000 AND quantity > 25 THEN 'aggressive'
                    WHEN ticket_price > 2000 THEN 'baseline' END AS arm_hint FROM txns),
snap AS (SELECT * FROM event_metrics),
f AS (SELECT req.*, coalesce(arm_hint, best.a) AS arm0, snap.current_inventory AS inv,
             snap.sell_through_rate_5min AS vel FROM req LEFT JOIN snap USING (event_id) CROSS JOIN best),
p AS (SELECT *, greatest(current_price * (1 + CASE WHEN arm0 = 'aggressive' THEN 0.1 ELSE 0.0 END)
                         * least(greatest(vel / greatest(CAST(inv AS DOUBLE), 1.0), 0.5), 2.0), 0.0) AS rp FROM f)
SELECT request_id, event_id, round(current_price, 4) AS current_price, arm_hint,
       round(CASE WHEN rp IS NULL OR isnan(rp) OR inv IS NULL THEN current_price * 1.05 ELSE rp END, 4) AS recommended_price,
       CASE WHEN rp IS NULL OR isnan(rp) OR inv IS NULL THEN 'fallback' ELSE arm0 END AS arm,
       round(CASE WHEN rp IS NULL OR isnan(rp) OR inv IS NULL THEN current_price * 1.05 * 0.9 ELSE rp * 0.9 END, 4)
         AS lower_confidence,
       round(CASE WHEN rp IS NULL OR isnan(rp) OR inv IS NULL THEN current_price * 1.05 * 1.1 ELSE rp * 1.1 END, 4)
         AS upper_confidence
FROM p""", "txns", "ticket_events", "request_log", "event_metrics"))
def q_pricing(spark, d):
    state = H.update_arms(H.initial_arms(spark), q_models._rewards(spark, d))
    out = W.batch_pricing(q_models._h2_requests(spark, d), {S.EVENT_REALTIME: q_models._event_snapshot(spark, d)},
                          state, deterministic=True)
    return round_doubles(out)


# ------------------------------------------------------------------ P6
# Both halves: the online rows, and per user what landed.
@register("p6_streaming_features", with_views(q_streaming.SQL_ALL_TIME.rstrip().removesuffix("FROM a") + """,
       n AS landed_rows, d AS landed_days FROM a JOIN (
  SELECT user_id AS u, count(DISTINCT CAST("timestamp" AS DATE)) AS d FROM raw_events GROUP BY 1) l
  ON a.user_id = l.u""", "raw_events"))
def q_streaming_features(spark, d):
    root = scratch_path(spark, "p6")
    stream = q_streaming._raw_stream(spark, d)
    qs = W.streaming_features(stream, f"{root}/online", f"{root}/landing", f"{root}/ckpt",
                              trigger={"availableNow": True})
    for q in qs.values():
        J.run_until_done(q)
    landed = spark.read.parquet(f"{root}/landing").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("landed_rows"), F.countDistinct("dt").alias("landed_days"))
    online = J.read_online(spark, f"{root}/online").drop("event_timestamp")
    return round_doubles(online.join(landed, "user_id"))
