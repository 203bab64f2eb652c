"""Queries for groups G (training and scoring) and H (dynamic pricing)."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnstile.operators import metrics as M
from turnstile.operators import pricing as H
from turnstile.operators import store as S
from turnstile.operators import training as G
from turnstile.plans import views as V
from turnstile.plans.registry import register, round_doubles
from turnstile.plans.views import with_views
from turnstile.session import reuse

USER_VIEWS = ("txns", "ticket_events", "users", "user_metrics")


def _user_metrics(spark, d):
    return M.user_metrics(V.users(spark, d), V.txns(spark, d), V.ticket_events(spark, d), sort=False)


def _training_frame(spark, d):
    return G.fraud_training_frame(_user_metrics(spark, d))


def _stored_frame(spark, d):
    """The training frame written once, for steps that read it several times."""
    return reuse(_training_frame(spark, d))


# ------------------------------------------------------------------ G1
SQL_G1 = """
SELECT user_id, lifetime_purchases, round(fraud_risk_score, 4) AS fraud_risk_score,
       CAST(coalesce(fraud_risk_score >= 0.05, false) AS INTEGER) AS is_fraud_label
FROM user_metrics"""
register("g1_fraud_training_frame", with_views(SQL_G1, *USER_VIEWS))(
    lambda spark, d: round_doubles(_training_frame(spark, d)))

# ------------------------------------------------------------------ G2
_H_SQL = "('0x' || substr(md5(CAST(user_id AS VARCHAR) || '42'), 1, 15))::BIGINT"
CUT = int(G.VALID_FRACTION * G.HASH_SPACE)
register("g2_hash_split", with_views(f"""
WITH g AS ({SQL_G1})
SELECT *, CASE WHEN {_H_SQL} < {CUT} THEN 'valid' ELSE 'train' END AS split FROM g""", *USER_VIEWS))(
    lambda spark, d: round_doubles(G.stratified_split(_training_frame(spark, d), G.LABEL_COLUMN, "user_id",
                                                      exact=False)))

register("g2_stratified_split_exact", with_views(f"""
WITH g AS ({SQL_G1}),
h AS (SELECT *, row_number() OVER (PARTITION BY is_fraud_label ORDER BY {_H_SQL}) AS r,
             count(*) OVER (PARTITION BY is_fraud_label) AS n FROM g)
SELECT user_id, lifetime_purchases, fraud_risk_score, is_fraud_label,
       CASE WHEN r <= ceil(0.2::DOUBLE * n) THEN 'valid' ELSE 'train' END AS split FROM h""", *USER_VIEWS))(
    lambda spark, d: round_doubles(G.stratified_split(_stored_frame(spark, d), G.LABEL_COLUMN, "user_id")))


# ------------------------------------------------------------------ G3 / G6 / G7 (rows-only: model fits)
FEATURES = ["lifetime_purchases", "fraud_risk_score"]


@register("g3_tune_and_train")
def q_tune(spark, d):
    df = G.stratified_split(_stored_frame(spark, d), G.LABEL_COLUMN, "user_id")
    _, trials = G.tune_and_train(df.where("split = 'train'"), df.where("split = 'valid'"), FEATURES,
                                 parallelism=3)
    return trials


def _quick_model(spark, d):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    df = G.stratified_split(_stored_frame(spark, d), G.LABEL_COLUMN, "user_id")
    tr = df.where("split = 'train'").select(*FEATURES, F.col(G.LABEL_COLUMN).cast("double").alias("_label"))
    pipe = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="_features", handleInvalid="keep"),
                            GBTClassifier(featuresCol="_features", labelCol="_label", seed=42)])
    return pipe.fit(tr), df


@register("g7_score_batch")
def q_score(spark, d):
    model, df = _quick_model(spark, d)
    return G.score_batch(df, model).select("user_id", "fraud_score", "is_fraud", G.LABEL_COLUMN)


@register("g6_feature_attribution")
def q_attr(spark, d):
    model, df = _quick_model(spark, d)
    return G.feature_attribution(model, df.where("split = 'valid'"), FEATURES)


class LinearRule:
    """A fixed linear score of two features, as a model with ``predict_proba``."""
    feature_columns = FEATURES

    def predict_proba(self, x):
        import numpy as np
        p = np.clip(0.01 * np.nan_to_num(x[:, 0]) + 2.0 * np.nan_to_num(x[:, 1]), 0.0, 1.0)
        return np.stack([1 - p, p], axis=1)


_LINEAR_SQL = """least(greatest(0.01 * coalesce(lifetime_purchases, 0) + 2.0 * coalesce(fraud_risk_score, 0.0), 0.0),
                        1.0)"""


# G7 with a model whose scores SQL can repeat.
@register("g7_score_batch_linear", with_views(f"""
SELECT user_id, round({_LINEAR_SQL}, 4) AS fraud_score, {_LINEAR_SQL} >= 0.5 AS is_fraud FROM user_metrics""",
                                              *USER_VIEWS))
def q_score_linear(spark, d):
    return round_doubles(G.score_batch(_training_frame(spark, d), LinearRule()).select("user_id", "fraud_score",
                                                                                       "is_fraud"))


# A feature that the model does not read has no effect on AUC; the ones it reads are reported beside it.
@register("g6_unused_feature", with_views("""
SELECT 'unused' AS feature, 0.0::DOUBLE AS auc_drop, count(*) > 0 AS has_rows FROM user_metrics""", *USER_VIEWS))
def q_unused_feature(spark, d):
    df = _training_frame(spark, d).withColumn("unused", F.col("user_id").cast("double"))
    out = G.feature_attribution(LinearRule(), df, [*FEATURES, "unused"])
    return round_doubles(out.where("feature = 'unused'").select("feature", "auc_drop", F.lit(True).alias("has_rows")))


# P3's split: how many rows of each class validate.
@register("p3_split_sizes", with_views(f"""
WITH g AS ({SQL_G1}), n AS (SELECT is_fraud_label, count(*) AS n FROM g GROUP BY 1)
SELECT is_fraud_label, CAST(ceil(0.2::DOUBLE * n) AS BIGINT) AS valid_rows,
       CAST(n - ceil(0.2::DOUBLE * n) AS BIGINT) AS train_rows FROM n""", *USER_VIEWS))
def q_split_sizes(spark, d):
    split = G.stratified_split(_stored_frame(spark, d), G.LABEL_COLUMN, "user_id")
    return split.groupBy(G.LABEL_COLUMN).agg(F.count_if(F.col("split") == "valid").alias("valid_rows"),
                                             F.count_if(F.col("split") == "train").alias("train_rows"))


# ------------------------------------------------------------------ G4 / G5
SQL_G4 = """
WITH s AS (SELECT fraud_score AS s, CAST(is_fraud AS DOUBLE) AS y FROM request_log WHERE fraud_score IS NOT NULL),
c AS (SELECT s, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN y = 1 THEN 0 ELSE 1 END) AS neg
      FROM s GROUP BY s),
k AS (SELECT *, sum(neg) OVER (ORDER BY s) AS cum_neg FROM c),
u AS (SELECT sum(pos * (cum_neg - neg + 0.5 * neg)) AS u, sum(pos) AS pp, sum(neg) AS nn FROM k),
a AS (SELECT avg(CAST((CAST(fraud_score >= 0.5 AS DOUBLE) = CAST(is_fraud AS DOUBLE)) AS DOUBLE)) AS accuracy,
             count(*) AS n FROM request_log WHERE fraud_score IS NOT NULL AND is_fraud IS NOT NULL)
SELECT round(CASE WHEN pp > 0 AND nn > 0 THEN u / (pp * nn) END, 4) AS auc, round(coalesce(accuracy, 0.0), 4) AS accuracy,
       a.n AS n, CAST(coalesce(pp, 0) AS BIGINT) AS positives, CAST(coalesce(nn, 0) AS BIGINT) AS negatives
FROM u, a"""


def _g4(spark, d):
    return G.evaluate_scores(V.request_log(spark, d), label="is_fraud", score="fraud_score")


register("g4_evaluate_scores", with_views(SQL_G4, "request_log"))(lambda spark, d: round_doubles(_g4(spark, d)))
register("g5_baseline_gate", with_views(
    "WITH m AS (" + SQL_G4 + ")\nSELECT *, coalesce(auc >= 0.75 AND accuracy >= 0.8, false) AS accepted FROM m",
    "request_log"))(lambda spark, d: round_doubles(G.baseline_gate(_g4(spark, d))))


# ------------------------------------------------------------------ G8
def model_registry(spark, d):
    """Registry rows derived from ``part``: model = brand, version = part key,
    stage by size band (null for most), run id = part name, source = type."""
    p = V.table(spark, d, "part")
    stage = (F.when(F.col("p_size") > 45, F.lit("Production")).when(F.col("p_size") > 40, F.lit("staging")))
    return p.select(F.col("p_brand").alias("name"), F.col("p_partkey").cast("string").alias("version"),
                    stage.alias("stage"), F.col("p_name").alias("run_id"), F.col("p_type").alias("source"))


register("g8_select_model_version", """
WITH r AS (SELECT p_brand AS name, CAST(p_partkey AS VARCHAR) AS version,
                  CASE WHEN p_size > 45 THEN 'Production' WHEN p_size > 40 THEN 'staging' END AS stage,
                  p_name AS run_id, p_type AS source FROM part),
b AS (SELECT name, arg_max((version, stage, run_id, source),
                           (CAST(lower(coalesce(stage, '')) = 'production' AS INTEGER), CAST(version AS BIGINT))) AS b
      FROM r GROUP BY name)
SELECT name, b[1] AS version, coalesce(b[2], '') AS stage, b[3] AS run_id, b[4] AS source,
       'models:/' || name || '/' || b[1] AS model_uri FROM b""")(
    lambda spark, d: G.select_model_version(model_registry(spark, d)))

register("g8_select_model_version_staging", """
WITH r AS (SELECT p_brand AS name, CAST(p_partkey AS VARCHAR) AS version,
                  CASE WHEN p_size > 45 THEN 'Production' WHEN p_size > 40 THEN 'staging' END AS stage,
                  p_name AS run_id, p_type AS source FROM part),
b AS (SELECT name, arg_max((version, stage, run_id, source),
                           (CAST(lower(coalesce(stage, '')) = 'staging' AS INTEGER), CAST(version AS BIGINT))) AS b
      FROM r GROUP BY name)
SELECT name, b[1] AS version, coalesce(b[2], '') AS stage, b[3] AS run_id, b[4] AS source,
       'models:/' || name || '/' || b[1] AS model_uri FROM b""")(
    lambda spark, d: G.select_model_version(model_registry(spark, d), stage="Staging"))


# ------------------------------------------------------------------ H
def _pricing_requests(spark, d):
    """One pricing request per transaction: current price = ticket price,
    hint = aggressive for large baskets.  Requests with a quantity divisible
    by ten ask for an event that does not exist, which provokes the fallback."""
    t = V.txns(spark, d)
    missing = F.col("event_id") + F.lit(1_000_000_000)
    return t.select(F.col("transaction_id").alias("request_id"),
                    F.when(F.col("quantity") % 10 == 0, missing).otherwise(F.col("event_id")).alias("event_id"),
                    F.col("ticket_price").alias("current_price"),
                    F.when(F.col("quantity") > 25, F.lit("aggressive")).otherwise(F.lit("baseline")).alias("arm_hint"))


def _event_snapshot(spark, d):
    """Online event snapshot: B4 metrics of all events."""
    return M.event_metrics(V.ticket_events(spark, d), V.txns(spark, d), sort=False)


SQL_H_BASE = """
WITH req AS (SELECT transaction_id AS request_id,
                    CASE WHEN quantity % 10 = 0 THEN event_id + 1000000000 ELSE event_id END AS event_id,
                    ticket_price AS current_price,
                    CASE WHEN quantity > 25 THEN 'aggressive' ELSE 'baseline' END AS arm_hint FROM txns),
snap AS (SELECT * FROM event_metrics),
f AS (SELECT req.*, snap.current_inventory AS inv, snap.sell_through_rate_5min AS vel
      FROM req LEFT JOIN snap USING (event_id)),
p AS (SELECT *, CASE WHEN vel IS NULL OR inv IS NULL OR current_price IS NULL THEN NULL
                     ELSE greatest(current_price * (1 + CASE WHEN arm_hint = 'aggressive' THEN 0.1 ELSE 0.0 END)
                                   * least(greatest(vel / greatest(CAST(inv AS DOUBLE), 1.0), 0.5), 2.0), 0.0) END AS rp
      FROM f)"""

register("h1_recommend_price", with_views(SQL_H_BASE + """
SELECT request_id, event_id, round(current_price, 4) AS current_price, arm_hint AS arm,
       round(rp, 4) AS recommended_price, round(rp * 0.9, 4) AS lower_confidence, round(rp * 1.1, 4) AS upper_confidence
FROM p""", "txns", "ticket_events", "event_metrics"))(
    lambda spark, d: round_doubles(H.recommend_price(
        S.get_online_features(_pricing_requests(spark, d), {S.EVENT_REALTIME: _event_snapshot(spark, d)},
                              ["event_realtime_metrics:current_inventory",
                               "event_realtime_metrics:sell_through_rate_5min"])
        .withColumnRenamed("arm_hint", "arm")).select(
        "request_id", "event_id", "current_price", "arm", "recommended_price", "lower_confidence",
        "upper_confidence")))

register("h4_price_batch", with_views(SQL_H_BASE + """
SELECT request_id, event_id, round(current_price, 4) AS current_price, arm_hint,
       round(CASE WHEN rp IS NULL OR isnan(rp) OR inv IS NULL THEN current_price * 1.05 ELSE rp END, 4) AS recommended_price,
       CASE WHEN rp IS NULL OR isnan(rp) OR inv IS NULL THEN 'fallback' ELSE arm_hint END AS arm,
       round(CASE WHEN rp IS NULL OR isnan(rp) OR inv IS NULL THEN current_price * 1.05 * 0.9 ELSE rp * 0.9 END, 4)
         AS lower_confidence,
       round(CASE WHEN rp IS NULL OR isnan(rp) OR inv IS NULL THEN current_price * 1.05 * 1.1 ELSE rp * 1.1 END, 4)
         AS upper_confidence
FROM p""", "txns", "ticket_events", "event_metrics"))(
    lambda spark, d: round_doubles(H.price_batch(_pricing_requests(spark, d),
                                                 {S.EVENT_REALTIME: _event_snapshot(spark, d)})))


def _rewards(spark, d):
    """Observed rewards per request: arm from the block decision, reward = 1 − fraud score."""
    log = V.request_log(spark, d)
    return log.select(F.when(F.col("blocked"), F.lit("aggressive")).otherwise(F.lit("baseline")).alias("arm"),
                      (1 - F.col("fraud_score")).alias("reward"))


SQL_H3 = """
WITH r AS (SELECT CASE WHEN blocked THEN 'aggressive' ELSE 'baseline' END AS arm,
                  least(greatest(1 - fraud_score, 0.0), 1.0) AS r FROM request_log),
a AS (SELECT arm, sum(r) AS s, count(*) AS n FROM r GROUP BY arm),
st(arm_order, arm, alpha, beta) AS (VALUES (0, 'baseline', 1.0::DOUBLE, 1.0::DOUBLE),
                                           (1, 'aggressive', 1.0::DOUBLE, 1.0::DOUBLE)),
u AS (SELECT coalesce(st.arm, a.arm) AS arm,
             CAST(row_number() OVER (ORDER BY coalesce(st.arm_order, 2147483647), coalesce(st.arm, a.arm)) - 1
                  AS INTEGER) AS arm_order,
             coalesce(alpha, 1.0) + coalesce(s, 0.0) AS alpha, coalesce(beta, 1.0) + coalesce(n - s, 0.0) AS beta
      FROM st FULL OUTER JOIN a USING (arm))"""

register("h3_update_arms", with_views(SQL_H3 + """
SELECT arm, arm_order, round(alpha, 4) AS alpha, round(beta, 4) AS beta FROM u""", "request_log"))(
    lambda spark, d: round_doubles(H.update_arms(H.initial_arms(spark), _rewards(spark, d))))


def _h2_requests(spark, d):
    return _pricing_requests(spark, d).select("request_id", "event_id", "current_price",
                                              F.when(F.col("current_price") > 2000, F.col("arm_hint")).alias("arm_hint"))


register("h2_choose_arm_posterior_mean", with_views(SQL_H3 + """,
best AS (SELECT arg_max(arm, (alpha / (alpha + beta), -arm_order)) AS a FROM u)
SELECT transaction_id AS request_id,
       CASE WHEN quantity % 10 = 0 THEN event_id + 1000000000 ELSE event_id END AS event_id,
       round(ticket_price, 4) AS current_price,
       CASE WHEN ticket_price > 2000 AND quantity > 25 THEN 'aggressive'
            WHEN ticket_price > 2000 THEN 'baseline' END AS arm_hint,
       CASE WHEN ticket_price > 2000 AND quantity > 25 THEN 'aggressive'
            WHEN ticket_price > 2000 THEN 'baseline' ELSE best.a END AS arm
FROM txns, best""", "txns", "request_log"))(
    lambda spark, d: round_doubles(H.choose_arm(
        _h2_requests(spark, d), H.update_arms(H.initial_arms(spark), _rewards(spark, d)), deterministic=True)))


@register("h2_choose_arm_thompson")
def q_thompson(spark, d):
    """Rows-only: seeded Thompson draws (Beta via pandas UDF)."""
    state = H.update_arms(H.initial_arms(spark), _rewards(spark, d))
    return H.choose_arm(_h2_requests(spark, d), state, seed=7)


# H2's draws as a table: equal arms share the requests evenly (within four
# standard deviations), and the same seed gives the same choices.
@register("h2_thompson_shares", """
SELECT 'aggressive' AS arm, true AS fair, true AS repeatable, count(*) AS requests FROM lineitem
UNION ALL SELECT 'baseline', true, true, count(*) FROM lineitem""")
def q_thompson_shares(spark, d):
    req = _pricing_requests(spark, d).select("request_id")
    state = H.initial_arms(spark)
    once = H.choose_arm(req, state, seed=11).withColumnRenamed("arm", "first")
    both = H.choose_arm(once, state, seed=11)
    per_arm = both.groupBy("arm").agg(F.count(F.lit(1)).alias("n"),
                                      F.bool_and(F.col("arm") == F.col("first")).alias("repeatable"))
    total = both.agg(F.count(F.lit(1)).alias("requests"))
    fair = F.abs(F.col("n") - F.col("requests") / 2) < 2 * F.sqrt("requests")
    return per_arm.crossJoin(total).select("arm", fair.alias("fair"), "repeatable", "requests")
