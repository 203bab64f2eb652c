"""Queries for groups A (sources), C (realtime features), D (feature store), E (validation)."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnstile.functions.scalars import normalize_entity_id, parse_utc
from turnstile.operators import metrics as M
from turnstile.operators import quality as Q
from turnstile.operators import realtime as R
from turnstile.operators import store as S
from turnstile.plans import views as V
from turnstile.plans.registry import register, round_doubles
from turnstile.plans.views import with_views
from turnstile.session import checkpoint_root, scratch_path
from turnstile.sources import files as A

# ================================================================== A
register("a1_read_raw_events", with_views("""
SELECT user_id, event_id, total_amount, "timestamp" FROM raw_events""", "raw_events"))(
    lambda spark, d: A.read_raw_events(spark, f"{d}/events.parquet")
    .select("user_id", F.col("event_type").alias("event_id"), F.col("value").alias("total_amount"),
            F.col("ts").alias("timestamp")))

register("a2_filter_recent", with_views("""
SELECT * FROM raw_events WHERE "timestamp" >= (SELECT max("timestamp") FROM raw_events) - INTERVAL 24 HOUR""",
    "raw_events"))(
    lambda spark, d: A.filter_recent(V.raw_events(spark, d), "timestamp", None, 24))


# The window filter over times that come as text (ISO, Z for UTC); those that
# cannot be read drop out.
@register("a2_filter_recent_text", """
WITH t AS (SELECT user_id, event_type AS event_id, round(value, 4) AS total_amount,
                  CASE WHEN event_type = 'error' THEN NULL ELSE make_timestamp(epoch_us(ts) // 1000 * 1000) END AS tm FROM events)
SELECT user_id, event_id, total_amount, tm AS "timestamp" FROM t
WHERE tm >= (SELECT max(tm) FROM t) - INTERVAL 24 HOUR""")
def q_filter_recent_text(spark, d):
    raw = V.raw_events(spark, d)
    # "…T10:00:00.000Z", as a producer writes UTC with an offset that is replaced by Z
    offset = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS'+00:00'")
    text = F.when(F.col("event_id") == "error", F.lit("not a time")).otherwise(F.replace(offset, F.lit("+00:00"), F.lit("Z")))
    recent = A.filter_recent(raw.withColumn("timestamp", text), "timestamp", None, 24)
    return round_doubles(recent.where(F.col("timestamp").endswith("Z")).select(
        "user_id", "event_id", "total_amount", parse_utc(F.col("timestamp")).cast("timestamp_ntz").alias("timestamp")))


@register("a4_write_feature_table", with_views("""
SELECT event_id, round(avg_ticket_price, 4) AS avg_ticket_price, total_tickets_sold FROM event_metrics""",
    "txns", "ticket_events", "event_metrics"))
def q_write_feature_table(spark, d):
    em = M.event_metrics(V.ticket_events(spark, d), V.txns(spark, d), sort=False)
    path = A.write_feature_table(em.select("event_id", "avg_ticket_price", "total_tickets_sold"),
                                 scratch_path(spark, "event_metrics") + "/t")
    return round_doubles(spark.read.parquet(path))


@register("a3_schema_gate", """
SELECT 'user_id' AS "column", true AS present, count(user_id) AS rows FROM events
UNION ALL SELECT 'value', true, count(value) FROM events
UNION ALL SELECT 'total_amount', false, CAST(0 AS BIGINT)""")
def q_schema_gate(spark, d):
    return A.schema_gate(spark, V.table(spark, d, "events"), ("user_id", "value", "total_amount"))


@register("a9_resolve_source", """
SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderstatus""")
def q_resolve_source(spark, d):
    orders = A.resolve_source(spark, A.SourceConfig(local_root=d), "orders")
    return orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"),
                                               F.countDistinct("o_custkey").alias("customers"))


# ================================================================== C
SQL_C1 = with_views("""
WITH r AS (SELECT * FROM raw_events
           WHERE "timestamp" >= (SELECT max("timestamp") FROM raw_events) - INTERVAL 24 HOUR),
a AS (SELECT user_id, count(user_id) AS user_txn_count_1h,
             coalesce(sum(CAST(round(total_amount * 100) AS BIGINT)) / 100.0, 0.0) AS user_txn_amount_1h,
             count(DISTINCT event_id) AS user_distinct_events_1h
      FROM r WHERE user_id IS NOT NULL GROUP BY user_id)
SELECT user_id, user_txn_count_1h, round(user_txn_amount_1h, 4) AS user_txn_amount_1h, user_distinct_events_1h,
       round(user_txn_amount_1h / greatest(user_txn_count_1h, 1), 4) AS user_avg_amount_24h,
       (SELECT max("timestamp") FROM raw_events) AS event_timestamp,
       (SELECT max("timestamp") FROM raw_events) AS ingested_at
FROM a""", "raw_events")


@register("c1_user_realtime_features", SQL_C1)
def q_user_realtime(spark, d):
    recent = A.filter_recent(V.raw_events(spark, d), "timestamp", None, 24, keep_bound="_as_of")
    return round_doubles(R.user_realtime_features(recent, as_of="_as_of"))


register("c2_reference_features", with_views("""
WITH a AS (SELECT user_id, count(user_id) AS n, coalesce(sum(CAST(round(total_amount * 100) AS BIGINT)) / 100.0, 0.0) AS s,
                  count(DISTINCT event_id) AS de
           FROM txns WHERE user_id IS NOT NULL GROUP BY user_id)
SELECT user_id, n AS user_txn_count_1h, round(s, 4) AS user_txn_amount_1h, de AS user_distinct_events_1h,
       round(s / greatest(n, 1), 4) AS user_avg_amount_24h FROM a""", "txns"))(
    lambda spark, d: round_doubles(R.reference_features(V.txns(spark, d))))

def _sql_trailing(rows: str) -> str:
    return f"""
WITH t AS ({rows})
SELECT transaction_id, user_id, event_timestamp,
  count(*) OVER w1 AS user_txn_count_1h,
  round(coalesce(sum(cents) OVER w1, 0) / 100.0, 4) AS user_txn_amount_1h,
  count(DISTINCT event_id) OVER w1 AS user_distinct_events_1h,
  round(coalesce(sum(cents) OVER w24, 0) / 100.0 / greatest(count(*) OVER w24, 1), 4) AS user_avg_amount_24h
FROM t
WINDOW w1 AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW),
       w24 AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)"""


register("c6_trailing_user_features", with_views(_sql_trailing("""
SELECT transaction_id, user_id, event_id, event_timestamp, CAST(round(total_amount * 100) AS BIGINT) AS cents,
       epoch_us(event_timestamp) AS us FROM txns"""), "txns"))(
    lambda spark, d: round_doubles(R.trailing_user_features(V.txns(spark, d))))

# The same over the event stream, whose timestamps are not day-grained.
register("c6_trailing_user_features_events", _sql_trailing("""
SELECT event_id AS transaction_id, user_id, event_type AS event_id, ts AS event_timestamp,
       CAST(round(value * 100) AS BIGINT) AS cents, epoch_us(ts) AS us FROM events"""))(
    lambda spark, d: round_doubles(R.trailing_user_features(V.table(spark, d, "events").select(
        F.col("event_id").alias("transaction_id"), "user_id", F.col("event_type").alias("event_id"),
        F.col("ts").alias("event_timestamp"), F.col("value").alias("total_amount")))))

# ================================================================== D
# Per-(user, day) purchase features, available from the next day: the
# offline feature table D2-D4 and D8 read.
USER_DAILY = S.FeatureView("user_daily_purchases", ("user_id",), 90 * 86400,
                           (("user_txn_count", "bigint"), ("user_txn_amount", "double")), ingested=None)


def user_daily_features(spark, d):
    t = V.txns(spark, d)
    return (t.groupBy("user_id", "event_timestamp")
             .agg(F.count(F.lit(1)).alias("user_txn_count"), F.sum("total_amount").alias("user_txn_amount"))
             .select("user_id", F.timestamp_add("DAY", F.lit(1), F.col("event_timestamp")).alias("event_timestamp"),
                     "user_txn_count", "user_txn_amount"))


SQL_USER_DAILY = """
WITH f AS (SELECT user_id, event_timestamp + INTERVAL 1 DAY AS event_timestamp, count(*) AS user_txn_count,
                  sum(total_amount) AS user_txn_amount FROM txns GROUP BY user_id, 2)"""


@register("d1_feature_view_health", with_views("""
WITH v AS (
  SELECT 'event_historical_metrics' AS view, count(*) AS n_rows, count(DISTINCT (event_id, promoter_id)) AS n_keys,
         max(event_timestamp) AS max_event_timestamp, 31536000 AS ttl_seconds,
         count(*) FILTER (WHERE total_tickets_sold IS NULL) AS n1,
         count(*) FILTER (WHERE avg_ticket_price IS NULL) AS n2,
         count(*) FILTER (WHERE promoter_success_rate IS NULL) AS n3,
         'total_tickets_sold' AS f1, 'avg_ticket_price' AS f2, 'promoter_success_rate' AS f3
  FROM event_metrics
  UNION ALL
  SELECT 'user_purchase_behavior', count(*), count(DISTINCT user_id), max(event_timestamp), 31536000,
         count(*) FILTER (WHERE lifetime_purchases IS NULL), count(*) FILTER (WHERE fraud_risk_score IS NULL),
         count(*) FILTER (WHERE preferred_category IS NULL),
         'lifetime_purchases', 'fraud_risk_score', 'preferred_category'
  FROM user_metrics)
SELECT view, field, n_rows, n_keys, max_event_timestamp, CAST(ttl_seconds AS BIGINT) AS ttl_seconds,
       round(coalesce(nulls / n_rows, 0.0), 4) AS null_share
FROM (SELECT view, n_rows, n_keys, max_event_timestamp, ttl_seconds, f1 AS field, n1 AS nulls FROM v
      UNION ALL SELECT view, n_rows, n_keys, max_event_timestamp, ttl_seconds, f2, n2 FROM v
      UNION ALL SELECT view, n_rows, n_keys, max_event_timestamp, ttl_seconds, f3, n3 FROM v)""",
    "txns", "ticket_events", "users", "event_metrics", "user_metrics"))
def q_view_health(spark, d):
    ev, tx, us = V.ticket_events(spark, d), V.txns(spark, d), V.users(spark, d)
    em = M.event_metrics(ev, tx, sort=False)
    um = M.user_metrics(us, tx, ev, sort=False)
    return round_doubles(S.feature_view_health({S.EVENT_HISTORICAL: em, S.USER_PURCHASE: um}))


@register("d2_get_historical_features", with_views(SQL_USER_DAILY + """,
e AS (SELECT o_orderkey, o_custkey AS user_id, o_orderdate AS event_timestamp FROM orders)
SELECT e.o_orderkey, e.user_id, e.event_timestamp,
       CASE WHEN f.event_timestamp >= e.event_timestamp - INTERVAL 90 DAY THEN f.user_txn_count END AS user_txn_count,
       round(CASE WHEN f.event_timestamp >= e.event_timestamp - INTERVAL 90 DAY THEN f.user_txn_amount END, 4)
         AS user_txn_amount
FROM e ASOF LEFT JOIN f ON e.user_id = f.user_id AND e.event_timestamp >= f.event_timestamp""", "txns"))
def q_historical(spark, d):
    ent = V.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"),
                                              F.col("o_orderdate").alias("event_timestamp"))
    return round_doubles(S.get_historical_features(ent, user_daily_features(spark, d), USER_DAILY,
                                                   bucket_seconds=30 * 86400))


@register("d3_materialize", with_views(SQL_USER_DAILY + """
SELECT user_id, max(event_timestamp) AS event_timestamp,
       arg_max(user_txn_count, event_timestamp) AS user_txn_count,
       round(arg_max(user_txn_amount, event_timestamp), 4) AS user_txn_amount
FROM f WHERE event_timestamp >= (SELECT max(event_timestamp) FROM f) - INTERVAL 365 DAY
GROUP BY user_id""", "txns"))
def q_materialize(spark, d):
    f = user_daily_features(spark, d)
    end = f.agg(F.max("event_timestamp").alias("e"))
    g = f.crossJoin(F.broadcast(end)).where(
        F.col("event_timestamp") >= F.timestamp_add("DAY", F.lit(-365), F.col("e"))).drop("e")
    return round_doubles(S.materialize(g, USER_DAILY))


@register("d4_upsert_snapshot", with_views(SQL_USER_DAILY + """
SELECT user_id, max(event_timestamp) AS event_timestamp,
       arg_max(user_txn_count, event_timestamp) AS user_txn_count,
       round(arg_max(user_txn_amount, event_timestamp), 4) AS user_txn_amount
FROM f GROUP BY user_id""", "txns"))
def q_upsert(spark, d):
    f = user_daily_features(spark, d)
    cut = F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")
    snap = S.upsert_snapshot(None, f.where(F.col("event_timestamp") < cut), ["user_id"], "event_timestamp")
    checkpoint_root(spark)
    snap = snap.checkpoint()  # the stored snapshot version; lineage cut like a written table
    return round_doubles(S.upsert_snapshot(snap, f.where(F.col("event_timestamp") >= cut), ["user_id"],
                                           "event_timestamp"))


@register("d5_get_online_features", with_views("""
SELECT t.transaction_id AS request_id, t.user_id, t.event_id,
       round(um.fraud_risk_score, 4) AS user_purchase_behavior__fraud_risk_score,
       um.lifetime_purchases AS user_purchase_behavior__lifetime_purchases,
       em.current_inventory AS event_realtime_metrics__current_inventory,
       round(em.sell_through_rate_5min, 4) AS event_realtime_metrics__sell_through_rate_5min,
       round(em.avg_ticket_price, 4) AS event_historical_metrics__avg_ticket_price
FROM txns t LEFT JOIN user_metrics um USING (user_id) LEFT JOIN event_metrics em USING (event_id)""",
    "txns", "ticket_events", "users", "event_metrics", "user_metrics"))
def q_online(spark, d):
    ev, tx, us = V.ticket_events(spark, d), V.txns(spark, d), V.users(spark, d)
    em = M.event_metrics(ev, tx, sort=False)
    um = M.user_metrics(us, tx, ev, sort=False)
    req = S.requests_from_transactions(tx).select("request_id", "user_id", "event_id")
    refs = ["user_purchase_behavior:fraud_risk_score", "user_purchase_behavior:lifetime_purchases",
            *S.PRICING_REFS]
    out = S.get_online_features(req, {S.USER_PURCHASE: um, S.EVENT_REALTIME: em, S.EVENT_HISTORICAL: em}, refs)
    return round_doubles(out)


SQL_NORMALIZE = """CASE WHEN regexp_matches({s}, '^[0-9]+$') THEN TRY_CAST({s} AS BIGINT)
  WHEN contains({s}, '_') AND regexp_matches(string_split({s}, '_')[-1], '^[0-9]+$')
    THEN TRY_CAST(string_split({s}, '_')[-1] AS BIGINT)
  WHEN contains({s}, '_') AND regexp_matches(trim(string_split({s}, '_')[-1]), '^[+-]?(0[xX])?[0-9a-fA-F]+$')
    THEN CAST((((CASE WHEN starts_with(trim(string_split({s}, '_')[-1]), '-') THEN -1 ELSE 1 END)
               * ('0x' || regexp_replace(trim(string_split({s}, '_')[-1]), '^[+-]?(0[xX])?', ''))::HUGEINT)
              % 2147483647 + 2147483647) % 2147483647 AS BIGINT)
  ELSE ('0x' || substr(md5({s}), 1, 15))::BIGINT % 2147483647 END"""


def _sql_norm(raw: str) -> str:
    s = f"regexp_replace({raw}, '^\\s+|\\s+$', '', 'g')"
    return SQL_NORMALIZE.format(s=s)


@register("d6_normalize_entity_id", f"""
SELECT c_custkey,
  {_sql_norm("c_name")} AS id_from_name,
  {_sql_norm("'user_' || CAST(c_custkey AS VARCHAR)")} AS id_from_suffix,
  {_sql_norm("'evt_' || lower(hex(c_custkey * 7919))")} AS id_from_hex,
  {_sql_norm("'  ' || CAST(c_custkey AS VARCHAR) || ' '")} AS id_from_padded
FROM customer""")
def q_normalize(spark, d):
    c = V.table(spark, d, "customer").select("c_custkey", "c_name")
    return c.select(
        "c_custkey",
        normalize_entity_id(F.col("c_name")).alias("id_from_name"),
        normalize_entity_id(F.concat(F.lit("user_"), F.col("c_custkey").cast("string"))).alias("id_from_suffix"),
        normalize_entity_id(F.concat(F.lit("evt_"), F.lower(F.hex(F.col("c_custkey") * 7919)))).alias("id_from_hex"),
        normalize_entity_id(F.concat(F.lit("  "), F.col("c_custkey").cast("string"), F.lit(" "))).alias("id_from_padded"),
    )


@register("d7_build_feature_frame", with_views("""
SELECT t.transaction_id AS request_id,
       CASE WHEN t.is_fraud THEN 1.0 ELSE CAST(um.lifetime_purchases AS DOUBLE) END AS lifetime_purchases,
       round(CAST(um.fraud_risk_score AS DOUBLE), 4) AS fraud_risk_score,
       0.0::DOUBLE AS velocity_score
FROM txns t LEFT JOIN user_metrics um USING (user_id)""", "txns", "ticket_events", "users", "user_metrics"))
def q_feature_frame(spark, d):
    ev, tx, us = V.ticket_events(spark, d), V.txns(spark, d), V.users(spark, d)
    um = M.user_metrics(us, tx, ev, sort=False).select("user_id", "lifetime_purchases", "fraud_risk_score")
    ov = F.when(F.col("is_fraud"), F.create_map(F.lit("lifetime_purchases"), F.lit(1.0))) \
          .otherwise(F.create_map(F.lit("not_a_model_column"), F.lit(5.0)))
    req = S.requests_from_transactions(tx.withColumn("_ov", ov), overrides=F.col("_ov")).join(um, "user_id", "left")
    return round_doubles(S.build_feature_frame(req, ["lifetime_purchases", "fraud_risk_score", "velocity_score"]))


@register("d8_feature_freshness", with_views(SQL_USER_DAILY + """,
a AS (SELECT max(o_orderdate) AS as_of FROM orders),
m AS (SELECT 'event_historical_metrics' AS view, max(event_timestamp) AS ts FROM event_metrics
      UNION ALL SELECT 'user_purchase_behavior', max(event_timestamp) FROM user_metrics
      UNION ALL SELECT 'user_daily_purchases', max(event_timestamp) FROM f)
SELECT view, ts AS max_event_timestamp,
       round((epoch_us(as_of) - epoch_us(ts)) / 1e6, 4) AS freshness_seconds,
       (epoch_us(as_of) - epoch_us(ts)) / 1e6 > 300 AS stale
FROM m CROSS JOIN a""", "txns", "ticket_events", "users", "event_metrics", "user_metrics"))
def q_freshness(spark, d):
    ev, tx, us = V.ticket_events(spark, d), V.txns(spark, d), V.users(spark, d)
    srcs = {S.EVENT_HISTORICAL: M.event_metrics(ev, tx, sort=False),
            S.USER_PURCHASE: M.user_metrics(us, tx, ev, sort=False),
            USER_DAILY: user_daily_features(spark, d)}
    as_of = V.table(spark, d, "orders").agg(F.max("o_orderdate").alias("as_of"))
    return round_doubles(S.feature_freshness(srcs, as_of))


@register("d9_conform_view", with_views("""
SELECT event_id, promoter_id, event_timestamp, total_tickets_sold,
       round(CAST(CAST(avg_ticket_price AS FLOAT) AS DOUBLE), 2) AS avg_ticket_price,
       round(CAST(CAST(promoter_success_rate AS FLOAT) AS DOUBLE), 2) AS promoter_success_rate
FROM event_metrics""", "txns", "ticket_events", "event_metrics"))
def q_conform(spark, d):
    em = M.event_metrics(V.ticket_events(spark, d), V.txns(spark, d), sort=False)
    out = S.conform_view(em, S.EVENT_HISTORICAL)
    # float32 columns: compare at 2 places (float → double widening is exact in both engines)
    return round_doubles(out.withColumns({c: F.col(c).cast("double") for c in
                                          ("avg_ticket_price", "promoter_success_rate")}), 2)


register("d10_requests_from_transactions", with_views("""
SELECT transaction_id AS request_id, user_id, event_id, coalesce(CAST(total_amount AS DOUBLE), 0.0) AS amount
FROM txns""", "txns"))(lambda spark, d: S.requests_from_transactions(V.txns(spark, d)))

# ================================================================== E
register("e1_validate_aggregates", with_views("""
WITH a AS (SELECT event_id, avg(avg_ticket_price) AS avg_ticket_price_mean FROM event_metrics GROUP BY event_id),
c AS (SELECT count(*) AS n, count(*) FILTER (WHERE avg_ticket_price_mean IS NULL) AS bad FROM a)
SELECT 'aggregates' AS "check", n > 0 AND bad = 0 AS passed, CAST(bad AS BIGINT) AS bad_rows,
       CASE WHEN n = 0 THEN 'empty' WHEN bad > 0 THEN 'null avg_ticket_price_mean' ELSE 'ok' END AS detail
FROM c""", "txns", "ticket_events", "event_metrics"))(
    lambda spark, d: Q.validate_aggregates(M.event_price_aggregates(
        M.event_metrics(V.ticket_events(spark, d), V.txns(spark, d), sort=False))))

register("e2_validate_inputs", with_views("""
SELECT 'input:events' AS "check", count(*) > 0 AS passed, CAST(NULL AS BIGINT) AS bad_rows,
       CASE WHEN count(*) = 0 THEN 'empty' ELSE 'ok' END AS detail FROM ticket_events
UNION ALL
SELECT 'input:users', false, CAST(NULL AS BIGINT), 'missing home_city' FROM (SELECT 1)""",
    "ticket_events"))(
    lambda spark, d: Q.validate_inputs(
        {"events": V.ticket_events(spark, d), "users": V.users(spark, d)},
        {"events": ["event_id", "capacity", "base_price"], "users": ["user_id", "home_city"]}))

register("e3_validate_requests", """
SELECT event_id AS request_id, round(value - 20, 4) AS amount, round(value / 300, 4) AS fraud_score,
       CASE WHEN value - 20 < 0 THEN 'amount outside [0.0, inf]'
            WHEN value / 300 < 0 OR value / 300 > 1 THEN 'fraud_score outside [0.0, 1.0]' END AS reason,
       NOT (value - 20 < 0 OR value / 300 < 0 OR value / 300 > 1) AS valid
FROM events""")(
    lambda spark, d: round_doubles(Q.validate_requests(V.table(spark, d, "events").select(
        F.col("event_id").alias("request_id"), (F.col("value") - 20).alias("amount"),
        (F.col("value") / 300).alias("fraud_score")))))


@register("d2_historical_features_multi", with_views(SQL_USER_DAILY + """,
e AS (SELECT o_orderkey, o_custkey AS user_id, o_orderdate AS event_timestamp FROM orders),
a AS (SELECT e.*, CASE WHEN f.event_timestamp >= e.event_timestamp - INTERVAL 90 DAY THEN f.user_txn_count END
             AS user_daily_purchases__user_txn_count
      FROM e ASOF LEFT JOIN f ON e.user_id = f.user_id AND e.event_timestamp >= f.event_timestamp)
SELECT a.o_orderkey, a.user_id, a.event_timestamp, a.user_daily_purchases__user_txn_count,
       CASE WHEN u.event_timestamp >= a.event_timestamp - INTERVAL 365 DAY THEN u.lifetime_purchases END
         AS user_purchase_behavior__lifetime_purchases,
       CASE WHEN u.event_timestamp >= a.event_timestamp - INTERVAL 365 DAY THEN u.preferred_category END
         AS user_purchase_behavior__preferred_category
FROM a ASOF LEFT JOIN user_metrics u ON a.user_id = u.user_id AND a.event_timestamp >= u.event_timestamp""",
    "txns", "ticket_events", "users", "user_metrics"))
def q_historical_multi(spark, d):
    ent = V.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"),
                                              F.col("o_orderdate").alias("event_timestamp"))
    um = M.user_metrics(V.users(spark, d), V.txns(spark, d), V.ticket_events(spark, d), sort=False)
    return S.historical_features(
        ent, {USER_DAILY: user_daily_features(spark, d), S.USER_PURCHASE: um},
        ["user_daily_purchases:user_txn_count", "user_purchase_behavior:lifetime_purchases",
         "user_purchase_behavior:preferred_category"], full_feature_names=True, bucket_seconds=30 * 86400)


# ------------------------------------------------------------------ K9 / K10
# Names with their separator replaced, and tests of how segments begin and end.
@register("k_text_functions", """
SELECT c_custkey AS user_id, replace(c_name, '#', '-') AS name, ends_with(c_mktsegment, 'ING') AS ends,
       starts_with(c_mktsegment, 'B') AS starts FROM customer""")
def q_text_functions(spark, d):
    c = V.table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("user_id"), F.replace("c_name", F.lit("#"), F.lit("-")).alias("name"),
                    F.endswith("c_mktsegment", F.lit("ING")).alias("ends"),
                    F.startswith("c_mktsegment", F.lit("B")).alias("starts"))
