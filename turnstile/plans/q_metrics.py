"""Queries for group B (ticketing batch metrics)."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnstile.operators import metrics as M
from turnstile.plans import views as V
from turnstile.plans.registry import register, round_doubles
from turnstile.plans.views import with_views

# ------------------------------------------------------------------ B1
register("b1_event_sales", with_views("""
SELECT event_id, CAST(sum(quantity) AS BIGINT) AS total_tickets_sold,
       round(avg(ticket_price), 4) AS avg_ticket_price, max(quantity) AS concurrent_viewers
FROM txns GROUP BY event_id""", "txns"))(
    lambda spark, d: round_doubles(M.event_sales(V.txns(spark, d))))

# ------------------------------------------------------------------ B2
register("b2_event_inventory", with_views("""
WITH sales AS (SELECT event_id, sum(quantity) AS s, avg(ticket_price) AS a, max(quantity) AS m
               FROM txns GROUP BY event_id)
SELECT e.event_id, CAST(coalesce(s.s, 0) AS BIGINT) AS total_tickets_sold,
       round(coalesce(s.a, e.base_price), 4) AS avg_ticket_price,
       CAST(coalesce(s.m, 0) AS BIGINT) AS concurrent_viewers,
       round(least(greatest(coalesce(s.s, 0) / e.capacity, 0.0), 1.0), 4) AS sell_through_rate_5min,
       CAST(greatest(e.capacity - coalesce(s.s, 0), 0) AS BIGINT) AS current_inventory
FROM ticket_events e LEFT JOIN sales s USING (event_id)""", "txns", "ticket_events"))(
    lambda spark, d: round_doubles(
        M.event_inventory(V.ticket_events(spark, d), M.event_sales(V.txns(spark, d))).select(
            "event_id", "total_tickets_sold", "avg_ticket_price", "concurrent_viewers",
            "sell_through_rate_5min", "current_inventory")))

# ------------------------------------------------------------------ B3
register("b3_promoter_success", with_views("""
WITH prom AS (SELECT promoter_id, avg(capacity) AS ps FROM ticket_events
              WHERE promoter_id IS NOT NULL GROUP BY promoter_id),
     mx AS (SELECT coalesce(nullif(max(ps), 0), 1) AS m FROM prom)
SELECT e.event_id, e.promoter_id, round(coalesce(p.ps / mx.m, 0.0), 4) AS promoter_success_rate
FROM ticket_events e LEFT JOIN prom p USING (promoter_id) CROSS JOIN mx""", "ticket_events"))(
    lambda spark, d: round_doubles(
        M.promoter_success(V.ticket_events(spark, d), sold_col="capacity")
        .select("event_id", "promoter_id", "promoter_success_rate")))

# ------------------------------------------------------------------ B4 (flagship)
SQL_B4 = with_views("""
WITH sales AS (SELECT event_id, sum(quantity) AS s, avg(ticket_price) AS a, max(quantity) AS m
               FROM txns GROUP BY event_id),
inv AS (SELECT e.event_id, e.promoter_id, e.start_time, e.capacity, coalesce(s.s, 0) AS sold,
               coalesce(s.a, e.base_price) AS avg_ticket_price, coalesce(s.m, 0) AS viewers
        FROM ticket_events e LEFT JOIN sales s USING (event_id)),
prom AS (SELECT promoter_id, avg(sold) AS ps FROM inv WHERE promoter_id IS NOT NULL GROUP BY promoter_id),
mx AS (SELECT coalesce(nullif(max(ps), 0), 1) AS m FROM prom)
SELECT event_id, promoter_id, start_time AS event_timestamp,
       CAST(greatest(capacity - sold, 0) AS BIGINT) AS current_inventory,
       round(least(greatest(sold / capacity, 0.0), 1.0), 4) AS sell_through_rate_5min,
       CAST(viewers AS BIGINT) AS concurrent_viewers, CAST(sold AS BIGINT) AS total_tickets_sold,
       round(avg_ticket_price, 4) AS avg_ticket_price,
       round(coalesce(ps / mx.m, 0.0), 4) AS promoter_success_rate
FROM inv LEFT JOIN prom USING (promoter_id) CROSS JOIN mx ORDER BY event_id""", "txns", "ticket_events")


@register("b4_event_metrics", SQL_B4)
def q_event_metrics(spark, d):
    return round_doubles(M.event_metrics(V.ticket_events(spark, d), V.txns(spark, d)))


# ------------------------------------------------------------------ B5 + B6
register("b5_user_metrics", with_views("""
WITH agg AS (SELECT user_id, sum(quantity) AS p, avg(CAST(is_fraud AS DOUBLE)) AS r FROM txns GROUP BY user_id),
cnt AS (SELECT t.user_id, e.category, count(*) AS n FROM txns t JOIN ticket_events e USING (event_id)
        GROUP BY t.user_id, e.category),
pref AS (SELECT user_id, arg_max(category, (n, category)) AS preferred_category FROM cnt GROUP BY user_id)
SELECT u.user_id, u.signup_date AS event_timestamp, CAST(coalesce(a.p, 0) AS BIGINT) AS lifetime_purchases,
       round(least(greatest(coalesce(a.r, 0.0), 0.0), 1.0), 4) AS fraud_risk_score, pref.preferred_category
FROM users u LEFT JOIN agg a USING (user_id) LEFT JOIN pref USING (user_id)
ORDER BY u.user_id""", "txns", "ticket_events", "users"))(
    lambda spark, d: round_doubles(M.user_metrics(V.users(spark, d), V.txns(spark, d), V.ticket_events(spark, d))))

register("b6_preferred_category", with_views("""
WITH cnt AS (SELECT t.user_id, e.category, count(*) AS n FROM txns t JOIN ticket_events e USING (event_id)
             GROUP BY t.user_id, e.category)
SELECT user_id, arg_max(category, (n, category)) AS preferred_category FROM cnt GROUP BY user_id""",
    "txns", "ticket_events"))(
    lambda spark, d: M.preferred_category(V.txns(spark, d), V.ticket_events(spark, d)))

# ------------------------------------------------------------------ B7
register("b7_event_price_aggregates", with_views("""
WITH sales AS (SELECT event_id, avg(ticket_price) AS a FROM txns GROUP BY event_id),
em AS (SELECT e.event_id, coalesce(s.a, e.base_price) AS avg_ticket_price
       FROM ticket_events e LEFT JOIN sales s USING (event_id))
SELECT event_id, round(avg(avg_ticket_price), 4) AS avg_ticket_price_mean FROM em GROUP BY event_id""",
    "txns", "ticket_events"))(
    lambda spark, d: round_doubles(M.event_price_aggregates(
        M.event_metrics(V.ticket_events(spark, d), V.txns(spark, d), sort=False))))

# ------------------------------------------------------------------ B8 + B9
register("b8_enrich_transactions", with_views("""
SELECT t.transaction_id, t.user_id, t.event_id, round(t.ticket_price, 4) AS ticket_price,
       e.base_price, u.loyalty_tier
FROM txns t LEFT JOIN ticket_events e USING (event_id) LEFT JOIN users u USING (user_id)""",
    "txns", "ticket_events", "users"))(
    lambda spark, d: round_doubles(M.enrich_transactions(
        V.txns(spark, d), V.ticket_events(spark, d), V.users(spark, d)).select(
        "transaction_id", "user_id", "event_id", "ticket_price", "base_price", "loyalty_tier")))

register("b9_rule_fraud_probability", with_views("""
SELECT t.transaction_id, t.user_id, t.event_id,
       least(greatest(0.03 + CASE WHEN t.ticket_price > 300 THEN 0.05 ELSE 0.0 END
                      + CASE WHEN u.loyalty_tier = 'platinum' THEN -0.02 ELSE 0.0 END, 0.001), 0.3)::DOUBLE
         AS fraud_probability
FROM txns t LEFT JOIN users u USING (user_id)""", "txns", "users"))(
    lambda spark, d: round_doubles(M.rule_fraud_probability(
        V.txns(spark, d).join(V.users(spark, d).select("user_id", "loyalty_tier"), "user_id", "left"))
        .select("transaction_id", "user_id", "event_id", "fraud_probability")))

# ------------------------------------------------------------------ B10
register("b10_transaction_amounts", with_views("""
SELECT CAST(user_id AS VARCHAR) AS user_id, event_id, round(quantity * ticket_price, 2) AS total_amount,
       strftime(event_timestamp, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS "timestamp",
       CAST(quantity AS BIGINT) AS num_tickets, round(ticket_price, 2) AS price_per_ticket
FROM txns""", "txns"))(
    lambda spark, d: M.transaction_amounts(V.txns(spark, d)))

# ------------------------------------------------------------------ B11 / B12
register("b11_pricing_tiers", with_views("""
WITH b AS (SELECT event_id, capacity,
             CASE WHEN popularity > 0.9 THEN 200.0 WHEN popularity > 0.7 THEN 100.0 ELSE 50.0 END::DOUBLE AS lo,
             CASE WHEN popularity > 0.9 THEN 2000.0 WHEN popularity > 0.7 THEN 800.0 ELSE 300.0 END::DOUBLE AS hi
           FROM ticket_events)
SELECT event_id, 'VIP' AS tier, hi AS price, CAST(trunc(capacity * 0.10) AS INTEGER) AS tier_capacity FROM b
UNION ALL SELECT event_id, 'Premium', (lo + hi) / 2, CAST(trunc(capacity * 0.30) AS INTEGER) FROM b
UNION ALL SELECT event_id, 'Standard', lo, CAST(trunc(capacity * 0.60) AS INTEGER) FROM b""", "ticket_events"))(
    lambda spark, d: M.pricing_tiers(V.ticket_events(spark, d)).drop("benefits"))

register("b12_sellout_hours", with_views("""
SELECT event_id, popularity > 0.9 AS is_mega_event,
       round(capacity / CASE WHEN popularity > 0.9 THEN 100000.0 WHEN popularity > 0.7 THEN 10000.0
                             ELSE 100.0 END, 4)::DOUBLE AS expected_sellout_hours
FROM ticket_events""", "ticket_events"))(
    lambda spark, d: round_doubles(M.sellout_hours(V.ticket_events(spark, d))))


# ------------------------------------------------------------------ B13
def risk_input(spark, d):
    """Transactions with the columns B13 reads, derived from the driver tables:
    ip_country = the supplier's nation, velocity = the user's n lines that day
    on the score's scale of 0 to 10 as 10 n / (n + 10), device_mismatch = returned line, fraud_probability = B9."""
    li = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag",
                                              "l_extendedprice", "l_quantity")
    o = V.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    s = V.table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    n = V.table(spark, d, "nation").select("n_nationkey", "n_name")
    u = V.users(spark, d).select("user_id", "country", "loyalty_tier")
    t = (li.join(o, li.l_orderkey == o.o_orderkey)
           .join(s, li.l_suppkey == s.s_suppkey, "left")
           .join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left")
           .select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("transaction_id"),
                   F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("event_timestamp"),
                   F.col("n_name").alias("ip_country"), (F.col("l_returnflag") == "R").alias("device_mismatch"),
                   F.try_divide("l_extendedprice", "l_quantity").alias("ticket_price")))
    vel = t.groupBy("user_id", "event_timestamp").agg(
        (F.count(F.lit(1)) * 10.0 / (F.count(F.lit(1)) + 10.0)).alias("velocity_score"))
    t = t.join(vel, ["user_id", "event_timestamp"]).join(u, "user_id", "left")
    return M.rule_fraud_probability(t)


SQL_RISK_INPUT = """
WITH t AS (SELECT l_orderkey * 10 + l_linenumber AS transaction_id, o_custkey AS user_id,
                  o_orderdate AS event_timestamp, n_name AS ip_country, l_returnflag = 'R' AS device_mismatch,
                  l_extendedprice / l_quantity AS ticket_price
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey
           LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey),
vel AS (SELECT user_id, event_timestamp, count(*) * 10.0::DOUBLE / (count(*) + 10.0::DOUBLE) AS velocity_score
        FROM t GROUP BY user_id, event_timestamp),
r AS (SELECT t.*, vel.velocity_score, u.country, u.loyalty_tier,
             least(greatest(0.03 + CASE WHEN t.ticket_price > 300 THEN 0.05 ELSE 0.0 END
                   + CASE WHEN u.loyalty_tier = 'platinum' THEN -0.02 ELSE 0.0 END, 0.001), 0.3) AS fraud_probability
      FROM t JOIN vel USING (user_id, event_timestamp) LEFT JOIN users u USING (user_id))
"""

register("b13_risk_indicators", with_views(SQL_RISK_INPUT + """
, f AS (SELECT transaction_id, velocity_score, coalesce(device_mismatch, false) AS dm,
              coalesce(ip_country <> 'SA' AND ip_country <> coalesce(country, 'SA'), false) AS geo,
              coalesce((hour(event_timestamp) < 4 OR hour(event_timestamp) > 23) AND fraud_probability > 0.5, false) AS ta
       FROM r)
SELECT transaction_id, round(velocity_score, 2) AS velocity_score, dm AS device_mismatch, geo AS geo_mismatch,
       ta AS time_anomaly,
       round(velocity_score / 10 * 0.3 + CAST(dm AS DOUBLE) * 0.2 + CAST(geo AS DOUBLE) * 0.3
             + CAST(ta AS DOUBLE) * 0.2, 2) AS risk_score
FROM f""".replace("\n, f AS", ", f AS"), "users"))(
    lambda spark, d: M.risk_indicators(risk_input(spark, d)))

# ------------------------------------------------------------------ B14
register("b14_inject_drift", with_views("""
SELECT transaction_id, CAST(greatest(1, round_even(quantity * 1.5, 0)) AS INTEGER) AS quantity,
       round(round(ticket_price * 1.5, 2), 4) AS ticket_price, round(total_amount * 1.5, 2) AS total_amount
FROM txns""", "txns"))(
    lambda spark, d: round_doubles(M.inject_drift(
        V.txns(spark, d).select("transaction_id", "quantity", "ticket_price", "total_amount"),
        0.5, ["quantity", "ticket_price", "total_amount"])))
