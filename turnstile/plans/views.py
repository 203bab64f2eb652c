"""Logical tables of the ticketing domain, derived from the driver tables.

Each view exists twice: as a lazy DataFrame (what the operators consume)
and as a SQL ``WITH`` fragment for the DuckDB oracle.  Both are plain
projections/joins so Catalyst prunes columns and pushes filters into the
Parquet scans.

Mapping (SURVEY 7.3):

* ``txns``          lineitem ⋈ orders — one ticket purchase per line item
* ``ticket_events`` part              — one ticketed event per part
* ``users``         customer ⋈ nation — one buyer per customer
* ``raw_events``    events            — landed stream rows
* ``request_log``   events            — one scoring request per event row
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- txns
def txns(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
    return j.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("transaction_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("event_id"),
        F.col("o_orderdate").alias("event_timestamp"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")).alias("ticket_price"),
        F.col("l_extendedprice").alias("total_amount"),
        (F.col("l_returnflag") == "R").alias("is_fraud"),
    )


SQL_TXNS = """txns AS (
  SELECT l_orderkey * 10 + l_linenumber AS transaction_id, o_custkey AS user_id,
         l_partkey AS event_id, o_orderdate AS event_timestamp,
         CAST(l_quantity AS INTEGER) AS quantity,
         l_extendedprice / l_quantity AS ticket_price, l_extendedprice AS total_amount,
         l_returnflag = 'R' AS is_fraud
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


# ------------------------------------------------------- ticket_events
def ticket_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("event_id"),
        F.col("p_brand").alias("promoter_id"),
        F.col("p_type").alias("category"),
        (F.col("p_size") * 40).alias("capacity"),
        F.col("p_retailprice").alias("base_price"),
        (F.col("p_size") / F.lit(50.0)).alias("popularity"),
        F.timestamp_add("DAY", F.col("p_size"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("start_time"),
    )


SQL_TICKET_EVENTS = """ticket_events AS (
  SELECT p_partkey AS event_id, p_brand AS promoter_id, p_type AS category,
         p_size * 40 AS capacity, p_retailprice AS base_price, p_size / 50.0 AS popularity,
         TIMESTAMP '2024-01-01 00:00:00' + to_days(p_size) AS start_time
  FROM part)"""


# ---------------------------------------------------------------- users
def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = c.join(n, c.c_nationkey == n.n_nationkey, "left")
    return j.select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_mktsegment").alias("loyalty_tier"),
        F.col("n_name").alias("country"),
        F.timestamp_add("DAY", F.col("c_nationkey"), F.lit("1994-01-01 00:00:00").cast("timestamp_ntz")).alias("signup_date"),
    )


SQL_USERS = """users AS (
  SELECT c_custkey AS user_id, c_mktsegment AS loyalty_tier, n_name AS country,
         TIMESTAMP '1994-01-01 00:00:00' + to_days(c_nationkey) AS signup_date
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)"""


# ----------------------------------------------------------- raw_events
def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id"),
        F.col("event_type").alias("event_id"),
        F.col("value").alias("total_amount"),
        F.col("ts").alias("timestamp"),
    )


SQL_RAW_EVENTS = """raw_events AS (
  SELECT user_id, event_type AS event_id, value AS total_amount, ts AS "timestamp" FROM events)"""


# ---------------------------------------------------------- request_log
def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id").alias("request_id"),
        F.col("ts"),
        (F.col("user_id") % 3).cast("int").alias("service"),
        F.col("value").alias("latency_ms"),
        F.when(F.col("event_type") == "error", F.lit(503)).otherwise(F.lit(200)).alias("status"),
        (F.col("event_type") == "purchase").alias("blocked"),
        (k >= 90).alias("is_fraud"),
        F.least(F.col("value") / F.lit(500.0), F.lit(1.0)).alias("fraud_score"),
        (F.col("value") > 300).alias("timed_out"),
        F.when((F.col("event_type") == "error") & (k >= 80), F.lit("timeout")).alias("error"),
    )


SQL_REQUEST_LOG = """request_log AS (
  SELECT event_id AS request_id, ts, CAST(user_id % 3 AS INTEGER) AS service, value AS latency_ms,
         CASE WHEN event_type = 'error' THEN 503 ELSE 200 END AS status,
         event_type = 'purchase' AS blocked,
         CAST(json_extract_string(props, '$.k') AS INTEGER) >= 90 AS is_fraud,
         least(value / 500.0, 1.0) AS fraud_score,
         value > 300 AS timed_out,
         CASE WHEN event_type = 'error' AND CAST(json_extract_string(props, '$.k') AS INTEGER) >= 80
              THEN 'timeout' END AS error
  FROM events)"""


# Composite fragments (B4 / B5 outputs) reused by several oracles.
SQL_EVENT_METRICS = """event_metrics AS (
  WITH sales AS (SELECT event_id, sum(quantity) AS s, avg(ticket_price) AS a, max(quantity) AS m
                 FROM txns GROUP BY event_id),
  inv AS (SELECT e.event_id, e.promoter_id, e.start_time, e.capacity, coalesce(s.s, 0) AS sold,
                 coalesce(s.a, e.base_price) AS avg_ticket_price, coalesce(s.m, 0) AS viewers
          FROM ticket_events e LEFT JOIN sales s USING (event_id)),
  prom AS (SELECT promoter_id, avg(sold) AS ps FROM inv WHERE promoter_id IS NOT NULL GROUP BY promoter_id),
  mx AS (SELECT coalesce(nullif(max(ps), 0), 1) AS m FROM prom)
  SELECT event_id, promoter_id, start_time AS event_timestamp,
         CAST(greatest(capacity - sold, 0) AS BIGINT) AS current_inventory,
         least(greatest(sold / capacity, 0.0), 1.0) AS sell_through_rate_5min,
         CAST(viewers AS BIGINT) AS concurrent_viewers, CAST(sold AS BIGINT) AS total_tickets_sold,
         avg_ticket_price, coalesce(ps / mx.m, 0.0) AS promoter_success_rate
  FROM inv LEFT JOIN prom USING (promoter_id) CROSS JOIN mx)"""

SQL_USER_METRICS = """user_metrics AS (
  WITH agg AS (SELECT user_id, sum(quantity) AS p, avg(CAST(is_fraud AS DOUBLE)) AS r FROM txns GROUP BY user_id),
  cnt AS (SELECT t.user_id, e.category, count(*) AS n FROM txns t JOIN ticket_events e USING (event_id)
          GROUP BY t.user_id, e.category),
  pref AS (SELECT user_id, arg_max(category, (n, category)) AS preferred_category FROM cnt GROUP BY user_id)
  SELECT u.user_id, u.signup_date AS event_timestamp, CAST(coalesce(a.p, 0) AS BIGINT) AS lifetime_purchases,
         least(greatest(coalesce(a.r, 0.0), 0.0), 1.0) AS fraud_risk_score, pref.preferred_category
  FROM users u LEFT JOIN agg a USING (user_id) LEFT JOIN pref USING (user_id))"""

SQL_VIEWS = {
    "event_metrics": SQL_EVENT_METRICS,
    "user_metrics": SQL_USER_METRICS,
    "txns": SQL_TXNS,
    "ticket_events": SQL_TICKET_EVENTS,
    "users": SQL_USERS,
    "raw_events": SQL_RAW_EVENTS,
    "request_log": SQL_REQUEST_LOG,
}


def with_views(sql: str, *names: str) -> str:
    """Prefix an oracle query with the WITH fragments it needs.

    A body that starts with its own ``WITH`` has its CTEs appended after
    the view fragments.
    """
    order = ["txns", "ticket_events", "users", "raw_events", "request_log", "event_metrics", "user_metrics"]
    head = ",\n".join(SQL_VIEWS[n] for n in sorted(set(names), key=order.index))
    body = sql.lstrip()
    if body[:5].upper() == "WITH ":
        return "WITH " + head + ",\n" + body[5:]
    return "WITH " + head + "\n" + body
