"""Queries for the streaming operators (A5, A6, A8, C3, C4, C5, C7, D4, H3-stream).

Each query replays the driver's ``events`` table through a file-source
stream with ``availableNow`` (the stand-in for the topic), into folders
under the shared checkpoint root, then reads what the sink wrote.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from turnstile.functions.scalars import money_sum
from turnstile.operators import metrics as M
from turnstile.operators import realtime as R
from turnstile.plans import views as V
from turnstile.plans.registry import register, round_doubles
from turnstile.plans.views import with_views
from turnstile.session import reuse, scratch_path
from turnstile.sources import topic as T
from turnstile.streaming import jobs as J
from turnstile.streaming import landing as L


def _events_stream(spark, d):
    schema = V.table(spark, d, "events").schema
    return J.file_stream(spark, d, schema, glob="events.parquet")


def _raw_stream(spark, d):
    """The landed-transaction shape of the events stream (see views.raw_events)."""
    e = _events_stream(spark, d)
    return e.select("user_id", F.col("event_type").alias("event_id"), F.col("value").alias("total_amount"),
                    F.col("ts").alias("timestamp"))


def _dirs(spark, name):
    root = scratch_path(spark, name)
    return f"{root}/out", f"{root}/ckpt"


# ------------------------------------------------------------------ A8 / A5
def _wire(spark, d):
    return J.encode_transactions(M.transaction_amounts(V.txns(spark, d)))


register("a8_encode_transactions", with_views("""
SELECT CAST(user_id AS VARCHAR) AS "key",
       '{"user_id":"' || CAST(user_id AS VARCHAR) || '","event_id":' || CAST(event_id AS VARCHAR) ||
       ',"total_amount":' || CAST(round(quantity * ticket_price, 2) AS VARCHAR) ||
       ',"timestamp":"' || strftime(event_timestamp, '%Y-%m-%dT%H:%M:%S.%g') || 'Z"' ||
       ',"num_tickets":' || CAST(quantity AS VARCHAR) ||
       ',"price_per_ticket":' || CAST(round(ticket_price, 2) AS VARCHAR) || '}' AS value
FROM txns""", "txns"))(lambda spark, d: _wire(spark, d))

register("a5_parse_transactions", with_views("""
SELECT CAST(user_id AS BIGINT) AS user_id, event_id, round(quantity * ticket_price, 2) AS total_amount,
       strftime(event_timestamp, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS "timestamp",
       CAST(quantity AS BIGINT) AS num_tickets, round(ticket_price, 2) AS price_per_ticket,
       '' AS payment_status, false AS is_fraud
FROM txns""", "txns"))(
    lambda spark, d: J.parse_transactions(_wire(spark, d)).select(
        "user_id", "event_id", "total_amount", "timestamp", "num_tickets", "price_per_ticket",
        "payment_status", "is_fraud"))


# Messages of some baskets are cut short.  Per user what was decoded and what is on record as malformed, and the counts.
@register("a5_side_output", with_views("""
SELECT CAST(user_id AS VARCHAR) AS "key", count(*) FILTER (WHERE quantity % 10 <> 3) AS good,
       count(*) FILTER (WHERE quantity % 10 = 3) AS bad,
       round(coalesce(sum(CAST(round(quantity * ticket_price * 100) AS BIGINT))
                      FILTER (WHERE quantity % 10 <> 3), 0) / 100.0, 4) AS amount,
       (SELECT count(*) FROM txns) AS messages, (SELECT count(*) FROM txns WHERE quantity % 10 = 3) AS malformed
FROM txns GROUP BY user_id""", "txns"))
def q_side_output(spark, d):
    root = scratch_path(spark, "side_output")
    wire = J.encode_transactions(M.transaction_amounts(V.txns(spark, d)).withColumn("cut", F.col("num_tickets") % 10 == 3))
    cut = F.when(F.col("value").contains('"cut":true'), F.expr("left(value, length(value) - 5)")).otherwise(F.col("value"))
    wire.select("key", cut.alias("value")).write.parquet(f"{root}/messages")
    stream = J.file_stream(spark, f"{root}/messages", "key string, value string")
    J.run_until_done(L.land_transactions(stream, f"{root}/landed", f"{root}/ckpt", trigger={"availableNow": True}))
    good = L.read_good(spark, f"{root}/landed").groupBy("key").agg(F.count(F.lit(1)).alias("good"),
                                                                   money_sum("total_amount").alias("amount"))
    bad = L.read_bad(spark, f"{root}/landed").where(F.col("malformed").isNotNull()).groupBy("key").agg(
        F.count(F.lit(1)).alias("bad"))
    counts = L.read_counts(spark, f"{root}/landed").agg(F.sum("messages").alias("messages"), F.sum("malformed").alias("malformed"))
    both = good.join(bad, "key", "full").crossJoin(counts)
    return round_doubles(both.select("key", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("bad", F.lit(0)).alias("bad"),
                                     F.coalesce("amount", F.lit(0.0)).alias("amount"), "messages", "malformed"))


# The stream lands in several micro-batches; compactions and a vacuum run between them, the last batches stay unfolded.
@register("a6_compacted_landing", """
SELECT event_id, user_id, ts, value, CAST(ts AS DATE) AS dt, true AS few_files FROM events""")
def q_compacted(spark, d):
    root = scratch_path(spark, "landing")
    events = V.table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    events.repartition(6, "event_id").write.parquet(f"{root}/source")
    for k in range(3):  # two files a micro-batch, then a pause
        stream = J.file_stream(spark, f"{root}/source", events.schema, max_files=1, glob=f"part-0000[{2 * k}{2 * k + 1}]*")
        J.run_until_done(L.land_batches(stream, f"{root}/landed", f"{root}/ckpt{k}", ts_col="ts", trigger={"availableNow": True}))
        if k < 2:
            L.compact_landed(spark, f"{root}/landed")
            L.vacuum_landed(spark, f"{root}/landed", keep=1)
    parts = L.current(spark, f"{root}/landed").parts
    files = spark.read.parquet(*[L._part(f"{root}/landed", *p) for p in parts]).select(
        F.countDistinct("_metadata.file_path").alias("files"))
    few = files.select((F.col("files") == len(parts)).alias("few_files"))  # one file a date, since each is below the target
    return L.read_landed(spark, f"{root}/landed").crossJoin(few)


# ------------------------------------------------------------------ A7
# Transactions into a topic in two appends; one consumer stops between them and goes on, another reads all at once.
@register("a7_topic_source", with_views("""
SELECT CAST(user_id AS BIGINT) AS user_id, event_id, round(quantity * ticket_price, 2) AS total_amount,
       CAST(quantity AS BIGINT) AS num_tickets, CAST(2 AS BIGINT) AS consumers FROM txns""", "txns"))
def q_topic(spark, d):
    root = scratch_path(spark, "topic")
    wire = reuse(_wire(spark, d))
    early = F.pmod(F.xxhash64("value"), F.lit(2)) == 0

    def consume(name):
        parsed = J.parse_transactions(T.topic_source(spark, f"{root}/t")).select(
            "user_id", "event_id", "total_amount", "num_tickets", "timestamp")
        J.run_until_done(J.write_to_table(parsed, f"{root}/{name}", f"{root}/{name}-ck"))
    T.write_topic(wire.where(early), f"{root}/t")
    consume("restarted")
    T.write_topic(wire.where(~early), f"{root}/t")
    consume("restarted")
    consume("fresh")
    both = [spark.read.parquet(f"{root}/{n}") for n in ("restarted", "fresh")]
    cols = both[0].columns
    same = both[0].withColumn("c", F.lit(1)).unionByName(both[1].withColumn("c", F.lit(2))).groupBy(*cols).agg(
        F.count_if(F.col("c") == 1).alias("n"), F.count_if(F.col("c") == 2).alias("m"))
    rows = same.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest("n", "m"))))
    consumers = (F.col("copy") <= F.col("n")).cast("long") + (F.col("copy") <= F.col("m")).cast("long")
    return rows.select("user_id", "event_id", "total_amount", "num_tickets", consumers.alias("consumers"))


# ------------------------------------------------------------------ A6
@register("a6_land_stream", """
SELECT event_id, user_id, ts, value, CAST(ts AS DATE) AS dt FROM events""")
def q_land(spark, d):
    out, ck = _dirs(spark, "landing")
    s = _events_stream(spark, d).select("event_id", "user_id", "ts", "value")
    J.run_until_done(J.land_stream(s, out, ck, ts_col="ts", trigger={"availableNow": True}))
    return spark.read.parquet(out).select("event_id", "user_id", "ts", "value", "dt")


# ------------------------------------------------------------------ C3 / C4 / C7
SQL_ALL_TIME = """
WITH a AS (SELECT user_id, count(*) AS n, sum(CAST(round(coalesce(total_amount, 0.0) * 100) AS BIGINT)) AS c,
                  count(DISTINCT event_id) AS de
           FROM raw_events WHERE user_id IS NOT NULL GROUP BY user_id)
SELECT user_id, n AS user_txn_count_1h, round(c / 100.0, 4) AS user_txn_amount_1h,
       de AS user_distinct_events_1h, round(c / 100.0 / n, 4) AS user_avg_amount_24h FROM a"""


@register("c3_stream_user_aggregates", with_views(SQL_ALL_TIME, "raw_events"))
def q_stream_agg(spark, d):
    out, ck = _dirs(spark, "user_agg")
    J.run_until_done(J.write_to_table(J.stream_user_aggregates(_raw_stream(spark, d)), out, ck, mode="update"))
    return round_doubles(J.newest_batches(spark.read.parquet(out), ["user_id"]))


@register("c4_publish_user_features", with_views(SQL_ALL_TIME, "raw_events"))
def q_publish(spark, d):
    out, ck = _dirs(spark, "online")
    J.run_until_done(J.publish_user_features(J.stream_user_aggregates(_raw_stream(spark, d)), out, ck,
                                             trigger={"availableNow": True}))
    return round_doubles(J.read_online(spark, out).drop("event_timestamp"))


@register("c7_feature_parity", with_views("""
WITH s AS (SELECT count(DISTINCT user_id) AS n FROM raw_events WHERE user_id IS NOT NULL)
SELECT n AS n_stream, n AS n_batch, CAST(0 AS BIGINT) AS missing_in_stream, CAST(0 AS BIGINT) AS missing_in_batch,
       CAST(0 AS BIGINT) AS mismatched, true AS parity FROM s""", "raw_events"))
def q_parity(spark, d):
    out, ck = _dirs(spark, "parity")
    J.run_until_done(J.publish_user_features(J.stream_user_aggregates(_raw_stream(spark, d)), out, ck,
                                             trigger={"availableNow": True}))
    stream_out = J.read_online(spark, out)
    batch_out = R.user_realtime_features(V.raw_events(spark, d))
    return R.feature_parity(stream_out, batch_out, features=R.FEATURES, tol=1e-6)


# ------------------------------------------------------------------ D4
# A week of features is a batch; two compactions and a vacuum lie between the batches.
@register("d4_online_store", with_views("""
WITH w AS (SELECT user_id, CAST(floor(epoch("timestamp" - TIMESTAMP '2024-01-01 00:00:00') / 604800) AS BIGINT) AS week,
                  count(*) AS n, sum(CAST(round(coalesce(total_amount, 0.0) * 100) AS BIGINT)) AS c
           FROM raw_events WHERE user_id IS NOT NULL GROUP BY 1, 2)
SELECT user_id, max(week) AS week, arg_max(n, week) AS txn_count, round(arg_max(c, week) / 100.0, 4) AS amount
FROM w GROUP BY user_id""", "raw_events"))
def q_online_store(spark, d):
    root = scratch_path(spark, "online_store")
    raw = V.raw_events(spark, d).where("user_id is not null")
    week = F.floor(F.timestamp_diff("SECOND", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("timestamp"))
                   / 604800).alias("week")
    weekly = raw.groupBy("user_id", week).agg(F.count(F.lit(1)).alias("txn_count"),
                                              money_sum(F.coalesce(F.col("total_amount"), F.lit(0.0))).alias("amount"))
    weekly = reuse(weekly)
    for k, (w,) in enumerate(sorted(weekly.select("week").distinct().collect())):  # a batch a week
        J.write_online_batch(weekly.where(F.col("week") == w), k, root)
        if k % 2:
            J.compact_online(spark, root, buckets=16)
            J.vacuum_online(spark, root, keep=1)
    return round_doubles(J.read_online(spark, root).drop("event_timestamp"))


# ------------------------------------------------------------------ C5
@register("c5_windowed_user_features", with_views("""
WITH w AS (SELECT r.user_id, r.event_id, r.total_amount,
                  make_timestamp(CAST((floor(epoch_us(r."timestamp") / 300000000) - i) * 300000000 AS BIGINT)) AS ws
           FROM raw_events r, range(0, 12) t(i)),
m AS (SELECT max("timestamp") AS mx FROM raw_events),
h AS (SELECT ws, user_id, count(*) AS n, sum(CAST(round(coalesce(total_amount, 0.0) * 100) AS BIGINT)) AS c,
             count(DISTINCT event_id) AS de
      FROM w, m WHERE ws + INTERVAL 1 HOUR <= mx - INTERVAL 10 MINUTE GROUP BY ws, user_id),
d AS (SELECT h.ws, h.user_id, count(*) AS n, sum(CAST(round(coalesce(r.total_amount, 0.0) * 100) AS BIGINT)) AS c
      FROM h JOIN raw_events r ON h.user_id = r.user_id AND r."timestamp" >= h.ws - INTERVAL 23 HOUR
           AND r."timestamp" < h.ws + INTERVAL 1 HOUR GROUP BY h.ws, h.user_id)
SELECT h.ws AS window_start, h.ws + INTERVAL 1 HOUR AS window_end, h.user_id, h.n AS user_txn_count_1h,
       round(h.c / 100.0, 4) AS user_txn_amount_1h, h.de AS user_distinct_events_1h,
       round(d.c / 100.0 / d.n, 4) AS user_avg_amount_24h
FROM h JOIN d ON h.ws = d.ws AND h.user_id = d.user_id""", "raw_events"))
def q_windows(spark, d):
    out, ck = _dirs(spark, "windows")
    w = J.windowed_user_features(_raw_stream(spark, d))
    J.run_until_done(J.write_to_table(w, out, ck, mode="append"))
    r = spark.read.parquet(out)
    return round_doubles(r.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                                  F.col("window_end").cast("timestamp_ntz").alias("window_end"),
                                  "user_id", "user_txn_count_1h", "user_txn_amount_1h", "user_distinct_events_1h",
                                  "user_avg_amount_24h"))


# ------------------------------------------------------------------ H3 (stream)
@register("h3_stream_arm_updates", with_views("""
WITH r AS (SELECT CASE WHEN blocked THEN 'aggressive' ELSE 'baseline' END AS arm,
                  least(greatest(1 - fraud_score, 0.0), 1.0) AS r FROM request_log)
SELECT arm, round(1.0 + sum(r), 4) AS alpha, round(1.0 + count(*) - sum(r), 4) AS beta FROM r GROUP BY arm""",
    "request_log"))
def q_stream_arms(spark, d):
    out, ck = _dirs(spark, "arms")
    e = _events_stream(spark, d)
    rewards = e.select(F.when(F.col("event_type") == "purchase", F.lit("aggressive")).otherwise(F.lit("baseline"))
                       .alias("arm"), (1 - F.least(F.col("value") / F.lit(500.0), F.lit(1.0))).alias("reward"))
    J.run_until_done(J.write_to_table(J.stream_arm_updates(rewards), out, ck, mode="update"))
    ch = spark.read.parquet(out)
    latest = ch.groupBy("arm").agg(F.max_by(F.struct("alpha", "beta"), F.col("batch_id")).alias("r"))
    return round_doubles(latest.select("arm", "r.alpha", "r.beta"))


@register("c5_daily_mean_amount", with_views("""
WITH m AS (SELECT max("timestamp") AS mx FROM raw_events),
w AS (SELECT make_timestamp(CAST(floor(epoch_us("timestamp") / 86400000000) * 86400000000 AS BIGINT)) AS ws,
             user_id, CAST(round(coalesce(total_amount, 0.0) * 100) AS BIGINT) AS c FROM raw_events)
SELECT ws AS window_start, user_id, round(sum(c) / 100.0 / count(*), 4) AS user_avg_amount_24h
FROM w, m WHERE ws + INTERVAL 1 DAY <= mx - INTERVAL 10 MINUTE GROUP BY ws, user_id""", "raw_events"))
def q_daily_mean(spark, d):
    out, ck = _dirs(spark, "daily_mean")
    J.run_until_done(J.write_to_table(J.daily_mean_amount(_raw_stream(spark, d)), out, ck, mode="append"))
    r = spark.read.parquet(out)
    return round_doubles(r.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "user_id",
                                  "user_avg_amount_24h"))
