"""Queries for group I (request-log analytics) over ``request_log`` (events)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnstile.operators import requests as I
from turnstile.plans import views as V
from turnstile.plans.registry import register, round_doubles
from turnstile.plans.views import with_views

LOG = "request_log"


def _log(spark, d):
    return V.request_log(spark, d)


# ------------------------------------------------------------------ I1
register("i1_latency_percentiles", with_views("""
SELECT service, count(latency_ms) AS n,
       round(quantile_cont(latency_ms, 0.5), 4) AS p50_latency_ms,
       round(quantile_cont(latency_ms, 0.95), 4) AS p95_latency_ms,
       round(quantile_cont(latency_ms, 0.99), 4) AS p99_latency_ms
FROM request_log GROUP BY service""", LOG))(
    lambda spark, d: round_doubles(I.latency_percentiles(_log(spark, d), by=["service"])))

register("i1_latency_percentiles_all", with_views("""
SELECT count(latency_ms) AS n,
       round(quantile_cont(latency_ms, 0.5), 4) AS p50_latency_ms,
       round(quantile_cont(latency_ms, 0.95), 4) AS p95_latency_ms,
       round(quantile_cont(latency_ms, 0.99), 4) AS p99_latency_ms
FROM request_log""", LOG))(
    lambda spark, d: round_doubles(I.latency_percentiles(_log(spark, d))))

# ------------------------------------------------------------------ I2
register("i2_latency_sla", with_views("""
WITH r AS (SELECT service, latency_ms,
                  row_number() OVER (PARTITION BY service ORDER BY latency_ms) - 1 AS i,
                  count(*) OVER (PARTITION BY service) AS n
           FROM request_log WHERE latency_ms IS NOT NULL),
s AS (SELECT service, n,
             max(CASE WHEN i = floor(0.5::DOUBLE * (n - 1)) THEN latency_ms END) AS p50_ms,
             max(CASE WHEN i = floor(0.95::DOUBLE * (n - 1)) THEN latency_ms END) AS p95_ms,
             max(CASE WHEN i = floor(0.99::DOUBLE * (n - 1)) THEN latency_ms END) AS p99_ms
      FROM r GROUP BY service, n)
SELECT service, n, round(p50_ms, 4) AS p50_ms, round(p95_ms, 4) AS p95_ms, round(p99_ms, 4) AS p99_ms,
       p50_ms <= 50 AND p95_ms <= 150 AND p99_ms <= 200 AS passed, CAST(NULL AS VARCHAR) AS reason
FROM s""", LOG))(
    lambda spark, d: round_doubles(I.latency_sla(_log(spark, d), by=["service"])))

# ------------------------------------------------------------------ I3
register("i3_error_rate", with_views("""
SELECT service, count(*) AS n, count(*) FILTER (WHERE coalesce(status, 200) >= 400) AS errors,
       round(coalesce(count(*) FILTER (WHERE coalesce(status, 200) >= 400) / count(*), 0.0), 4) AS error_rate
FROM request_log GROUP BY service""", LOG))(
    lambda spark, d: round_doubles(I.error_rate(_log(spark, d), by=["service"])))

register("i3_error_rate_non2xx", with_views("""
SELECT count(*) AS n, count(*) FILTER (WHERE coalesce(status, 200) < 200 OR coalesce(status, 200) >= 300) AS errors,
       round(coalesce(count(*) FILTER (WHERE coalesce(status, 200) < 200 OR coalesce(status, 200) >= 300)
                      / count(*), 0.0), 4) AS error_rate
FROM request_log""", LOG))(
    lambda spark, d: round_doubles(I.error_rate(_log(spark, d), rule="non2xx")))

# ------------------------------------------------------------------ I4
register("i4_throughput", with_views("""
WITH t AS (SELECT count(*) AS n, greatest((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 1.0) AS d FROM request_log),
p AS (SELECT max(c) AS peak FROM (SELECT date_trunc('second', ts) AS s, count(*) AS c FROM request_log GROUP BY 1))
SELECT n, round(d, 4) AS duration_seconds, round(n / d, 4) AS mean_rps, CAST(coalesce(peak, 0) AS BIGINT) AS peak_rps
FROM t, p""", LOG))(
    lambda spark, d: round_doubles(I.throughput(_log(spark, d))))

# ------------------------------------------------------------------ I5 / I6 / I7 / I9
register("i5_timeout_count", with_views("""
SELECT service, count(*) FILTER (WHERE coalesce(timed_out, false) OR coalesce(error = 'timeout', false)) AS timeout_count
FROM request_log GROUP BY service""", LOG))(
    lambda spark, d: I.timeout_count(_log(spark, d), by=["service"]))

SQL_I6 = """
SELECT service, count(*) FILTER (WHERE blocked AND is_fraud) AS true_positives,
       count(*) FILTER (WHERE is_fraud) AS actual_fraud, count(*) FILTER (WHERE blocked) AS blocked,
       round(coalesce(count(*) FILTER (WHERE blocked AND is_fraud) / nullif(count(*) FILTER (WHERE is_fraud), 0), 0.0), 4)
         AS fraud_recall,
       round(coalesce(count(*) FILTER (WHERE blocked AND is_fraud) / nullif(count(*) FILTER (WHERE is_fraud), 0), 0.0)
             * 100, 4) AS fraud_detected_pct,
       round(coalesce(count(*) FILTER (WHERE blocked AND is_fraud) / nullif(count(*) FILTER (WHERE blocked), 0), 0.0), 4)
         AS fraud_precision
FROM request_log GROUP BY service"""
register("i6_fraud_rates", with_views(SQL_I6, LOG))(
    lambda spark, d: round_doubles(I.fraud_rates(_log(spark, d), by=["service"])))

register("i7_confusion_metrics", with_views("""
WITH c AS (SELECT service, count(*) AS n,
      count(*) FILTER (WHERE coalesce(is_fraud, false) AND (coalesce(blocked, false) OR coalesce(fraud_score, 0) > 0.7)) AS tp,
      count(*) FILTER (WHERE NOT coalesce(is_fraud, false) AND (coalesce(blocked, false) OR coalesce(fraud_score, 0) > 0.7)) AS fp,
      count(*) FILTER (WHERE coalesce(is_fraud, false) AND NOT (coalesce(blocked, false) OR coalesce(fraud_score, 0) > 0.7)) AS fn
    FROM request_log GROUP BY service),
m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall FROM c)
SELECT service, n, tp, fp, fn, round(precision, 4) AS precision, round(recall, 4) AS recall,
       round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0), 4) AS f1,
       n > 0 AND recall >= 0.9 AND precision >= 0.85 AS passed,
       CASE WHEN n = 0 THEN 'no responses' END AS reason
FROM m""", LOG))(
    lambda spark, d: round_doubles(I.confusion_metrics(_log(spark, d), by=["service"])))

register("i9_fallback_share", with_views("""
SELECT service, round(coalesce(avg(CAST(coalesce(latency_ms, 0) > 200 AS DOUBLE)), 0.0) * 100, 4) AS fallback_used_pct
FROM request_log GROUP BY service""", LOG))(
    lambda spark, d: round_doubles(I.fallback_share(_log(spark, d), by=["service"])))


# ------------------------------------------------------------------ I8
def _payments(spark, d):
    """Completed vs declined payments: a returned line counts as declined."""
    return V.txns(spark, d).select(
        "total_amount", F.when(F.col("is_fraud"), F.lit("declined")).otherwise(F.lit("completed")).alias("payment_status"))


register("i8_business_metrics", with_views("""
WITH r AS (SELECT count(*) AS n, count(*) FILTER (WHERE coalesce(blocked, false) AND coalesce(is_fraud, false)) AS tp,
                  count(*) FILTER (WHERE coalesce(is_fraud, false)) AS fr, count(*) FILTER (WHERE coalesce(blocked, false)) AS bl
           FROM request_log),
v AS (SELECT coalesce(avg(CASE WHEN NOT is_fraud THEN coalesce(total_amount, 0.0) END), 0.0) AS revenue_impact FROM txns)
SELECT round(coalesce(tp / nullif(fr, 0), 0.0), 4) AS fraud_recall,
       round(coalesce(bl / nullif(n, 0), 0.0) * 100, 4) AS fraud_blocked_pct,
       round(revenue_impact, 4) AS revenue_impact,
       n > 0 AND coalesce(tp / nullif(fr, 0), 0.0) >= 0.95 AS passed,
       CASE WHEN n = 0 THEN 'no responses' END AS reason
FROM r, v""", LOG, "txns"))(
    lambda spark, d: round_doubles(I.business_metrics(_log(spark, d), _payments(spark, d))))

# ------------------------------------------------------------------ I10
EXPECTED = [("p50_latency_ms", 50.0), ("p95_latency_ms", 150.0), ("p99_latency_ms", 200.0),
            ("error_rate", 0.2), ("fallback_used_pct", 15.0), ("peak_rps", 300.0)]
_EXP_SQL = ", ".join(f"('{m}', {v}::DOUBLE)" for m, v in EXPECTED)


def _actual_metrics(spark, d) -> DataFrame:
    log = _log(spark, d)
    p = I.latency_percentiles(log)
    e = I.error_rate(log)
    f = I.fallback_share(log)
    one = p.crossJoin(e).crossJoin(f)
    cols = ["p50_latency_ms", "p95_latency_ms", "p99_latency_ms", "error_rate", "fallback_used_pct"]
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
                                         for c in cols])))


@register("i10_check_expectations", with_views(f"""
WITH e(metric, expected) AS (VALUES {_EXP_SQL}),
a AS (SELECT 'p50_latency_ms' AS metric, quantile_cont(latency_ms, 0.5) AS value FROM request_log
      UNION ALL SELECT 'p95_latency_ms', quantile_cont(latency_ms, 0.95) FROM request_log
      UNION ALL SELECT 'p99_latency_ms', quantile_cont(latency_ms, 0.99) FROM request_log
      UNION ALL SELECT 'error_rate', count(*) FILTER (WHERE coalesce(status, 200) >= 400) / count(*) FROM request_log
      UNION ALL SELECT 'fallback_used_pct', avg(CAST(coalesce(latency_ms, 0) > 200 AS DOUBLE)) * 100 FROM request_log),
j AS (SELECT e.metric, e.expected, a.value,
             abs(a.value - e.expected) / CASE WHEN e.expected <> 0 THEN e.expected ELSE 1.0 END AS rel
      FROM e LEFT JOIN a USING (metric))
SELECT metric, expected, round(value, 4) AS actual, round(rel, 4) AS relative_error,
       CASE WHEN value IS NULL THEN false ELSE rel <= 0.1 END AS passed,
       CASE WHEN value IS NULL THEN 'Metric ''' || metric || ''' not found in results'
            WHEN rel > 0.1 THEN printf('%s: expected %.4f, got %.4f', metric, CAST(expected AS DOUBLE), CAST(value AS DOUBLE))
       END AS failure
FROM j""", LOG))
def q_expectations(spark, d):
    exp = spark.createDataFrame(EXPECTED, "metric string, expected double")
    return round_doubles(I.check_expectations(_actual_metrics(spark, d), exp))


# ------------------------------------------------------------------ I11
register("i11_latency_histogram", with_views("""
WITH v AS (SELECT CAST(latency_ms AS DOUBLE) AS v FROM request_log WHERE latency_ms IS NOT NULL),
r AS (SELECT min(v) AS lo, max(v) AS hi FROM v),
b AS (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((v - lo) / ((hi - lo) / 50.0)), 49) END AS INTEGER) AS bin,
             lo, hi FROM v, r)
SELECT bin, round(lo + bin * CASE WHEN hi = lo THEN 0.0 ELSE (hi - lo) / 50.0 END, 4) AS bin_start,
       round(lo + (bin + 1) * CASE WHEN hi = lo THEN 0.0 ELSE (hi - lo) / 50.0 END, 4) AS bin_end, count(*) AS count
FROM b GROUP BY bin, lo, hi""", LOG))(
    lambda spark, d: round_doubles(I.latency_histogram(_log(spark, d))))

# ------------------------------------------------------------------ I12 / I13
_BUCKET = "make_timestamp(CAST(floor(epoch_us(ts) / {us}) * {us} AS BIGINT))"
B5 = _BUCKET.format(us=300_000_000)
register("i12_request_rate", with_views(f"""
SELECT {B5} AS window_start, {B5} + INTERVAL 5 MINUTE AS window_end, service,
       count(*) AS requests, round(count(*) / 300.0, 4) AS rps
FROM request_log GROUP BY 1, 2, service""", LOG))(
    lambda spark, d: round_doubles(I.request_rate(_log(spark, d))))

register("i13_error_ratio", with_views(f"""
SELECT {B5} AS window_start, {B5} + INTERVAL 5 MINUTE AS window_end, service, count(*) AS requests,
       count(*) FILTER (WHERE coalesce(status, 200) >= 400) AS errors,
       round(count(*) FILTER (WHERE coalesce(status, 200) >= 400) / count(*), 4) AS error_ratio,
       count(*) FILTER (WHERE coalesce(status, 200) >= 400) / count(*) > 0.01 AS alert
FROM request_log GROUP BY 1, 2, service""", LOG))(
    lambda spark, d: round_doubles(I.error_ratio(_log(spark, d))))

# ------------------------------------------------------------------ I14
_LES = list(I.PROM_BUCKETS)
_LE_SQL = ", ".join(f"({i}, '{b}'::DOUBLE)" for i, b in enumerate(_LES))
_IDX_SQL = "CASE " + " ".join(f"WHEN latency_ms * 0.001 <= '{b}'::DOUBLE THEN {i}"
                              for i, b in enumerate(_LES[:-1])) + f" ELSE {len(_LES) - 1} END"
QUANTILES = (0.5, 0.95, 0.99)
_Q_SQL = ", ".join(f"({q}::DOUBLE)" for q in QUANTILES)

@register("i14_histogram_quantile", with_views(f"""
WITH les(b, le) AS (VALUES {_LE_SQL}),
c AS (SELECT service, {_IDX_SQL} AS b, count(*) AS c FROM request_log WHERE latency_ms IS NOT NULL GROUP BY 1, 2),
g AS (SELECT k.service, les.b, les.le, coalesce(c.c, 0) AS c
      FROM (SELECT DISTINCT service FROM c) k CROSS JOIN les LEFT JOIN c ON c.service = k.service AND c.b = les.b),
cum AS (SELECT service, b, le, sum(c) OVER (PARTITION BY service ORDER BY b) AS cnt FROM g),
x AS (SELECT *, lag(le) OVER (PARTITION BY service ORDER BY le) AS prev_le,
             lag(cnt) OVER (PARTITION BY service ORDER BY le) AS prev_c,
             max(cnt) OVER (PARTITION BY service) AS total,
             max(CASE WHEN le <> 'inf'::DOUBLE THEN le END) OVER (PARTITION BY service) AS max_finite FROM cum),
qs(q) AS (VALUES {_Q_SQL}),
hit AS (SELECT x.*, qs.q FROM x, qs WHERE cnt >= qs.q * total AND total > 0),
f AS (SELECT service, q, arg_min((le, cnt, prev_le, prev_c, total, max_finite), le) AS h FROM hit GROUP BY service, q)
SELECT service, q,
       round(CASE WHEN h[1] = 'inf'::DOUBLE THEN h[6]
                  WHEN h[3] IS NULL AND h[1] <= 0 THEN h[1]
                  ELSE coalesce(h[3], 0.0) + (h[1] - coalesce(h[3], 0.0)) * (q * h[5] - coalesce(h[4], 0))
                       / (h[2] - coalesce(h[4], 0)) END, 4) AS value
FROM f""", LOG))
def q_histogram_quantile(spark, d):
    return round_doubles(I.histogram_quantile(I.latency_buckets(_log(spark, d)), list(QUANTILES)))


# ------------------------------------------------------------------ I15
B60 = _BUCKET.format(us=3_600_000_000)


@register("i15_sustained_alerts", with_views(f"""
WITH s AS (SELECT {B60} AS window_start, service, count(*) AS requests,
                  count(*) FILTER (WHERE coalesce(status, 200) >= 400) / count(*) AS error_ratio
           FROM request_log GROUP BY 1, service),
c AS (SELECT *, coalesce(error_ratio > 0.25, false) AS cond, epoch_us(window_start) AS us FROM s),
l AS (SELECT *, lag(us) OVER (PARTITION BY service ORDER BY window_start) AS pus,
             lag(cond) OVER (PARTITION BY service ORDER BY window_start) AS pc FROM c),
n AS (SELECT *, CAST(NOT cond OR pus IS NULL OR us - pus <> 3600000000 OR NOT coalesce(pc, false) AS INTEGER) AS nw FROM l),
i AS (SELECT *, sum(nw) OVER (PARTITION BY service ORDER BY window_start ROWS UNBOUNDED PRECEDING) AS island FROM n),
h AS (SELECT *, (us - min(us) OVER (PARTITION BY service, island)) / 1e6 AS held FROM i)
SELECT window_start, service, requests, round(error_ratio, 4) AS error_ratio, cond AS condition,
       CASE WHEN cond THEN held END AS held_seconds, cond AND held >= 7200 AS firing,
       CASE WHEN cond AND held >= 7200 THEN 'warning' END AS severity
FROM h""", LOG))
def q_sustained(spark, d):
    log = _log(spark, d)
    series = log.groupBy(F.window("ts", "1 hour").start.alias("window_start"), "service").agg(
        F.count(F.lit(1)).alias("requests"), (F.count_if(I.is_error(log)) / F.count(F.lit(1))).alias("error_ratio"))
    out = I.sustained_alerts(series, F.col("error_ratio") > 0.25, hold_seconds=7200, step_seconds=3600)
    return round_doubles(out)


# ------------------------------------------------------------------ I16
@register("i16_parse_predictions", with_views("""
WITH r AS (SELECT request_id, is_fraud,
                  CASE WHEN status = 200 THEN '{"predictions": [{"fraud_score": ' || CAST(fraud_score AS VARCHAR) ||
                       CASE WHEN blocked THEN ', "is_fraud": true' ELSE '' END || '}]}' ELSE '{}' END AS body
           FROM request_log),
p AS (SELECT request_id, is_fraud, coalesce(CAST(json_extract(body, '$.predictions[0].fraud_score') AS DOUBLE), 0.0) AS s,
             CAST(json_extract(body, '$.predictions[0].is_fraud') AS BOOLEAN) AS f FROM r)
SELECT request_id, is_fraud, round(s, 4) AS fraud_score, coalesce(f, s >= 0.7) AS predicted_is_fraud, s > 0.7 AS blocked
FROM p""", LOG))
def q_parse(spark, d):
    log = _log(spark, d)
    body = F.when(F.col("status") == 200, F.concat(
        F.lit('{"predictions": [{"fraud_score": '), F.col("fraud_score").cast("string"),
        F.when(F.col("blocked"), F.lit(', "is_fraud": true')).otherwise(F.lit("")), F.lit("}]}"))
    ).otherwise(F.lit("{}"))
    raw = log.select("request_id", "is_fraud", body.alias("body"))
    return round_doubles(I.parse_predictions(raw))


# ------------------------------------------------------------------ I17
@register("i17_report_row", with_views("""
WITH m AS (SELECT count(*) FILTER (WHERE blocked AND is_fraud) / nullif(count(*) FILTER (WHERE blocked), 0) AS p,
                  count(*) FILTER (WHERE coalesce(timed_out, false) OR coalesce(error = 'timeout', false)) AS t,
                  count(*) FILTER (WHERE coalesce(status, 200) >= 400) / count(*) AS e
           FROM request_log)
SELECT round(coalesce(p, 0.0) * 100, 4) AS fraud_metric_value, 'Fraud Precision' AS fraud_metric_label,
       (e <= 0.25) AND t <= 0 AS passed,
       concat_ws('; ', CASE WHEN e > 0.25 THEN 'error_rate above 0.25' END,
                 CASE WHEN t > 0 THEN 'timeouts: expected 0, got ' || CAST(t AS VARCHAR) END) AS failures
FROM m""", LOG))
def q_report(spark, d):
    log = _log(spark, d)
    m = I.fraud_rates(log).crossJoin(I.timeout_count(log)).crossJoin(I.error_rate(log))
    m = m.withColumn("passed", F.col("error_rate") <= 0.25).withColumn(
        "failures", F.when(F.col("error_rate") > 0.25, F.lit("error_rate above 0.25")))
    return round_doubles(I.report_row(m.drop("fraud_recall", "fraud_detected_pct")))


# ------------------------------------------------------------------ I18
@register("i18_combine_runs", with_views("""
WITH u AS (SELECT 'first_half' AS run, status FROM request_log WHERE ts < TIMESTAMP '2024-01-16'
           UNION ALL SELECT 'second_half', status FROM request_log WHERE ts >= TIMESTAMP '2024-01-16')
SELECT run, count(*) AS n, count(*) FILTER (WHERE coalesce(status, 200) >= 400) AS errors,
       round(count(*) FILTER (WHERE coalesce(status, 200) >= 400) / count(*), 4) AS error_rate
FROM u GROUP BY run""", LOG))
def q_combine(spark, d):
    log = _log(spark, d)
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    runs = {"first_half": log.where(F.col("ts") < cut),
            "second_half": log.where(F.col("ts") >= cut).drop("error", "timed_out")}
    return round_doubles(I.error_rate(I.combine_runs(runs), by=["run"]))


register("i12_request_rate_sliding", with_views("""
WITH w AS (SELECT service,
                  make_timestamp(CAST((floor(epoch_us(ts) / 60000000) - i) * 60000000 AS BIGINT)) AS ws
           FROM request_log, range(0, 5) t(i))
SELECT ws AS window_start, ws + INTERVAL 5 MINUTE AS window_end, service, count(*) AS requests,
       round(count(*) / 300.0, 4) AS rps
FROM w GROUP BY ws, service""", LOG))(
    lambda spark, d: round_doubles(I.request_rate(_log(spark, d), slide="1 minute")))


# ------------------------------------------------------------------ I15 over all rules
# Freshness of each event type on the 30 s grid, and a daily drift figure of
# the latency held for the first five minutes of its day.
def _alert_inputs(spark, d):
    log = _log(spark, d)
    e = V.table(spark, d, "events").select(F.col("event_type").alias("view"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"),
                                           F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    nxt = F.lead("us").over(Window.partitionBy("view").orderBy("us"))
    first = F.ceil(F.col("us") / 30_000_000) * 30_000_000
    points = e.withColumn("next", nxt).where(first < F.col("next")) \
              .select("view", "us", F.explode(F.sequence(first, F.col("next") - 1, F.lit(30_000_000).cast("long"))).alias("p"))
    fresh = points.select("view", F.timestamp_micros("p").cast("timestamp_ntz").alias("window_start"),
                          ((F.col("p") - F.col("us")) / 1e6).alias("value"))
    daily = log.groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.avg("latency_ms").alias("m"))
    whole = log.agg(F.avg("latency_ms").alias("mean"), F.stddev_samp("latency_ms").alias("std"))
    steps = F.explode(F.sequence(F.lit(0), F.lit(270), F.lit(30))).alias("s")
    drift = daily.crossJoin(whole).select(F.lit("latency").alias("model"), "day", steps, (
        F.least(F.lit(1.0), F.abs(F.col("m") - F.col("mean")) / F.col("std"))).alias("value"))
    start = (F.unix_micros(F.col("day").cast("timestamp")) + F.col("s") * 1_000_000).cast("long")
    return log, fresh, drift.select("model", F.timestamp_micros(start).cast("timestamp_ntz").alias("window_start"), "value")


def _islands(rule: str, key: str) -> str:
    bound, hold = I.ALERT_RULES[rule]
    return f"""
SELECT '{rule}' AS rule, series, make_timestamp(us) AS window_start, round(value, 4) AS value, held AS held_seconds,
       'warning' AS severity
FROM (SELECT *, (us - min(us) OVER (PARTITION BY series, island)) / 1e6 AS held
      FROM (SELECT *, sum(nw) OVER (PARTITION BY series ORDER BY us ROWS UNBOUNDED PRECEDING) AS island
            FROM (SELECT *, CAST(NOT cond OR lag(us) OVER w IS NULL OR us - lag(us) OVER w <> 30000000
                                 OR NOT coalesce(lag(cond) OVER w, false) AS INTEGER) AS nw
                  FROM (SELECT *, coalesce(value > {bound}, false) AS cond FROM {key}) a
                  WINDOW w AS (PARTITION BY series ORDER BY us)) b) c) e
WHERE cond AND held >= {hold}"""


@register("i15_alert_rules", with_views(f"""
WITH wins AS (SELECT CAST(service AS VARCHAR) AS series, status, latency_ms,
                     CAST(floor(epoch_us(ts) / 30000000) - i AS BIGINT) * 30000000 AS us
              FROM request_log, range(0, 10) t(i)),
errs AS (SELECT series, us, count(*) FILTER (WHERE coalesce(status, 200) >= 400) / count(*) AS value
         FROM wins GROUP BY series, us),
les(b, le) AS (VALUES {_LE_SQL}),
cnt AS (SELECT series, us, {_IDX_SQL} AS b, count(*) AS c FROM wins WHERE latency_ms IS NOT NULL GROUP BY 1, 2, 3),
tot AS (SELECT series, us, b, c, sum(c) OVER (PARTITION BY series, us) AS total,
               sum(c) OVER (PARTITION BY series, us ORDER BY b) AS upto FROM cnt),
hit AS (SELECT series, us, arg_min((b, c, upto, total), b) AS h FROM tot WHERE upto >= 0.99 * total GROUP BY series, us),
p99 AS (SELECT series, us, CASE WHEN le.le = 'inf'::DOUBLE THEN lo.le
                                ELSE coalesce(lo.le, 0.0) + (le.le - coalesce(lo.le, 0.0))
                                     * (0.99 * h[4] - (h[3] - h[2])) / h[2] END AS value
        FROM hit JOIN les le ON le.b = h[1] LEFT JOIN les lo ON lo.b = h[1] - 1),
ev AS (SELECT event_type AS series, epoch_us(ts) AS e, lead(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts) AS nx
       FROM events),
fresh AS (SELECT series, p AS us, (p - e) / 1e6 AS value
          FROM (SELECT series, e, unnest(generate_series(CAST(ceil(e / 30000000) AS BIGINT) * 30000000, nx - 1, 30000000)) AS p
                FROM ev WHERE nx IS NOT NULL AND CAST(ceil(e / 30000000) AS BIGINT) * 30000000 < nx) x),
daily AS (SELECT date_trunc('day', ts) AS day, avg(latency_ms) AS m FROM request_log GROUP BY 1),
whole AS (SELECT avg(latency_ms) AS mean, stddev_samp(latency_ms) AS std FROM request_log),
drift AS (SELECT 'latency' AS series, epoch_us(CAST(day AS TIMESTAMP)) + s * 1000000 AS us,
                 least(1.0, abs(m - mean) / std) AS value FROM daily, whole, range(0, 300, 30) r(s))
{_islands('ModelLatencyHigh', 'p99')}
UNION ALL {_islands('ErrorRateHigh', 'errs')}
UNION ALL {_islands('FeatureFreshnessStale', 'fresh')}
UNION ALL {_islands('DataDriftDetected', 'drift')}""", LOG))
def q_alert_rules(spark, d):
    return round_doubles(I.alert_rules(*_alert_inputs(spark, d)))
