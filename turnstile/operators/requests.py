"""I — request/response log analytics: latency, errors, fraud quality, alerts.

Log columns used: ``ts, service, latency_ms, status, blocked, is_fraud,
fraud_score, timed_out, error`` (absent columns take the reference's
defaults).  Every metric is a grouped aggregate, optionally ``by`` some
keys; order statistics go through :mod:`turnstile.functions.ordered` so a
hot service never needs a single-task sort.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstile.functions.ordered import interpolated_percentiles, order_statistics
from turnstile.functions.scalars import safe_div
from turnstile.session import reuse

# Fixed values from the reference: SLA limits, thresholds, histogram buckets.
SLA_LIMITS_MS = {"p50": 50.0, "p95": 150.0, "p99": 200.0}
FRAUD_SCORE_THRESHOLD = 0.7
MIN_RECALL, MIN_PRECISION = 0.90, 0.85
BUSINESS_MIN_RECALL = 0.95
FALLBACK_LATENCY_MS = 200.0
EXPECTATION_TOLERANCE = 0.10
ERROR_RATIO_ALERT = 0.01
LATENCY_P99_ALERT_S = 0.2
# Default latency histogram bucket bounds (seconds) of the metrics client, +Inf last.
PROM_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0, float("inf"))


def _col_or(df: DataFrame, name: str, default) -> Column:
    return F.col(name) if name in df.columns else F.lit(default)


def _global_or_grouped(df: DataFrame, by, *aggs) -> DataFrame:
    by = list(by)
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


# ---------------------------------------------------------------- I1
def latency_percentiles(log: DataFrame, by=(), col: str = "latency_ms") -> DataFrame:
    """Linear-interpolated p50/p95/p99 (exact); no rows → 0."""
    st = interpolated_percentiles(log.select(*by, col), col, {"p50": 0.50, "p95": 0.95, "p99": 0.99}, by)
    return st.select(*by, F.coalesce("n", F.lit(0)).alias("n"),
                     *[F.coalesce(F.col(p), F.lit(0.0)).alias(f"{p}_latency_ms") for p in ("p50", "p95", "p99")])


# ---------------------------------------------------------------- I2
def latency_sla(log: DataFrame, limits: dict | None = None, by=(), col: str = "latency_ms") -> DataFrame:
    """Order statistic at index int(p·(n−1)); pass ⇔ every pXX ≤ its limit."""
    limits = limits or SLA_LIMITS_MS
    probs = {"p50": 0.50, "p95": 0.95, "p99": 0.99}
    st = order_statistics(log.select(*by, col), col,
                          {f"{k}_ms": (lambda n, p=p: F.floor(F.lit(p) * (n - 1))) for k, p in probs.items()}, by)
    ok = reduce(lambda a, b: a & b, [F.col(f"{k}_ms") <= F.lit(limits[k]) for k in probs])
    has = F.coalesce(F.col("n"), F.lit(0)) > 0
    return st.select(*by, F.coalesce("n", F.lit(0)).alias("n"), *[f"{k}_ms" for k in probs],
                     F.when(has, F.coalesce(ok, F.lit(False))).otherwise(F.lit(False)).alias("passed"),
                     F.when(~has, F.lit("no latency data")).alias("reason"))


# ---------------------------------------------------------------- I3
def is_error(log: DataFrame, rule: str = "status") -> Column:
    """rule ``status``: status ≥ 400 (missing = 200); rule ``non2xx``: outside
    200-299 (a transport failure is one error, not two — SURVEY R8)."""
    st = F.coalesce(_col_or(log, "status", 200), F.lit(200))
    if rule == "status":
        return st >= 400
    return (st < 200) | (st >= 300)


def error_rate(log: DataFrame, rule: str = "status", by=()) -> DataFrame:
    """Errors / rows."""
    err = is_error(log, rule)
    return _global_or_grouped(log, by, F.count(F.lit(1)).alias("n"), F.count_if(err).alias("errors")) \
        .withColumn("error_rate", safe_div(F.col("errors"), F.col("n")))


# ---------------------------------------------------------------- I4
def throughput(log: DataFrame, duration_s: float | None = None, ts: str = "ts") -> DataFrame:
    """I4: mean rate = rows / duration (the reference's "peak_rps") and the
    true peak = max rows in one 1-second tumbling window."""
    per_sec = log.groupBy(F.date_trunc("second", F.col(ts).cast("timestamp")).alias("_s")).agg(
        F.count(F.lit(1)).alias("_c"))
    peak = per_sec.agg(F.coalesce(F.max("_c"), F.lit(0)).alias("peak_rps"))
    tot = log.agg(F.count(F.lit(1)).alias("n"),
                  ((F.unix_micros(F.max(F.col(ts).cast("timestamp"))) -
                    F.unix_micros(F.min(F.col(ts).cast("timestamp")))) / 1e6).alias("_span"))
    dur = F.lit(float(duration_s)) if duration_s else F.greatest(F.coalesce(F.col("_span"), F.lit(0.0)), F.lit(1.0))
    return tot.crossJoin(peak).select("n", dur.alias("duration_seconds"),
                                      (F.col("n") / dur).alias("mean_rps"), F.col("peak_rps").cast("long"))


# ---------------------------------------------------------------- I5
def timeout_count(log: DataFrame, by=()) -> DataFrame:
    """Rows with timed_out or error = 'timeout'."""
    t = F.coalesce(_col_or(log, "timed_out", False), F.lit(False)) | \
        F.coalesce(_col_or(log, "error", None) == "timeout", F.lit(False))
    return _global_or_grouped(log, by, F.count_if(t).alias("timeout_count"))


# ---------------------------------------------------------------- I6
def fraud_rates(log: DataFrame, by=()) -> DataFrame:
    """Recall (and as %), precision of ``blocked`` against ``is_fraud``."""
    b = F.coalesce(F.col("blocked"), F.lit(False))
    f = F.coalesce(F.col("is_fraud"), F.lit(False))
    g = _global_or_grouped(log, by, F.count_if(b & f).alias("true_positives"),
                           F.count_if(f).alias("actual_fraud"), F.count_if(b).alias("blocked"))
    return g.select(*by, "true_positives", "actual_fraud", "blocked",
                    safe_div(F.col("true_positives"), F.col("actual_fraud")).alias("fraud_recall"),
                    (safe_div(F.col("true_positives"), F.col("actual_fraud")) * 100).alias("fraud_detected_pct"),
                    safe_div(F.col("true_positives"), F.col("blocked")).alias("fraud_precision"))


# ---------------------------------------------------------------- I7
def confusion_metrics(log: DataFrame, threshold: float = FRAUD_SCORE_THRESHOLD, by=(),
                      actual: str = "is_fraud", predicted: str = "blocked", score: str = "fraud_score") -> DataFrame:
    """predicted = blocked or score > threshold; tp/fp/fn, precision,
    recall, F1; passed ⇔ recall ≥ 0.90 and precision ≥ 0.85; empty → fails."""
    y = F.coalesce(_col_or(log, actual, False), F.lit(False))
    p = F.coalesce(_col_or(log, predicted, False), F.lit(False)) | \
        (F.coalesce(_col_or(log, score, 0.0), F.lit(0.0)) > F.lit(threshold))
    g = _global_or_grouped(log, by, F.count(F.lit(1)).alias("n"), F.count_if(y & p).alias("tp"),
                           F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"))
    prec = safe_div(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = safe_div(F.col("tp"), F.col("tp") + F.col("fn"))
    g = g.withColumn("precision", prec).withColumn("recall", rec)
    f1 = safe_div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    passed = (F.col("n") > 0) & (F.col("recall") >= MIN_RECALL) & (F.col("precision") >= MIN_PRECISION)
    return g.select(*by, "n", "tp", "fp", "fn", "precision", "recall", f1.alias("f1"), passed.alias("passed"),
                    F.when(F.col("n") == 0, F.lit("no responses")).alias("reason"))


# ---------------------------------------------------------------- I8
def business_metrics(log: DataFrame, txns: DataFrame | None = None,
                     min_recall: float = BUSINESS_MIN_RECALL) -> DataFrame:
    """I8: fraud recall, blocked %, mean amount of completed transactions."""
    b = F.coalesce(F.col("blocked"), F.lit(False))
    f = F.coalesce(F.col("is_fraud"), F.lit(False))
    r = log.agg(F.count(F.lit(1)).alias("n"), F.count_if(b & f).alias("_tp"),
                F.count_if(f).alias("_fr"), F.count_if(b).alias("_bl"))
    if txns is not None:
        done = F.col("payment_status") == "completed"
        rev = txns.agg(F.coalesce(F.avg(F.when(done, F.coalesce(F.col("total_amount"), F.lit(0.0)))),
                                  F.lit(0.0)).alias("revenue_impact"))
    else:
        rev = log.sparkSession.range(1).select(F.lit(0.0).alias("revenue_impact"))
    recall = safe_div(F.col("_tp"), F.col("_fr"))
    return r.crossJoin(rev).select(
        recall.alias("fraud_recall"), (safe_div(F.col("_bl"), F.col("n")) * 100).alias("fraud_blocked_pct"),
        "revenue_impact", ((F.col("n") > 0) & (recall >= F.lit(min_recall))).alias("passed"),
        F.when(F.col("n") == 0, F.lit("no responses")).alias("reason"))


# ---------------------------------------------------------------- I9
def fallback_share(log: DataFrame, limit_ms: float = FALLBACK_LATENCY_MS, by=()) -> DataFrame:
    """% of rows slower than the fallback limit (missing latency = 0)."""
    slow = F.coalesce(F.col("latency_ms"), F.lit(0.0)) > F.lit(limit_ms)
    return _global_or_grouped(log, by, (F.coalesce(F.avg(slow.cast("double")), F.lit(0.0)) * 100)
                              .alias("fallback_used_pct"))


# ---------------------------------------------------------------- I10
def check_expectations(actual: DataFrame, expected: DataFrame,
                       tolerance: float = EXPECTATION_TOLERANCE) -> DataFrame:
    """I10 per metric: ``actual(metric, value)`` vs ``expected(metric, expected)``;
    missing → failure; |a − e| / (e or 1) > tolerance → failure."""
    j = expected.join(actual, "metric", "left")
    denom = F.when(F.col("expected") != 0, F.col("expected")).otherwise(F.lit(1.0))
    rel = F.abs(F.col("value") - F.col("expected")) / denom
    ok = F.when(F.col("value").isNull(), F.lit(False)).otherwise(rel <= F.lit(tolerance))
    why = (F.when(F.col("value").isNull(), F.concat(F.lit("Metric '"), F.col("metric"), F.lit("' not found in results")))
            .when(~ok, F.format_string("%s: expected %.4f, got %.4f", "metric", "expected", "value")))
    return j.select("metric", "expected", F.col("value").alias("actual"), rel.alias("relative_error"),
                    ok.alias("passed"), why.alias("failure"))


def expectations_passed(checks: DataFrame) -> DataFrame:
    """I10 overall: pass ⇔ no failures."""
    return checks.agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"),
                      F.count_if(~F.col("passed")).alias("n_failures"))


# ---------------------------------------------------------------- I11
def latency_histogram(log: DataFrame, bins: int = 50, col: str = "latency_ms") -> DataFrame:
    """Equal-width histogram; the maximum goes in the last bin.
    Range from a one-row min/max aggregate; only non-empty bins are returned.
    Null, NaN and infinite values are in no bin."""
    v = log.select(F.col(col).cast("double").alias("v")).where(F.abs("v") < float("inf"))
    rng = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    idx = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))).cast("int")
    h = v.crossJoin(F.broadcast(rng)).select(idx.alias("bin"), "lo", "hi").groupBy("bin", "lo", "hi").agg(
        F.count(F.lit(1)).alias("count"))
    w = F.when(F.col("hi") == F.col("lo"), F.lit(0.0)).otherwise((F.col("hi") - F.col("lo")) / F.lit(float(bins)))
    return h.select("bin", (F.col("lo") + F.col("bin") * w).alias("bin_start"),
                    (F.col("lo") + (F.col("bin") + 1) * w).alias("bin_end"), "count")


# ---------------------------------------------------------------- I12 / I13
def _win(ts: str, window: str, slide: str | None):
    return F.window(F.col(ts), window, slide) if slide else F.window(F.col(ts), window)


def request_rate(log: DataFrame, window: str = "5 minutes", by=("service",), ts: str = "ts",
                 slide: str | None = None) -> DataFrame:
    """Per-second request rate per window and key (tumbling, or
    sliding with ``slide`` like a range rate evaluated every step)."""
    g = log.groupBy(_win(ts, window, slide).alias("w"), *by).agg(F.count(F.lit(1)).alias("requests"))
    span = (F.unix_micros(F.col("w.end").cast("timestamp")) - F.unix_micros(F.col("w.start").cast("timestamp"))) / 1e6
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by,
                    "requests", (F.col("requests") / span).alias("rps"))


def error_ratio(log: DataFrame, window: str = "5 minutes", by=("service",), ts: str = "ts",
                rule: str = "status", alert_above: float = ERROR_RATIO_ALERT, slide: str | None = None) -> DataFrame:
    """Errors / requests per window and key; alert when > 1 %."""
    err = is_error(log, rule)
    g = log.groupBy(_win(ts, window, slide).alias("w"), *by).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(err).alias("errors"))
    ratio = F.col("errors") / F.col("requests")
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by,
                    "requests", "errors", ratio.alias("error_ratio"), (ratio > F.lit(alert_above)).alias("alert"))


# ---------------------------------------------------------------- I14
def latency_buckets(log: DataFrame, by=("service",), col: str = "latency_ms",
                    bounds=PROM_BUCKETS, scale: float = 1e-3) -> DataFrame:
    """Cumulative ``le`` bucket counts (the metrics client's histogram) from raw rows.

    The per-(key, bucket) counts are tiny (keys × 15) and materialised once;
    the key grid and the cumulative window read that copy, not the log."""
    v = F.col(col) * F.lit(scale)
    finite = [b for b in bounds if b != float("inf")]
    idx = reduce(lambda acc, b: F.when(v <= F.lit(b[1]), F.lit(b[0])).otherwise(acc),
                 reversed(list(enumerate(finite))), F.lit(len(finite)))
    counts = reuse(log.where(F.col(col).isNotNull()).groupBy(*by, idx.alias("_b"))
                   .agg(F.count(F.lit(1)).alias("_c")))
    les = F.array(*[F.struct(F.lit(i).alias("_b"), F.lit(float(b)).alias("le")) for i, b in enumerate(bounds)])
    grid = counts.select(*by).distinct().select(*by, F.inline(les))  # every key × the fixed bucket bounds
    j = grid.join(counts, [*by, "_b"], "left").fillna(0, subset=["_c"])
    w = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    return j.select(*by, "le", F.sum("_c").over(w).alias("count"), "_b")


def histogram_quantile(buckets: DataFrame, q, by=("service",)) -> DataFrame:
    """quantile(s) from cumulative ``le`` buckets, interpolating linearly
    inside the bucket; a rank in the +Inf bucket returns the highest finite
    bound.  ``q`` may be one value or a list (all computed in one pass)."""
    by = list(by)
    qs = list(q) if isinstance(q, (list, tuple)) else [q]
    w = Window.partitionBy(*by).orderBy("le")
    b = (buckets.withColumn("_prev_le", F.lag("le").over(w)).withColumn("_prev_c", F.lag("count").over(w))
                .withColumn("_total", F.max("count").over(Window.partitionBy(*by)))
                .withColumn("_max_finite", F.max(F.when(~F.isnan("le") & (F.col("le") != float("inf")),
                                                        F.col("le"))).over(Window.partitionBy(*by))))
    b = b.select("*", F.explode(F.array(*[F.lit(float(x)) for x in qs])).alias("q"))
    rank = F.col("q") * F.col("_total")
    hit = b.where((F.col("count") >= rank) & (F.col("_total") > 0))
    first = hit.groupBy(*by, "q").agg(F.min_by(F.struct("le", "count", "_prev_le", "_prev_c", "_total", "_max_finite"),
                                               F.col("le")).alias("h"))
    lo = F.coalesce(F.col("h._prev_le"), F.lit(0.0))
    pc = F.coalesce(F.col("h._prev_c"), F.lit(0)).cast("double")
    r = F.col("q") * F.col("h._total")
    val = (F.when(F.col("h.le") == float("inf"), F.col("h._max_finite"))
            .when(F.col("h._prev_le").isNull() & (F.col("h.le") <= 0), F.col("h.le"))
            .otherwise(lo + (F.col("h.le") - lo) * (r - pc) / (F.col("h.count") - pc)))
    return first.select(*by, "q", val.alias("value"))


# ---------------------------------------------------------------- I15
def sustained_alerts(series: DataFrame, condition: Column, hold_seconds: int, step_seconds: int,
                     key=("service",), ts: str = "window_start", severity: str = "warning") -> DataFrame:
    """A condition fires once it has held for ``hold`` without a break
    (gaps-and-islands: a false point or a missing step starts a new island)."""
    key = list(key)
    w = Window.partitionBy(*key).orderBy(ts)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    s = series.withColumn("_cond", F.coalesce(condition, F.lit(False))).withColumn("_us", us)
    prev_us = F.lag("_us").over(w)
    prev_c = F.lag("_cond").over(w)
    brk = (~F.col("_cond")) | prev_us.isNull() | (F.col("_us") - prev_us != F.lit(step_seconds * 1_000_000)) | \
        (~F.coalesce(prev_c, F.lit(False)))
    s = s.withColumn("_new", brk.cast("int")).withColumn(
        "_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    wi = Window.partitionBy(*key, "_island")
    s = s.withColumn("_start_us", F.min("_us").over(wi))
    held = (F.col("_us") - F.col("_start_us")) / 1e6
    firing = F.col("_cond") & (held >= F.lit(hold_seconds))
    return s.select(*[c for c in series.columns], F.col("_cond").alias("condition"),
                    F.when(F.col("_cond"), held).alias("held_seconds"), firing.alias("firing"),
                    F.when(firing, F.lit(severity)).alias("severity"))


# The alert rules (condition bound, seconds it must hold), their
# rate window and evaluation step.
ALERT_RULES = {"ModelLatencyHigh": (0.2, 300), "ErrorRateHigh": (0.01, 300), "FeatureFreshnessStale": (300.0, 120),
               "DataDriftDetected": (0.3, 120)}
ALERT_RANGE, ALERT_STEP_S = "5 minutes", 30


def alert_rules(log: DataFrame, freshness: DataFrame, drift: DataFrame, by=("service",), ts: str = "ts",
                col: str = "latency_ms") -> DataFrame:
    """I15 over all four rules: one row per firing point.

    Latency and errors are rates over sliding windows of ``ALERT_RANGE`` every
    ``ALERT_STEP_S`` seconds per key; ``freshness`` and ``drift`` are series
    (``window_start``, ``value``) on the same step.  A rule fires where its
    value has stayed above the bound for its holding time without a gap.
    Returns ``rule, series, window_start, value, held_seconds, severity``.
    """
    by = list(by)
    sliding = f"{ALERT_STEP_S} seconds"
    errors = error_ratio(log, ALERT_RANGE, by, ts, slide=sliding) \
        .select("window_start", *by, F.col("error_ratio").alias("value"))
    windows = log.withColumn("window_start", _win(ts, ALERT_RANGE, sliding).start)
    p99 = histogram_quantile(latency_buckets(windows, [*by, "window_start"], col), 0.99, [*by, "window_start"]) \
        .select("window_start", *by, "value")

    def firing(rule, series, key):
        bound, hold = ALERT_RULES[rule]
        out = sustained_alerts(series, F.col("value") > bound, hold, ALERT_STEP_S, key=key)
        name = F.concat_ws("/", *[F.col(k).cast("string") for k in key]) if key else F.lit("")
        return out.where("firing").select(F.lit(rule).alias("rule"), name.alias("series"), "window_start", "value",
                                          "held_seconds", "severity")
    # The two single series hold one point a step; a constant key stands for them.
    parts = [firing("ModelLatencyHigh", p99, by), firing("ErrorRateHigh", errors, by),
             firing("FeatureFreshnessStale", freshness.withColumn("view", F.col("view").cast("string")), ["view"]),
             firing("DataDriftDetected", drift.withColumn("model", F.col("model").cast("string")), ["model"])]
    return reduce(DataFrame.unionByName, parts)


# ---------------------------------------------------------------- I16
PREDICTION_SCHEMA = "predictions array<struct<fraud_score: double, is_fraud: boolean>>"


def parse_predictions(raw: DataFrame, body: str = "body") -> DataFrame:
    """I16: first prediction of a JSON response body; score default 0, flag
    default score ≥ 0.7, blocked = score > 0.7."""
    first = F.get(F.from_json(F.col(body), PREDICTION_SCHEMA).getField("predictions"), 0)
    score = F.coalesce(first.getField("fraud_score"), F.lit(0.0))
    return raw.select(*[c for c in raw.columns if c != body], score.alias("fraud_score"),
                      F.coalesce(first.getField("is_fraud"), score >= F.lit(FRAUD_SCORE_THRESHOLD)).alias("predicted_is_fraud"),
                      (score > F.lit(FRAUD_SCORE_THRESHOLD)).alias("blocked"))


# ---------------------------------------------------------------- I17
def report_row(metrics: DataFrame) -> DataFrame:
    """The figure a report shows (precision %, else recall %, else
    detected %) and the pass flag; timeouts > 0 force a failure with a reason."""
    cols = set(metrics.columns)
    val = (F.col("fraud_precision") * 100 if "fraud_precision" in cols else
           F.col("fraud_recall") * 100 if "fraud_recall" in cols else
           F.coalesce(_col_or(metrics, "fraud_detected_pct", 0.0), F.lit(0.0)))
    label = ("Fraud Precision" if "fraud_precision" in cols else
             "Fraud Recall" if "fraud_recall" in cols else "Fraud Detected")
    to = F.coalesce(_col_or(metrics, "timeout_count", 0), F.lit(0))
    base_fail = _col_or(metrics, "failures", None).cast("string")
    to_msg = F.when(to > 0, F.concat(F.lit("timeouts: expected 0, got "), to.cast("long").cast("string")))
    failures = F.concat_ws("; ", base_fail, to_msg)
    passed = F.coalesce(_col_or(metrics, "passed", True), F.lit(False)) & (to <= 0)
    return metrics.select(val.cast("double").alias("fraud_metric_value"), F.lit(label).alias("fraud_metric_label"),
                          passed.alias("passed"), failures.alias("failures"))


# ---------------------------------------------------------------- I18
def combine_runs(runs: dict[str, DataFrame]) -> DataFrame:
    """Concatenate several runs' logs by column name, tagged with ``run``."""
    parts = [df.withColumn("run", F.lit(name)) for name, df in runs.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
