"""F — drift scores, performance comparison, alert and retrain decisions.

All statistics are aggregates: each side is reduced to one row (means,
sample std) or to per-(column, value) counts, so the work is partially
aggregated map-side and only tiny frames are joined.  Per-column results are
long tables ``(column, ...)``; summaries are one-row frames.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnstile.functions.ordered import COARSE, FINE, value_bucket
from turnstile.functions.scalars import numeric_columns
from turnstile.session import path_exists, reuse

# Thresholds of the reference's monitoring code.
DRIFT_THRESHOLD = 0.3          # detection (>=) for scores in [0, 1]
PERFORMANCE_DROP_THRESHOLD = 0.1
STD_EPSILON = 1e-8
# Our per-column test choice for F4 (the reference delegates it to a library):
KS_ALPHA = 0.05                # two-sample KS at 5 %
JS_THRESHOLD = 0.1             # Jensen-Shannon distance for categorical columns


def common_numeric(ref: DataFrame, cur: DataFrame, cols=None) -> list[str]:
    cols = cols or numeric_columns(ref)
    cur_num = set(numeric_columns(cur))
    return [c for c in cols if c in cur_num and c in ref.columns]


# ---------------------------------------------------------------- F1
def _moments(ref: DataFrame, cur: DataFrame, cols: list[str]) -> DataFrame:
    """One row: row counts, reference means and sample stds, current means
    (one aggregate pass per side)."""
    r = ref.agg(F.count(F.lit(1)).alias("_rn"),
                *[F.avg(F.col(c).cast("double")).alias(f"rm_{c}") for c in cols],
                *[F.stddev_samp(F.col(c).cast("double")).alias(f"rs_{c}") for c in cols])
    k = cur.agg(F.count(F.lit(1)).alias("_cn"), *[F.avg(F.col(c).cast("double")).alias(f"cm_{c}") for c in cols])
    return r.crossJoin(k)


def _moments_split(df: DataFrame, is_ref: Column, cols: list[str]) -> DataFrame:
    """``_moments`` for two sides of one table in a single aggregate pass;
    ``is_ref`` true → reference row, false → current row, null → neither."""
    ref, cur = F.coalesce(is_ref, F.lit(False)), F.coalesce(~is_ref, F.lit(False))
    return df.agg(F.count_if(ref).alias("_rn"), F.count_if(cur).alias("_cn"),
                  *[F.avg(F.when(ref, F.col(c).cast("double"))).alias(f"rm_{c}") for c in cols],
                  *[F.stddev_samp(F.when(ref, F.col(c).cast("double"))).alias(f"rs_{c}") for c in cols],
                  *[F.avg(F.when(cur, F.col(c).cast("double"))).alias(f"cm_{c}") for c in cols])


def _score(c: str) -> Column:
    rs = F.col(f"rs_{c}")
    std = F.when(rs.isNull() | (rs == 0) | F.isnan(rs), F.lit(1.0)).otherwise(rs)
    # least() skips nulls: an undefined mean scores 1.0 like the reference's min(1.0, nan)
    return F.least(F.lit(1.0), F.abs(F.col(f"cm_{c}") - F.col(f"rm_{c}")) / (std + F.lit(STD_EPSILON)))


def mean_shift_scores(ref: DataFrame, cur: DataFrame, cols=None) -> DataFrame:
    """F1 per column: min(1, |mean_cur - mean_ref| / (std_ref + 1e-8)),
    sample std; a null/zero std counts as 1."""
    cols = common_numeric(ref, cur, cols)
    if not cols:
        return ref.sparkSession.createDataFrame(
            [], "column string, ref_mean double, cur_mean double, ref_std double, score double")
    return _scores_long(_moments(ref, cur, cols), cols)


def _scores_long(one: DataFrame, cols: list[str]) -> DataFrame:
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"rm_{c}").alias("ref_mean"), F.col(f"cm_{c}").alias("cur_mean"),
                 F.col(f"rs_{c}").alias("ref_std"), _score(c).alias("score")) for c in cols])))


def mean_shift_scores_split(df: DataFrame, is_ref: Column, cols) -> DataFrame:
    """F1 per column for two sides of one table (one pass)."""
    return _scores_long(_moments_split(df, is_ref, list(cols)), list(cols))


def mean_shift_drift_split(df: DataFrame, is_ref: Column, cols, threshold: float = DRIFT_THRESHOLD) -> DataFrame:
    """F1 summary for two sides of one table (one pass)."""
    cols = list(cols)
    return _summary_from(_moments_split(df, is_ref, cols), cols, threshold).drop("_rn", "_cn")


def _summary_from(one: DataFrame, cols: list[str], threshold: float) -> DataFrame:
    """Overall score, flag and score map as expressions over the moments row
    (no second aggregation, so each side is read once)."""
    if cols:
        scores = F.array(*[_score(c) for c in cols])
        overall = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.lit(float(len(cols)))
        cmap = F.map_from_arrays(F.array(*[F.lit(c) for c in cols]), scores)
    else:
        overall = F.lit(0.0)
        cmap = F.create_map().cast("map<string,double>")
    return one.select(overall.alias("drift_score"), F.lit(len(cols)).cast("long").alias("n_columns"),
                      cmap.alias("column_scores"), "_rn", "_cn") \
              .withColumn("drift_detected", drift_decision(F.col("drift_score"), threshold))


def summarize_scores(scores: DataFrame, threshold: float = DRIFT_THRESHOLD) -> DataFrame:
    """Overall = plain mean of per-column scores (0 without columns); F2 flag."""
    one = scores.agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("drift_score"),
                     F.count(F.lit(1)).alias("n_columns"),
                     F.map_from_entries(F.collect_list(F.struct("column", "score"))).alias("column_scores"))
    return one.withColumn("drift_detected", drift_decision(F.col("drift_score"), threshold))


def mean_shift_drift(ref: DataFrame, cur: DataFrame, cols=None, threshold: float = DRIFT_THRESHOLD) -> DataFrame:
    """F1 summary row: drift_score, n_columns, column_scores map, drift_detected."""
    cols = common_numeric(ref, cur, cols)
    return _summary_from(_moments(ref, cur, cols), cols, threshold).drop("_rn", "_cn")


# ---------------------------------------------------------------- F2
def drift_decision(score: Column, threshold: float = DRIFT_THRESHOLD) -> Column:
    """F2: detected ⇔ score ≥ threshold (inclusive)."""
    return score >= F.lit(threshold)


# ---------------------------------------------------------------- F3
def ratio_drift(ref: DataFrame, cur: DataFrame, cols, threshold: float = DRIFT_THRESHOLD) -> DataFrame:
    """per column |mean_cur - mean_ref| / mean_ref (signed denominator,
    0 → 1); columns without values on a side are skipped; overall = mean,
    capped at 1 above only; passed ⇔ overall < 0.30; an empty side → passed, 0."""
    cols = [c for c in cols if c in ref.columns and c in cur.columns]
    r = ref.agg(F.count(F.lit(1)).alias("_rn"), *[F.avg(F.col(c).cast("double")).alias(f"rm_{c}") for c in cols])
    k = cur.agg(F.count(F.lit(1)).alias("_cn"), *[F.avg(F.col(c).cast("double")).alias(f"cm_{c}") for c in cols])
    one = r.crossJoin(k)
    parts = []
    for c in cols:
        rm, cm = F.col(f"rm_{c}"), F.col(f"cm_{c}")
        denom = F.when(rm != 0, rm).otherwise(F.lit(1.0))
        parts.append(F.when(rm.isNotNull() & cm.isNotNull(), F.abs(cm - rm) / denom))
    arr = F.filter(F.array(*parts), lambda x: x.isNotNull()) if parts else F.array().cast("array<double>")
    mean = F.when(F.size(arr) > 0, F.aggregate(arr, F.lit(0.0), lambda a, x: a + x) / F.size(arr)) \
            .otherwise(F.lit(0.0))
    empty = (F.col("_rn") == 0) | (F.col("_cn") == 0)
    score = F.when(empty, F.lit(0.0)).otherwise(F.least(F.lit(1.0), mean))
    return one.select(score.alias("drift_score"), (score < F.lit(threshold)).alias("passed"),
                      F.when(empty, F.lit("insufficient data")).alias("reason"),
                      F.size(arr).alias("n_columns"))


# ---------------------------------------------------------------- F4
def _ks_critical(n: Column, m: Column, alpha: float = KS_ALPHA) -> Column:
    c = math.sqrt(-math.log(alpha / 2) / 2)
    return F.lit(c) * F.sqrt((n + m) / (n * m))


def _stack_values(df: DataFrame, num: list[str], cat: list[str], rc: Column, cc: Column) -> DataFrame:
    items = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v"),
                      F.lit(None).cast("string").alias("s")) for c in num]
    items += [F.struct(F.lit(c).alias("column"), F.lit(None).cast("double").alias("v"),
                       F.col(c).alias("s")) for c in cat]
    return df.select(rc.alias("rc"), cc.alias("cc"), F.inline(F.array(*items)))


def _ks_buckets(values: DataFrame) -> DataFrame:
    """Every fine bucket of ``values`` (column, v, rc, cc, b, f) with counts of
    both sides, the totals before it, the distance of the two distribution
    functions at its ``end`` and the ``most`` that it could be inside.

    One pass counts fine buckets, map-side; totals come from prefix scans over
    coarse buckets (a few thousand a column) and, side by side, over the fine
    buckets of each."""
    counts = [F.sum("rc").alias("rc"), F.sum("cc").alias("cc")]
    # Bounded by the buckets, whatever the rows: FINE an octave and column.
    fine = reuse(values.groupBy("column", "b", "f").agg(*counts, F.min("v").alias("lo"), F.max("v").alias("hi")))
    whole = Window.partitionBy("column")

    def before(c: str, window: Window) -> Column:
        return F.coalesce(F.sum(c).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    coarse = fine.groupBy("column", "b").agg(*counts).select(
        "column", "b", before("rc", whole.orderBy("b")).alias("r0"), before("cc", whole.orderBy("b")).alias("c0"),
        F.sum("rc").over(whole).alias("n_ref"), F.sum("cc").over(whole).alias("n_cur"))
    inner = Window.partitionBy("column", "b").orderBy("f")
    t = fine.join(coarse.where("n_ref > 0 and n_cur > 0"), ["column", "b"]) \
            .withColumn("r0", F.col("r0") + before("rc", inner)).withColumn("c0", F.col("c0") + before("cc", inner))
    r0, r1 = F.col("r0") / F.col("n_ref"), (F.col("r0") + F.col("rc")) / F.col("n_ref")
    c0, c1 = F.col("c0") / F.col("n_cur"), (F.col("c0") + F.col("cc")) / F.col("n_cur")
    return t.withColumn("end", F.abs(r1 - c1)).withColumn("most", F.greatest(r1 - c0, c1 - r0))


def _ks_opened(t: DataFrame) -> DataFrame:
    """Buckets of several values that could beat the best end of their column.
    Where both sides are alike the best end shrinks with the root of the
    rows, but a fine bucket holds a millionth of them, so few are opened."""
    best = t.groupBy("column").agg(F.max("end").alias("best"))
    return t.join(F.broadcast(best), "column").where("most > best and lo < hi").select(
        "column", "b", "f", "r0", "c0", "n_ref", "n_cur")  # best: one row a column


def _ks_statistics(stacked: DataFrame) -> DataFrame:
    """(column, n_ref, n_cur, statistic): the largest distance of two empirical
    distribution functions, exactly.

    The distance at every fine bucket's end is known after one pass; a second
    pass counts by value inside the few buckets that could exceed it.  No task
    sees more than a bucket of values or a table of buckets."""
    values = stacked.where(F.col("v").isNotNull()).withColumn("b", value_bucket(F.col("v"), COARSE)) \
                    .withColumn("f", value_bucket(F.col("v"), FINE))
    t = reuse(_ks_buckets(values))
    found = t.select("column", "n_ref", "n_cur", F.col("end").alias("d"))
    opened = reuse(_ks_opened(t))
    if not opened.isEmpty():
        inside = values.join(opened.select("column", "b", "f"), ["column", "b", "f"], "left_semi") \
                       .groupBy("column", "b", "f", "v").agg(F.sum("rc").alias("rc"), F.sum("cc").alias("cc")) \
                       .join(opened, ["column", "b", "f"])
        up_to = Window.partitionBy("column", "b", "f").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        gap = F.abs((F.col("r0") + F.sum("rc").over(up_to)) / F.col("n_ref")
                    - (F.col("c0") + F.sum("cc").over(up_to)) / F.col("n_cur"))
        found = found.unionByName(inside.select("column", "n_ref", "n_cur", gap.alias("d")))
    return found.groupBy("column", "n_ref", "n_cur").agg(F.max("d").alias("statistic"))


def _tests_from_stack(stacked: DataFrame, num: list[str], cat: list[str]) -> DataFrame:
    parts = []
    if num:
        d = _ks_statistics(stacked.where(F.col("column").isin(*num)))
        thr = _ks_critical(F.col("n_ref").cast("double"), F.col("n_cur").cast("double"))
        parts.append(d.select("column", F.lit("ks").alias("kind"), "statistic", thr.alias("threshold")))
    if cat:
        counts = stacked.where(F.col("column").isin(*cat)).groupBy("column", "s") \
                        .agg(F.sum("rc").alias("rc"), F.sum("cc").alias("cc"))
        sizes = counts.groupBy("column").agg(F.sum("rc").alias("n_ref"), F.sum("cc").alias("n_cur")) \
                      .where("n_ref > 0 and n_cur > 0")
        p = F.col("rc") / F.col("n_ref")
        q = F.col("cc") / F.col("n_cur")
        m = (p + q) / 2

        def kl(a):
            return F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
        js = (counts.join(sizes, "column").groupBy("column")
                    .agg(F.sqrt(F.greatest(F.lit(0.0), 0.5 * F.sum(kl(p)) + 0.5 * F.sum(kl(q)))).alias("statistic")))
        parts.append(js.select("column", F.lit("jensen_shannon").alias("kind"), "statistic",
                               F.lit(JS_THRESHOLD).alias("threshold")))
    tested = reduce(DataFrame.unionByName, parts)
    # A column without values on one side has no test: "no data", not drifted.
    every = stacked.sparkSession.createDataFrame([(c,) for c in [*num, *cat]], "column string")
    return every.join(tested, "column", "left").select(
        "column", F.coalesce("kind", F.lit("no data")).alias("kind"), "statistic", "threshold",
        F.coalesce(F.col("statistic") > F.col("threshold"), F.lit(False)).alias("drifted"))


_EMPTY_TESTS = "column string, kind string, statistic double, threshold double, drifted boolean"


def distribution_tests(ref: DataFrame, cur: DataFrame, cols=None) -> DataFrame:
    """F4 per column: numeric → two-sample KS statistic vs its 5 % critical
    value; string → Jensen-Shannon distance (base 2) vs 0.1.

    Long format: (column, kind, statistic, threshold, drifted).  A column
    without values on one side has kind "no data" and null statistics.
    """
    num = common_numeric(ref, cur, cols)
    cat = [c for c, t in ref.dtypes if t == "string" and c in cur.columns and (cols is None or c in cols)]
    if not num and not cat:
        return ref.sparkSession.createDataFrame([], _EMPTY_TESTS)
    stacked = _stack_values(ref, num, cat, F.lit(1), F.lit(0)).unionByName(
        _stack_values(cur, num, cat, F.lit(0), F.lit(1)))
    return _tests_from_stack(stacked, num, cat)


def distribution_tests_split(df: DataFrame, is_ref: Column, cols) -> DataFrame:
    """F4 for two sides of one table, in one pass over it."""
    num = [c for c in cols if c in numeric_columns(df)]
    cat = [c for c, t in df.dtypes if t == "string" and c in cols]
    if not num and not cat:
        return df.sparkSession.createDataFrame([], _EMPTY_TESTS)
    d = df.where(is_ref.isNotNull())
    stacked = _stack_values(d, num, cat, F.when(is_ref, 1).otherwise(0), F.when(is_ref, 0).otherwise(1))
    return _tests_from_stack(stacked, num, cat)


def drifted_share(ref: DataFrame, cur: DataFrame, cols=None, threshold: float = DRIFT_THRESHOLD,
                  tests: DataFrame | None = None) -> DataFrame:
    """F4 summary: share of drifted columns as the drift score (``tests``
    may be passed in, e.g. from ``distribution_tests_split``).  Columns without
    data on a side don't count; where no column has data on both, the score is
    that of F1."""
    t = tests if tests is not None else distribution_tests(ref, cur, cols)
    one = t.agg(F.count_if(F.col("kind") != "no data").alias("n_columns"), F.count_if("drifted").alias("n_drifted"))
    score = F.try_divide(F.col("n_drifted"), F.col("n_columns"))
    if ref is not None and cur is not None:
        one = one.crossJoin(mean_shift_drift(ref, cur, cols).select(F.col("drift_score").alias("_f1")))
        score = F.coalesce(score, F.col("_f1"))
    score = F.coalesce(score, F.lit(0.0))
    return one.select("n_columns", "n_drifted", score.alias("drift_score"),
                      drift_decision(score, threshold).alias("drift_detected"))


# ---------------------------------------------------------------- F5
def prediction_drift(ref: DataFrame, cur: DataFrame, col: str = "prediction") -> DataFrame:
    """drift of the prediction column when both sides have it, else of the whole frame."""
    if col in ref.columns and col in cur.columns:
        return mean_shift_drift(ref.select(col), cur.select(col))
    return mean_shift_drift(ref, cur)


# ---------------------------------------------------------------- F6
def accuracy(df: DataFrame, target: str = "target", pred: str = "prediction") -> Column | None:
    if target not in df.columns or pred not in df.columns:
        return None
    return F.coalesce(F.avg(F.coalesce(F.col(target) == F.col(pred), F.lit(False)).cast("double")), F.lit(0.0))


def compare_performance(ref: DataFrame, cur: DataFrame, target: str = "target",
                        pred: str = "prediction") -> DataFrame:
    """accuracy per side (nulls count as wrong; absent columns → 0)."""
    def one(df, name):
        a = accuracy(df, target, pred)
        if a is None:
            return df.sparkSession.range(1).select(F.lit(0.0).alias(name))
        return df.agg(a.alias(name))
    return one(ref, "accuracy_reference").crossJoin(one(cur, "accuracy_current"))


# ---------------------------------------------------------------- F7
def alert_decision(drift_score: Column, perf_ref: Column | None = None, perf_cur: Column | None = None,
                   drift_threshold: float = DRIFT_THRESHOLD,
                   perf_threshold: float | None = PERFORMANCE_DROP_THRESHOLD) -> Column:
    """drift ≥ threshold, or relative performance drop ≥ perf threshold (ref > 0)."""
    alert = drift_score >= F.lit(drift_threshold)
    if perf_threshold is not None and perf_ref is not None and perf_cur is not None:
        drop = F.when(perf_ref > 0, (perf_ref - perf_cur) / perf_ref)
        alert = alert | F.coalesce(drop >= F.lit(perf_threshold), F.lit(False))
    return alert


# ---------------------------------------------------------------- F8
def drift_metrics(summary: DataFrame) -> DataFrame:
    """F8: metric rows ``ml_data_drift_score`` and ``ml_drift_detected`` (0/1)."""
    return summary.select(F.inline(F.array(
        F.struct(F.lit("ml_data_drift_score").alias("metric"), F.col("drift_score").cast("double").alias("value")),
        F.struct(F.lit("ml_drift_detected").alias("metric"),
                 F.col("drift_detected").cast("int").cast("double").alias("value")))))


# ---------------------------------------------------------------- F9
def drift_summary_record(summary: DataFrame, run_ts: Column, reference_source: str = "seed_regenerated",
                         window_hours: int = 24) -> DataFrame:
    """F9 record: score, flag, column scores, run time, reference, window."""
    return summary.select("drift_score", "drift_detected", "column_scores",
                          run_ts.cast("timestamp").alias("run_ts"),
                          F.lit(reference_source).alias("reference_source"),
                          F.lit(window_hours).alias("target_window_hours"))


def write_drift_summary(record: DataFrame, path: str) -> str:
    """append the JSON summary to a history table partitioned by run date."""
    (record.withColumn("run_date", F.to_date("run_ts"))
           .write.mode("append").partitionBy("run_date").json(path))
    return path


# ---------------------------------------------------------------- F10
def retrain_decision(summary: DataFrame, threshold: float = DRIFT_THRESHOLD) -> DataFrame:
    """needs_retrain ⇔ score ≥ threshold; action label; context kept."""
    needs = F.col("drift_score") >= F.lit(threshold)
    ctx = [c for c in summary.columns if c not in ("drift_score",)]
    return summary.select("drift_score", F.lit(threshold).alias("drift_threshold"), needs.alias("needs_retrain"),
                          F.when(needs, F.lit("trigger_retraining")).otherwise(F.lit("skip_retraining")).alias("action"),
                          *ctx)


# ---------------------------------------------------------------- F11
SUMMARY_SCHEMA = "drift_score double, drift_detected boolean, reference_source string, target_window_hours int, " \
                 "run_ts string"


def collect_drift(spark: SparkSession, summary_path: str | None, predictions: DataFrame | None = None,
                  pred: str = "prediction", label: str = "label") -> DataFrame:
    """latest stored summary; without one (no table, or an empty one), the calibration gap
    |mean(pred) - mean(label)| over real prediction rows."""
    if summary_path and path_exists(spark, summary_path):
        hist = spark.read.schema(SUMMARY_SCHEMA).json(summary_path)
        latest = hist.where("drift_score is not null").agg(F.max_by(F.struct(
            "drift_score", "drift_detected", "reference_source", "run_ts"), F.col("run_ts")).alias("s"))
        stored = latest.where(F.col("s").isNotNull())
        if not stored.isEmpty():
            return stored.select("s.drift_score", "s.drift_detected", F.lit("feature_pipeline").alias("source"),
                                 "s.reference_source", "s.run_ts")
    if predictions is None:
        raise ValueError("no drift summary and no predictions to fall back on")
    gap = F.abs(F.avg(F.col(pred).cast("double")) - F.avg(F.col(label).cast("double")))
    return predictions.agg(gap.alias("drift_score")).select(
        "drift_score", drift_decision(F.col("drift_score")).alias("drift_detected"),
        F.lit("calibration_gap").alias("source"), F.lit(None).cast("string").alias("reference_source"),
        F.lit(None).cast("string").alias("run_ts"))


# ---------------------------------------------------------------- F12
FEATURE_COLUMNS = ["user_txn_count_1h", "user_txn_amount_1h", "user_distinct_events_1h", "user_avg_amount_24h"]


def check_feature_drift(current: DataFrame, reference: DataFrame,
                        threshold: float = DRIFT_THRESHOLD) -> DataFrame:
    """drift of the realtime feature table against the reference build.

    Uses the feature columns present on both sides, drops all-null rows,
    and scores with F1.  An empty side yields score 0 with a note.  Row
    counts come from the same aggregate pass as the moments.
    """
    cols = [c for c in FEATURE_COLUMNS if c in current.columns and c in reference.columns]
    cur = current.select(*cols).dropna(how="all")
    ref = reference.select(*cols).dropna(how="all")
    s = _summary_from(_moments(ref, cur, cols), cols, threshold)
    empty = (F.col("_rn") == 0) | (F.col("_cn") == 0)
    return s.select(F.when(empty, F.lit(0.0)).otherwise(F.col("drift_score")).alias("drift_score"),
                    F.when(empty, F.lit(False)).otherwise(F.col("drift_detected")).alias("drift_detected"),
                    "n_columns", "column_scores",
                    F.when(empty, F.lit("reference or current empty")).alias("note"),
                    F.col("_rn").alias("n_reference"), F.col("_cn").alias("n_current"))
