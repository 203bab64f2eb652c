"""The jobs users run, composed from the operators (no new semantics).

Each job is one lazy plan per output; files are written only where the job
publishes a table.  They return dicts of DataFrames / paths so callers can
pick what to materialise.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstile.operators import drift as D
from turnstile.operators import metrics as M
from turnstile.operators import pricing as H
from turnstile.operators import quality as Q
from turnstile.operators import realtime as R
from turnstile.operators import store as S
from turnstile.operators import training as G
from turnstile.session import reuse
from turnstile.sources import files as A
from turnstile.streaming import jobs as J


# ---------------------------------------------------------------- P1
class ValidationFailed(ValueError):
    """The hourly job's aggregates break a rule; nothing was published."""


def hourly_features(spark: SparkSession, raw: DataFrame, event_metrics: DataFrame, reference_txns: DataFrame | None,
                    out_root: str, as_of: dt.datetime | None = None, window_hours: int = 24,
                    reference_features: DataFrame | None = None) -> dict:
    """A1→A2→A3→B7→E1 gate → C1→A4, D3, F12 (+ F9 summary).

    The gate comes first: aggregates that fail E1 raise, and neither the
    feature table nor the drift summary is written.  ``raw`` is the landed
    table (``read_raw_events``); ``as_of`` None uses the table's own newest
    timestamp so reruns are repeatable: it is looked up once, and in a table
    partitioned by ``dt`` only in the newest partition; the bound then prunes
    the scan.  The drift reference never changes with the target, so a stored
    C2 table can be passed as ``reference_features`` instead of recomputing it
    from ``reference_txns`` every hour.
    """
    ok, missing = A.require_columns(raw)
    result: dict = {"schema_ok": ok, "missing_columns": missing}
    if not ok:
        return result
    agg = reuse(M.event_price_aggregates(event_metrics))
    result["event_aggregates"] = agg
    result["validation"] = reuse(Q.validate_aggregates(agg))
    broken = result["validation"].where(~F.col("passed")).collect()  # one row a rule
    if broken:
        raise ValidationFailed("; ".join(str(r.asDict()) for r in broken))
    if as_of is None:
        as_of = newest_timestamp(raw, "timestamp")
    if "dt" in raw.columns and as_of is not None:
        raw = raw.where(F.col("dt") >= F.lit((as_of - dt.timedelta(hours=window_hours)).date()))
    stamp = F.lit(as_of)
    feats = R.user_realtime_features(A.filter_recent(raw, "timestamp", stamp, window_hours), stamp)
    result["features_path"] = A.write_feature_table(feats, f"{out_root}/user_realtime_features")
    feats = spark.read.parquet(result["features_path"])  # the published table; lineage ends here
    window = feats.where(F.col("event_timestamp") >= stamp - F.expr("INTERVAL 1 DAY"))
    result["online"] = S.materialize(window, S.USER_REALTIME)
    ref = reference_features if reference_features is not None else R.reference_features(reference_txns)
    drift = reuse(D.check_feature_drift(feats, ref))  # one row
    result["drift"] = drift
    # append the run's summary to the history table P2 reads
    result["drift_summary_path"] = D.write_drift_summary(
        D.drift_summary_record(drift, stamp, window_hours=window_hours), f"{out_root}/drift_summary")
    return result


def newest_timestamp(df: DataFrame, ts_col: str) -> dt.datetime | None:
    """Newest timestamp of a table, from its newest ``dt`` partition if it has
    partitions by day."""
    if "dt" in df.columns:
        newest = df.agg(F.max("dt").alias("d")).first()["d"]
        df = df.where(F.col("dt") == F.lit(newest))
    return df.agg(F.max(F.col(ts_col).cast("timestamp_ntz")).alias("t")).first()["t"]


# ---------------------------------------------------------------- P2
def daily_monitoring(spark: SparkSession, summary_path: str | None, predictions: DataFrame | None = None,
                     perf_reference: DataFrame | None = None, perf_current: DataFrame | None = None,
                     target: str = "target", pred: str = "prediction",
                     daily_path: str | None = None) -> DataFrame:
    """F11 → F9 write-back → F10 (→ F7 when performance frames are given):
    one decision row.  The day's summary is appended to ``daily_path`` after it
    is collected, so a drift found by the calibration gap is on record too."""
    drift = reuse(D.collect_drift(spark, summary_path, predictions))  # one row
    if daily_path:
        record = drift.withColumn("column_scores", F.create_map().cast("map<string,double>")) \
                      .withColumn("run_ts", F.coalesce(F.col("run_ts").cast("timestamp"), F.current_timestamp()))
        D.write_drift_summary(record.select("drift_score", "drift_detected", "column_scores", "run_ts", "source",
                                            "reference_source"), daily_path)
    dec = D.retrain_decision(drift)
    if perf_reference is not None and perf_current is not None:
        perf = D.compare_performance(perf_reference, perf_current, target, pred)
        dec = dec.crossJoin(perf).withColumn(
            "alert", D.alert_decision(F.col("drift_score"), F.col("accuracy_reference"), F.col("accuracy_current")))
    else:
        dec = dec.withColumn("alert", D.alert_decision(F.col("drift_score")))
    return dec


# ---------------------------------------------------------------- P3
def weekly_training(user_metrics: DataFrame, trials: int = G.N_TRIALS, registry_path: str | None = None,
                    model_name: str = "fraud_detection", models_root: str | None = None) -> dict:
    """G1 → G2 → G3 → G4 → G5; an accepted model is saved under
    ``models_root`` and added to the registry table (next version, stage
    Staging) when ``registry_path`` is given.  The split is written once and
    read by every trial."""
    frame = G.fraud_training_frame(user_metrics)
    split = reuse(G.stratified_split(reuse(frame), G.LABEL_COLUMN, "user_id"))
    features = ["lifetime_purchases", "fraud_risk_score"]
    train, valid = split.where("split = 'train'"), split.where("split = 'valid'")
    model, trials_df = G.tune_and_train(train, valid, features, trials=trials)
    metrics = G.evaluate_scores(G.score_batch(valid, model), label=G.LABEL_COLUMN, score="fraud_score")
    gate = G.baseline_gate(metrics)
    out = {"model": model, "trials": trials_df, "metrics": metrics, "gate": gate}
    if registry_path:
        out["registered"] = G.register_if_accepted(gate, registry_path, model_name, model=model, models_root=models_root)
    return out


# ---------------------------------------------------------------- P4
def batch_fraud_scoring(requests: DataFrame, snapshots: dict, model, refs=S.FRAUD_REFS,
                        threshold: float = G.SCORE_THRESHOLD, missing_as: float | None = 0.0,
                        registry: DataFrame | None = None) -> DataFrame:
    """D6 → D5 → D7 → G7 (requests carry ``request_id``, raw user/event ids).

    ``model`` is a fitted model or, with ``registry``, the URI of a registered
    one (``models:/name/version`` or ``/stage``), loaded here.  A model that
    was trained on plain feature names reads them from ``view__feature``.
    Entities missing from the online store score with ``missing_as`` (Spark
    GBT models reject NaN inputs); pass None for models that handle NaN."""
    req = S.normalize_ids(requests, [c for c in ("user_id", "event_id") if c in requests.columns])
    feats = S.get_online_features(req, snapshots, refs)
    cols = [r.replace(":", "__") for r in refs]
    frame = S.build_feature_frame(feats, cols, null_as=missing_as)
    if isinstance(model, str):
        model = G.load_model(registry, model)
    plain = {r.split(":", 1)[1]: c for r, c in zip(refs, cols)}
    wanted = [c for c in G.model_inputs(model) or [] if c not in frame.columns and c in plain]
    scored = G.score_batch(frame.select("*", *[F.col(plain[c]).alias(c) for c in wanted]), model, threshold)
    return scored.drop(*wanted)


# ---------------------------------------------------------------- P5
def batch_pricing(requests: DataFrame, snapshots: dict, state: DataFrame | None, seed: int = 0,
                  deterministic: bool = False) -> DataFrame:
    """P5: D5 → H2 → H1 → H4."""
    return H.price_batch(requests, snapshots, state, seed=seed, deterministic=deterministic)


# ---------------------------------------------------------------- P6
def streaming_features(stream: DataFrame, online_root: str, landing_root: str, checkpoint_root: str,
                       trigger: dict | None = None) -> dict:
    """Decoded transactions → {C3 → C4 → D4, A6}: two queries over one
    source, each with its own checkpoint."""
    publish = J.publish_user_features(J.stream_user_aggregates(stream), online_root, f"{checkpoint_root}/publish", trigger)
    land = J.land_stream(stream, landing_root, f"{checkpoint_root}/landing", trigger=trigger)
    return {"publish": publish, "landing": land}
