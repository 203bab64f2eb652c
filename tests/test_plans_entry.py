"""Plan checks (pushdown, pruning, no Python in expression-only operators) and the driver contract."""
import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from turnstile.operators import metrics as M
from turnstile.plans import views as V
from turnstile.sources import files as A


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and df.columns == M.EVENT_METRIC_COLUMNS


def test_every_oracle_has_a_query():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 90
    # The training-data queries come with their subpackage, all or none.
    import importlib.util
    there = sorted(k for k in q if k.startswith("op") or k == "pipeline")
    assert len(there) == (14 if importlib.util.find_spec("turnstile.llm") else 0)


def test_scan_prunes_columns_and_pushes_filters(spark, sf_dir):
    df = V.txns(spark, sf_dir).where(F.col("event_id") < 100).select("event_id", "quantity")
    p = _plan(df)
    assert "PushedFilters: [IsNotNull(l_partkey), LessThan(l_partkey,100)" in p
    assert "l_returnflag" not in p and "l_shipdate" not in p


def test_partition_pruning_on_landed_dates(spark):
    root = tempfile.mkdtemp(prefix="ts-landed-", dir="/tmp") + "/t"
    spark.createDataFrame([(1, "e", 1.0, "2024-01-0%dT00:00:00Z" % d, dt.date(2024, 1, d)) for d in (1, 2, 3)],
                          "user_id long, event_id string, total_amount double, timestamp string, dt date") \
        .write.partitionBy("dt").parquet(root)
    df = A.read_raw_events(spark, root, as_of=dt.datetime(2024, 1, 3, 12), hours=24)
    assert "PartitionFilters: [isnotnull(dt" in _plan(df) and df.count() == 2


def test_no_python_eval_in_expression_operators(spark, sf_dir):
    for name in ("b4_event_metrics", "c6_trailing_user_features", "d2_get_historical_features",
                 "i2_latency_sla", "g4_evaluate_scores", "d6_normalize_entity_id", "a5_parse_transactions"):
        p = _plan(E.queries()[name](spark, sf_dir))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name


def test_no_cartesian_on_large_sides(spark, sf_dir):
    for name in ("b4_event_metrics", "f1_mean_shift_drift", "i11_latency_histogram", "c1_user_realtime_features"):
        p = _plan(E.queries()[name](spark, sf_dir))
        assert "CartesianProduct" not in p, name  # one-row sides are broadcast nested-loop joins


def test_all_registered_queries_run_on_smoke_data(spark, sf_dir):
    """Whole results; training-data queries run in tests/llm."""
    for name, fn in E.queries().items():
        if name != "pipeline" and not name.startswith("op"):
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()


def test_require_columns_and_resolve_source(spark, sf_dir):
    raw = spark.createDataFrame([(1, 2)], "user_id long, event_id long")
    assert A.require_columns(raw) == (False, ["total_amount"])
    assert [(r.present, r.rows) for r in A.schema_gate(spark, raw).collect()] == [(True, 1), (True, 1), (False, 0)]
    cfg = A.SourceConfig(local_root=sf_dir)
    assert A.resolve_source(spark, cfg, "region").count() == 5
    with pytest.raises(ValueError):
        A.resolve_source(spark, A.SourceConfig(environment="production", offline_store="file"), "region")


def _scans(plan, table):
    return plan.count(f"/{table}.parquet]")


def test_scan_once_plans(spark, sf_dir):
    q = E.queries()
    b4 = _plan(q["b4_event_metrics"](spark, sf_dir))
    assert _scans(b4, "lineitem") == 0 and "Scan ExistingRDD" in b4  # reads the checkpointed event table
    f1 = _plan(q["f1_mean_shift_drift"](spark, sf_dir))
    assert _scans(f1, "lineitem") == 1 and _scans(f1, "orders") == 1  # both sides in one pass
    d2 = q["d2_get_historical_features"](spark, sf_dir)
    assert _scans(_plan(d2), "lineitem") == 0  # both sides are read once, into the stored union
    assert "monotonically_increasing_id" not in d2._jdf.queryExecution().optimizedPlan().toString()


def test_bucketed_table_aggregates_without_shuffle(spark, sf_dir):
    from turnstile.operators import realtime as R
    from turnstile.session import save_bucketed
    t = save_bucketed(V.txns(spark, sf_dir), "txns_by_user", "user_id", 4)
    feats = R.reference_features(t)
    p = _plan(feats)
    assert "Exchange hashpartitioning(user_id" not in p
    assert feats.count() == R.reference_features(V.txns(spark, sf_dir)).count()


def test_launcher_settings_survive_get_spark():
    """Master and shuffle partitions given by a launcher are not overridden."""
    import subprocess
    import sys
    code = ("from pyspark.sql import SparkSession\n"
            "SparkSession.builder.master('local[2]').config('spark.sql.shuffle.partitions', '4000')"
            ".config('spark.ui.enabled', 'false').config('spark.sql.session.timeZone', 'Europe/Paris').getOrCreate()\n"
            "from turnstile.session import get_spark\n"
            "s = get_spark()\n"
            "print('GOT', s.sparkContext.master, s.conf.get('spark.sql.shuffle.partitions'),"
            " s.conf.get('spark.sql.session.timeZone'))\n")
    import os
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=root, timeout=120)
    assert "GOT local[2] 4000 Europe/Paris" in out.stdout, out.stderr[-500:]
