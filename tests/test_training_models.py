"""Model search and scoring paths (small data, few trees)."""
import os
import subprocess
import sys

import numpy as np
import pytest

from turnstile.operators import store as S
from turnstile.operators import training as G
from turnstile.plans import workflows as W


def test_score_batch_with_external_model(spark):
    class _Linear:  # defined here so it ships to the Python workers by value
        feature_columns = ["x"]

        def predict_proba(self, x):
            p = np.clip(x[:, 0], 0.0, 1.0)
            return np.column_stack([1 - p, p])

    df = spark.createDataFrame([(1, 0.2), (2, 0.7), (3, 0.5)], "id long, x double")
    out = {r.id: r for r in G.score_batch(df, _Linear()).collect()}
    assert out[1].fraud_score == pytest.approx(0.2) and not out[1].is_fraud
    assert out[2].is_fraud and out[3].is_fraud  # threshold is inclusive


def test_tune_and_train_small(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(x), float(x > 0.5)) for i, x in enumerate(rng.random(300))]
    df = spark.createDataFrame(rows, "user_id long, x double, is_fraud_label double")
    split = G.stratified_split(df, G.LABEL_COLUMN, "user_id")
    model, trials = G.tune_and_train(split.where("split = 'train'"), split.where("split = 'valid'"), ["x"],
                                     trials=2, parallelism=2)
    t = trials.collect()
    assert len(t) == 2 and all(0.0 <= r.roc_auc <= 1.0 for r in t)
    scored = G.evaluate_scores(G.score_batch(df, model), label=G.LABEL_COLUMN, score="fraud_score").collect()[0]
    assert scored.auc > 0.9  # a separable label is learned


def _model(spark, column="x"):
    rng = np.random.default_rng(1)
    rows = [(i, float(x), float(x > 0.5)) for i, x in enumerate(rng.random(200))]
    df = spark.createDataFrame(rows, f"user_id long, {column} double, is_fraud_label double")
    return G.tune_and_train(df, df, [column], trials=1)[0], df


def _gate(spark, ok=True):
    return spark.createDataFrame([(0.9, 0.95, ok)], "auc double, accuracy double, accepted boolean")


def test_registered_model_is_loaded_in_a_fresh_session(spark, tmp_path):
    """Saved by one process, found by its URI and scored by another."""
    model, df = _model(spark)
    table, root = str(tmp_path / "registry"), str(tmp_path / "models")
    assert G.register_if_accepted(_gate(spark), table, "fraud", model=model, models_root=root)
    want = {r.user_id: r.fraud_score for r in G.score_batch(df, model).collect()}
    df.write.parquet(str(tmp_path / "rows"))
    code = f"""
import sys; sys.path.insert(0, {os.getcwd()!r})
from turnstile.session import get_spark
from turnstile.operators import training as G
spark = get_spark(master="local[2]", shuffle_partitions=2)
model = G.load_model(spark.read.parquet({table!r}), "models:/fraud/1")
G.score_batch(spark.read.parquet({str(tmp_path / "rows")!r}), model).select("user_id", "fraud_score") \\
    .write.parquet({str(tmp_path / "scores")!r})
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300, capture_output=True,
                   env={k: v for k, v in os.environ.items() if not k.startswith("PYSPARK_GATEWAY")})
    got = {r.user_id: r.fraud_score for r in spark.read.parquet(str(tmp_path / "scores")).collect()}
    assert got == want


def test_versions_stages_and_unfinished_registrations(spark, tmp_path):
    model, _ = _model(spark)
    table, root = str(tmp_path / "registry"), str(tmp_path / "models")
    assert not G.register_if_accepted(_gate(spark, False), table, "fraud", model=model, models_root=root)
    assert not os.path.exists(root)
    (tmp_path / "models" / "fraud" / "version=1").mkdir(parents=True)  # a registration that stopped before its row
    (tmp_path / "models" / "fraud" / "version=1" / "half").write_text("")
    for _ in range(2):
        assert G.register_if_accepted(_gate(spark), table, "fraud", model=model, models_root=root)
    registry = spark.read.parquet(table)
    assert sorted(r.source for r in registry.collect()) == [f"{root}/fraud/version={v}" for v in (1, 2)]
    assert G.resolve_model(registry, "models:/fraud/1")["version"] == "1"
    assert G.resolve_model(registry, "models:/fraud/staging")["version"] == "2"
    assert G.resolve_model(registry, "models:/fraud/Production")["version"] == "2"  # none there: the highest
    with pytest.raises(LookupError):
        G.load_model(registry, "models:/fraud/7")
    with pytest.raises(LookupError):
        G.load_model(registry, "models:/nobody/Production")
    for bad in ("runs:/fraud/1", "fraud", "models:/fraud"):
        with pytest.raises(ValueError):
            G.load_model(registry, bad)


def test_batch_scoring_takes_a_registered_model(spark, tmp_path):
    """The model's plain feature names are read from the view's columns."""
    model, _ = _model(spark, "x")
    table = str(tmp_path / "registry")
    G.register_if_accepted(_gate(spark), table, "fraud", model=model)
    view = S.FeatureView("v", ("user_id",), 3600, (("x", "double"),))
    snap = spark.createDataFrame([(1, 0.1), (2, 0.9)], "user_id long, x double")
    req = spark.createDataFrame([(10, "user_1"), (11, "2"), (12, "3")], "request_id long, user_id string")
    out = {r.request_id: r for r in W.batch_fraud_scoring(req, {view: snap}, "models:/fraud/1", ("v:x",),
                                                          registry=spark.read.parquet(table)).collect()}
    assert not out[10].is_fraud and out[11].is_fraud and not out[12].is_fraud and "x" not in out[10].asDict()


def test_permutation_depends_on_rows_and_seed_only(spark, monkeypatch):
    df = spark.range(5000).selectExpr("id AS user_id", "cast(id AS double) AS x", "cast(id % 3 AS double) AS y")
    for rows in (G.PERMUTE_ROWS, 700):
        monkeypatch.setattr(G, "PERMUTE_ROWS", rows)
        one = {r.user_id: r.x for r in G._permute_column(df, "x", 1).collect()}
        other = {r.user_id: r.x for r in G._permute_column(df.repartition(7, "y"), "x", 1).collect()}
        assert one == other and sorted(one.values()) == [float(k) for k in range(5000)]
        assert sum(k == v for k, v in one.items()) < 100
        assert one != {r.user_id: r.x for r in G._permute_column(df, "x", 2).collect()}
        moved = np.corrcoef(list(one), list(one.values()))[0, 1]
        assert abs(moved) < 0.08
