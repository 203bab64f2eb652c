"""I request-log metrics, G evaluation/selection, H pricing."""
import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnstile.operators import pricing as H
from turnstile.operators import requests as I
from turnstile.operators import training as G

T0 = dt.datetime(2024, 1, 1)
LOG = ("ts timestamp_ntz, service int, latency_ms double, status int, blocked boolean, is_fraud boolean, "
       "fraud_score double, timed_out boolean, error string")


def _log(spark, n=200, seed=0):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append((T0 + dt.timedelta(seconds=rnd.randint(0, 3600)), rnd.choice([0, 0, 1]),
                     round(rnd.expovariate(1 / 60), 2), rnd.choice([200, 200, 200, 503, 599]),
                     rnd.random() < 0.3, rnd.random() < 0.3, rnd.random(), rnd.random() < 0.05,
                     rnd.choice([None, None, "timeout"])))
    return rows, spark.createDataFrame(rows, LOG)


def test_sla_order_statistics(spark):
    rows, log = _log(spark)
    got = {r.service: r for r in I.latency_sla(log, by=["service"]).collect()}
    for s in (0, 1):
        v = sorted(r[2] for r in rows if r[1] == s)
        n = len(v)
        assert got[s].p95_ms == v[int(0.95 * (n - 1))] and got[s].n == n
        assert got[s].passed == (v[int(0.5 * (n - 1))] <= 50 and v[int(0.95 * (n - 1))] <= 150
                                 and v[int(0.99 * (n - 1))] <= 200)
    empty = I.latency_sla(log.where("service > 5")).collect()[0]
    assert not empty.passed and empty.reason == "no latency data"


def test_percentiles_numpy_and_empty_zero(spark):
    rows, log = _log(spark)
    r = I.latency_percentiles(log).collect()[0]
    assert r.p99_latency_ms == pytest.approx(np.percentile([x[2] for x in rows], 99))
    z = I.latency_percentiles(log.where("service > 5")).collect()[0]
    assert (z.n, z.p50_latency_ms) == (0, 0.0)


def test_error_timeout_fraud_confusion(spark):
    rows, log = _log(spark)
    e = I.error_rate(log).collect()[0]
    assert e.errors == sum(1 for r in rows if r[3] >= 400)
    e2 = I.error_rate(log, rule="non2xx").collect()[0]
    assert e2.errors == e.errors  # one count per failed request (no double counting)
    t = I.timeout_count(log).collect()[0]
    assert t.timeout_count == sum(1 for r in rows if r[7] or r[8] == "timeout")
    c = I.confusion_metrics(log).collect()[0]
    pred = [r[4] or r[6] > 0.7 for r in rows]
    tp = sum(1 for r, p in zip(rows, pred) if r[5] and p)
    fp = sum(1 for r, p in zip(rows, pred) if not r[5] and p)
    assert (c.tp, c.fp) == (tp, fp)
    assert not I.confusion_metrics(log.where("service > 5")).collect()[0].passed


def test_histogram_quantile_interpolation(spark):
    b = spark.createDataFrame([("s", 0.1, 10), ("s", 0.2, 30), ("s", float("inf"), 40)],
                              "service string, le double, count long")
    got = {r.q: r.value for r in [I.histogram_quantile(b, q).collect()[0] for q in (0.5, 0.99)]}
    assert got[0.5] == pytest.approx(0.1 + 0.1 * (20 - 10) / 20)
    assert got[0.99] == 0.2  # rank in the +Inf bucket → highest finite bound


def test_sustained_alert_islands(spark):
    pts = [(T0 + dt.timedelta(minutes=5 * i), "s", v) for i, v in enumerate([0.5, 0.5, 0.5, 0.0, 0.5, 0.5])]
    pts.append((T0 + dt.timedelta(minutes=45), "s", 0.5))  # gap of one step → new island
    df = spark.createDataFrame(pts, "window_start timestamp_ntz, service string, v double")
    out = I.sustained_alerts(df, F.col("v") > 0.1, hold_seconds=600, step_seconds=300).orderBy("window_start").collect()
    assert [r.firing for r in out] == [False, False, True, False, False, False, False]


def test_histogram_last_bin_holds_max(spark):
    df = spark.createDataFrame([(float(x),) for x in range(101)], "latency_ms double")
    h = {r.bin: r["count"] for r in I.latency_histogram(df, bins=10).collect()}
    assert sum(h.values()) == 101 and h[9] == 11


def test_auc_matches_pairwise(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice([0.1, 0.2, 0.5, 0.5, 0.9]), int(rnd.random() < 0.4)) for _ in range(300)]
    df = spark.createDataFrame(rows, "score double, label int")
    r = G.evaluate_scores(df).collect()[0]
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    pairs = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
    assert r.auc == pytest.approx(pairs / (len(pos) * len(neg)))
    assert r.accuracy == pytest.approx(np.mean([(s >= 0.5) == y for s, y in rows]))
    one = G.evaluate_scores(df.where("label = 1")).collect()[0]
    assert one.auc is None


def test_exact_split_sizes_and_hash_split(spark):
    df = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(1000)], "user_id long, y int")
    ex = G.stratified_split(df, "y", "user_id", exact=True).groupBy("y", "split").count().collect()
    sizes = {(r.y, r.split): r["count"] for r in ex}
    assert sizes[(0, "valid")] == 180 and sizes[(1, "valid")] == 20
    assert G.stratified_split(df, "y", "user_id").where("split = 'valid'").count() == 200  # exact is the default
    hs = G.stratified_split(df, "y", "user_id", exact=False).where("split = 'valid'").count()
    assert 120 < hs < 280


def test_select_model_version(spark):
    reg = spark.createDataFrame([("m", "2", "Production", "r2", "s"), ("m", "10", None, "r10", "s"),
                                 ("m", "3", "production", "r3", "s"), ("n", "1", "Staging", "r1", "s")],
                                "name string, version string, stage string, run_id string, source string")
    got = {r.name: r for r in G.select_model_version(reg).collect()}
    assert got["m"].version == "3" and got["m"].model_uri == "models:/m/3"
    assert got["n"].version == "1"  # no production version → highest overall


def test_price_rule_and_fallback(spark):
    req = spark.createDataFrame([(1, 100.0, "aggressive", 2.0, 1.0), (2, 100.0, "baseline", 0.0, 0.5)],
                                "request_id long, current_price double, arm string, "
                                "event_realtime_metrics__current_inventory double, "
                                "event_realtime_metrics__sell_through_rate_5min double")
    got = {r.request_id: r for r in H.recommend_price(req).collect()}
    assert got[1].recommended_price == pytest.approx(100 * 1.1 * 0.5)
    assert got[2].recommended_price == pytest.approx(100 * 0.5) and got[2].upper_confidence == pytest.approx(55.0)
    absent = {r.request_id: r for r in H.recommend_price(req.select("request_id", "current_price", "arm")).collect()}
    assert absent[2].recommended_price == pytest.approx(100.0)  # absent features default to 1 → demand 1


def test_bandit_update_and_deterministic_draws(spark):
    state = H.initial_arms(spark)
    rw = spark.createDataFrame([("aggressive", 1.0), ("aggressive", 2.0), ("baseline", -1.0), ("new", 0.5)],
                               "arm string, reward double")
    st = {r.arm: r for r in H.update_arms(state, rw).collect()}
    assert (st["aggressive"].alpha, st["aggressive"].beta) == (3.0, 1.0)
    assert (st["baseline"].alpha, st["baseline"].beta) == (1.0, 2.0)
    assert (st["new"].alpha, st["new"].beta) == (1.5, 1.5)
    keys = np.arange(20000, dtype=np.uint64)
    draws = H.beta_draw(keys, np.full(20000, 3.0), np.full(20000, 1.0))
    assert abs(draws.mean() - 0.75) < 0.01 and np.array_equal(draws, H.beta_draw(keys, np.full(20000, 3.0),
                                                                                  np.full(20000, 1.0)))
    req = spark.createDataFrame([(i, None) for i in range(400)], "request_id long, arm_hint string")
    upd = H.update_arms(state, spark.createDataFrame([("aggressive", 1.0)] * 30, "arm string, reward double"))
    arms = [r.arm for r in H.choose_arm(req, upd, seed=1).collect()]
    assert arms.count("aggressive") > 300  # Beta(31, 1) beats Beta(1, 1) almost always
    again = [r.arm for r in H.choose_arm(req, upd, seed=1).collect()]
    assert arms == again


def test_register_if_accepted_appends_next_version(spark):
    import tempfile
    path = tempfile.mkdtemp(prefix="ts-registry-", dir="/tmp") + "/r"
    ok = spark.createDataFrame([(0.9, 0.95, True)], "auc double, accuracy double, accepted boolean")
    bad = spark.createDataFrame([(0.5, 0.5, False)], "auc double, accuracy double, accepted boolean")
    assert G.register_if_accepted(ok, path, "m") and not G.register_if_accepted(bad, path, "m")
    assert G.register_if_accepted(ok, path, "m")
    reg = spark.read.parquet(path)
    assert sorted((r.version, r.stage) for r in reg.collect()) == [("1", "Staging"), ("2", "Staging")]
    assert G.select_model_version(reg, "Production").collect()[0].version == "2"


def test_unreadable_registry_is_an_error(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "part-0.parquet").write_text("no parquet")
    ok = spark.createDataFrame([(0.9, 0.95, True)], "auc double, accuracy double, accepted boolean")
    with pytest.raises(Exception, match="(?i)parquet"):
        G.register_if_accepted(ok, str(tmp_path / "r"), "m")


NAN = float("nan")


def test_nan_is_no_price_input(spark):
    from turnstile.operators import store as S
    req = spark.createDataFrame([(k, k, 100.0, "baseline") for k in range(1, 6)],
                                "request_id long, event_id long, current_price double, arm_hint string")
    snap = spark.createDataFrame([(1, 1.0, NAN), (2, NAN, 1.0), (3, None, 1.0), (4, 1.0, 1.0)],
                                 "event_id long, current_inventory double, sell_through_rate_5min double")
    got = {r.request_id: (r.recommended_price, r.arm) for r in H.price_batch(req, {S.EVENT_REALTIME: snap}).collect()}
    assert got == {1: (105.0, "fallback"), 2: (105.0, "fallback"), 3: (105.0, "fallback"), 4: (100.0, "baseline"),
                   5: (105.0, "fallback")}


def test_every_new_arm_is_explored(spark):
    """Unseen arms with equal state draw on their own; orders are different."""
    state = H.update_arms(H.initial_arms(spark, ["baseline"]), spark.createDataFrame(
        [("x", 0.5), ("y", 0.5), ("baseline", 0.5), ("y", None), ("z", NAN)], "arm string, reward double"))
    rows = {r.arm: (r.arm_order, r.alpha, r.beta) for r in state.collect()}
    assert rows == {"baseline": (0, 1.5, 1.5), "x": (1, 1.5, 1.5), "y": (2, 1.5, 1.5)}
    req = spark.range(20_000).select(F.col("id").alias("request_id"))
    share = {r.arm: r["count"] for r in H.choose_arm(req, state, seed=3).groupBy("arm").count().collect()}
    assert set(share) == {"baseline", "x", "y"} and all(6_000 < n < 7_400 for n in share.values())


def test_requests_need_their_required_fields(spark):
    from turnstile.operators import quality as Q
    df = spark.createDataFrame([(1, 2, None), (1, 2, 5.0), (None, 2, 5.0), (1, 2, -1.0)],
                               "user_id long, event_id long, amount double")
    assert [r.valid for r in Q.validate_requests(df).collect()] == [False, True, False, False]


def test_histogram_ignores_nan_and_infinity(spark):
    df = spark.createDataFrame([(float(x),) for x in range(10)] + [(NAN,), (float("inf"),), (None,)], "latency_ms double")
    bins = I.latency_histogram(df, bins=5).collect()
    assert sum(r["count"] for r in bins) == 10 and max(r.bin_end for r in bins) == 9.0


def test_percentiles_with_infinite_latency(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("inf"),)], "latency_ms double")
    r = I.latency_sla(df).collect()[0]
    assert r.p50_ms == 2.0 and r.n == 3


def test_auc_with_infinite_scores(spark):
    rows = [(float("inf"), 1), (5.0, 0), (0.5, 1), (0.5, 0), (float("-inf"), 0)]
    r = G.evaluate_scores(spark.createDataFrame(rows, "score double, label int")).collect()[0]
    assert r.auc == pytest.approx((3 + 1.5) / 6)


def test_auc_of_crowded_scores(spark):
    """Equal scores, scores that share a fine bucket, infinities and NaN against pair by pair."""
    rnd = random.Random(4)
    near = [0.7 * (1 + k * 1e-7) for k in range(40)]
    rows = [(rnd.choice([0.5, 0.25, float("inf"), float("nan"), -1.0, *near]), float(rnd.random() < 0.4)) for _ in range(600)]
    rank = lambda s: (2, 0.0) if s != s else (1, s)
    pos, neg = ([rank(s) for s, y in rows if y == v] for v in (1.0, 0.0))
    pairs = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
    r = G.evaluate_scores(spark.createDataFrame(rows, "score double, label double")).first()
    assert r.auc == pytest.approx(pairs / (len(pos) * len(neg))) and r.n == 600
