"""Feature store: point-in-time join vs brute force, ids, snapshots, online lookup."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from turnstile.functions.scalars import normalize_entity_id
from turnstile.operators import store as S

VIEW = S.FeatureView("v", ("user_id",), 3 * 3600, (("f", "double"),))
T0 = dt.datetime(2024, 1, 1)


def _brute(entities, feats, ttl_s):
    out = {}
    for rid, uid, ets in entities:
        cands = [(fts, ing, f) for (u, fts, ing, f) in feats if u == uid and fts <= ets]
        if not cands:
            out[rid] = None
            continue
        fts, ing, f = max(cands, key=lambda c: (c[0], c[1]))
        out[rid] = f if fts >= ets - dt.timedelta(seconds=ttl_s) else None
    return out


@pytest.mark.parametrize("bucket_seconds", [600, 3600, 86400])
def test_point_in_time_matches_brute_force(spark, bucket_seconds):
    rnd = random.Random(5)
    feats, ents = [], []
    for i in range(400):
        u = rnd.choice([1, 1, 1, 2, 3])  # user 1 is hot
        ts = T0 + dt.timedelta(minutes=rnd.randint(0, 2000))
        feats.append((u, ts, T0 + dt.timedelta(seconds=i), float(i)))
    for i in range(300):
        u = rnd.choice([1, 2, 3, 4])
        ents.append((i, u, T0 + dt.timedelta(minutes=rnd.randint(0, 2100))))
    fdf = spark.createDataFrame(feats, "user_id long, event_timestamp timestamp_ntz, ingested_at timestamp_ntz, f double")
    edf = spark.createDataFrame(ents, "rid long, user_id long, event_timestamp timestamp_ntz")
    got = {r.rid: r.f for r in S.get_historical_features(edf, fdf, VIEW, bucket_seconds=bucket_seconds).collect()}
    assert got == _brute(ents, feats, VIEW.ttl_seconds)


def test_point_in_time_never_returns_future_and_keeps_null_latest(spark):
    fdf = spark.createDataFrame([(1, T0, T0, 1.0), (1, T0 + dt.timedelta(hours=1), T0, None),
                                 (1, T0 + dt.timedelta(hours=2), T0, 3.0)],
                                "user_id long, event_timestamp timestamp_ntz, ingested_at timestamp_ntz, f double")
    edf = spark.createDataFrame([(1, 1, T0 + dt.timedelta(minutes=90)), (2, 1, T0 - dt.timedelta(minutes=1))],
                                "rid long, user_id long, event_timestamp timestamp_ntz")
    got = {r.rid: r.f for r in S.get_historical_features(edf, fdf, VIEW).collect()}
    assert got == {1: None, 2: None}  # latest row holds a null → null, not the older 1.0; no future rows


def test_normalize_entity_id_cases(spark):
    df = spark.createDataFrame([(" 42 ",), ("user_123",), ("evt_ff",), ("plain",), ("a_b_0x1A",), ("user_",)], "s string")
    got = [r.k for r in df.select(normalize_entity_id(F.col("s")).alias("k")).collect()]
    assert got[0] == 42 and got[1] == 123 and got[2] == 255 and got[4] == 26
    assert 0 <= got[3] < 2 ** 31 - 1 and 0 <= got[5] < 2 ** 31 - 1
    again = [r.k for r in df.select(normalize_entity_id(normalize_entity_id(F.col("s")).cast("string")).alias("k")).collect()]
    assert again == got  # idempotent on its own output


def test_materialize_and_upsert_idempotent(spark):
    rows = [(1, T0, 1.0), (1, T0 + dt.timedelta(hours=1), 2.0), (2, T0, 5.0)]
    df = spark.createDataFrame(rows, "user_id long, event_timestamp timestamp_ntz, f double")
    snap = {r.user_id: r.f for r in S.materialize(df, VIEW).collect()}
    assert snap == {1: 2.0, 2: 5.0}
    upd = spark.createDataFrame([(2, T0 + dt.timedelta(hours=3), 7.0)], "user_id long, event_timestamp timestamp_ntz, f double")
    once = S.upsert_snapshot(df, upd, ["user_id"], "event_timestamp")
    twice = S.upsert_snapshot(once, upd, ["user_id"], "event_timestamp")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_online_lookup_and_feature_frame(spark):
    req = spark.createDataFrame([(1, 10, {"f": 9.0, "zz": 1.0}), (2, 99, None)],
                                "request_id long, user_id long, overrides map<string,double>")
    snap = spark.createDataFrame([(10, 1.5)], "user_id long, f double")
    feats = S.get_online_features(req, {VIEW: snap}, ["v:f"])
    got = {r.request_id: r for r in S.build_feature_frame(feats.withColumnRenamed("v__f", "f"), ["f", "g"]).collect()}
    assert got[1].f == 9.0 and got[1].g == 0.0
    assert got[2].f is None and got[2].g == 0.0


def test_historical_features_multiple_views(spark):
    v2 = S.FeatureView("w", ("user_id",), 86400, (("g", "double"),))
    f1 = spark.createDataFrame([(1, T0, T0, 1.0)], "user_id long, event_timestamp timestamp_ntz, ingested_at timestamp_ntz, f double")
    f2 = spark.createDataFrame([(1, T0 + dt.timedelta(hours=5), 7.0)], "user_id long, event_timestamp timestamp_ntz, g double")
    ent = spark.createDataFrame([(1, T0 + dt.timedelta(hours=1)), (1, T0 + dt.timedelta(hours=6))],
                                "user_id long, event_timestamp timestamp_ntz")
    out = S.historical_features(ent, {VIEW: f1, v2: f2}, ["v:f", "w:g"], full_feature_names=True)
    got = sorted((r.event_timestamp, r.v__f, r.w__g) for r in out.collect())
    assert got == [(T0 + dt.timedelta(hours=1), 1.0, None), (T0 + dt.timedelta(hours=6), None, 7.0)]


def test_normalize_matches_python_rule_for_long_hex(spark):
    M = 2 ** 31 - 1
    cases = ["evt_" + "f" * 40, "u_0xDEADBEEFCAFEBABE1234", "u_-ff", "user_ 1f", "a_b_c0ffee"]
    got = dict(spark.createDataFrame([(c,) for c in cases], "s string")
               .select("s", normalize_entity_id(F.col("s")).alias("k")).collect())
    for c in cases:
        assert got[c] == int(c.strip().split("_")[-1], 16) % M


KEYED = S.FeatureView("v", ("k",), 10 * 86400, (("x", "double"),), ingested=None)


def test_null_keys_match_nothing(spark):
    import datetime as dt
    t = lambda h: dt.datetime(2024, 1, 1, h)
    feats = spark.createDataFrame([(None, t(1), 7.0), (1, t(1), 3.0)], "k long, event_timestamp timestamp_ntz, x double")
    ents = spark.createDataFrame([(10, None, t(2)), (11, 1, t(2)), (12, 2, t(2))],
                                 "id long, k long, event_timestamp timestamp_ntz")
    got = {r.id: r.x for r in S.get_historical_features(ents, feats, KEYED).collect()}
    assert got == {10: None, 11: 3.0, 12: None}


def test_crowded_buckets_are_cut_finer(spark, monkeypatch):
    import datetime as dt
    import random
    rnd = random.Random(1)
    t0 = dt.datetime(2024, 1, 1)
    at = lambda: t0 + dt.timedelta(seconds=rnd.randint(0, 3 * 86400))
    feats = [(rnd.choice([1, 1, 1, 2]), at(), float(n)) for n in range(300)]
    feats = list({(k, t): (k, t, x) for k, t, x in feats}.values())
    ents = [(n, rnd.choice([1, 1, 2, 3]), at()) for n in range(300)]
    monkeypatch.setattr(S, "HOT_ROWS", 20)
    got = S.get_historical_features(spark.createDataFrame(ents, "id long, k long, event_timestamp timestamp_ntz"),
                                    spark.createDataFrame(feats, "k long, event_timestamp timestamp_ntz, x double"), KEYED)
    want = {i: max(((t, x) for k2, t, x in feats if k2 == k and t <= e), default=(None, None))[1] for i, k, e in ents}
    assert {r.id: r.x for r in got.collect()} == want


def test_crowded_instants_are_split_by_rows(spark, monkeypatch):
    """One key, one instant: many segments, none with more than its share."""
    at = dt.datetime(2024, 1, 1)
    feats = spark.range(4000).select(F.lit(1).cast("long").alias("k"), F.lit(at).cast("timestamp_ntz").alias("event_timestamp"),
                                     F.col("id").alias("ingested_at"), F.col("id").cast("double").alias("x"))
    ents = spark.range(4000).select("id", F.lit(1).cast("long").alias("k"),
                                    F.lit(at).cast("timestamp_ntz").alias("event_timestamp"))
    monkeypatch.setattr(S, "HOT_ROWS", 100)
    cut = []
    plain = S._segments
    monkeypatch.setattr(S, "_segments", lambda rows, keys: cut.append(plain(rows, keys)) or cut[0])
    view = S.FeatureView("v", ("k",), 3600, (("x", "double"),))
    got = S.get_historical_features(ents, feats, view).groupBy("x").count().collect()
    assert [tuple(r) for r in got] == [(3999.0, 4000)]
    sizes = [r["count"] for r in cut[0].groupBy("k", "_pit_b", "_pit_s").count().collect()]
    assert sum(sizes) == 8000 and len(sizes) >= 4 and max(sizes) < 2 * sorted(sizes)[len(sizes) // 2]


def test_repeated_snapshot_keys_do_not_multiply_requests(spark):
    req = spark.createDataFrame([(1, 5), (2, 6)], "request_id long, k long")
    snap = spark.createDataFrame([(5, 1, 1.0), (5, 2, 2.0)], "k long, event_timestamp long, x double")
    got = sorted(map(tuple, S.get_online_features(req, {KEYED: snap}, ["v:x"]).select("request_id", "v__x").collect()))
    assert got == [(1, 2.0), (2, None)]


def test_a_view_without_a_key_in_the_request_gives_nulls(spark):
    req = spark.createDataFrame([(1, 5)], "request_id long, other long")
    snap = spark.createDataFrame([(5, 1, 1.0)], "k long, event_timestamp long, x double")
    out = S.get_online_features(req, {KEYED: snap}, ["v:x"])
    assert [tuple(r) for r in out.collect()] == [(1, 5, None)] and dict(out.dtypes)["v__x"] == "double"


def test_an_update_beats_the_snapshot_at_equal_times(spark):
    old = spark.createDataFrame([(1, 5, 1.0)], "k long, ts long, x double")
    new = spark.createDataFrame([(1, 5, 2.0)], "k long, ts long, x double")
    assert [r.x for r in S.upsert_snapshot(old, new, ["k"], "ts").collect()] == [2.0]
