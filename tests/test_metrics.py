"""B operators on hand-computed frames."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from turnstile.operators import metrics as M

EV_SCHEMA = "event_id long, promoter_id string, category string, capacity int, base_price double, popularity double, start_time timestamp_ntz"
TX_SCHEMA = "transaction_id long, user_id long, event_id long, event_timestamp timestamp_ntz, quantity int, ticket_price double, total_amount double, is_fraud boolean"
T0 = dt.datetime(2024, 1, 1)


def events(spark):
    return spark.createDataFrame([
        (1, "p1", "rock", 10, 50.0, 0.95, T0), (2, "p1", "rock", 4, 20.0, 0.8, T0),
        (3, "p2", "jazz", 0, 30.0, 0.1, T0), (4, None, "pop", 8, 10.0, 0.5, T0)], EV_SCHEMA)


def txns(spark):
    return spark.createDataFrame([
        (10, 7, 1, T0, 4, 100.0, 400.0, True), (11, 7, 1, T0, 2, 120.0, 240.0, False),
        (12, 8, 2, T0, 6, 50.0, 300.0, False), (13, 9, 9, T0, 1, 10.0, 10.0, False)], TX_SCHEMA)


def test_event_metrics_defaults_clip_and_promoter(spark):
    out = {r.event_id: r for r in M.event_metrics(events(spark), txns(spark)).collect()}
    assert list(out) == [1, 2, 3, 4]
    e1, e2, e3, e4 = out[1], out[2], out[3], out[4]
    assert (e1.total_tickets_sold, e1.concurrent_viewers, e1.current_inventory) == (6, 4, 4)
    assert e1.avg_ticket_price == pytest.approx(110.0) and e1.sell_through_rate_5min == pytest.approx(0.6)
    # oversold: clipped to 1, inventory floors at 0
    assert e2.sell_through_rate_5min == 1.0 and e2.current_inventory == 0
    # no sales: defaults; capacity 0 with no sales → NaN like 0/0
    assert (e3.total_tickets_sold, e3.concurrent_viewers, e3.avg_ticket_price) == (0, 0, 30.0)
    assert e3.sell_through_rate_5min != e3.sell_through_rate_5min
    # promoter means: p1 = (6+6)/2 = 6, p2 = 0 → max 6; null promoter → 0
    assert e1.promoter_success_rate == 1.0 and e3.promoter_success_rate == 0.0 and e4.promoter_success_rate == 0.0


def test_promoter_success_zero_max_divides_by_one(spark):
    df = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "event_id long, promoter_id string, total_tickets_sold long")
    assert [r.promoter_success_rate for r in M.promoter_success(df).collect()] == [0.0, 0.0]


def test_user_metrics_and_preferred_category(spark):
    users = spark.createDataFrame([(7, "gold", "SA", T0), (8, "platinum", "AE", T0), (5, "x", None, T0)],
                                  "user_id long, loyalty_tier string, country string, signup_date timestamp_ntz")
    out = {r.user_id: r for r in M.user_metrics(users, txns(spark), events(spark)).collect()}
    assert out[7].lifetime_purchases == 6 and out[7].fraud_risk_score == pytest.approx(0.5)
    assert out[5].lifetime_purchases == 0 and out[5].fraud_risk_score == 0.0 and out[5].preferred_category is None
    assert out[7].preferred_category == "rock"


def test_preferred_category_tie_takes_larger_name(spark):
    ev = spark.createDataFrame([(1, "p", "alpha", 1, 1.0, 0.1, T0), (2, "p", "beta", 1, 1.0, 0.1, T0)], EV_SCHEMA)
    tx = spark.createDataFrame([(1, 7, 1, T0, 1, 1.0, 1.0, False), (2, 7, 2, T0, 1, 1.0, 1.0, False)], TX_SCHEMA)
    assert M.preferred_category(tx, ev).collect()[0].preferred_category == "beta"


def test_rule_fraud_probability(spark):
    df = spark.createDataFrame([(500.0, "platinum"), (500.0, "gold"), (10.0, "platinum"), (None, None)],
                               "ticket_price double, loyalty_tier string")
    got = [r.fraud_probability for r in M.rule_fraud_probability(df).collect()]
    assert got == pytest.approx([0.06, 0.08, 0.01, 0.03])


def test_transaction_amounts_format(spark):
    out = M.transaction_amounts(txns(spark)).where("event_id = 1").orderBy("total_amount").collect()[0]
    assert out.user_id == "7" and out.timestamp == "2024-01-01T00:00:00.000Z" and out.total_amount == 240.0


def test_pricing_tiers_and_sellout(spark):
    tiers = {(r.event_id, r.tier): r for r in M.pricing_tiers(events(spark)).collect()}
    assert tiers[(1, "VIP")].price == 2000.0 and tiers[(1, "Premium")].price == 1100.0
    assert tiers[(1, "Standard")].tier_capacity == 6 and tiers[(2, "VIP")].price == 800.0
    so = {r.event_id: r for r in M.sellout_hours(events(spark)).collect()}
    assert so[1].is_mega_event and so[1].expected_sellout_hours == pytest.approx(10 / 100000)
    assert so[4].expected_sellout_hours == pytest.approx(8 / 100)


def test_risk_indicators(spark):
    df = spark.createDataFrame([(1, 5.0, True, "US", None, 0.9, dt.datetime(2024, 1, 1, 3)),
                                (2, 0.0, False, "SA", "SA", 0.9, dt.datetime(2024, 1, 1, 12))],
                               "transaction_id long, velocity_score double, device_mismatch boolean, ip_country string, "
                               "country string, fraud_probability double, event_timestamp timestamp_ntz")
    r = {x.transaction_id: x for x in M.risk_indicators(df).collect()}
    assert r[1].geo_mismatch and r[1].time_anomaly and r[1].risk_score == pytest.approx(0.85)
    assert not r[2].geo_mismatch and r[2].risk_score == 0.0


@pytest.mark.parametrize("level", [0.0, -1.0])
def test_inject_drift_noop(spark, level):
    df = txns(spark)
    assert M.inject_drift(df, level, ["quantity"]) is df


def test_inject_drift_monotone_and_types(spark):
    df = spark.createDataFrame([(1, 1.25), (3, None)], "q int, p double")
    lo = M.inject_drift(df, 0.1, ["q", "p"]).collect()
    hi = M.inject_drift(df, 2.0, ["q", "p"]).collect()  # clamped to 1 → ×2
    assert lo[0].q == 1 and lo[0].p == pytest.approx(1.38) and lo[1].p is None
    assert hi[0].q == 2 and hi[0].p == 2.5 and hi[1].q == 6
    assert dict(M.inject_drift(df, 0.5, ["q"]).dtypes)["q"] == "int"
