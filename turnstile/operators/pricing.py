"""H — dynamic pricing: price rule, Thompson-sampling arm choice, bandit update, batch pricing.

The price rule and the fallback are column expressions.  Arm choice needs
Beta draws: a vectorised pandas UDF computes them from a counter-based
hash of (request, arm, seed), so every row's draw is reproducible no matter
how rows are batched or retried.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile.functions.scalars import clip
from turnstile.operators.store import get_online_features

# Fixed values from the reference: arms, uplift, demand clip, band, fallback.
ARMS = ("baseline", "aggressive")
AGGRESSIVE_UPLIFT = 0.1
DEMAND_MIN, DEMAND_MAX = 0.5, 2.0
BAND_LOW, BAND_HIGH = 0.9, 1.1
FALLBACK_UPLIFT = 1.05
VELOCITY_COL = "event_realtime_metrics__sell_through_rate_5min"
INVENTORY_COL = "event_realtime_metrics__current_inventory"


# ---------------------------------------------------------------- H1
def recommend_price(req: DataFrame, price_col: str = "current_price", arm_col: str = "arm") -> DataFrame:
    """H1: price = max(base·(1+uplift)·clip(velocity / max(inventory, 1), 0.5, 2), 0),
    band ±10 %.  Absent feature columns default to 1; a feature or price that is
    null or NaN gives no price (H4 then falls back)."""
    def number(name, default):
        if name not in req.columns:
            return F.lit(default)
        return F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))  # NaN is no price input
    vel, inv = number(VELOCITY_COL, 1.0), number(INVENTORY_COL, 1.0)
    base = number(price_col, None)
    uplift = F.when(F.col(arm_col) == "aggressive", F.lit(AGGRESSIVE_UPLIFT)).otherwise(F.lit(0.0))
    demand = clip(vel / F.greatest(inv, F.lit(1.0)), DEMAND_MIN, DEMAND_MAX)
    price = F.when(vel.isNotNull() & inv.isNotNull() & base.isNotNull(),
                   F.greatest(base * (1 + uplift) * demand, F.lit(0.0)))
    return req.withColumn("recommended_price", price) \
              .withColumn("lower_confidence", F.col("recommended_price") * BAND_LOW) \
              .withColumn("upper_confidence", F.col("recommended_price") * BAND_HIGH)


# ---------------------------------------------------------------- H2
_M64 = np.uint64(0xFFFFFFFFFFFFFFFF)


def _splitmix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (x + np.uint64(0x9E3779B97F4A7C15)) & _M64
        z = ((z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)) & _M64
        z = ((z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)) & _M64
        return z ^ (z >> np.uint64(31))


def _uniform(key: np.ndarray, counter: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = _splitmix(key ^ _splitmix(np.full(key.shape, counter, dtype=np.uint64)))
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _gamma(key: np.ndarray, shape: np.ndarray, stream: int) -> np.ndarray:
    """Marsaglia-Tsang Gamma(shape, 1), vectorised; loops until every row accepts."""
    a = np.asarray(shape, dtype=np.float64)
    small = a < 1
    a_eff = np.where(small, a + 1.0, a)
    d = a_eff - 1.0 / 3.0
    c = 1.0 / np.sqrt(9.0 * d)
    out = np.full(a.shape, np.nan)
    todo = np.ones(a.shape, dtype=bool)
    attempt = 0
    while todo.any():
        base = stream * 1_000_003 + attempt * 4
        u1, u2, u3 = _uniform(key, base), _uniform(key, base + 1), _uniform(key, base + 2)
        z = np.sqrt(-2.0 * np.log(u1)) * np.cos(2 * np.pi * u2)
        v = (1.0 + c * z) ** 3
        ok = (v > 0) & (np.log(u3) < 0.5 * z * z + d - d * np.where(v > 0, v, 1.0)
                        + d * np.log(np.where(v > 0, v, 1.0)))
        take = todo & ok
        out[take] = (d * v)[take]
        todo &= ~ok
        attempt += 1
    boost = _uniform(key, stream * 1_000_003 + 999_983) ** (1.0 / np.where(small, a, 1.0))
    return np.where(small, out * boost, out)


def beta_draw(key: np.ndarray, alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Reproducible Beta(α, β) = X/(X+Y) with X~Γ(α), Y~Γ(β) from 64-bit keys."""
    x = _gamma(key, np.asarray(alpha, dtype=np.float64), 1)
    y = _gamma(key, np.asarray(beta, dtype=np.float64), 2)
    return x / (x + y)


def _thompson(key: np.ndarray, arms: list[tuple]) -> np.ndarray:
    """Per request: the place of the arm with the largest Beta draw, ties to
    the earlier one.  Draws are keyed by (request, arm name) and vectorised per arm."""
    k = key.astype(np.int64).view(np.uint64)
    best, pick = np.full(len(k), -np.inf), np.zeros(len(k), dtype=np.int64)
    for i, (_, arm_key, a, b) in enumerate(arms):
        own = _splitmix(k ^ _splitmix(np.full(len(k), np.int64(arm_key)).view(np.uint64)))
        draw = beta_draw(own, np.full(len(k), float(a)), np.full(len(k), float(b)))
        pick = np.where(draw > best, i, pick)
        best = np.maximum(best, draw)
    return pick


def choose_arm(requests: DataFrame, state: DataFrame, seed: int = 0, hint_col: str = "arm_hint",
               deterministic: bool = False) -> DataFrame:
    """H2: the hinted arm, else the arm with the largest Beta(α, β) draw
    (ties → the earlier ``arm_order``, then name; null without any arm).

    Draws come from a hash of (request id, seed, arm name), so they do not
    depend on partitioning, retries or the other arms, and every arm draws on
    its own.  Every request without a hint is drawn for every arm, so the state
    is a catalogue, a line an arm; it is read once and sent to each
    executor, not along with the requests.  ``deterministic=True`` ranks arms by
    posterior mean α/(α+β) as a JVM expression instead.
    """
    hint = F.col(hint_col) if hint_col in requests.columns else F.lit(None).cast("string")
    if deterministic:
        mean = F.col("alpha") / (F.col("alpha") + F.col("beta"))
        best = state.agg(F.min_by("arm", F.struct(-mean, "arm_order", "arm")).alias("_best"))  # one row
        return requests.crossJoin(best).select(*requests.columns, F.coalesce(hint, F.col("_best")).alias("arm"))
    arms = [tuple(r) for r in state.orderBy("arm_order", "arm").select("arm", F.xxhash64("arm"), "alpha", "beta").collect()]
    shared = requests.sparkSession.sparkContext.broadcast(arms)

    def draw(key: pd.Series) -> pd.Series:
        out = np.full(len(key), None, dtype=object)
        asked = key.notna().to_numpy()  # a hinted request draws nothing
        if asked.any() and shared.value:
            names = np.array([a[0] for a in shared.value], dtype=object)
            out[asked] = names[_thompson(key[asked].to_numpy(), shared.value)]
        return pd.Series(out)
    key = F.when(hint.isNull(), F.xxhash64(F.col("request_id"), F.lit(seed)).cast("string"))
    sampled = F.pandas_udf(draw, T.StringType())(key)
    return requests.select(*requests.columns, F.coalesce(hint, sampled).alias("arm"))


def initial_arms(spark, arms=ARMS) -> DataFrame:
    """Bandit state with every arm at Beta(1, 1)."""
    return spark.createDataFrame([(i, a, 1.0, 1.0) for i, a in enumerate(arms)],
                                 "arm_order int, arm string, alpha double, beta double")


# ---------------------------------------------------------------- H3
def update_arms(state: DataFrame, rewards: DataFrame) -> DataFrame:
    """H3: α += clip(r, 0, 1), β += 1 − clip(r, 0, 1) per reward; an unseen
    arm starts at (1, 1).  A null or NaN reward says nothing.  Additive, so
    rewards aggregate in any order."""
    given = F.nanvl(F.col("reward").cast("double"), F.lit(None).cast("double"))
    r = F.least(F.greatest(given, F.lit(0.0)), F.lit(1.0))
    agg = rewards.where(given.isNotNull()).groupBy("arm").agg(F.sum(r).alias("_s"), F.count(F.lit(1)).alias("_n"))
    j = state.join(agg, "arm", "full_outer")
    # The catalogue of arms is small; new arms follow the known ones by name.
    order = Window.orderBy(F.coalesce(F.col("arm_order"), F.lit(2 ** 31 - 1)), "arm")
    return j.select(
        "arm",
        (F.row_number().over(order) - 1).cast("int").alias("arm_order"),
        (F.coalesce(F.col("alpha"), F.lit(1.0)) + F.coalesce(F.col("_s"), F.lit(0.0))).alias("alpha"),
        (F.coalesce(F.col("beta"), F.lit(1.0)) + F.coalesce(F.col("_n") - F.col("_s"), F.lit(0.0))).alias("beta"))


# ---------------------------------------------------------------- H4
def price_batch(requests: DataFrame, snapshots: dict, state: DataFrame | None = None, seed: int = 0,
                deterministic: bool = False) -> DataFrame:
    """H4: online feature lookup by event → arm → H1; a request with no
    feature row, or a null/NaN result, gets the fallback price·1.05 with arm
    "fallback" and the same ±10 % band."""
    from turnstile.operators.store import EVENT_REALTIME
    refs = [f"{EVENT_REALTIME.name}:current_inventory", f"{EVENT_REALTIME.name}:sell_through_rate_5min"]
    feats = get_online_features(requests, {v: s for v, s in snapshots.items()}, refs)
    if state is not None:
        feats = choose_arm(feats, state, seed=seed, deterministic=deterministic)
    else:
        feats = feats.withColumn("arm", F.coalesce(F.col("arm_hint"), F.lit(ARMS[0])))
    priced = recommend_price(feats)
    rp = F.col("recommended_price")
    bad = rp.isNull() | F.isnan(rp) | F.col(INVENTORY_COL).isNull()
    fb = F.col("current_price").cast("double") * FALLBACK_UPLIFT
    out = priced.select(
        *[c for c in requests.columns],
        F.when(bad, fb).otherwise(rp).alias("recommended_price"),
        F.when(bad, F.lit("fallback")).otherwise(F.col("arm")).alias("arm"),
        F.when(bad, fb * BAND_LOW).otherwise(F.col("lower_confidence")).alias("lower_confidence"),
        F.when(bad, fb * BAND_HIGH).otherwise(F.col("upper_confidence")).alias("upper_confidence"))
    return out
