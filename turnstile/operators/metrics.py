"""B — ticketing batch metrics.

Inputs use the logical tables of :mod:`turnstile.plans.views`:
``txns(transaction_id, user_id, event_id, event_timestamp, quantity,
ticket_price, total_amount, is_fraud)``, ``ticket_events(event_id,
promoter_id, category, capacity, base_price, popularity, start_time)`` and
``users(user_id, loyalty_tier, country, signup_date)``.

Scale notes: every per-key statistic is a ``groupBy`` (map-side partial
aggregation, so a hot event or promoter never lands whole in one task)
followed by an equi-join back.  Global scalars (max over promoters) are
one-row aggregates joined with ``crossJoin`` — the only broadcast whose
size is bounded by construction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.functions.scalars import clip, fround, iso_millis_z
from turnstile.session import reuse

# Fixed values from the reference: fraud rule, pricing tiers, sell-out rates.
FRAUD_BASE_PROB = 0.03
FRAUD_HIGH_PRICE = 300.0
FRAUD_HIGH_PRICE_BOOST = 0.05
FRAUD_PLATINUM_PENALTY = -0.02
FRAUD_PROB_MIN, FRAUD_PROB_MAX = 0.001, 0.3
MEGA_POPULARITY, HIGH_POPULARITY = 0.9, 0.7
PRICE_RANGE_MEGA = (200.0, 2000.0)
PRICE_RANGE_HIGH = (100.0, 800.0)
PRICE_RANGE_OTHER = (50.0, 300.0)
TIER_SHARES = (("VIP", 0.10), ("Premium", 0.30), ("Standard", 0.60))
TIER_BENEFITS = {
    "VIP": ["Meet & Greet", "Premium Seating", "VIP Lounge"],
    "Premium": ["Priority Entry", "Better View"],
    "Standard": [],
}
SELLOUT_BASE_RATE = 100.0  # tickets/hour; x1000 for mega events, x100 for popular ones


# ---------------------------------------------------------------- B1
def event_sales(txns: DataFrame) -> DataFrame:
    """B1: per event tickets sold, mean ticket price, max quantity."""
    return txns.groupBy("event_id").agg(
        F.sum("quantity").alias("total_tickets_sold"),
        F.avg("ticket_price").alias("avg_ticket_price"),
        F.max("quantity").alias("concurrent_viewers"),
    )


# ---------------------------------------------------------------- B2
def event_inventory(events: DataFrame, sales: DataFrame) -> DataFrame:
    """B2: left join events with sales; defaults, sell-through and inventory."""
    j = events.join(sales, "event_id", "left")
    sold = F.coalesce(F.col("total_tickets_sold"), F.lit(0)).cast("long")
    ratio = F.when(F.col("capacity") == 0,
                   F.when(sold > 0, F.lit(1.0)).otherwise(F.lit(float("nan"))))\
             .otherwise(sold / F.col("capacity"))
    return j.select(
        *[c for c in events.columns],
        sold.alias("total_tickets_sold"),
        F.coalesce(F.col("avg_ticket_price"), F.col("base_price").cast("double")).alias("avg_ticket_price"),
        F.coalesce(F.col("concurrent_viewers"), F.lit(0)).cast("long").alias("concurrent_viewers"),
        clip(ratio, 0.0, 1.0).alias("sell_through_rate_5min"),
        F.greatest(F.col("capacity") - sold, F.lit(0)).cast("long").alias("current_inventory"),
    )


# ---------------------------------------------------------------- B3
def promoter_success(df: DataFrame, sold_col: str = "total_tickets_sold") -> DataFrame:
    """Mean tickets per promoter (each event once) over the largest
    promoter mean; a zero or missing maximum divides by 1, missing → 0.

    Group-by + join back instead of an un-bounded ``Window.partitionBy`` so a
    promoter holding a third of all events is still partially aggregated.
    """
    per_promoter = (df.where(F.col("promoter_id").isNotNull())
                    .groupBy("promoter_id").agg(F.avg(sold_col).alias("_promoter_sales")))
    top = per_promoter.agg(F.max("_promoter_sales").alias("_max_sales"))
    denom = F.coalesce(F.when(F.col("_max_sales") != 0, F.col("_max_sales")), F.lit(1.0))
    return (df.join(per_promoter, "promoter_id", "left")
              .crossJoin(F.broadcast(top))
              .withColumn("promoter_success_rate",
                          F.coalesce(F.col("_promoter_sales") / denom, F.lit(0.0)))
              .drop("_promoter_sales", "_max_sales"))


# ---------------------------------------------------------------- B4
EVENT_METRIC_COLUMNS = [
    "event_id", "promoter_id", "event_timestamp", "current_inventory",
    "sell_through_rate_5min", "concurrent_viewers", "total_tickets_sold",
    "avg_ticket_price", "promoter_success_rate",
]


def event_metrics(events: DataFrame, txns: DataFrame, sort: bool = True, materialize: bool = True) -> DataFrame:
    """B4 (flagship): B1 → B2 → B3, event_timestamp = start_time, 9 columns.

    The event-level table feeds three branches (output rows, per-promoter
    means, the global maximum).  With ``materialize`` it is checkpointed
    once — one row per event, far smaller than the transactions — so the
    transactions are scanned and aggregated once instead of three times.
    """
    inv = event_inventory(events, event_sales(txns))
    if materialize:
        inv = reuse(inv)
    out = promoter_success(inv).withColumn("event_timestamp", F.col("start_time"))
    out = out.select(*EVENT_METRIC_COLUMNS)
    return out.orderBy("event_id") if sort else out


# ---------------------------------------------------------------- B5/B6
def preferred_category(txns: DataFrame, events: DataFrame) -> DataFrame:
    """Most frequent category per user; ties → larger category name."""
    counts = (txns.select("user_id", "event_id")
              .join(events.select("event_id", "category"), "event_id", "inner")
              .groupBy("user_id", "category").agg(F.count(F.lit(1)).alias("_n")))
    return counts.groupBy("user_id").agg(
        F.max_by("category", F.struct("_n", "category")).alias("preferred_category"))


def user_metrics(users: DataFrame, txns: DataFrame, events: DataFrame | None = None,
                 sort: bool = True) -> DataFrame:
    """Lifetime purchases, fraud risk score per user (+ B6 category).

    With ``events`` the transactions are read once: partial sums per
    (user, category) feed both the per-user totals and the preferred
    category (transactions of unknown events still count in the totals).
    """
    if events is None:
        agg = txns.groupBy("user_id").agg(
            F.sum("quantity").alias("_purchases"),
            F.avg(F.col("is_fraud").cast("double")).alias("_fraud_rate"))
    else:
        per_cat = (txns.select("user_id", "event_id", "quantity", "is_fraud")
                   .join(events.select("event_id", "category"), "event_id", "left")
                   .groupBy("user_id", "category")
                   .agg(F.sum("quantity").alias("_q"), F.sum(F.col("is_fraud").cast("double")).alias("_f"),
                        F.count("is_fraud").alias("_nf"), F.count(F.lit(1)).alias("_n")))
        known = F.col("category").isNotNull()
        agg = per_cat.groupBy("user_id").agg(
            F.sum("_q").alias("_purchases"),
            (F.sum("_f") / F.sum("_nf")).alias("_fraud_rate"),
            F.max_by(F.when(known, F.col("category")),
                     F.when(known, F.struct(F.col("_n"), F.col("category")))).alias("preferred_category"))
    j = users.join(agg, "user_id", "left")
    cols = [
        F.col("user_id"),
        F.col("signup_date").alias("event_timestamp"),
        F.coalesce(F.col("_purchases"), F.lit(0)).cast("long").alias("lifetime_purchases"),
        clip(F.coalesce(F.col("_fraud_rate"), F.lit(0.0)), 0.0, 1.0).alias("fraud_risk_score"),
    ]
    if events is not None:
        cols.append(F.col("preferred_category"))
    out = j.select(*cols)
    return out.orderBy("user_id") if sort else out


# ---------------------------------------------------------------- B7
def event_price_aggregates(event_metrics_df: DataFrame) -> DataFrame:
    """Mean of avg_ticket_price per event."""
    return event_metrics_df.groupBy("event_id").agg(
        F.avg("avg_ticket_price").alias("avg_ticket_price_mean"))


# ---------------------------------------------------------------- B8
def enrich_transactions(txns: DataFrame, events: DataFrame, users: DataFrame) -> DataFrame:
    """Look up base_price (by event) and loyalty_tier (by user); missing → null.

    Dimension sides are projected to two columns; Catalyst broadcasts them
    when their measured size is under ``autoBroadcastJoinThreshold`` and
    falls back to a shuffle join otherwise.
    """
    return (txns.join(events.select("event_id", "base_price"), "event_id", "left")
                .join(users.select("user_id", "loyalty_tier"), "user_id", "left"))


# ---------------------------------------------------------------- B9
def rule_fraud_probability(df: DataFrame, price_col: str = "ticket_price",
                           tier_col: str = "loyalty_tier") -> DataFrame:
    """clip(0.03 + 0.05·[price>300] − 0.02·[tier=platinum], 0.001, 0.3)."""
    boost = F.when(F.col(price_col) > FRAUD_HIGH_PRICE, F.lit(FRAUD_HIGH_PRICE_BOOST)).otherwise(F.lit(0.0))
    pen = F.when(F.col(tier_col) == "platinum", F.lit(FRAUD_PLATINUM_PENALTY)).otherwise(F.lit(0.0))
    p = F.lit(FRAUD_BASE_PROB) + boost + pen
    return df.withColumn("fraud_probability", F.least(F.greatest(p, F.lit(FRAUD_PROB_MIN)), F.lit(FRAUD_PROB_MAX)))


# ---------------------------------------------------------------- B10
def transaction_amounts(df: DataFrame) -> DataFrame:
    """Wire form of a transaction (rounded money, ISO-8601 ms Z time)."""
    return df.select(
        F.col("user_id").cast("string").alias("user_id"),
        F.col("event_id").cast("long").alias("event_id"),
        fround(F.col("quantity") * F.col("ticket_price"), 2).alias("total_amount"),
        iso_millis_z("event_timestamp").alias("timestamp"),
        F.col("quantity").cast("long").alias("num_tickets"),
        fround("ticket_price", 2).alias("price_per_ticket"),
    )


# ---------------------------------------------------------------- B11/B12
def _price_bounds():
    pop = F.col("popularity")
    lo = (F.when(pop > MEGA_POPULARITY, F.lit(PRICE_RANGE_MEGA[0]))
           .when(pop > HIGH_POPULARITY, F.lit(PRICE_RANGE_HIGH[0])).otherwise(F.lit(PRICE_RANGE_OTHER[0])))
    hi = (F.when(pop > MEGA_POPULARITY, F.lit(PRICE_RANGE_MEGA[1]))
           .when(pop > HIGH_POPULARITY, F.lit(PRICE_RANGE_HIGH[1])).otherwise(F.lit(PRICE_RANGE_OTHER[1])))
    return lo, hi


def pricing_tiers(events: DataFrame, explode: bool = True) -> DataFrame:
    """Three pricing tiers per event from its popularity band.

    ``explode=False`` keeps the nested ``pricing_tiers`` array of structs;
    otherwise one row per (event, tier).
    """
    lo, hi = _price_bounds()
    prices = {"VIP": hi, "Premium": (lo + hi) / 2, "Standard": lo}
    tiers = F.array(*[
        F.struct(F.lit(name).alias("tier"), prices[name].alias("price"),
                 (F.col("capacity") * F.lit(share)).cast("int").alias("capacity"),
                 F.array(*[F.lit(b) for b in TIER_BENEFITS[name]]).cast("array<string>").alias("benefits"))
        for name, share in TIER_SHARES])
    nested = events.select("event_id", F.struct(lo.alias("min_price"), hi.alias("max_price")).alias("price_range"),
                           tiers.alias("pricing_tiers"))
    if not explode:
        return nested
    return nested.select("event_id", F.inline("pricing_tiers")).select(
        "event_id", "tier", "price", F.col("capacity").alias("tier_capacity"), "benefits")


def sellout_hours(events: DataFrame) -> DataFrame:
    """Expected sell-out hours and mega-event flag (event metadata)."""
    pop = F.col("popularity")
    rate = (F.when(pop > MEGA_POPULARITY, F.lit(SELLOUT_BASE_RATE * 1000))
             .when(pop > HIGH_POPULARITY, F.lit(SELLOUT_BASE_RATE * 100)).otherwise(F.lit(SELLOUT_BASE_RATE)))
    return events.select(
        "event_id",
        (pop > MEGA_POPULARITY).alias("is_mega_event"),
        (F.col("capacity") / rate).alias("expected_sellout_hours"),
    )


# ---------------------------------------------------------------- B13
def risk_indicators(txns: DataFrame, home_country: str = "SA", risky_threshold: float = 0.5) -> DataFrame:
    """Geo / time anomaly flags and a weighted risk score.

    Expects ``ip_country``, ``country`` (user's, may be null),
    ``velocity_score`` (0-10), ``device_mismatch`` (bool),
    ``fraud_probability`` and ``event_timestamp`` columns.
    """
    user_country = F.coalesce(F.col("country"), F.lit(home_country))
    geo = (F.col("ip_country") != F.lit(home_country)) & (F.col("ip_country") != user_country)
    hour = F.hour("event_timestamp")
    time_anom = ((hour < 4) | (hour > 23)) & (F.col("fraud_probability") > risky_threshold)
    geo = F.coalesce(geo, F.lit(False))
    time_anom = F.coalesce(time_anom, F.lit(False))
    dev = F.coalesce(F.col("device_mismatch"), F.lit(False))
    score = (F.col("velocity_score") / 10 * 0.3 + dev.cast("double") * 0.2
             + geo.cast("double") * 0.3 + time_anom.cast("double") * 0.2)
    return txns.select(
        "transaction_id",
        fround("velocity_score", 2).alias("velocity_score"),
        dev.alias("device_mismatch"),
        geo.alias("geo_mismatch"),
        time_anom.alias("time_anomaly"),
        fround(score, 2).alias("risk_score"),
    )


# ---------------------------------------------------------------- B14
def inject_drift(df: DataFrame, level: float, cols: list[str]) -> DataFrame:
    """Multiply numeric columns by 1+level (level clamped to [0,1]).

    Floating columns → round(x·m, 2); integral columns → max(1, round-half-even(x·m));
    nulls stay null; level ≤ 0 leaves the frame untouched.
    """
    level = min(max(float(level), 0.0), 1.0)
    if level <= 0:
        return df
    m = F.lit(1.0 + level)
    types = dict(df.dtypes)
    out = {}
    for c in cols:
        if c not in types:
            continue
        t = types[c]
        if t in ("double", "float") or t.startswith("decimal"):
            out[c] = fround(F.col(c) * m, 2).cast(t)
        elif t in ("int", "bigint", "smallint", "tinyint"):
            out[c] = F.greatest(F.lit(1), F.bround(F.col(c) * m, 0).cast("long")).cast(t)
    return df.withColumns(out) if out else df
