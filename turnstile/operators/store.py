"""D — feature store as DataFrames: views, point-in-time retrieval, snapshots.

The "online store" is a one-row-per-key snapshot table; the "offline store"
is any DataFrame keyed by (entity keys, event_timestamp[, ingested_at]).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstile.functions.scalars import INT32_MOD, normalize_entity_id
from turnstile.session import reuse

# Rows of one (keys, bucket) pair that one task may hold in the point-in-time join.
HOT_ROWS = 1_000_000


@dataclass(frozen=True)
class FeatureView:
    """Entity keys + TTL + typed fields over a timestamped source."""
    name: str
    entities: tuple[str, ...]
    ttl_seconds: int
    fields: tuple[tuple[str, str], ...]
    timestamp: str = "event_timestamp"
    ingested: str | None = "ingested_at"
    online: bool = True
    tags: dict = field(default_factory=dict, compare=False, hash=False)

    @property
    def feature_names(self) -> list[str]:
        return [f for f, _ in self.fields]


# The four feature views of the reference (keys, TTL, fields).
EVENT_REALTIME = FeatureView("event_realtime_metrics", ("event_id",), 60 * 60, (
    ("current_inventory", "bigint"), ("sell_through_rate_5min", "float"), ("concurrent_viewers", "bigint")))
EVENT_HISTORICAL = FeatureView("event_historical_metrics", ("event_id", "promoter_id"), 365 * 86400, (
    ("total_tickets_sold", "bigint"), ("avg_ticket_price", "float"), ("promoter_success_rate", "float")))
USER_PURCHASE = FeatureView("user_purchase_behavior", ("user_id",), 365 * 86400, (
    ("lifetime_purchases", "bigint"), ("fraud_risk_score", "float"), ("preferred_category", "string")))
USER_REALTIME = FeatureView("user_realtime_fraud_features", ("user_id",), 2 * 3600, (
    ("user_txn_count_1h", "bigint"), ("user_txn_amount_1h", "float"),
    ("user_distinct_events_1h", "bigint"), ("user_avg_amount_24h", "float")))
VIEWS = (EVENT_REALTIME, EVENT_HISTORICAL, USER_PURCHASE, USER_REALTIME)
# Default lookups of the two services.
FRAUD_REFS = ("user_realtime_fraud_features:user_txn_count_1h", "user_purchase_behavior:fraud_risk_score")
PRICING_REFS = ("event_realtime_metrics:current_inventory", "event_realtime_metrics:sell_through_rate_5min",
                "event_historical_metrics:avg_ticket_price")


def _ingested(df: DataFrame, view: FeatureView) -> Column:
    if view.ingested and view.ingested in df.columns:
        return F.col(view.ingested)
    return F.col(view.timestamp)  # SURVEY R5: fall back to the event time


# ---------------------------------------------------------------- D9
def conform_view(df: DataFrame, view: FeatureView) -> DataFrame:
    """Keys + timestamp (+ ingested_at) + declared fields, declared types."""
    cols = [F.col(k) for k in view.entities] + [F.col(view.timestamp)]
    if view.ingested and view.ingested in df.columns:
        cols.append(F.col(view.ingested))
    cols += [F.col(f).cast(t).alias(f) for f, t in view.fields]
    return df.select(*cols)


# ---------------------------------------------------------------- D1
def feature_view_health(sources: dict[FeatureView, DataFrame]) -> DataFrame:
    """One row per (view, field): rows, distinct keys, null share, max
    timestamp, TTL.  One aggregate per view table, unioned."""
    parts = []
    for view, df in sources.items():
        key = F.struct(*[F.col(k) for k in view.entities])
        aggs = [F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_keys"),
                F.max(view.timestamp).alias("max_event_timestamp")]
        aggs += [F.count_if(F.col(f).isNull()).alias(f"_null_{f}") for f in view.feature_names]
        one = df.agg(*aggs)
        stacked = F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_null_{f}").alias("_nulls"))
                                     for f in view.feature_names]))
        parts.append(one.select(F.lit(view.name).alias("view"), "n_rows", "n_keys", "max_event_timestamp",
                                F.lit(view.ttl_seconds).cast("long").alias("ttl_seconds"), stacked)
                     .select("view", "field", "n_rows", "n_keys", "max_event_timestamp", "ttl_seconds",
                             F.coalesce(F.try_divide(F.col("_nulls"), F.col("n_rows")), F.lit(0.0)).alias("null_share")))
    return reduce(DataFrame.unionByName, parts)


# ---------------------------------------------------------------- D2
def _segments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``_pit_s``, the segment of its (keys, bucket): 0, or where
    any bucket has more than HOT_ROWS rows the range of the whole order in
    which a row lies, so that a bucket has a segment in each range it touches."""
    most, total = rows.groupBy(*keys, "_pit_b").count().agg(F.max("count"), F.sum("count")).first()
    if (most or 0) <= HOT_ROWS:
        return rows.withColumn("_pit_s", F.lit(0))
    order = [*keys, "_pit_b", "_pit_us", "_pit_side", "_pit_ing", "_pit_h", "_pit_row"]
    ranges = max(-(-total // HOT_ROWS), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(ranges, *order)
    return reuse(dealt.withColumn("_pit_s", F.spark_partition_id()))  # stored, so a segment stays what it is


def get_historical_features(entity_df: DataFrame, feature_df: DataFrame, view: FeatureView,
                            entity_ts: str = "event_timestamp", features=None,
                            bucket_seconds: int = 86400, prefix: str | None = None) -> DataFrame:
    """Point-in-time join — for each entity row the latest feature row of
    the same keys with ``feature_ts <= entity_ts`` (ties → newest
    ``ingested_at``), then null when older than the view's TTL.

    Built as union + window (Spark has no as-of join).  To keep a hot key
    from landing in one task, the window is partitioned by (keys, time
    bucket, segment): if a bucket is crowded, rows are dealt out by ranges of
    their order and a segment is what one range holds, so even rows of one key
    and one instant lie in many tasks.  Of feature rows that tie in both times the one
    with the largest hash counts.  Rows with a null key match
    nothing; such entities keep null features.  Entity rows travel through the union as one struct, so no
    row id and no join back to the entity table are needed.  For entities
    whose segment holds no earlier feature row, the last feature row of the
    nearest earlier segment is carried forward by a second, small window
    over one row per segment, and joined on it — the
    partitioning the first window already produced.  Feature rows are
    wrapped in a struct so a latest row holding nulls is still the latest.
    """
    keys = list(view.entities)
    feats = list(features or view.feature_names)
    bucket_us = bucket_seconds * 1_000_000
    fts = F.col(view.timestamp)
    fpay = F.struct(fts.alias("ts"), _ingested(feature_df, view).alias("ing"), *[F.col(f) for f in feats])
    pay_type = feature_df.select(fpay.alias("p")).schema["p"].dataType
    ent_type = entity_df.select(F.struct(*entity_df.columns).alias("e")).schema["e"].dataType

    def us_of(c):
        return F.unix_micros(c.cast("timestamp"))

    have_keys = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])
    f_rows = feature_df.where(have_keys).select(
        *keys, us_of(fts).alias("_pit_us"), F.lit(0).alias("_pit_side"), _ingested(feature_df, view).alias("_pit_ing"),
        fpay.alias("_pit_p"), F.lit(None).cast(ent_type).alias("_pit_e"))
    ets = F.col(entity_ts)
    e_rows = entity_df.select(
        *keys, us_of(ets).alias("_pit_us"), F.lit(1).alias("_pit_side"),
        F.lit(None).cast(pay_type["ing"].dataType).alias("_pit_ing"), F.lit(None).cast(pay_type).alias("_pit_p"),
        F.struct(*[F.col(c) for c in entity_df.columns]).alias("_pit_e"))
    coarse = F.floor(F.col("_pit_us") / F.lit(bucket_us)) * F.lit(bucket_us)
    # Both sides are read once; every later branch reads this copy.
    u = reuse(f_rows.unionByName(e_rows).withColumn("_pit_b", coarse).withColumn("_pit_h", F.xxhash64("_pit_p"))
              .withColumn("_pit_row", F.monotonically_increasing_id()))
    keyed = _segments(u.where(have_keys), keys)
    order = ["_pit_us", "_pit_side", "_pit_ing", "_pit_h", "_pit_row"]
    unit = [*keys, "_pit_b", "_pit_s"]
    w = Window.partitionBy(*unit).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inb = (keyed.withColumn("_pit_in", F.last("_pit_p", ignorenulls=True).over(w))
           .where(F.col("_pit_side") == 1)
           .select(*unit, "_pit_e", "_pit_in"))
    # One row per segment: its last feature row, and whether entities are in
    # it.  A segment takes the last row of strictly earlier ones.
    latest = F.struct("_pit_us", "_pit_ing", "_pit_h", "_pit_row")
    per_s = keyed.groupBy(*unit).agg(F.max_by("_pit_p", F.when(F.col("_pit_side") == 0, latest)).alias("_pit_lb"),
                                     F.max("_pit_side").alias("_pit_has"))
    w2 = Window.partitionBy(*keys).orderBy("_pit_b", "_pit_s").rowsBetween(Window.unboundedPreceding, -1)
    carried = (per_s.withColumn("_pit_prev", F.last("_pit_lb", ignorenulls=True).over(w2))
                    .where((F.col("_pit_has") == 1) & F.col("_pit_prev").isNotNull())
                    .select(*unit, "_pit_prev"))
    res = inb.join(carried, unit, "left") \
             .select("_pit_e", F.coalesce("_pit_in", "_pit_prev").alias("_pit_f"))
    # An entity without a whole key has no features.
    keyless = u.where(~have_keys).select("_pit_e", F.lit(None).cast(pay_type).alias("_pit_f"))
    res = res.unionByName(keyless)
    ttl_ok = us_of(F.col("_pit_f.ts")) >= us_of(F.col(f"_pit_e.{entity_ts}")) - F.lit(view.ttl_seconds * 1_000_000)
    pre = prefix if prefix is not None else ""
    fcols = [F.when(ttl_ok, F.col(f"_pit_f.{f}")).alias(f"{pre}{f}") for f in feats]
    return res.select(*[F.col(f"_pit_e.{c}").alias(c) for c in entity_df.columns], *fcols)


def historical_features(entity_df: DataFrame, sources: dict[FeatureView, DataFrame], refs,
                        entity_ts: str = "event_timestamp", full_feature_names: bool = False,
                        bucket_seconds: int = 86400) -> DataFrame:
    """D2 over several views: ``refs`` are ``view:feature`` strings.  One
    point-in-time join per view, chained — entity rows pass through each
    join unchanged, so no row id is needed.  Columns are the feature names,
    or ``view__feature`` with ``full_feature_names``."""
    by_view: dict[str, list[str]] = {}
    for r in refs:
        v, f = r.split(":", 1)
        by_view.setdefault(v, []).append(f)
    out = entity_df
    for view, feats_df in sources.items():
        if view.name not in by_view:
            continue
        out = get_historical_features(out, feats_df, view, entity_ts=entity_ts, features=by_view[view.name],
                                      bucket_seconds=bucket_seconds,
                                      prefix=f"{view.name}__" if full_feature_names else "")
    return out


# ---------------------------------------------------------------- D3
def materialize(view_df: DataFrame, view: FeatureView, start=None, end=None) -> DataFrame:
    """D3: latest row per entity among rows with start <= ts <= end.

    ``max_by`` is an ordinary aggregate, so it is partially evaluated
    map-side; a hot key costs one buffer row per task, not a sort.
    """
    df = view_df
    ts = F.col(view.timestamp)
    if start is not None:
        df = df.where(ts >= (start if isinstance(start, Column) else F.lit(start)))
    if end is not None:
        df = df.where(ts <= (end if isinstance(end, Column) else F.lit(end)))
    keys = list(view.entities)
    others = [c for c in df.columns if c not in keys]
    latest = df.groupBy(*keys).agg(F.max_by(
        F.struct(*others), F.struct(ts, _ingested(df, view), F.xxhash64(*others))).alias("_row"))  # ties: one fixed row
    return latest.select(*keys, "_row.*")


# ---------------------------------------------------------------- D4
def upsert_snapshot(snapshot: DataFrame | None, updates: DataFrame, keys, ts_col: str) -> DataFrame:
    """New snapshot = latest row per key over (old snapshot ∪ updates).

    At equal times an update beats the snapshot.  Idempotent: re-applying the
    same batch gives the same snapshot."""
    keys = list(keys)
    both = updates.withColumn("_new", F.lit(1))
    if snapshot is not None:
        both = snapshot.withColumn("_new", F.lit(0)).unionByName(both, allowMissingColumns=True)
    others = [c for c in both.columns if c not in keys and c != "_new"]
    order = F.struct(F.col(ts_col), F.col("_new"), F.xxhash64(*others))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_r")).select(*keys, "_r.*")


# ---------------------------------------------------------------- D5
def get_online_features(entities: DataFrame, snapshots: dict[FeatureView, DataFrame], refs) -> DataFrame:
    """One output row per entity row; ``view__feature`` columns, missing → null.

    ``entities`` must carry a ``request_id`` so callers can restore order.
    A view whose keys are not all in the request resolves the missing keys
    through the snapshot itself (SURVEY R6: event → promoter); one that shares
    no key with the request gives nulls.
    """
    by_view: dict[str, list[str]] = {}
    for r in refs:
        v, f = r.split(":", 1)
        by_view.setdefault(v, []).append(f)
    # Views over one snapshot with the same request keys share a single join.
    sides: dict[tuple, list] = {}
    for view, snap in snapshots.items():
        if view.name in by_view:
            keys = tuple(k for k in view.entities if k in entities.columns)
            sides.setdefault((id(snap), keys), []).append((view, snap))
    out = entities
    for (_, keys), views in sides.items():
        snap = views[0][1]
        if not keys:  # the request says nothing about the view's entities
            out = out.select("*", *[F.lit(None).cast(snap.schema[f].dataType).alias(f"{v.name}__{f}")
                                    for v, _ in views for f in by_view[v.name]])
            continue
        values = {f"{v.name}__{f}": F.col(f) for v, _ in views for f in by_view[v.name]}
        # One whole row per key, the latest: repeated keys never multiply
        # requests, and keys missing from the request (e.g. promoter for an
        # event) are resolved without mixing values of different rows.
        rest = [k for v, _ in views for k in v.entities if k not in keys and k in snap.columns]
        times = [v.timestamp for v, _ in views if v.timestamp in snap.columns]
        order = [F.col(c) for c in dict.fromkeys([*times, *rest])]
        picked = F.struct(*[c.alias(n) for n, c in values.items()])
        side = snap.where(F.col(keys[0]).isNotNull()).groupBy(*keys).agg(
            F.max_by(picked, F.struct(*order, F.xxhash64(*values.values()))).alias("_r")).select(*keys, "_r.*")
        out = out.join(side, list(keys), "left")
    return out


# ---------------------------------------------------------------- D6
def normalize_ids(df: DataFrame, cols, modulus: int = INT32_MOD) -> DataFrame:
    """D6 over whole columns: integral columns pass through, others are mapped
    (``modulus``: key space of hashed ids)."""
    types = dict(df.dtypes)
    out = {}
    for c in cols:
        if types[c] in ("tinyint", "smallint", "int", "bigint"):
            out[c] = F.col(c).cast("long")
        else:
            out[c] = normalize_entity_id(F.col(c), modulus)
    return df.withColumns(out)


# ---------------------------------------------------------------- D7
def build_feature_frame(requests: DataFrame, model_columns, overrides_col: str = "overrides",
                        null_as: float | None = None) -> DataFrame:
    """Model input frame — a request's override map replaces its own
    feature values, unknown override names are ignored, absent model columns
    are filled with 0.0; fixed column order (request_id first).

    ``null_as`` also fills values that are present but null (entity missing
    from the online store) — needed by models that reject NaN inputs."""
    have = set(requests.columns)
    cols = [F.col("request_id")]
    ov = F.col(overrides_col) if overrides_col in have else None
    for c in model_columns:
        base = F.col(c).cast("double") if c in have else F.lit(0.0)
        if ov is not None:
            base = F.coalesce(F.try_element_at(ov, F.lit(c)), base)
        if c in have and null_as is not None:
            base = F.coalesce(base, F.lit(float(null_as)))
        cols.append(F.coalesce(base, F.lit(0.0)).alias(c) if c not in have else base.alias(c))
    return requests.select(*cols)


# ---------------------------------------------------------------- D8
def feature_freshness(sources: dict[FeatureView, DataFrame], as_of, max_age_s: float = 300.0) -> DataFrame:
    """Per view seconds since its newest row; ``stale`` when > max_age.

    ``as_of`` is a literal, a Column, or a one-row DataFrame whose first
    column holds the reference time (joined as a bounded one-row side).
    """
    parts = []
    for view, df in sources.items():
        parts.append(df.agg(F.max(view.timestamp).cast("timestamp").alias("_max_ts"))
                     .select(F.lit(view.name).alias("view"), "_max_ts"))
    u = reduce(DataFrame.unionByName, parts)
    if isinstance(as_of, DataFrame):
        u = u.crossJoin(F.broadcast(as_of.select(F.col(as_of.columns[0]).cast("timestamp").alias("_as_of"))))
        ref = F.col("_as_of")
    else:
        ref = (as_of if isinstance(as_of, Column) else F.lit(as_of)).cast("timestamp")
    age = (F.unix_micros(ref) - F.unix_micros(F.col("_max_ts"))) / F.lit(1e6)
    return u.select("view", F.col("_max_ts").cast("timestamp_ntz").alias("max_event_timestamp"),
                    age.alias("freshness_seconds"), (age > F.lit(max_age_s)).alias("stale"))


# ---------------------------------------------------------------- D10
def requests_from_transactions(txns: DataFrame, overrides: Column | None = None) -> DataFrame:
    """Scoring requests (user, event, amount default 0.0, optional overrides)."""
    cols = [F.col("transaction_id").alias("request_id"), "user_id", "event_id",
            F.coalesce(F.col("total_amount").cast("double"), F.lit(0.0)).alias("amount")]
    if overrides is not None:
        cols.append(overrides.alias("overrides"))
    return txns.select(*cols)
