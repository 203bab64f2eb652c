"""C — per-user realtime fraud features (batch forms).

Feature names follow the reference's feature view.  Two meanings of the
``_1h``/``_24h`` names coexist (SURVEY R1): :func:`user_realtime_features`
aggregates whatever window the caller filtered (the hourly job passes the
last 24 h), :func:`trailing_user_features` gives the literal trailing
1 h / 24 h windows as of every transaction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstile.functions.scalars import cents, money_sum

FEATURES = ["user_txn_count_1h", "user_txn_amount_1h", "user_distinct_events_1h", "user_avg_amount_24h"]
HOUR_US = 3600 * 1_000_000


def _lit_ts(as_of) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of)


# ---------------------------------------------------------------- C1
def user_realtime_features(raw: DataFrame, as_of=None) -> DataFrame:
    """Per user count, amount sum (nulls skipped, all-null → 0), distinct
    events, average = sum / max(count, 1); both timestamps = ``as_of``.

    ``as_of`` may be a literal, a Column, None to use ``max(timestamp)`` of
    the input (a one-row aggregate, not a window), or the name of a column
    already carrying the bound (no extra pass over the input).
    Null user ids are dropped, as the reference's group-by does.
    """
    agg = (raw.where(F.col("user_id").isNotNull())
              .groupBy("user_id")
              .agg(F.count("user_id").alias("user_txn_count_1h"),
                   F.coalesce(money_sum("total_amount"), F.lit(0.0)).alias("user_txn_amount_1h"),
                   F.countDistinct("event_id").alias("user_distinct_events_1h")))
    agg = agg.withColumn("user_avg_amount_24h",
                         F.col("user_txn_amount_1h") / F.greatest(F.col("user_txn_count_1h"), F.lit(1)))
    if isinstance(as_of, str):
        # the bound travels with the rows (see filter_recent(keep_bound=...))
        return (raw.where(F.col("user_id").isNotNull()).groupBy("user_id")
                   .agg(F.count("user_id").alias("user_txn_count_1h"),
                        F.coalesce(money_sum("total_amount"), F.lit(0.0)).alias("user_txn_amount_1h"),
                        F.countDistinct("event_id").alias("user_distinct_events_1h"),
                        F.max(as_of).alias("event_timestamp"))
                   .withColumn("user_avg_amount_24h",
                               F.col("user_txn_amount_1h") / F.greatest(F.col("user_txn_count_1h"), F.lit(1)))
                   .select("user_id", *FEATURES, "event_timestamp")
                   .withColumn("ingested_at", F.col("event_timestamp")))
    if as_of is None:
        stamp = raw.agg(F.max("timestamp").alias("event_timestamp"))
        out = agg.crossJoin(F.broadcast(stamp))
    else:
        out = agg.withColumn("event_timestamp", _lit_ts(as_of))
    return out.withColumn("ingested_at", F.col("event_timestamp"))


# ---------------------------------------------------------------- C2
def reference_features(seed_txns: DataFrame) -> DataFrame:
    """The C1 aggregate over the reference transactions; the 4 feature columns."""
    return user_realtime_features(seed_txns, as_of=F.lit(None).cast("timestamp")).select("user_id", *FEATURES)


# ---------------------------------------------------------------- C6
def trailing_user_features(txns: DataFrame, ts_col: str = "event_timestamp", bucket_hours: int = 24) -> DataFrame:
    """The realtime features as of each transaction (training-time form):
    trailing 1 h count, amount and distinct events, trailing 24 h mean amount,
    over ``(ts - width, ts]``; rows at equal timestamps see each other.

    Every row adds its weight when it arrives and takes it back when it leaves
    the 1 h and the 24 h window, so a trailing total is a running total over
    these steps: linear, no frame is summed again.  An event counts as distinct
    from an occurrence to its last repetition plus one hour, found from the
    neighbouring occurrences of (user, event).

    Rows are shuffled once, by (user, bucket of time), so a busy user is many
    tasks.  A row goes to its own bucket, and without id to later ones that
    begin less than 24 h after it: for buckets of a day at most one.  So a bucket
    holds all that its windows see, and steps are made and summed within it.
    """
    day, width = 24 * HOUR_US, bucket_hours * HOUR_US
    us = F.unix_micros(F.col(ts_col).cast("timestamp"))

    def begin(at: Column) -> Column:
        return at - F.pmod(at, F.lit(width))
    rows = txns.select("transaction_id", "user_id", "event_id", ts_col, cents("total_amount").alias("_cents"),
                       F.explode(F.sequence(begin(us), begin(us + F.lit(day - 1)), F.lit(width))).alias("_bucket"))
    own = F.col("_us") >= F.col("_bucket")
    rows = rows.withColumn("transaction_id", F.when(us >= F.col("_bucket"), F.col("transaction_id"))) \
               .repartition("user_id", "_bucket").withColumn("_us", us)
    same = Window.partitionBy("user_id", "_bucket", "event_id").orderBy("_us")
    last, after = F.lag("_us").over(same), F.lead("_us").over(same)
    known = F.col("event_id").isNotNull()
    rows = rows.withColumn("_starts", (known & F.coalesce(F.col("_us") - last >= HOUR_US, F.lit(True))).cast("int")) \
               .withColumn("_ends", (known & F.coalesce(after - F.col("_us") >= HOUR_US, F.lit(True))).cast("int"))
    c = F.coalesce(F.col("_cents"), F.lit(0))
    zero, one = F.lit(0), F.lit(1)

    # Only the step of a row's arrival in its own bucket names it; its time is never null.
    def step(at, arrives, n1, s1, d1, n24, s24):
        named = [F.when(F.lit(arrives) & own, F.col(x)).alias(x) for x in ("transaction_id", ts_col)]
        return F.struct(*named, at.alias("_at"), n1.alias("_n1"), s1.alias("_s1"), d1.alias("_d1"), n24.alias("_n24"),
                        s24.alias("_s24"))
    steps = F.array(step(F.col("_us"), True, one, c, F.col("_starts"), one, c),
                    step(F.col("_us") + HOUR_US, False, -one, -c, -F.col("_ends"), zero, zero),
                    step(F.col("_us") + day, False, zero, zero, zero, -one, -c))
    points = rows.select("user_id", "_bucket", F.inline(steps)).where(F.col("_at") < F.col("_bucket") + width)
    up_to = Window.partitionBy("user_id", "_bucket").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    j = points.select("transaction_id", "user_id", ts_col, *[
        F.sum(x).over(up_to).alias(x) for x in ("_n1", "_s1", "_d1", "_n24", "_s24")]).where(F.col(ts_col).isNotNull())
    return j.select("transaction_id", "user_id", ts_col, F.col("_n1").alias("user_txn_count_1h"),
                    (F.col("_s1") / F.lit(100.0)).alias("user_txn_amount_1h"),
                    F.col("_d1").alias("user_distinct_events_1h"),
                    (F.col("_s24") / F.lit(100.0) / F.greatest(F.col("_n24"), F.lit(1))).alias("user_avg_amount_24h"))


# ---------------------------------------------------------------- C7
def feature_parity(stream_out: DataFrame, batch_out: DataFrame, features=None, tol: float = 1e-6,
                   key: str = "user_id") -> DataFrame:
    """Compare streaming and batch feature tables key by key.

    One row: keys in each side, keys missing from either side, keys whose
    feature values differ by more than ``tol`` (nulls on one side count).
    """
    features = list(features or [c for c in stream_out.columns if c in batch_out.columns and c != key])
    s = stream_out.select(key, *[F.col(c).alias(f"s_{c}") for c in features]).withColumn("_s", F.lit(True))
    b = batch_out.select(key, *[F.col(c).alias(f"b_{c}") for c in features]).withColumn("_b", F.lit(True))
    j = s.join(b, key, "full_outer")
    differs = F.lit(False)
    for c in features:
        sc, bc = F.col(f"s_{c}").cast("double"), F.col(f"b_{c}").cast("double")
        d = F.when(sc.isNull() & bc.isNull(), F.lit(False)) \
             .when(sc.isNull() | bc.isNull(), F.lit(True)) \
             .otherwise(F.abs(sc - bc) > F.lit(tol))
        differs = differs | d
    both = F.col("_s").isNotNull() & F.col("_b").isNotNull()
    return j.agg(
        F.count_if(F.col("_s").isNotNull()).alias("n_stream"),
        F.count_if(F.col("_b").isNotNull()).alias("n_batch"),
        F.count_if(F.col("_s").isNull()).alias("missing_in_stream"),
        F.count_if(F.col("_b").isNull()).alias("missing_in_batch"),
        F.count_if(both & differs).alias("mismatched"),
    ).withColumn("parity", (F.col("missing_in_stream") + F.col("missing_in_batch") + F.col("mismatched")) == 0)
