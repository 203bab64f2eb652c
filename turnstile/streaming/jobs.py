"""Structured Streaming jobs: decode, land, per-user state, online publish, windows.

Sources are Kafka in production (``kafka_source``) and a file source in
tests (``file_stream``).  Sinks are the Parquet file sink (exactly-once via
its commit log) and ``foreachBatch`` writers that are idempotent by batch id.
Every query takes its checkpoint folder explicitly; callers put it under
the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from turnstile.functions.scalars import cents, normalize_entity_id, parse_utc
from turnstile.session import keep_state_in_rocksdb
from turnstile.streaming.online import _run_id, compact_online, read_online, vacuum_online, write_online_batch

__all__ = ["compact_online", "read_online", "vacuum_online", "write_online_batch"]  # D4, beside the jobs below

# The stream record (field, default) and the consumer's limits.
RAW_FIELDS = [
    ("transaction_id", T.StringType(), ""), ("event_id", T.StringType(), None), ("user_id", T.StringType(), None),
    ("timestamp", T.StringType(), ""), ("num_tickets", T.LongType(), 0), ("tier", T.StringType(), ""),
    ("price_per_ticket", T.DoubleType(), 0.0), ("total_amount", T.DoubleType(), 0.0),
    ("payment_method", T.StringType(), ""), ("payment_status", T.StringType(), ""),
    ("device_type", T.StringType(), ""), ("browser", T.StringType(), ""), ("user_agent", T.StringType(), ""),
    ("ip_address", T.StringType(), ""), ("ip_country", T.StringType(), ""), ("session_id", T.StringType(), ""),
    ("is_fraud", T.BooleanType(), False), ("persona", T.StringType(), ""), ("is_bot", T.BooleanType(), False),
    ("fraud_indicators", T.MapType(T.StringType(), T.StringType()), None),
]
RAW_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t, _ in RAW_FIELDS])
_PARSE_SCHEMA = T.StructType(RAW_SCHEMA.fields + [T.StructField("_corrupt_record", T.StringType(), True)])
TOPIC = "raw.transactions"
PUSH_INTERVAL = "30 seconds"
REQUIRED_KEYS = ("user_id", "event_id", "total_amount", "timestamp")


# ---------------------------------------------------------------- A7
def kafka_source(spark: SparkSession, bootstrap: str, topic: str = TOPIC, starting: str = "earliest",
                 max_offsets: int | None = None) -> DataFrame:
    """The raw transaction topic as a stream of (key, value) strings.

    Needs the Kafka connector on the classpath; without it Spark raises
    ``DATA_SOURCE_NOT_FOUND`` when the stream is built.
    """
    r = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", bootstrap)
         .option("subscribe", topic).option("startingOffsets", starting))
    if max_offsets:
        r = r.option("maxOffsetsPerTrigger", str(max_offsets))
    return r.load().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def file_stream(spark: SparkSession, folder: str, schema, fmt: str = "parquet", glob: str | None = None,
                max_files: int | None = None) -> DataFrame:
    """A file source standing in for the topic (tests, replays)."""
    r = spark.readStream.schema(schema).format(fmt)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    return r.load(folder)


# ---------------------------------------------------------------- A5
def parse_transactions(df: DataFrame, value_col: str = "value", observe_as: str | None = None) -> DataFrame:
    """A5: decode JSON messages; malformed messages are dropped (and counted
    through ``observe`` when ``observe_as`` is given); absent fields take the
    record defaults; ids are normalised to integers (D6).

    One parse per message: the PERMISSIVE parser routes bad input to a
    corrupt-record field, and the parsed struct is materialised through a
    generator so the optimizer cannot split it into one parse per field.
    """
    d = decode_transactions(df, value_col)
    if observe_as:
        d = d.observe(observe_as, F.count(F.lit(1)).alias("messages"), F.count_if(~F.col("_ok")).alias("malformed"))
    return d.where(F.col("_ok")).select(*defaulted_fields())


def decode_transactions(df: DataFrame, value_col: str = "value", keep: list | tuple = ()) -> DataFrame:
    """Each message once parsed: ``keep``, its text ``_value``, the record
    ``r``, and whether it is well-formed, ``_ok``."""
    v = F.col(value_col).cast("string")
    parsed = F.from_json(v, _PARSE_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    d = df.select(*keep, F.inline(F.array(F.struct(v.alias("_value"), parsed.alias("r")))))
    return d.withColumn("_ok", F.col("r").isNotNull() & F.col("r._corrupt_record").isNull())


def defaulted_fields() -> list:
    """The record's fields of ``r`` with defaults and whole-number ids."""
    cols = []
    for name, typ, default in RAW_FIELDS:
        c = F.col(f"r.{name}")
        if name in ("user_id", "event_id"):
            c = F.when(c.isNull() | (F.trim(c) == ""), F.lit(0).cast("long")).otherwise(normalize_entity_id(c))
        elif default is not None:
            c = F.coalesce(c, F.lit(default).cast(typ))
        cols.append(c.alias(name))
    return cols


# ---------------------------------------------------------------- A8
def encode_transactions(df: DataFrame, scenario: str | None = None) -> DataFrame:
    """Producer records — rows missing any required key are dropped; key =
    user id as text; value = compact JSON of the row (+ ``_scenario``)."""
    d = df
    for k in REQUIRED_KEYS:
        d = d.where(F.col(k).isNotNull())
    if scenario is not None:
        d = d.withColumn("_scenario", F.lit(scenario))
    return d.select(F.col("user_id").cast("string").alias("key"),
                    F.to_json(F.struct(*[F.col(c) for c in d.columns])).alias("value"))


# ---------------------------------------------------------------- A6
def land_stream(df: DataFrame, path: str, checkpoint: str, ts_col: str = "timestamp",
                trigger: dict | None = None) -> StreamingQuery:
    """Append the stream to Parquet partitioned by the row's own date
    (``dt``; SURVEY R3 — not the batch's first row); snappy; exactly-once
    through the file sink's commit log.  Default trigger: every 30 s."""
    ts = F.col(ts_col)
    if dict(df.dtypes)[ts_col] == "string":
        ts = parse_utc(ts)
    out = df.withColumn("dt", F.coalesce(F.to_date(ts), F.current_date()))
    w = (out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
         .option("compression", "snappy").partitionBy("dt").outputMode("append"))
    return w.trigger(**(trigger or {"processingTime": PUSH_INTERVAL})).start()


# ---------------------------------------------------------------- C3
def stream_user_aggregates(stream: DataFrame) -> DataFrame:
    """C3 (default): per user since the start — count, amount sum, distinct
    events, average.  Null users are skipped; not de-duplicated.  Amounts are
    summed in cents (exact).

    Distinct events are counted in two stages: a (user, event) pair is let
    through once, when it is first seen, and per user only sums are kept.  So a
    user's state is three numbers, pairs are spread by both keys, and the rows of a busy user
    are combined before they are shuffled: no task holds all of a user's events.
    """
    rows = stream.where(F.col("user_id").isNotNull()).select(
        "user_id", "event_id", cents(F.coalesce(F.col("total_amount"), F.lit(0.0))).alias("_cents"))
    first_seen = rows.where(F.col("event_id").isNotNull()).select("user_id", "event_id").dropDuplicates()
    parts = rows.select("user_id", F.lit(1).alias("_n"), "_cents", F.lit(0).alias("_new")) \
        .unionByName(first_seen.select("user_id", F.lit(0).alias("_n"), F.lit(0).cast("long").alias("_cents"),
                                       F.lit(1).alias("_new")))
    g = parts.groupBy("user_id").agg(F.sum("_n").alias("user_txn_count_1h"), F.sum("_cents").alias("_cents"),
                                     F.sum("_new").alias("user_distinct_events_1h"))
    return g.select("user_id", "user_txn_count_1h", (F.col("_cents") / F.lit(100.0)).alias("user_txn_amount_1h"),
                    "user_distinct_events_1h",
                    (F.col("_cents") / F.lit(100.0) / F.col("user_txn_count_1h")).alias("user_avg_amount_24h"))


# ---------------------------------------------------------------- C4
def publish_user_features(aggregates: DataFrame, root: str, checkpoint: str,
                          trigger: dict | None = None) -> StreamingQuery:
    """C4: push changed per-user features at most every 30 s (update mode +
    processing-time trigger) into the online changelog (D4)."""
    def sink(batch: DataFrame, batch_id: int):
        write_online_batch(batch, batch_id, root)
    w = (aggregates.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
         .foreachBatch(sink))
    return w.trigger(**(trigger or {"processingTime": PUSH_INTERVAL})).start()


# ---------------------------------------------------------------- C5
def windowed_user_features(stream: DataFrame, ts_col: str = "timestamp", watermark: str = "10 minutes",
                           window: str = "1 hour", slide: str = "5 minutes",
                           trailing: dt.timedelta = dt.timedelta(hours=24)) -> DataFrame:
    """What the view's names promise, in one row per user and sliding
    window — count, amount and distinct events of the window, and the mean
    amount of the ``trailing`` time up to its end.  Rows later than the
    watermark are dropped; a window is emitted once the watermark passes its end
    (append mode).  A null event counts as a transaction, not as an event; null
    users are skipped, as in C1 and C3.

    Two stateful steps: panes of one slide per (user, event), where raw rows are
    combined and spread by all three, and per user the windows over these panes
    (``trailing_mean``).  A window is worked out where it is emitted and is never
    kept: state, its checkpoint and what is shuffled grow with the panes, not with
    the twelve windows of each.  A user's task gets a row per pane and event.
    State is kept in RocksDB, for which the session is set here.
    """
    keep_state_in_rocksdb(stream.sparkSession)
    # A null key would make the keys beside it floats in Python.  The condition names the time, or it would be tested
    # before the watermark, which is that of all rows.
    s = stream.withColumn("_ts", F.col(ts_col).cast("timestamp")).withWatermark("_ts", watermark) \
              .where(F.when(F.col("_ts").isNotNull(), F.col("user_id")).isNotNull())
    panes = s.groupBy(F.window("_ts", slide).alias("pane"), "user_id", "event_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(cents(F.coalesce(F.col("total_amount"), F.lit(0.0)))).alias("c"))
    # Plain columns: a struct would reach Python as an object a row.  Events as text: whole numbers beside nulls would be floats.
    flat = panes.select("user_id", F.window_time("pane").alias("t"), F.unix_micros("pane.end").alias("end"),
                        F.col("event_id").cast("string").alias("event"), "n", "c")
    span, width, step = (int(x.total_seconds() * 1_000_000) for x in (trailing, pd.Timedelta(window), pd.Timedelta(slide)))
    out = flat.groupBy("user_id").transformWithStateInPandas(
        trailing_mean(span, width, step), T.StructType([panes.schema["user_id"], *[
            T.StructField(c, T.LongType()) for c in ("start", "end", "n", "c", "events", "day_n", "day_c")]]), "Append", "EventTime")
    return out.select(F.timestamp_micros("start").alias("window_start"), F.timestamp_micros("end").alias("window_end"),
                      "user_id", F.col("n").alias("user_txn_count_1h"), (F.col("c") / 100.0).alias("user_txn_amount_1h"),
                      F.col("events").alias("user_distinct_events_1h"),
                      (F.col("day_c") / 100.0 / F.col("day_n")).alias("user_avg_amount_24h"))


def trailing_mean(span: int, width: int = 3_600_000_000, slide: int = 300_000_000) -> StatefulProcessor:
    """Per user: panes of ``slide`` per event in, windows of ``width`` out, with
    the totals of the last ``span`` up to their end (all in microseconds).

    The state is the user's panes of that time (end, count, cents as whole
    numbers: 288 at most for a day of 5-minute panes), the events of the last
    ``width`` with the end of their newest pane, and the time up to which windows have been
    emitted.  An event counts from the end of a pane for ``width``, less what its pane
    before covers already, so distinct events are a running total too.  A timer
    asks for the user again when the next window closes without new panes, and
    drops the state when the last pane is older than ``span``.

    The class is defined here so that it is pickled by value: Spark also loads
    the processor in a Python process beside the driver, which does not get the
    files that ``ship_package`` hands to the executors."""

    class TrailingMean(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.user = handle.getValueState("user", "panes binary, events array<string>, newest binary, done bigint")

        def advance(self, rows, now):
            """Windows that end after those emitted and no later than ``now``."""
            known = self.user.get() or (b"", [], b"", np.iinfo(np.int64).min)
            panes, newest, done = np.frombuffer(known[0], np.int64).reshape(-1, 3), np.frombuffer(known[2], np.int64), known[3]
            events = pd.Series(known[1], dtype=object)
            if rows is not None:
                panes = np.concatenate([panes, rows[["end", "n", "c"]].to_numpy().astype(np.int64)])
                named = rows[rows["event"].notna()]
                events = pd.concat([events, named["event"].astype(object)])
                newest = np.concatenate([newest, named["end"].to_numpy().astype(np.int64)])
            at, slot = np.unique(panes[:, 0], return_inverse=True)
            totals = np.zeros((len(at) + 1, 2), np.int64)
            np.add.at(totals, slot + 1, panes[:, 1:])
            total = totals.cumsum(axis=0)
            ends = np.unique(at[:, None] + np.arange(0, width, slide))
            end = ends[(ends > done) & (ends <= now)]

            def within(time):
                return total[np.searchsorted(at, end, side="right")] - total[np.searchsorted(at, end - time, side="right")]
            code = pd.factorize(events)[0]
            order = np.lexsort((newest, code))
            code, newest, again = code[order], newest[order], np.diff(code[order]) == 0
            starts = newest.copy()
            starts[1:][again] = np.maximum(newest[1:], newest[:-1] + width)[again]
            distinct = np.searchsorted(np.sort(starts), end, side="right") - np.searchsorted(np.sort(newest + width), end, side="right")
            out = pd.DataFrame(np.column_stack([end - width, end, within(width), distinct, within(span)]),
                               columns=["start", "end", "n", "c", "events", "day_n", "day_c"])
            if at[-1] + max(span, width) <= now:
                self.user.clear()
                return out
            last = np.append(~again, np.ones(min(len(code), 1), bool)) & (newest > now - width)
            kept = at > now - max(span, width)
            self.user.update((np.column_stack([at, totals[1:]])[kept].tobytes(), events.to_numpy()[order][last].tolist(),
                              newest[last].tobytes(), now))
            later = ends[ends > now]
            due = later[0] if len(later) else at[-1] + max(span, width)
            self.handle.registerTimer(int(due) // 1000 - 1)  # fires once the watermark is beyond, so at the window's end
            return out

        def handleInputRows(self, key, rows, timerValues):
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            rows = pd.concat(list(rows))
            out = self.advance(rows, timerValues.getCurrentWatermarkInMs() * 1000)
            if len(out):
                out.insert(0, "user_id", rows["user_id"].iloc[0])
                yield out

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            out = self.advance(None, timerValues.getCurrentWatermarkInMs() * 1000)
            if len(out):
                out.insert(0, "user_id", pd.Series([key[0]] * len(out), dtype=object))
                yield out

        def close(self) -> None:
            pass

    return TrailingMean()


def daily_mean_amount(stream: DataFrame, ts_col: str = "timestamp", watermark: str = "10 minutes") -> DataFrame:
    """C5, 24 h part: mean amount per user per 24 h tumbling window."""
    s = stream.withColumn("_ts", F.col(ts_col).cast("timestamp")).withWatermark("_ts", watermark)
    g = s.groupBy(F.window("_ts", "24 hours").alias("w"), "user_id").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(cents(F.coalesce(F.col("total_amount"), F.lit(0.0)))).alias("_c"))
    return g.select(F.col("w.start").alias("window_start"), "user_id",
                    (F.col("_c") / F.lit(100.0) / F.col("_n")).alias("user_avg_amount_24h"))


# ---------------------------------------------------------------- H3 (stream)
def stream_arm_updates(rewards: DataFrame) -> DataFrame:
    """H3 as a stream: running reward sums per arm (update mode); the bandit
    state is (1 + Σr, 1 + Σ(1−r)) — additive, so batches can arrive in any order."""
    given = F.nanvl(F.col("reward").cast("double"), F.lit(None).cast("double"))  # null and NaN rewards say nothing
    r = F.least(F.greatest(given, F.lit(0.0)), F.lit(1.0))
    g = rewards.where(given.isNotNull()).groupBy("arm").agg(F.sum(r).alias("_s"), F.count(F.lit(1)).alias("_n"))
    return g.select("arm", (F.lit(1.0) + F.col("_s")).alias("alpha"),
                    (F.lit(1.0) + F.col("_n") - F.col("_s")).alias("beta"))


# ---------------------------------------------------------------- helpers
def run_until_done(query: StreamingQuery, timeout_s: float | None = None) -> StreamingQuery:
    """Wait for an ``availableNow`` query; re-raise its failure."""
    query.awaitTermination(timeout_s)
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
    return query


def write_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append",
                   trigger: dict | None = None) -> StreamingQuery:
    """Stream into a Parquet table (append) or through an idempotent overwrite
    per run and batch (update/complete); see ``newest_batches``."""
    if mode == "append":
        w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        return w.outputMode("append").trigger(**(trigger or {"availableNow": True})).start()

    def sink(batch: DataFrame, batch_id: int):
        batch.withColumn("written_at", F.current_timestamp()) \
             .write.mode("overwrite").parquet(f"{path}/run_id={_run_id(batch)}/batch_id={batch_id}")
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def newest_batches(df: DataFrame, keys) -> DataFrame:
    """Newest row per key of a table that ``write_to_table`` wrote in update mode."""
    keys = list(keys)
    kept = [c for c in df.columns if c not in (*keys, "written_at", "run_id", "batch_id")]
    order = F.struct("written_at", F.col("run_id").cast("string"), F.col("batch_id").cast("long"))
    return df.groupBy(*keys).agg(F.max_by(F.struct(*kept), order).alias("_r")).select(*keys, "_r.*")
