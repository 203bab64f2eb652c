"""A1-A4, A9 — landed-table scans, window filter, schema gate, sinks, source resolution."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstile.functions.scalars import parse_utc
from turnstile.session import path_exists, writable

RAW_REQUIRED = ("user_id", "event_id", "total_amount")
RAW_EMPTY = "user_id long, event_id long, total_amount double, timestamp string"


# ---------------------------------------------------------------- A1
def read_raw_events(spark: SparkSession, root: str, as_of: dt.datetime | None = None,
                    hours: float | None = None, schema=None) -> DataFrame:
    """A1: every Parquet file under ``root`` (``dt=YYYY-MM-DD`` partitions).
    With ``as_of``/``hours`` a predicate on the partition column prunes whole
    days before any file is opened.

    With ``schema`` (the stored schema, as a scheduled job has it) no footer is
    opened to plan the read; without it the files' columns are merged by name.
    A folder that does not exist gives an empty frame (the step is skipped);
    one that cannot be read is an error.
    """
    if not path_exists(spark, root):
        return spark.createDataFrame([], schema or RAW_EMPTY)
    reader = spark.read.schema(schema) if schema is not None else spark.read.option("mergeSchema", "true")
    df = reader.parquet(root)
    if as_of is not None and hours and hours > 0 and "dt" in df.columns:
        cutoff = (as_of - dt.timedelta(hours=hours)).date()
        df = df.where(F.col("dt") >= F.lit(cutoff))
    return df


# ---------------------------------------------------------------- A2
def filter_recent(df: DataFrame, ts_col: str = "timestamp", as_of=None, hours: float = 24,
                  keep_bound: str | None = None) -> DataFrame:
    """A2: keep rows with ``ts >= as_of - hours`` (inclusive, no upper bound).

    The column is parsed as UTC; unparsable values become null and drop.
    Skipped when the column is absent or ``hours <= 0``.  ``as_of`` is a
    literal / Column, or None for the input's own max timestamp;
    ``keep_bound`` names a column that keeps that bound on every row, so
    later steps need no second pass to find it.
    """
    if ts_col not in df.columns or hours is None or hours <= 0:
        return df
    ts = F.col(ts_col)
    if dict(df.dtypes)[ts_col] == "string":
        ts = parse_utc(ts)
    micros = int(round(hours * 3600 * 1_000_000))
    if as_of is None:
        bound = df.agg(F.max(ts).alias("_as_of"))
        out = (df.crossJoin(F.broadcast(bound))
                 .where(ts >= F.col("_as_of") - F.make_dt_interval(secs=F.lit(micros / 1e6))))
        return out.withColumnRenamed("_as_of", keep_bound) if keep_bound else out.drop("_as_of")
    as_of = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return df.where(ts >= as_of - F.make_dt_interval(secs=F.lit(micros / 1e6)))


# ---------------------------------------------------------------- A3
def require_columns(df: DataFrame, cols=RAW_REQUIRED) -> tuple[bool, list[str]]:
    """A3: (ok, missing columns) — callers skip the step when not ok."""
    missing = [c for c in cols if c not in df.columns]
    return (not missing, missing)


def schema_gate(spark: SparkSession, df: DataFrame, cols=RAW_REQUIRED) -> DataFrame:
    """A3 as a table: one row per required column with ``present`` and the rows
    that have a value in it (0 where the column is absent); one pass."""
    here = set(df.columns)
    one = df.agg(*[(F.count(F.col(c)) if c in here else F.lit(0).cast("long")).alias(f"n_{i}")
                   for i, c in enumerate(cols)]) if here & set(cols) else \
        spark.range(1).select(*[F.lit(0).cast("long").alias(f"n_{i}") for i in range(len(cols))])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(c in here).alias("present"), F.col(f"n_{i}").alias("rows"))
        for i, c in enumerate(cols)])))


# ---------------------------------------------------------------- A4
def write_feature_table(df: DataFrame, path: str, fallback: str | None = None,
                        partition_by=None) -> str:
    """A4: overwrite a Parquet table, at ``fallback`` where ``path`` may not be
    written.  The job runs once; a job that fails is an error."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fallback and not writable(df.sparkSession, path):
        path = fallback
    w.parquet(path)
    return path


# ---------------------------------------------------------------- A9
@dataclass(frozen=True)
class SourceConfig:
    environment: str = "local"          # "production" or anything else
    offline_store: str = "file"         # "bigquery"/"warehouse" → table source
    dataset: str | None = None
    bucket: str | None = None
    local_root: str = "data/processed"


def resolve_source(spark: SparkSession, cfg: SourceConfig, view: str) -> DataFrame:
    """Production + warehouse + dataset → ``spark.table(dataset.view)``;
    otherwise a Parquet file.  Production without a warehouse, dataset or
    bucket is a configuration error."""
    if cfg.environment == "production":
        if cfg.offline_store not in ("bigquery", "warehouse") or not cfg.dataset or not cfg.bucket:
            raise ValueError("production requires a warehouse offline store, a dataset and a bucket")
        return spark.table(f"{cfg.dataset}.{view}")
    return spark.read.parquet(f"{cfg.local_root.rstrip('/')}/{view}.parquet")
