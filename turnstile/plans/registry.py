"""Query registry shared by the per-group query modules."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstile.functions.scalars import fround

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with an optional oracle."""
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def round_doubles(df: DataFrame, places: int = 4) -> DataFrame:
    """Round every double/float column (output formatting shared with the oracle)."""
    out = {}
    for f in df.schema.fields:
        if f.dataType.simpleString() in ("double", "float"):
            out[f.name] = fround(F.col(f.name), places)
    return df.withColumns(out) if out else df
