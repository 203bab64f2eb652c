"""E — validation gates as check tables (name, passed, bad_rows, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECK_SCHEMA = "check string, passed boolean, bad_rows long, detail string"


def _row(spark: SparkSession, name: str, passed: bool, bad: int | None, detail: str) -> DataFrame:
    return spark.createDataFrame([(name, passed, bad, detail)], CHECK_SCHEMA)


# ---------------------------------------------------------------- E1
def validate_aggregates(df: DataFrame | None, spark: SparkSession | None = None,
                        key: str = "event_id", value: str = "avg_ticket_price_mean") -> DataFrame:
    """Fail when empty, when ``key`` is absent, or when ``value`` has
    nulls; an absent table is a skip.  One aggregate pass over the table."""
    if df is None:
        return _row(spark, "aggregates", True, None, "skipped: table absent")
    spark = spark or df.sparkSession
    if key not in df.columns:
        return _row(spark, "aggregates", False, None, f"missing column {key}")
    nulls = F.count_if(F.col(value).isNull()) if value in df.columns else F.lit(0).cast("long")
    one = df.agg(F.count(F.lit(1)).alias("n"), nulls.alias("bad"))
    return one.select(
        F.lit("aggregates").alias("check"),
        ((F.col("n") > 0) & (F.col("bad") == 0)).alias("passed"),
        F.col("bad").cast("long").alias("bad_rows"),
        F.when(F.col("n") == 0, F.lit("empty"))
         .when(F.col("bad") > 0, F.concat(F.lit("null "), F.lit(value)))
         .otherwise(F.lit("ok")).alias("detail"))


# ---------------------------------------------------------------- E2
def validate_inputs(tables: dict[str, DataFrame], required: dict[str, list[str]]) -> DataFrame:
    """Every input non-empty and carrying its required columns."""
    parts = []
    for name, df in tables.items():
        missing = [c for c in required.get(name, []) if c not in df.columns]
        one = df.limit(1).agg(F.count(F.lit(1)).alias("n"))
        parts.append(one.select(
            F.lit(f"input:{name}").alias("check"),
            ((F.col("n") > 0) & F.lit(not missing)).alias("passed"),
            F.lit(None).cast("long").alias("bad_rows"),
            (F.lit(f"missing {','.join(missing)}") if missing else
             F.when(F.col("n") == 0, F.lit("empty")).otherwise(F.lit("ok"))).alias("detail")))
    return reduce(DataFrame.unionByName, parts)


# ---------------------------------------------------------------- E3
# request/response range constraints of the two services.
REQUEST_RULES = {
    "amount": (0.0, None),
    "fraud_score": (0.0, 1.0),
    "recommended_price": (0.0, None),
}


# Fields a request must carry.
REQUIRED_FIELDS = ("user_id", "event_id", "amount")


def validate_requests(df: DataFrame, rules: dict | None = None, required=REQUIRED_FIELDS) -> DataFrame:
    """Add ``valid`` and ``reason`` (first violated rule) per row; a null
    in a required field that the frame has is the first violation.

    Callers split good/bad rows with ``where(valid)`` / ``where(~valid)``."""
    rules = rules or {c: r for c, r in REQUEST_RULES.items() if c in df.columns}
    reason = F.lit(None).cast("string")
    for c, (lo, hi) in reversed(list(rules.items())):
        bad = F.lit(False)
        if lo is not None:
            bad = bad | (F.col(c) < F.lit(lo))
        if hi is not None:
            bad = bad | (F.col(c) > F.lit(hi))
        bad = bad | F.isnan(F.col(c).cast("double"))
        rng = f"[{lo if lo is not None else '-inf'}, {hi if hi is not None else 'inf'}]"
        reason = F.when(F.coalesce(bad, F.lit(False)), F.lit(f"{c} outside {rng}")).otherwise(reason)
    for c in reversed([c for c in required if c in df.columns]):
        reason = F.when(F.col(c).isNull(), F.lit(f"{c} is missing")).otherwise(reason)
    return df.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())
