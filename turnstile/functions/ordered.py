"""Exact order statistics without one-task windows or copies of the values.

A ``Window.orderBy`` over the values of a key that holds a third of the rows
sends them all to a single task.  Here every value is first mapped to a bucket
with a monotone function (``value_bucket``); counts per bucket are aggregated
map-side into a table whose size does not depend on the number of rows, and
only buckets that can hold the answer are opened.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstile.session import reuse

# Buckets per factor of two.  A coarse bucket spans about 1 % of its value, one
# of the others 0.004 % and 0.001 %.
COARSE = 64
FINE = 16384
PER_OCTAVE = 65536


def value_bucket(c: Column, per_octave: int = PER_OCTAVE) -> Column:
    """Integer bucket that never decreases as ``c`` increases: -Inf first, then
    finite values, +Inf, and NaN last."""
    offset = 1100 * per_octave  # larger than |floor(log2(x) * per_octave)| of every finite double
    finite = F.abs(c.cast("double")) < float("inf")
    lg = F.floor(F.log2(F.when(finite, F.abs(c.cast("double")))) * F.lit(float(per_octave))).cast("long")
    pos = F.lit(offset) + lg
    last = 2 * offset
    return (F.when(F.isnan(c.cast("double")), F.lit(last + 1))
             .when(c == float("inf"), F.lit(last))
             .when(c == float("-inf"), F.lit(-last))
             .when(c > 0, pos)
             .when(c < 0, -pos)
             .otherwise(F.lit(0)).cast("long"))


def _targets(totals: DataFrame, by: list[str], bucket: str, wanted: DataFrame | None, ranks: dict | None) -> DataFrame:
    """Buckets that hold a wanted rank, with the rank inside the bucket.

    ``totals`` has ``by, bucket, _c``.  At the first level (``ranks``) the
    ranks follow from each group's size; further down they come from the
    level above (``wanted``: by, _q, _r)."""
    over = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    t = totals.withColumn("_before", F.coalesce(F.sum("_c").over(over), F.lit(0)))
    if ranks is not None:
        t = t.withColumn("_n", F.sum("_c").over(Window.partitionBy(*by)))
        each = F.array(*[F.struct(F.lit(name).alias("_q"), fn(F.col("_n")).cast("long").alias("_r"))
                         for name, fn in ranks.items()])
        t = t.select(*by, bucket, "_before", "_c", "_n", F.inline(each))
    else:
        t = t.join(wanted, by)
    inside = (F.col("_r") >= F.col("_before")) & (F.col("_r") < F.col("_before") + F.col("_c"))
    return t.where(inside).withColumn("_r", F.col("_r") - F.col("_before")).drop("_before", "_c")


def order_statistics(df: DataFrame, value_col: str, ranks: dict[str, Callable[[Column], Column]],
                     by: Sequence[str] = ()) -> DataFrame:
    """Exact k-th smallest values per group, without sorting or copying them.

    Values are counted per coarse bucket; only the buckets that hold a wanted
    rank are counted again per fine bucket, and only those fine buckets' values
    are looked at one by one.  Counts are combined map-side, so what moves is
    buckets (at most a few hundred thousand a group, whatever its size) and
    slivers of values.

    ``ranks`` maps an output name to ``f(n) -> 0-based rank`` (n = non-null
    count of the group).  Returns one row per group that has values:
    ``by..., n, <name>...``.  Ranks outside ``[0, n)`` give null.
    """
    by = list(by)
    v = value_col
    d = df.where(F.col(v).isNotNull()).select(*by, v)
    coarse = d.withColumn("_b1", value_bucket(F.col(v), COARSE))
    counted = coarse.groupBy(*by, "_b1").agg(F.count(F.lit(1)).alias("_c"))
    # One row per group and rank: stored, because each next pass filters by it.
    first = reuse(_targets(counted, by, "_b1", None, ranks))
    # Bounded: one row per group and rank; Spark broadcasts it below its size threshold.
    fine = coarse.join(first.select(*by, "_b1").distinct(), [*by, "_b1"], "left_semi") \
                 .withColumn("_b2", value_bucket(F.col(v), PER_OCTAVE))
    counted = fine.groupBy(*by, "_b1", "_b2").agg(F.count(F.lit(1)).alias("_c"))
    second = reuse(_targets(counted, [*by, "_b1"], "_b2", first.drop("_n"), None))
    values = fine.join(second.select(*by, "_b1", "_b2").distinct(), [*by, "_b1", "_b2"], "left_semi") \
                 .groupBy(*by, "_b1", "_b2", v).agg(F.count(F.lit(1)).alias("_c"))
    hit = _targets(values, [*by, "_b1", "_b2"], v, second, None)
    picked = hit.groupBy(*by).agg(*[F.max(F.when(F.col("_q") == name, F.col(v))).alias(name) for name in ranks])
    sizes = (first.groupBy(*by) if by else first).agg(F.max("_n").alias("n"))
    if not ranks:
        return sizes
    if by:
        # Groups none of whose ranks exist still have a size.
        all_sizes = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
        return all_sizes.join(picked, by, "left")
    return d.agg(F.nullif(F.count(F.lit(1)), F.lit(0)).alias("n")).crossJoin(picked)


def interpolated_percentiles(df: DataFrame, value_col: str, probs: dict[str, float],
                             by: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolated percentiles (numpy default / SQL ``quantile_cont``)."""
    ranks = {}
    for name, p in probs.items():
        ranks[f"_lo_{name}"] = (lambda n, p=p: F.floor(F.lit(p) * (n - 1)))
        ranks[f"_hi_{name}"] = (lambda n, p=p: F.ceil(F.lit(p) * (n - 1)))
    st = order_statistics(df, value_col, ranks, by)
    out = [*by, "n"]
    cols = [F.col(c) for c in out]
    for name, p in probs.items():
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        frac = F.lit(p) * (F.col("n") - 1) - F.floor(F.lit(p) * (F.col("n") - 1))
        cols.append((lo + (hi - lo) * frac).alias(name))
    return st.select(*cols)
