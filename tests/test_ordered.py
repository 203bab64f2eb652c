"""Two-level running totals and order statistics against numpy brute force."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from turnstile.functions.ordered import COARSE, interpolated_percentiles, order_statistics, value_bucket


def _data(seed=1, n=3000):
    rng = np.random.default_rng(seed)
    keys = rng.choice(["a", "b", "c"], size=n, p=[0.8, 0.15, 0.05])  # one hot key
    vals = np.round(rng.normal(0, 100, size=n), 1)
    vals[::7] = 0.0
    vals[::11] = 42.0  # heavy duplicates
    return [(str(k), float(v)) for k, v in zip(keys, vals)]


def test_value_bucket_is_monotone(spark):
    xs = sorted(set([float("-inf"), -1e300, -5.5, -1.0, -1e-300, 0.0, 1e-300, 1e-5, 0.5, 1.0, 1.0000001, 3.0, 1e10, 1e300, float("inf")])) + [float("nan")]
    df = spark.createDataFrame([(x,) for x in xs], "v double")
    for per in (COARSE, 65536):
        got = [r.b for r in df.select("v", value_bucket(F.col("v"), per).alias("b")).orderBy("v").collect()]
        assert got == sorted(got)


def test_order_statistics_matches_sorted(spark):
    rows = _data(2)
    df = spark.createDataFrame(rows, "k string, v double")
    st = order_statistics(df, "v", {"p50": lambda n: F.floor(F.lit(0.5) * (n - 1)),
                                    "p99": lambda n: F.floor(F.lit(0.99) * (n - 1)),
                                    "first": lambda n: F.lit(0), "last": lambda n: n - 1}, by=["k"]).collect()
    for r in st:
        vals = sorted(v for k, v in rows if k == r.k)
        n = len(vals)
        assert r.n == n
        assert r.p50 == vals[int(0.5 * (n - 1))] and r.p99 == vals[int(0.99 * (n - 1))]
        assert r.first == vals[0] and r.last == vals[-1]


def test_order_statistics_global_and_empty(spark):
    df = spark.createDataFrame([(float(x),) for x in [5, 1, 3]], "v double")
    r = order_statistics(df, "v", {"mid": lambda n: F.lit(1)}).collect()[0]
    assert (r.n, r.mid) == (3, 3.0)
    empty = df.where("v > 100")
    r = order_statistics(empty, "v", {"mid": lambda n: F.lit(0)}).collect()
    assert len(r) == 1 and r[0].n is None and r[0].mid is None


def test_interpolated_percentiles_match_numpy(spark):
    rows = _data(3)
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    for r in interpolated_percentiles(df, "v", probs, by=["k"]).collect():
        vals = np.array([v for k, v in rows if k == r.k])
        for name, p in probs.items():
            assert getattr(r, name) == pytest.approx(float(np.percentile(vals, p * 100)), abs=1e-9)


def test_infinities_and_narrow_ranges(spark):
    """Infinite values are order statistics like any other; values that share a
    coarse bucket are told apart."""
    vals = [float("-inf"), float("-inf"), -1.0, 0.0, 2.5, float("inf")]
    df = spark.createDataFrame([(x,) for x in vals], "v double")
    r = order_statistics(df, "v", {f"r{k}": (lambda n, k=k: F.lit(k)) for k in range(6)}).collect()[0]
    assert [r[f"r{k}"] for k in range(6)] == vals
    close = [1_700_000_000_000_000 + 7 * k for k in range(2000)]
    df = spark.createDataFrame([(x,) for x in close], "v long")
    r = order_statistics(df, "v", {"a": lambda n: F.lit(0), "b": lambda n: F.floor(n / 2), "c": lambda n: n - 1}).collect()[0]
    assert (r.a, r.b, r.c) == (close[0], close[1000], close[-1])


def test_ranks_outside_a_group_are_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0), ("b", None)], "k string, v double")
    got = {r.k: (r.n, r.second) for r in order_statistics(df, "v", {"second": lambda n: F.lit(1)}, ["k"]).collect()}
    assert got == {"a": (2, 2.0), "b": (1, None)}
