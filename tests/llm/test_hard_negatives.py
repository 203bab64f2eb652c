"""Hard negatives against brute force, and the pruning of the index."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile.llm import hard_negatives as H
from turnstile.llm.queries import ORACLE, QUERIES

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                        T.StructField("label", T.IntegerType())])


def brute(rows, is_anchor, positives=5, negatives=5):
    used = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in rows
            if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, (i, v, label) in enumerate(used):
        if i is None or not is_anchor(i):
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j is None, j or 0, n, m == label, j)
                  for n, (j, w, m) in enumerate(used) if n != k and len(w) == len(v)]
        for p in sorted(r for r in scored if r[4])[:positives]:
            fit = sorted(r for r in scored if not r[4] and 80 * -p[0] <= 100 * -r[0] <= 100 * -p[0])[:negatives]
            out += [(i, p[5], rank, r[5], -p[0], -r[0]) for rank, r in enumerate(fit, 1)]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def clustered(rng, n, dims, centres=12):
    centre = rng.normal(size=(centres, dims))
    x = centre[rng.integers(0, centres, n)] + 0.4 * rng.normal(size=(n, dims))
    x *= rng.uniform(0.3, 1.0, (n, 1)) / np.linalg.norm(x, axis=1, keepdims=True)
    return x.astype(np.float32)


@pytest.mark.parametrize("dims,sizes", [(20, (30, 40)), (64, (4096, 1 << 18)), (3, (64, 64))])
def test_same_as_brute_force(spark, dims, sizes):
    rng = np.random.default_rng(dims)
    x = clustered(rng, 400, dims)
    x[50:70] = x[10]  # copies, so ties
    label = rng.integers(0, 4, 400)
    label[:160] = 0  # a third of the rows and more
    rows = [(k, x[k].tolist(), int(label[k])) for k in range(400)]
    got = H.hard_negatives(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 5 == 0,
                           least_shard=sizes[0], most_shard=sizes[1])
    want = brute(rows, lambda i: i % 5 == 0)
    assert len(want) > 500 and rows_of(got) == want


def test_edges(spark):
    rng = np.random.default_rng(1)
    x = clustered(rng, 60, 6).tolist()
    rows = [(k, x[k], k % 3) for k in range(60)]
    rows += [(100, None, 1), (101, x[3], None), (102, [0.1, None] + x[3][2:], 1), (103, [float("nan")] * 6, 1),
             (104, [float("inf")] * 6, 2), (105, [0.0] * 6, 1), (110, [], 1), (115, [], 2), (120, x[1][:3], 1),
             (125, x[2][:3], 0), (None, x[5], 2), (None, x[6], 0), (10, x[10], 1), (10, x[10], 1), (130, [-v for v in x[0]], 0)]
    df = spark.createDataFrame(rows, VECTORS)
    want = brute(rows, lambda i: i % 5 == 0)
    for least in (4096, 7):
        assert rows_of(H.hard_negatives(df, F.col("vec_id") % 5 == 0, least_shard=least, most_shard=max(least, 8))) == want
    clash = df.selectExpr("*", "1 as row", "2 as dims", "3 as part", "4 as anchor", "5 as score")
    assert rows_of(H.hard_negatives(clash, F.col("vec_id") % 5 == 0)) == want
    assert H.hard_negatives(spark.createDataFrame([], VECTORS), F.col("vec_id") % 5 == 0).count() == 0
    assert H.hard_negatives(df, F.col("vec_id") < 0).count() == 0
    huge = spark.createDataFrame([(0, [1e30, 1.0], 1), (1, [1e30, 1.0], 1), (2, [9e29, 1.0], 2)], VECTORS)
    assert H.hard_negatives(huge, F.col("vec_id") == 0).columns[0] == "anchor_id"


def test_index_finds_all_and_visits_little():
    rng = np.random.default_rng(2)
    x = np.floor(256 * clustered(rng, 9000, 64) * np.linspace(1, 0.1, 64)).astype(float)
    a = x[:50]
    index = H.Index(x)
    scores = a @ x.T
    least = np.sort(scores, axis=1)[:, -20]
    found = {(int(i), int(j)): s for parts in index.above(a, least) for i, j, s in zip(*parts)}
    i, j = np.nonzero(scores >= least[:, None])
    assert found == {(int(p), int(q)): scores[p, q] for p, q in zip(i, j)}
    assert index.visited < 0.75 * len(a) * len(x) * 8  # of eight chunks
    assert sum(len(p[0]) for p in index.above(a, np.full(50, -np.inf))) == 50 * 9000


def test_oracle(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf_dir}/embeddings.parquet')")
    name = "op13_threshold_join_negatives"
    df = QUERIES[name](spark, sf_dir)
    res = con.execute(ORACLE[name])
    order = [df.columns.index(c[0]) for c in res.description]
    assert sorted(tuple(r[i] for i in order) for r in df.collect()) == sorted(res.fetchall())
