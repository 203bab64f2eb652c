import math

import numpy as np
import pytest

from tests.llm.helpers import rows_of
from tests.llm.test_near_dup import smallest_reachable
from turnstile.llm import ann, embed_dedup

SCHEMA = "vec_id long, embedding array<float>, label int"


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def cos(a, b):
    a, b = np.array(a, dtype=np.float32).astype(float), np.array(b, dtype=np.float32).astype(float)
    return float(a @ b / np.sqrt((a @ a) * (b @ b)))


def brute_links(rows):
    links = [(i, j) for i in range(len(rows)) for j in range(i) if rows[i][2] is not None
             and rows[i][2] == rows[j][2] and usable(rows[i][1]) and usable(rows[j][1])
             and len(rows[i][1]) == len(rows[j][1]) and cos(rows[i][1], rows[j][1]) >= 0.98]
    count = [0] * len(rows)
    for i, j in links:
        count[i] += 1
        count[j] += 1
    # Rows of one id are one node; a vector without an id is a node behind all ids.
    node = [r[0] if r[0] is not None else 10**9 + i for i, r in enumerate(rows)]
    root = smallest_reachable(set(node), [(node[i], node[j]) for i, j in links])
    return sorted(((r[0], c, None if r[0] is None else root[r[0]], r[0] is None or root[r[0]] == r[0])
                   for r, c in zip(rows, count)), key=repr)


def groups(rng, n, d=64):
    """Vectors around common centres, cosines on both sides of 0.98."""
    rows = []
    for k in range(n):
        centre = rng.normal(size=d)
        for _ in range(int(rng.integers(1, 12))):
            v = centre + rng.normal(size=d) * rng.choice([0, .05, .1, .14, .16, .3])
            rows.append((len(rows), v.astype(np.float32).tolist(), int(rng.integers(0, 2))))
    return rows


def test_links_against_brute_force(spark, monkeypatch):
    rows = groups(np.random.default_rng(1), 25)
    want = brute_links(rows)
    assert sum(c for _, c, _, _ in want) > 50
    assert rows_of(embed_dedup.near_vectors(spark.createDataFrame(rows, SCHEMA))) == want
    monkeypatch.setattr(embed_dedup, "BLOCK", 3)
    assert rows_of(embed_dedup.near_vectors(spark.createDataFrame(rows, SCHEMA))) == want


def odd_vectors():
    v = [1.0, 2.0, 3.0, 4.0]
    return [(1, v, 0), (2, v, 0), (2, v, 0), (3, [2.0, 4.0, 6.0, 8.0], 0), (4, v, 1), (5, v, None), (6, None, 0),
            (7, [], 0), (8, [0.0] * 4, 0), (9, [1.0, None, 3.0, 4.0], 0), (10, [float("nan"), 1.0, 1.0, 1.0], 0),
            (11, [float("inf"), 1.0, 1.0, 1.0], 0), (12, [1.0], 0), (13, [2.0], 0), (14, v, None),
            (15, [0.0, -0.0, 1.0, 0.0], 3), (16, [-0.0, 0.0, 1.0, 0.0], 3)]


def test_link_edges(spark):
    rows = odd_vectors()
    assert rows_of(embed_dedup.near_vectors(spark.createDataFrame(rows, SCHEMA))) == brute_links(rows)
    assert embed_dedup.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    clash = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS digest", "2 AS filter", "3 AS component")
    assert rows_of(embed_dedup.near_vectors(clash)) == brute_links(rows)


def test_null_ids_count_as_vectors(spark):
    v = [1.0, 2.0]
    rows = [(None, v, 0), (5, v, 0), (None, [9.0, -1.0], 0)]
    assert rows_of(embed_dedup.near_vectors(spark.createDataFrame(rows, SCHEMA))) == brute_links(rows)


def test_vectors_without_id_connect_others(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(30):  # a chain: the middle one has no id and is the only link between the ends
        centre, side = rng.normal(size=(2, 64))
        for step, name in ((-0.16, 2 * k), (0.0, None), (0.16, 2 * k + 1)):
            rows.append((name, (centre + step * side).astype(np.float32).tolist(), 0))
    rows += [(r[0], r[1], 1) for r in rows[1::3]] * 2
    want = brute_links(rows)
    assert sum(r[2] is not None and r[2] != r[0] for r in want) >= 25
    for block in (embed_dedup.BLOCK, 2):
        monkeypatch.setattr(embed_dedup, "BLOCK", block)
        assert rows_of(embed_dedup.near_vectors(spark.createDataFrame(rows, SCHEMA))) == want


def test_contracting_a_matrix_equals_pair_by_pair():
    rng = np.random.default_rng(9)
    for _ in range(200):
        n = int(rng.integers(2, 12))
        own = rng.integers(0, 2, n)
        left, right = (np.arange(n),) * 2 if rng.random() < 0.5 else (np.flatnonzero(own == 0), np.flatnonzero(own == 1))
        linked = rng.random((len(left), len(right))) < rng.choice([0.1, 0.3, 0.9])
        if left is right:
            linked = np.triu(linked, 1) | np.triu(linked, 1).T
        got = embed_dedup._contract(left, right, linked, n)
        pairs = [(int(left[i]), int(right[j])) for i, j in zip(*np.nonzero(linked))]
        assert got.tolist() == [smallest_reachable(set(range(n)), pairs)[i] for i in range(n)]


def test_the_codebook_keeps_growing():
    """Members of a cap, vectors x caps of each over all caps, grow like the logarithm only."""
    members = [n * embed_dedup.probes(k) / k**2 for n in (10**4, 10**6, 10**8, 10**10)
               if (k := embed_dedup.code_words(n))]
    assert max(members) < 6 * min(members) and embed_dedup.code_words(10**10) > 10_000


def test_decode_finds_the_nearest_directions():
    rng = np.random.default_rng(2)
    code, x = embed_dedup.ProductCode(12, 8), rng.normal(size=(40, 12))
    turned = x / np.linalg.norm(x, axis=1, keepdims=True) @ code.rotation
    a = turned[:, code.halves[0]] @ code.codewords[0].T
    b = turned[:, code.halves[1]] @ code.codewords[1].T
    every = (a[:, :, None] + b[:, None, :]).reshape(40, -1)
    want = np.sort(np.argsort(-every, axis=1)[:, :16], axis=1)
    assert (code.decode(x, 16) == want).all()


@pytest.mark.parametrize("words", [64, 256])
def test_pairs_at_the_threshold_share_a_filter(words):
    rng = np.random.default_rng(3)
    u = rng.normal(size=(1000, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = rng.normal(size=u.shape)
    w -= (w * u).sum(axis=1, keepdims=True) * u
    v = 0.98 * u + math.sqrt(1 - 0.98 ** 2) * w / np.linalg.norm(w, axis=1, keepdims=True)
    code = embed_dedup.ProductCode(64, words)
    shared = [len(set(a) & set(b)) for a, b in zip(code.decode(u).tolist(), code.decode(v).tolist())]
    assert min(shared) > 0


def test_misses_do_not_grow_with_the_codebook():
    """At 1,024 words, 16 directions a vector miss several of these pairs."""
    rng, missed, missed_by_16 = np.random.default_rng(3), 0, 0
    code = embed_dedup.ProductCode(64, 1024)
    for _ in range(20):
        u = rng.normal(size=(1000, 64))
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        w = rng.normal(size=u.shape)
        w -= (w * u).sum(axis=1, keepdims=True) * u
        v = 0.98 * u + math.sqrt(1 - 0.98 ** 2) * w / np.linalg.norm(w, axis=1, keepdims=True)
        for a, b, a16, b16 in zip(*(code.decode(z, n).tolist() for n in (None, 16) for z in (u, v))):
            missed += set(a).isdisjoint(b)
            missed_by_16 += set(a16).isdisjoint(b16)
    assert missed == 0 and missed_by_16 > 0


def test_links_with_a_large_codebook(spark, monkeypatch):
    rows = groups(np.random.default_rng(5), 25)
    monkeypatch.setattr(embed_dedup, "code_words", lambda classes: 1024)
    monkeypatch.setattr(embed_dedup, "SHARED", 7)
    assert rows_of(embed_dedup.near_vectors(spark.createDataFrame(rows, SCHEMA))) == brute_links(rows)


def brute_nearest(rows, asked, k=5):
    out = []
    for q in {r[0]: r for r in asked}.values():
        if q[0] is None or not usable(q[1]):
            continue
        seen = {(r[0], tuple(r[1])) for r in rows if r[0] is not None and usable(r[1]) and len(r[1]) == len(q[1])}
        best = sorted(((-cos(q[1], v), i) for i, v in seen if i != q[0]))[:k]
        out += [(q[0], n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_nearest_against_brute_force(spark):
    rows = groups(np.random.default_rng(4), 60, 16)
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, ann.nearest(df, df.where("vec_id % 50 = 0"), shard_vectors=70).collect()))
    want = brute_nearest(rows, [r for r in rows if r[0] % 50 == 0])
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert np.allclose([x[3] for x in got], [x[3] for x in want], atol=1e-12)


def test_relaxed_pruning_keeps_recall(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 16))
    tree = ann.VantageTree(x)
    exact, _ = tree.search(x[:50], 6, 1.0)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    brute = np.argsort(-(unit[:50] @ unit.T), axis=1)[:, :6]
    assert (exact == brute).all()
    relaxed, _ = tree.search(x[:50], 6, 0.8)
    recall = np.mean([len(set(a) & set(b)) / 6 for a, b in zip(relaxed.tolist(), brute.tolist())])
    assert 0.5 < recall <= 1.0


def test_nearest_edges(spark):
    rows = [r for r in odd_vectors() if r[0] not in (3,)] + [(k, [1.0, 2.0, 3.0, 4.0], 0) for k in range(100, 130)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, ann.nearest(df, df).collect()))
    want = brute_nearest(rows, rows)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    empty = spark.createDataFrame([], SCHEMA)
    assert ann.nearest(empty, df).count() == 0 and ann.nearest(df, empty).count() == 0
    clash = df.selectExpr("*", "1 AS shard", "2 AS kind", "3 AS score")
    assert ann.nearest(clash, clash.where("vec_id = 1")).count() == 5


def test_fewer_candidates_than_asked(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (3, [1.0, 1.0], 0)], SCHEMA)
    got = sorted(map(tuple, ann.nearest(df, df.where("vec_id = 1")).collect()))
    assert [x[:3] for x in got] == [(1, 1, 3), (1, 2, 2)]


def test_tree_with_many_rows_at_one_distance():
    """One-hot vectors are all equally far apart; a few odd ones are not."""
    rng = np.random.default_rng(8)
    x = np.concatenate([np.eye(300), rng.normal(size=(40, 300)), np.eye(300)[:20] + 0.01])
    tree = ann.VantageTree(x)
    best, score = tree.search(x[::7], 6, 1.0)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = -np.sort(-(unit[::7] @ unit.T), axis=1)[:, :6]
    assert np.allclose(score, want, atol=1e-9)
