import random
import re
import tracemalloc
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import PROSE, docs, odd_docs, rows_of
from turnstile.llm import common, components, minhash
from turnstile.llm.components import connected_components

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(w) < 5:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4))


def smallest_reachable(nodes, links):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


def brute_force(rows):
    """(doc_id, n_shingles, component, kept) with python sets of words."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    links = [(a, b) for (a, s), (b, t) in combinations(sets, 2)
             if a is not None and b is not None and s and t and 100 * len(s & t) >= 75 * len(s | t)]
    root = smallest_reachable([i for i, _ in sets if i is not None], links)
    return sorted(((i, len(s), root.get(i), i is None or root[i] == i) for i, s in sets), key=repr)


def changed(words, share, rnd):
    return " ".join(w if rnd.random() > share else "".join(rnd.choice("abcdefgh") for _ in range(6)) for w in words)


def test_against_brute_force_on_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in d.collect()]
    assert rows_of(minhash.near_duplicates(d)) == brute_force(rows)


def test_against_brute_force_near_the_threshold(spark, monkeypatch):
    """Groups around 0.75, with blocks so small that they meet two by two."""
    rnd = random.Random(3)
    rows, n = [], 0
    for _ in range(6):
        base = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(rnd.choice([30, 80, 200]))]
        for share in [0, 0, .005, .01, .02, .03, .03, .04, .05, .05, .08, .2]:
            rows.append((n := n + 1, changed(base, share, rnd)))
    for k in range(20):  # a passage that many documents share
        rows.append((n := n + 1, PROSE + " " + changed(["w"] * 40, 1, rnd)))
    monkeypatch.setattr(minhash, "BLOCK", 4)
    assert rows_of(minhash.near_duplicates(docs(spark, rows))) == brute_force(rows)


def test_exact_threshold(spark):
    """3 of 4 shingles in common links; one word less does not."""
    w = [f"w{k}" for k in range(60)]
    # 28 shingles in common: 28 / (28 + 4 + 5) > 0.75 > 28 / (28 + 5 + 5)
    a, b, c = w[:32] + w[40:44], w[:32] + w[50:55], w[:32] + w[45:50]
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c))]
    assert rows_of(minhash.near_duplicates(docs(spark, rows))) == brute_force(rows)


def test_edges(spark):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs(spark).collect()]
    got = rows_of(minhash.near_duplicates(odd_docs(spark)))
    assert got == brute_force(rows)
    assert (3, 0, 3, True) in got and (5, 0, 5, True) in got and (6, 1, 6, True) in got
    assert minhash.near_duplicates(docs(spark, [])).count() == 0
    clash = docs(spark, [(1, PROSE), (2, PROSE)]).withColumnRenamed("lang", "component_id") \
        .withColumnRenamed("source", "digest")
    assert rows_of(minhash.near_duplicates(clash)) == brute_force([(1, PROSE), (2, PROSE)])


def test_short_sequences_are_not_prefixes(spark):
    rows = [(1, "A b"), (2, "a B "), (3, "a b c"), (4, "a"), (5, "a b c d e"), (6, "é É"), (7, "É é")]
    assert rows_of(minhash.near_duplicates(docs(spark, rows))) == brute_force(rows)


@pytest.mark.parametrize("seed", range(4))
def test_components(spark, seed, monkeypatch):
    rnd = random.Random(seed)
    if seed % 2:  # as if no task held two links of a component: the stars do all the work
        monkeypatch.setattr(components, "_contracted", lambda links: links)
    links = [(rnd.randint(0, 120), rnd.randint(0, 120)) for _ in range([20, 60, 90, 200][seed])]
    links += [(k, k + 1) for k in range(500, 560)] + [(900, k) for k in range(901, 960)]
    rnd.shuffle(links)
    touched = {x for a, b in links if a != b for x in (a, b)}
    root = smallest_reachable(touched, [x for x in links if x[0] != x[1]])
    df = spark.createDataFrame([*links, (None, 3), (4, None)], "src long, dst long")
    assert dict(rows_of(connected_components(df))) == root
    assert connected_components(df.limit(0)).count() == 0


def test_forest_rows_are_linear(spark):
    """A bucket of n classes leaves at most n - 1 links."""
    forest = minhash.Forest(50)
    for a, b in combinations(range(50), 2):
        forest.union(a, b)
    members, roots = forest.links()
    assert len(members) == 49 and set(roots.tolist()) == {0}


def test_minima_estimate_similarity():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2)
    a, b = minhash.minima(x[:3000]), minhash.minima(x[500:3500])
    assert abs((a == b).mean() - 2500 / 3500) < 0.08


@pytest.mark.parametrize("other", [0, 1])
def test_a_unit_takes_few_bytes_a_shingle(other):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 2000, 4000)) for _ in range(80)]
    texts += [t + " a b c" for t in texts]
    n = len(texts)
    group = pa.table({"_own": pa.array([0] * 80 + [other] * 80, pa.int32()), "_lo": pa.array([0] * n, pa.int32()),
                      "_hi": pa.array([other] * n, pa.int32()), "text": texts})
    forest = components.Forest(n)
    tracemalloc.start()
    minhash._join_by_sets(group, np.arange(n), forest)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [forest.find(i) for i in range(n)] == [*range(80)] * 2
    assert peak < 32 * 4000 * n


def test_a_task_gives_its_memory_back(spark, monkeypatch):
    class Rows:  # what mapInArrow gets, without a job
        def select(self, *cols):
            return self

        def mapInArrow(self, run, schema):
            self.run = run
            return self

    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(len(minhash._HASHES)))
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2], pa.int64()), "text": ["a b c d e f", None]})
    run = minhash.sketches(Rows(), "doc_id", "text").run
    assert [b.num_rows for b in run(iter([batch]))] == [2] and given == [0]
    stopped = run(iter([batch]))
    next(stopped)
    stopped.close()
    assert len(given) == 2
