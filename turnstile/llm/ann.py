"""Approximate nearest neighbours: vantage-point trees per shard.

Vectors are dealt to shards; each shard's task builds a vantage-point tree
and searches it for every query.  On unit vectors the chord is a metric and
falls as the cosine rises, so the triangle inequality prunes subtrees.
``factor`` scales the radius that must be searched: below one it prunes more
and may miss neighbours, at one the search is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile.llm.common import stored
from turnstile.llm.vectors import as_matrix, cosine, vector_rows

NEIGHBOURS = 5
FACTOR = 1.0
SHARD_VECTORS = 8192   # different vectors in a shard, on average
LEAF = 128             # vectors in a leaf
QUERY_BLOCK = 1024     # queries searched together
SLACK = 1e-7           # chords of equal cosines may differ by rounding


class VantageTree:
    """Node k: vantage point, radius (median chord of its rows to it), a child
    with the rows within the radius and one with the rows beyond it; leaves
    hold the rows."""

    def __init__(self, x: np.ndarray, seed: int = 7):
        self.x = x
        self.unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        self.rng = np.random.default_rng(seed)
        self.point: list[int] = []
        self.radius: list[float] = []
        self.children: list[tuple[int, int] | None] = []
        self.rows: list[np.ndarray] = []
        self._build(np.arange(len(x)))

    def _chords(self, point: int, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2 - 2 * (self.unit[rows] @ self.unit[point])))

    def _build(self, rows: np.ndarray) -> int:
        node = len(self.point)
        self.point.append(-1)
        self.radius.append(0.0)
        self.children.append(None)
        self.rows.append(rows)
        if len(rows) <= LEAF:
            return node
        point = int(self.rng.choice(rows))
        chord = self._chords(point, rows)
        radius = float(np.median(chord))
        inside = chord <= radius
        if inside.all():  # half of the rows or more are at the radius itself: they go beyond it
            inside = np.zeros(len(rows), dtype=bool)
            inside[np.argsort(chord, kind="stable")[: len(rows) // 2]] = True
        self.point[node], self.radius[node], self.rows[node] = point, radius, rows[:0]
        self.children[node] = (self._build(rows[inside]), self._build(rows[~inside]))
        return node

    def search(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(rows, cosines) of the ``k`` nearest rows found per query, best
        first, equal cosines by row; -1 where there are fewer."""
        state = _Search(self, queries, k, factor)
        everyone = np.arange(len(queries))
        state.descend(0, everyone)   # to each query's own leaf: a first radius
        state.visit(0, everyone)
        return state.best, state.score


class _Search:
    def __init__(self, tree: VantageTree, queries: np.ndarray, k: int, factor: float):
        self.tree, self.queries, self.factor, self.k = tree, queries, factor, k
        self.unit = queries / np.linalg.norm(queries, axis=1, keepdims=True)
        self.best = np.full((len(queries), k), -1, dtype=np.int64)
        self.score = np.full((len(queries), k), -np.inf)
        self.seen_leaf = np.full(len(queries), -1)

    def reach(self, who: np.ndarray) -> np.ndarray:
        """The chord within which a better neighbour must lie."""
        worst = self.score[who, -1]
        return np.where(np.isinf(worst), np.inf, np.sqrt(np.maximum(0.0, 2 - 2 * worst))) * self.factor + SLACK

    def offer(self, node: int, who: np.ndarray) -> None:
        """Compare the rows of a leaf with the queries that reach it, and keep
        each query's ``k`` best, all queries at once."""
        rows = self.tree.rows[node]
        near = self.unit[who] @ self.tree.unit[rows].T >= self.score[who, -1][:, None] - SLACK
        i, j = np.nonzero(near)
        if not len(i):
            return
        exact = cosine(self.queries[who[i]], self.tree.x[rows[j]])
        touched = np.unique(i)
        place = np.searchsorted(touched, i)
        held = who[touched]
        q = np.concatenate([np.repeat(np.arange(len(touched)), self.k), place])
        ids = np.concatenate([self.best[held].ravel(), rows[j]])
        scores = np.concatenate([self.score[held].ravel(), exact])
        order = np.lexsort((ids, -scores, q))
        first = np.searchsorted(q[order], np.arange(len(touched)))
        top = order[first[:, None] + np.arange(self.k)]
        self.best[held], self.score[held] = ids[top], scores[top]

    def descend(self, node: int, who: np.ndarray) -> None:
        children = self.tree.children[node]
        if children is None:
            self.seen_leaf[who] = node
            self.offer(node, who)
            return
        inside = self._distance(node, who) <= self.tree.radius[node]
        for child, own in zip(children, (who[inside], who[~inside])):
            if len(own):
                self.descend(child, own)

    def _distance(self, node: int, who: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2 - 2 * (self.unit[who] @ self.tree.unit[self.tree.point[node]])))

    def visit(self, node: int, who: np.ndarray) -> None:
        children = self.tree.children[node]
        if children is None:
            new = who[self.seen_leaf[who] != node]
            if len(new):
                self.offer(node, new)
            return
        chord, radius = self._distance(node, who), self.tree.radius[node]
        inner = who[chord - self.reach(who) <= radius]
        if len(inner):
            self.visit(children[0], inner)
        outer = who[chord + self.reach(who) >= radius]
        if len(outer):
            self.visit(children[1], outer)


def nearest(base: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, factor: float = FACTOR,
            id_col: str = "vec_id", vec_col: str = "embedding", shard_vectors: int = SHARD_VECTORS) -> DataFrame:
    """The ``k`` nearest rows of ``base`` by cosine for each row of ``queries``,
    the row with the query's own id left out.

    Returns ``query_id, rank`` (from 1), ``vec_id, score``, nearest first, ties
    to the smaller id; all candidates where there are fewer.  Vectors that are
    null, empty, zero or hold a null or non-finite component, and rows with a
    null id, take no part; vectors of different length are no candidates for
    each other; rows that repeat an id and vector count once.  An empty side
    gives an empty result.
    """
    valid = "vec is not null and vec_id is not null"
    rows = vector_rows(base, id_col, vec_col).where(valid)
    # Copies are one point; its k+1 smallest ids are all that any answer can name.
    points = stored(rows.groupBy("digest").agg(
        F.min("vec_id").alias("least"), F.first("dims").alias("dims"), F.first("vec").alias("vec")), "points")
    ids = rows.select("digest", "vec_id").distinct()
    shards = max(1, -(-points.count() // shard_vectors))
    shard = F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int")
    indexed = points.select(shard.alias("shard"), F.lit(0).alias("kind"), F.col("least").alias("id"), "dims", "vec",
                            "digest")
    asked = vector_rows(queries, id_col, vec_col).where(valid).select("vec_id", "dims", "vec", "digest").distinct()
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"),
                         F.col("vec_id").alias("id"), "dims", "vec", "digest")
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("digest", T.BinaryType()),
                           T.StructField("score", T.DoubleType())])
    found_k = k + 1  # the query's own point may be among the nearest

    def answers(trees: dict, batch: pa.RecordBatch):
        dims = batch.column("dims").to_numpy()
        for d in np.unique(dims).tolist():
            if d not in trees:
                continue
            tree, digests = trees[d]
            own = np.flatnonzero(dims == d)
            for at in range(0, len(own), QUERY_BLOCK):
                part = batch.take(pa.array(own[at:at + QUERY_BLOCK]))
                best, score = tree.search(as_matrix(part.column("vec"), d), found_k, factor)
                q, r = np.nonzero(best >= 0)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(q)), digests.take(pa.array(best[q, r])), pa.array(score[q, r])],
                    names=schema.names)

    def run(batches):
        shard, held, trees = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            shard_of, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            mark = shard_of.astype(np.int64) * 2 + kind
            bounds = [0, *(np.flatnonzero(mark[1:] != mark[:-1]) + 1).tolist(), len(mark)]
            for lo, hi in zip(bounds, bounds[1:]):
                part = batch.slice(lo, hi - lo)
                if shard_of[lo] != shard:
                    shard, held, trees = shard_of[lo], [], None
                if kind[lo] == 0:
                    held.append(part)
                    continue
                if trees is None:
                    trees, held = _trees(held), []
                yield from answers(trees, part)

    searched = indexed.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "kind", "id") \
                      .mapInArrow(run, schema)
    # Nearest points of all shards, then their ids.
    by_point = Window.partitionBy("query_id").orderBy(F.desc("score"))
    points_kept = searched.withColumn("place", F.rank().over(by_point)).where(F.col("place") <= found_k)
    wanted = stored(points_kept.select("query_id", "digest", "score"), "nearest_points")
    by_id = Window.partitionBy("digest").orderBy("vec_id")
    named = ids.join(wanted.select("digest").distinct(), "digest", "left_semi") \
               .withColumn("copy", F.row_number().over(by_id)).where(F.col("copy") <= found_k)
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = wanted.join(named, "digest").where("vec_id <> query_id").select("query_id", "vec_id", "score")
    return out.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k) \
              .select("query_id", "rank", "vec_id", "score")


def _trees(parts: list[pa.RecordBatch]) -> dict[int, tuple[VantageTree, pa.Array]]:
    """One tree per vector length."""
    if not parts:
        return {}
    table = pa.Table.from_batches(parts).combine_chunks()
    dims = table.column("dims").to_numpy()
    out = {}
    for d in np.unique(dims).tolist():
        own = table.take(pa.array(np.flatnonzero(dims == d)))
        out[d] = (VantageTree(as_matrix(own.column("vec"), d)), own.column("digest").combine_chunks())
    return out
