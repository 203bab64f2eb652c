"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.llm.common import giving_back
from turnstile.session import reuse


class Forest:
    """Union-find over 0..n-1 for the rows of one task; the smaller root wins."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def union(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(member, root) of every member that is not a root: links that keep
        the components and are fewer than the members."""
        roots = np.array([self.find(i) for i in range(len(self.parent))], dtype=np.int64)
        members = np.flatnonzero(roots != np.arange(len(roots)))
        return members, roots[members]


def _smallest(edges: DataFrame) -> DataFrame:
    """(u, v) -> (u, v, m) with m the smallest neighbour of u.  Aggregate and
    join instead of a window: a hot u is combined map-side, and as the minima
    are dealt anew for the join, its join rows can be split."""
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")).hint("rebalance"), "u")


ROWS_PER_TASK = 100_000  # links that one task reads at the start of a round, on average
CHUNK = 1_000_000        # links that a task contracts at once


def _contracted(links: DataFrame) -> DataFrame:
    """The same components with fewer links: each task replaces its own links
    by a forest that points at smallest nodes."""
    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK:
                yield forest(held)
                held, rows = [], 0
        if rows:
            yield forest(held)

    def forest(batches):
        u, v = (np.concatenate([b.column(c).to_numpy() for b in batches]) for c in ("u", "v"))
        nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
        own = Forest(len(nodes))
        for i, j in zip(place[: len(u)].tolist(), place[len(u):].tolist()):
            own.union(i, j)
        members, roots = own.links()
        return pa.RecordBatch.from_arrays([pa.array(nodes[members]), pa.array(nodes[roots])], names=["u", "v"])

    return links.mapInArrow(giving_back(run), "u long, v long")


def _parts(links: DataFrame) -> int:
    """Tasks that a stored set of links asks for."""
    return max(1, -(-links.count() // ROWS_PER_TASK))


def _are_stars(links: DataFrame) -> bool:
    """Whether every node has one link to a smaller node at most, and those
    with one are nobody's root: then each root is its component's smallest."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")) \
                .unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("root")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root")) \
               .where("up > 1 or (up = 1 and root = 1)").isEmpty()


def connected_components(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """``node, component`` for every node that has a link; the component is
    its smallest node.

    Large-star links each node's larger neighbours to its smallest, small-star
    links its smaller ones and itself; the two alternate until every component
    is a star, in a number of rounds that grows with the logarithm of the
    number of nodes.  Before each round every task contracts the links it has.  Links that are null or join a node to itself count for
    nothing; repeated links count once; an empty table gives an empty result.
    """
    a, b = F.col(a).cast("long"), F.col(b).cast("long")
    links = reuse(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                  .where(a.isNotNull() & b.isNotNull() & (a != b)).distinct())
    links = reuse(_contracted(links.coalesce(_parts(links))))
    while not _are_stars(links):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _smallest(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        small = _smallest(large)
        # (u, m) once per u and (v, m) for its other neighbours; all point from the larger to the smaller node.
        following = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                                 F.col("m").alias("v")).distinct()
        links = reuse(_contracted(following.coalesce(_parts(links))))
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
