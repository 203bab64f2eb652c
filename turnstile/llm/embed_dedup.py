"""Embedding near-duplicates by spherical-cap filters.

Filter directions come from a structured random product code: the rotated
space is cut in two halves, each half has K random unit codewords, and every
pair of codewords is one of K*K directions.  A direction's inner product with
a vector is the sum of its halves', so the directions that a vector exceeds
are decoded from two short sorted lists without looking at all K*K.  Vectors
of one label that share a filter meet and are verified.

The cap of a vector is as wide as its ``probes(K)`` nearest directions, more
of them the more directions there are, so that the pairs at cosine 0.98 that
share none do not grow with the codebook: none in 1,000,000 random pairs of 64
dimensions at K = 64, 256, 512 and 1,024 each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile.llm.common import stored
from turnstile.llm.components import connected_components
from turnstile.llm.minhash import by_group, grouped, in_blocks, meets
from turnstile.llm.vectors import as_matrix, cosine, vector_rows

LINK = 0.98
BLOCK = 1024   # classes in a block
SHARED = 8192  # filters that are looked at together
NEAR = 1e-9    # cosines this close to the threshold are computed again, pair by pair


class ProductCode:
    """K*K directions in ``dims`` dimensions, the same for the same seed."""

    def __init__(self, dims: int, words: int, seed: int = 5):
        rng = np.random.default_rng((seed, dims, words))
        self.words = words
        wide = max(2, dims)
        self.rotation = np.linalg.qr(rng.normal(size=(wide, wide)))[0][:dims]
        self.halves = np.array_split(np.arange(wide), 2)
        self.codewords = []
        for half in self.halves:
            c = rng.normal(size=(words, len(half)))
            self.codewords.append(c / np.linalg.norm(c, axis=1, keepdims=True))

    def decode(self, x: np.ndarray, nearest: int | None = None) -> np.ndarray:
        """Numbers of the ``nearest`` (else ``probes(K)``) directions nearest to
        each row, sorted.
        The r-th and s-th best codewords make one of the best ``nearest`` pairs
        only if r * s is at most ``nearest``, so no others are summed."""
        nearest = nearest or probes(self.words)
        x = x / np.linalg.norm(x, axis=1, keepdims=True) @ self.rotation
        keep = min(nearest, self.words)
        best, score = [], []
        for half, code in zip(self.halves, self.codewords):
            s = x[:, half] @ code.T
            order = np.argsort(-s, axis=1, kind="stable")[:, :keep]
            best.append(order)
            score.append(np.take_along_axis(s, order, axis=1))
        r, s = (np.array(z) for z in zip(*[(i, j) for i in range(keep) for j in range(keep)
                                          if (i + 1) * (j + 1) <= nearest]))
        total = score[0][:, r] + score[1][:, s]
        top = np.argsort(-total, axis=1, kind="stable")[:, :nearest]
        number = best[0][:, r].astype(np.int64) * self.words + best[1][:, s]
        return np.sort(np.take_along_axis(number, top, axis=1), axis=1).astype(np.int32)


def probes(words: int) -> int:
    """Directions per vector: eight more for every doubling of the codewords."""
    return int(max(16, 8 * np.log2(words) - 24))


def code_words(classes: int) -> int:
    """Codewords per half: a direction for every four vectors of the largest
    label, so that caps stay about as full at every size (a cap's members grow
    with ``probes``, that is with the logarithm of the size)."""
    return int(max(16, 2 ** np.ceil(np.log2(max(4, classes) / 4) / 2)))


def _filters(classes: DataFrame, words: int) -> DataFrame:
    schema = T.StructType([*classes.schema.fields, T.StructField("filters", T.ArrayType(T.IntegerType()))])

    def run(batches):
        codes: dict[int, ProductCode] = {}
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            filters: list = [None] * batch.num_rows
            for d in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == d)
                x = as_matrix(batch.column("vec").take(pa.array(rows)), d)
                if d not in codes:
                    codes[d] = ProductCode(d, words)
                for i, f in zip(rows.tolist(), codes[d].decode(x)):
                    filters[i] = f
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(filters, pa.list_(pa.int32()))],
                                             names=schema.names)

    return classes.mapInArrow(run, schema)


def _linked(group: pa.Table, link: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left rows, right rows, linked matrix) of one group.  A pair counts in
    the first filter that both have, so once in all."""
    left, right = meets(group)
    x = as_matrix(group.column("vec"), group.column("dims")[0].as_py())
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    similar = unit[left] @ unit[right].T
    linked = similar >= link
    a, b = np.nonzero(np.abs(similar - link) < NEAR)
    if len(a):
        linked[a, b] = cosine(x[left[a]], x[right[b]]) >= link
    here = group.column("filter")[0].as_py()
    lists = np.array(group.column("filters").to_pylist(), dtype=np.int64)
    earlier, holders = np.unique(lists[lists < here], return_counts=True)
    earlier = earlier[holders > 1]  # no pair has the others in common
    for first in range(0, len(earlier) if linked.any() else 0, SHARED):
        some = earlier[first:first + SHARED]
        has = np.zeros((len(x), len(some)), dtype=np.float32)
        at = np.searchsorted(some, lists).clip(max=len(some) - 1)
        row, col = np.nonzero(some[at] == lists)
        has[row, at[row, col]] = 1
        linked &= (has[left] @ has[right].T) == 0
    if left is right:
        np.fill_diagonal(linked, False)
    return left, right, linked


def _contract(left: np.ndarray, right: np.ndarray, linked: np.ndarray, n: int) -> np.ndarray:
    """A root for each of a group's n rows, the same one for rows that are
    connected.  Whole rows of the matrix are joined at a time, so a block
    of copies takes two steps and not one for each of its pairs."""
    links = np.zeros((n, n), dtype=bool)
    links[np.ix_(left, right)] = linked
    links |= links.T
    root = np.arange(n)
    new = links.any(axis=1)
    for seed in np.flatnonzero(new).tolist():
        if not new[seed]:
            continue
        new[seed], border = False, np.array([seed])
        while len(border):
            border = np.flatnonzero(links[border].any(axis=0) & new)
            root[border], new[border] = seed, False
    return root


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                 link: float = LINK) -> DataFrame:
    """Links between vectors of equal label at cosine ``link`` or more.

    Returns one row per input row: ``vec_id, n_links, component_id, kept``.
    A null label, or a vector that is null, empty, zero or holds a null or
    non-finite component, links with nothing, not even a copy; vectors of
    different length never link.  Rows that repeat an id are vectors of their
    own for ``n_links`` and one node for components; a null id counts as a
    vector, also as one that connects others, but has a null component and is kept.  An empty table gives an
    empty result.
    """
    rows = stored(vector_rows(df, id_col, vec_col, label_col), "vectors")
    usable = rows.where("vec is not null and label is not null")
    last = rows.agg(F.max("vec_id")).first()[0] or 0
    # Exact copies are one class, named by its smallest id; a class without any id is a node behind all ids.
    classes = usable.groupBy("label", "digest").agg(
        F.min("vec_id").alias("class_id"), F.count(F.lit(1)).alias("copies"),
        F.first("dims").alias("dims"), F.first("vec").alias("vec"))
    classes = stored(classes.withColumn("key", F.unhex(F.md5(F.concat("digest", F.encode("label", "UTF-8")))))
                     .withColumn("node", F.coalesce("class_id", F.lit(last + 1) + F.monotonically_increasing_id())),
                     "vector_classes")
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    filtered = stored(_filters(classes, code_words(most)), "filtered")
    # Caps with one vector are dropped, and the rest dealt to blocks, before any vector moves.
    cap = ["label", "dims", "filter"]
    light = filtered.select("key", "label", "dims", F.explode("filters").alias("filter"))
    sizes = light.groupBy(*cap).count().where("count > 1")
    blocks = in_blocks(light.join(sizes, cap), "key", F.ceil(F.col("count") / BLOCK)).drop("count")
    blocks = blocks.join(filtered.select("key", "node", "copies", "vec", "filters"), "key")
    schema = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("links", T.LongType()),
                           T.StructField("src", T.LongType()), T.StructField("dst", T.LongType())])

    def run(batches):
        for group in by_group(batches, cap):
            if group.num_rows < 2:
                continue
            left, right, linked = _linked(group, link)
            if not linked.any():
                continue
            copies = group.column("copies").to_numpy().astype(float)
            count = np.zeros(group.num_rows)
            count[left] += linked @ copies[right]
            if left is not right:
                count[right] += linked.T @ copies[left]
            root = _contract(left, right, linked, group.num_rows)
            nodes = group.column("node").combine_chunks()
            touched = np.flatnonzero(count > 0)
            yield pa.RecordBatch.from_arrays(
                [group.column("key").combine_chunks().take(pa.array(touched)),
                 pa.array(count[touched].astype(np.int64)), nodes.take(pa.array(touched)),
                 nodes.take(pa.array(root[touched]))], names=schema.names)

    found = stored(grouped(blocks, cap).mapInArrow(run, schema), "vector_links")
    components = connected_components(found).withColumn("component", F.when(F.col("component") <= last, F.col("component")))
    links = found.groupBy("key").agg(F.sum("links").alias("linked"))
    named = classes.select("key", "label", "digest", "class_id", "node", "copies").join(links, "key", "left") \
                   .join(components, "node", "left") \
                   .select("label", "digest", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("linked"),
                           F.coalesce("component", "class_id").alias("component"))
    out = rows.select("vec_id", "label", "digest").join(named, ["label", "digest"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.coalesce("linked", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"),
                      F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
