"""Hard-negative mining by threshold joins over an inverted index.

Vectors become whole numbers, floor(``SCALE`` * x), and scores are their inner
products.  For every anchor the best rows of its own label are its
positives; a positive of score p opens the window ``LOW`` % to ``HIGH`` % of
p, from which the best rows of other labels are its negatives.

Rows lie in shards, anchors stream past each shard.  A shard's index sorts
the dimensions by energy, the large ones first.  For a threshold t a row
indexes only its leading dimensions: those behind, whose norm times the
anchors' norm stays below t, cannot lift a pair to t and are left out, often
the whole row.  So the posting list of a dimension holds the rows whose
index reaches it.  Partial scores are accumulated along the lists, pairs
whose partial score plus remaining norms stay below t are dropped, and the
rest is scored in full.  The threshold starts high and is lowered until
every window is filled or reached to its lower end; so results are exact.

Each shard returns at most ``want`` rows a window, and Spark ranks those of
all shards.  Memory is bounded by ``MOST_SHARD`` rows and a batch of anchors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile.llm.common import stored

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
LOW, HIGH = 80, 100       # percent of the positive's score
LEAST_SHARD = 4096        # rows in a shard: a thousandth of all rows within these bounds
MOST_SHARD = 1 << 18
SHARDS = 1000
BLOCK = 4096              # rows of a shard that are looked at together
ANCHORS = 256             # anchors that are looked up together
CHUNK = 8                 # dimensions between two looks at the remaining norms
SAMPLE = 256              # rows of a shard that give a first threshold
SLACK = 1e-9              # of the bounds, for rounding
NO_ID = np.iinfo(np.int64).max


# ------------------------------------------------------------- the index
def _suffix_norms(x: np.ndarray) -> np.ndarray:
    """Norm of each row from every ``CHUNK``-th dimension on."""
    squares = np.add.reduceat(x * x, np.arange(0, x.shape[1], CHUNK), axis=1)
    return np.sqrt(np.cumsum(squares[:, ::-1], axis=1)[:, ::-1])


class Index:
    """Rows of a shard, longest first, in blocks; dimensions by energy."""

    def __init__(self, x: np.ndarray):
        self.dims = np.argsort(-(x * x).sum(axis=0), kind="stable")
        self.order = np.argsort(-(x * x).sum(axis=1), kind="stable")
        self.x = x[self.order][:, self.dims]
        self.norms = _suffix_norms(self.x)
        self.longest = float(self.norms[0, 0]) if len(x) else 0.0
        self.visited = 0  # products of partial scores, for tests of the pruning

    def above(self, anchors: np.ndarray, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Block by block: (anchor, row, score) of all pairs that score
        ``least`` (one threshold an anchor) or more."""
        a = anchors[:, self.dims]
        norms = _suffix_norms(a)
        everything = bool((least <= 0).any())
        reach = np.full(norms.shape[1], np.inf) if everything else (norms / least[:, None]).max(axis=0)
        for at in range(0, len(self.x), BLOCK):
            x, own = self.x[at:at + BLOCK], self.norms[at:at + BLOCK]
            if everything:
                need = np.full(len(x), own.shape[1])
            else:  # chunks that a row indexes: norms fall from chunk to chunk, so they are the leading ones
                need = (own * reach >= 1 - SLACK).sum(axis=1)
                if not need.any():
                    continue
            by_need = np.argsort(-need, kind="stable")
            rows = by_need[: int((need > 0).sum())]
            lists = [int((need > k).sum()) for k in range(own.shape[1])]
            score = np.zeros((len(a), len(rows)))
            for k, n in enumerate(lists):
                if not n:
                    break
                cut = slice(k * CHUNK, (k + 1) * CHUNK)
                score[:, :n] += a[:, cut] @ x[rows[:n], cut].T
                self.visited += n * len(a)
            short = need[rows] < own.shape[1]  # rows with dimensions outside the index
            rest = np.zeros(len(rows))
            rest[short] = own[rows[short], need[rows[short]]]
            tail = norms[:, np.minimum(need[rows], own.shape[1] - 1)] * rest
            i, j = np.nonzero(score + tail * (1 + SLACK) >= least[:, None])
            exact = score[i, j]
            late = np.flatnonzero(short[j])
            for lo in range(0, len(late), 1 << 16):
                some = late[lo:lo + (1 << 16)]
                exact[some] = np.einsum("ij,ij->i", a[i[some]], x[rows[j[some]]])
            good = exact >= least[i]
            yield i[good], self.order[at + rows[j[good]]], exact[good]


def _first(keys: list[np.ndarray], group: np.ndarray, want: int) -> np.ndarray:
    """Places of the first ``want`` of each group by ``keys``, the first key
    counting most."""
    order = np.lexsort((*keys[::-1], group))
    g = group[order]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, dtype=int)
    sizes = np.diff(np.r_[starts, len(g)])
    return order[np.arange(len(g)) - np.repeat(starts, sizes) < want]


def fill_windows(index: Index, anchors: np.ndarray, lo: np.ndarray, hi: np.ndarray, levels: np.ndarray,
                 allowed: Callable[[np.ndarray, np.ndarray], np.ndarray], ids: np.ndarray, rows: np.ndarray,
                 want: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, window, row, score) of the first ``want`` allowed rows of the
    shard in every window [lo, hi] of every anchor, both given as anchors x
    windows.  ``levels``: falling thresholds, anchors x tries; the last one
    fills every window or lies at the lower end of all."""
    windows = lo.shape[1]
    left = np.flatnonzero((lo <= hi).any(axis=1))
    out: list[tuple[np.ndarray, ...]] = []
    for level in range(levels.shape[1]):
        if not len(left):
            break
        t = levels[left, level]
        held = [np.zeros(0, dtype=np.int64)] * 3 + [np.zeros(0)]
        for i, j, s in index.above(anchors[left], t):
            fine = allowed(left[i], j)
            i, j, s = i[fine], j[fine], s[fine]
            pair, w = np.nonzero((lo[left[i]] <= s[:, None]) & (s[:, None] <= hi[left[i]]))
            held = [np.concatenate([h, n]) for h, n in zip(held, (i[pair], w, j[pair], s[pair]))]
            best = _first([-held[3], ids[held[2]], rows[held[2]]], held[0] * windows + held[1], want)
            held = [h[best] for h in held]
        got = np.bincount(held[0] * windows + held[1], minlength=len(left) * windows).reshape(len(left), windows)
        full = ((got >= want) | (t[:, None] <= lo[left]) | (lo[left] > hi[left])).all(axis=1)
        if level == levels.shape[1] - 1:
            full[:] = True
        done = full[held[0]]
        out.append((left[held[0][done]], *(h[done] for h in held[1:])))
        left = left[~full]
    return tuple(np.concatenate(z) for z in zip(*out)) if out else (np.zeros(0, dtype=np.int64),) * 4


# ------------------------------------------------------------- rows of Spark
def points(df: DataFrame, id_col: str, vec_col: str, label_col: str, anchors: Column, scale: int) -> DataFrame:
    """``row, vec_id, label, dims, vec, anchor`` of the rows that take part;
    ``vec`` holds the whole numbers as 16-bit integers or, where one is
    larger, all as doubles."""
    vec = F.col(vec_col)
    sound = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    src = df.where(F.col(label_col).isNotNull() & vec.isNotNull() & sound).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
        F.transform(vec, lambda x: F.floor(x.cast("double") * scale)).alias("whole"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"))
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", T.StringType()),
                           T.StructField("dims", T.IntegerType()), T.StructField("vec", T.BinaryType()),
                           T.StructField("anchor", T.BooleanType())])

    def run(batches):
        for batch in batches:
            col = batch.column("whole")
            sizes = pc.list_value_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
            values = col.flatten().to_numpy(zero_copy_only=False)
            vecs = []
            for end, n in zip(np.cumsum(sizes).tolist(), sizes.tolist()):
                own = values[end - n:end]
                small = not n or (own.min() >= -1 << 15 and own.max() < 1 << 15)
                vecs.append(own.astype("<i2" if small else "<f8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(sizes.astype(np.int32)),
                 pa.array(vecs, pa.binary()), batch.column("anchor")], names=schema.names)

    # Written once, so that row numbers never change.
    return stored(src.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "points")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    if not dims:
        return np.zeros((len(column), 1))
    return np.stack([np.frombuffer(v, dtype="<i2" if len(v) == 2 * dims else "<f8") for v in column.to_pylist()]) \
             .astype(float)


def _ids(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column, NO_ID).to_numpy(zero_copy_only=False)


def _shards(batches: Iterator[pa.RecordBatch], unit: list[str]):
    """(table of a shard's rows, batch of at most ``ANCHORS`` of its anchors),
    anchors as they come; rows (kind 0) stand before anchors (kind 1)."""
    held: list[pa.RecordBatch] = []
    key, table = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        differs = np.zeros(batch.num_rows - 1, dtype=bool)
        for c in [*unit, "kind"]:
            col = batch.column(c)
            differs |= pc.not_equal(col.slice(1), col.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
        bounds = [0, *(np.flatnonzero(differs) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(bounds, bounds[1:]):
            own = tuple(batch.column(c)[lo].as_py() for c in unit)
            if own != key:
                key, table, held = own, None, []
            if batch.column("kind")[lo].as_py() == 0:
                held.append(batch.slice(lo, hi - lo))
                continue
            if table is None and held:
                table, held = pa.Table.from_batches(held).combine_chunks(), []
            for at in range(lo, hi if table is not None else lo, ANCHORS):
                yield table, batch.slice(at, min(ANCHORS, hi - at))


FOUND = T.StructType([T.StructField("anchor_row", T.LongType()), T.StructField("anchor_id", T.LongType()),
                      T.StructField("window", T.LongType()), T.StructField("row", T.LongType()),
                      T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])


def _search(units: DataFrame, unit: list[str], tasks: int, own_label: bool, want: int, low: int, high: int) -> DataFrame:
    """The best of each shard for each anchor: of the anchor's own label, all
    in one window, or of other labels in the windows of its ``scores``."""
    def run(batches):
        shard, index = None, None
        for table, anchors in _shards(batches, unit):
            dims = anchors.column("dims")[0].as_py()
            if table is not shard:
                shard, index = table, Index(_matrix(table.column("vec").chunk(0), dims))
                rows, labels = table.column("row").to_numpy(), np.array(table.column("label").to_pylist(), dtype=object)
                ids = _ids(table.column("vec_id").chunk(0))
            a = _matrix(anchors.column("vec"), dims)
            own_rows = anchors.column("row").to_numpy()
            if own_label:
                scores = None
                lo, hi = np.full((len(a), 1), -np.inf), np.full((len(a), 1), np.inf)
                sample = np.sort(a[:, index.dims] @ index.x[:SAMPLE].T, axis=1)
                # One of the sampled rows may be the anchor itself, so one more is counted.
                sure = sample[:, -want - 1] if sample.shape[1] > want else np.full(len(a), -np.inf)
                sure = sure - SLACK * np.abs(sure)
                top = np.sqrt((a * a).sum(axis=1)) * index.longest
                step = np.where(np.isfinite(sure), top - sure, 0)
                levels = np.stack([sure + 0.5 * step, sure + 0.2 * step, sure], axis=1)

                def allowed(i, j):
                    return rows[j] != own_rows[i]
            else:
                lists = anchors.column("scores").to_pylist()
                scores = np.full((len(a), max(map(len, lists))), np.nan)
                for k, s in enumerate(lists):
                    scores[k, : len(s)] = s
                # s is in the window if low * p <= 100 * s <= high * p
                lo = np.nan_to_num(np.ceil(low * scores / 100), nan=np.inf)
                hi = np.nan_to_num(np.floor(high * scores / 100), nan=-np.inf)
                floor = np.where(lo <= hi, lo, np.inf).min(axis=1)
                floor = np.where(np.isfinite(floor), floor, 0)
                levels = np.stack([np.ceil(floor * f) for f in (1.15, 1.05)] + [floor], axis=1)
                levels = np.where(floor[:, None] > 0, levels, floor[:, None])
                own_labels = np.array(anchors.column("label").to_pylist(), dtype=object)

                def allowed(i, j):
                    return labels[j] != own_labels[i]
            i, w, j, s = fill_windows(index, a, lo, hi, levels, allowed, ids, rows, want)
            i, w, j = (z.astype(np.int64) for z in (i, w, j))
            window = np.zeros(len(i)) if own_label else scores[i, w]
            # Beyond the longs' range scores stop at its ends.
            whole = [pa.array(np.clip(z, -2.0**63, 2.0**63 - 1024).astype(np.int64)) for z in (window, s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(own_rows[i]), anchors.column("vec_id").take(pa.array(i)), whole[0], pa.array(rows[j]),
                 table.column("vec_id").chunk(0).take(pa.array(j)), whole[1]], names=FOUND.names)

    together = units.repartition(tasks, *unit).sortWithinPartitions(*unit, "kind")
    return together.mapInArrow(run, FOUND)


def _ranked(found: DataFrame, want: int) -> DataFrame:
    """The first ``want`` of each anchor and window over all shards."""
    best = Window.partitionBy("anchor_row", "window").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= want)


def hard_negatives(df: DataFrame, anchors: Column, id_col: str = "vec_id", vec_col: str = "embedding",
                   label_col: str = "label", scale: int = SCALE, positives: int = POSITIVES,
                   negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
                   least_shard: int = LEAST_SHARD, most_shard: int = MOST_SHARD) -> DataFrame:
    """Positives of every anchor and hard negatives of every positive.

    ``anchors`` is a condition on ``df``.  Returns ``anchor_id, positive_id,
    rank`` (from 1), ``negative_id, positive_score, negative_score``: for each
    anchor its best ``positives`` other rows of its label (higher scores
    first, then smaller ids, null ids last), and for each of them the best
    ``negatives`` rows of other labels with ``low`` % <= score <= ``high`` % of
    the positive's; fewer where there are fewer, none for a negative score.

    Rows with a null label, a null vector, or a null or non-finite component
    take no part.  Zero and empty vectors do; vectors of different length
    never meet.  A row that repeats an id is a row of its own, a null id may
    be found but the condition decides whether it is an anchor.  Scores are
    exact below 2**53 and doubles beyond, ending at the longs' range.  Other
    columns are not read; an empty table gives an empty result.
    """
    rows = points(df, id_col, vec_col, label_col, anchors, scale)
    total = rows.count()
    size = min(most_shard, max(least_shard, total // SHARDS))
    tasks = min(20_000, 2 * -(-total // size) + 16)
    # Labels of more than a shard: fewer than total / size, so their broadcast is bounded.
    crowded = rows.groupBy("label", "dims").count().where(F.col("count") > size) \
                  .select("label", "dims", F.ceil(F.col("count") / size).alias("parts"))
    unit = ["label", "dims", "part"]
    dealt = rows.join(F.broadcast(crowded), ["label", "dims"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    columns = ["row", "vec_id", "label", "dims", "vec"]
    part = F.pmod(F.xxhash64("row"), F.col("parts"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    units = dealt.select(*columns, part.alias("part"), F.lit(0).alias("kind")) \
        .unionByName(dealt.where("anchor").select(*columns, every.alias("part"), F.lit(1).alias("kind")))
    found = _ranked(_search(units, unit, tasks, True, positives, low, high), positives)
    best = stored(found.select("anchor_row", "anchor_id", F.col("row").alias("positive_row"),
                               F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    windows = best.where("positive_score >= 0").groupBy("anchor_row").agg(
        F.array_sort(F.collect_set("positive_score")).alias("scores")).withColumnRenamed("anchor_row", "row")
    crowded = rows.groupBy("dims").count().where(F.col("count") > size) \
                  .select("dims", F.ceil(F.col("count") / size).alias("parts"))
    dealt = rows.join(F.broadcast(crowded), "dims", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    unit = ["dims", "part"]
    units = dealt.select(*columns, part.alias("part"), F.lit(0).alias("kind"),
                         F.lit(None).cast("array<long>").alias("scores")) \
        .unionByName(dealt.where("anchor").join(windows, "row").select(*columns, every.alias("part"),
                                                                       F.lit(1).alias("kind"), "scores"))
    found = _ranked(_search(units, unit, tasks, False, negatives, low, high), negatives)
    found = found.select("anchor_row", F.col("window").alias("positive_score"), "rank",
                         F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return best.join(found, ["anchor_row", "positive_score"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score",
        "negative_score")
