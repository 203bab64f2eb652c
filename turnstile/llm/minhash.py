"""MinHash near-duplicates: minima of many universal hash functions, banding,
signature verification, exact confirmation on whole shingle sets, components.

1. One pass over the texts gives each document's shingle-set digest, its band
   keys and a short sketch (one byte of each of the first minima).
2. Documents with equal sets are one class from here on.
3. Classes that share a band key share a bucket.  Buckets with the same
   members count once.  Inside a bucket, sketches put aside pairs far below
   the threshold; what remains is joined into groups by a forest, so a bucket
   of n classes leaves fewer than n rows.
4. The whole sets of a group meet in blocks; every pair in a block is counted
   exactly and the links leave as a forest again.

Large buckets and groups are cut into blocks that meet two by two, so a task
never holds more than two blocks.  No pair list of a group is ever written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile.llm.common import giving_back, stored, text_slices
from turnstile.llm.components import Forest, connected_components

WORDS = 5               # words in a shingle
LINK_PERCENT = 75       # 100 * intersection >= 75 * union
BANDS, ROWS = 64, 6     # at similarity 0.75 a pair misses all bands once in 280,000
SKETCH = 128            # minima kept as one byte each
SKETCH_LEAST = 64       # equal bytes below which a pair of 0.75 is a 6-sigma event
BLOCK = 512             # classes in a block
BLOCK_SHINGLES = 1_500_000  # shingles in a block, on average

WORD_CACHE = 200_000
CHUNK = 256             # shingles hashed at once; keeps the table in cache


class WordHashes(dict):
    """word -> 64-bit hash, remembered per worker up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


_HASHES = WordHashes()


def forget_words() -> None:
    """At the end of a task: its words are not kept for the worker's next stage."""
    _HASHES.clear()


_MIX = np.random.default_rng(20).integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_HASH_A = np.random.default_rng(21).integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_HASH_B = np.random.default_rng(22).integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_BAND_MIX = np.random.default_rng(23).integers(1, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct five-word shingles of a text; A-Z
    are lower-cased and words end at the six ASCII white-space characters.  A
    text of fewer words has its whole sequence as one shingle, a text without
    words has none."""
    words = text.encode("utf-8").lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    x = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    if len(x) < WORDS:  # the length is part of the hash: a short sequence is no prefix of a longer one
        mixed = (x * _MIX[: len(x)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(x))
    else:
        n = len(x) - WORDS + 1
        mixed = x[:n] * _MIX[0]
        for k in range(1, WORDS):
            mixed = mixed + x[k:k + n] * _MIX[k]
    return np.unique(_scramble(mixed))


def minima(hashes: np.ndarray) -> np.ndarray:
    """Minimum of each universal hash a*x + b (mod 2^32) over a set."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    best = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), CHUNK):
        table = np.multiply.outer(x[at:at + CHUNK], _HASH_A)
        table += _HASH_B
        np.minimum(best, table.min(axis=0), out=best)
    return best


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of the key."""
    rows = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    keys = (rows * _BAND_MIX).sum(axis=2, dtype=np.uint64)
    return _scramble(keys + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, digest, sketch, bands: the last three null for an
    empty set."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()),
                           T.StructField("digest", T.BinaryType()), T.StructField("sketch", T.BinaryType()),
                           T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                sets = [shingles(t) for t in texts]
                full = [i for i, s in enumerate(sets) if len(s)]
                signatures = np.empty((len(full), BANDS * ROWS), dtype=np.uint32)
                digest: list[bytes | None] = [None] * len(sets)
                sketch: list[bytes | None] = [None] * len(sets)
                for k, i in enumerate(full):
                    signatures[k] = minima(sets[i])
                    digest[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                    sketch[i] = (signatures[k, :SKETCH] * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8).tobytes()
                sizes = np.zeros(len(sets) + 1, dtype=np.int32)
                sizes[np.array(full, dtype=int) + 1] = BANDS
                bands = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)),
                                                 pa.array(band_keys(signatures).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(digest, pa.binary()), pa.array(sketch, pa.binary()), bands], names=schema.names)
        forget_words()

    return src.mapInArrow(giving_back(run), schema)


# ------------------------------------------------------------ blocks
def in_blocks(rows: DataFrame, member: str, blocks) -> DataFrame:
    """Deal the members of each key to ``blocks`` blocks and bring every two
    blocks of a key together once: adds ``_own`` (the member's block), ``_lo``
    and ``_hi`` (the two that meet); (key, _lo, _hi) is one task's unit."""
    own = F.pmod(F.xxhash64(member, F.lit("block")), blocks)
    rows = rows.withColumn("_own", own.cast("int")) \
               .withColumn("_other", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
    return rows.withColumn("_lo", F.least("_own", "_other")).withColumn("_hi", F.greatest("_own", "_other")) \
               .drop("_other")


def grouped(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of each unit together in one task, one unit after the other."""
    unit = [*keys, "_lo", "_hi"]
    return rows.repartition(*unit).sortWithinPartitions(*unit)


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The units of ``grouped`` rows, whole, whatever batches they come in."""
    unit = [*keys, "_lo", "_hi"]
    held: list[pa.RecordBatch] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        if held and any(held[-1].column(c)[-1] != batch.column(c)[0] for c in unit):
            yield pa.Table.from_batches(held)
            held = []
        differs = np.zeros(n - 1, dtype=bool)
        for c in unit:
            col = batch.column(c)
            differs |= pc.not_equal(col.slice(1), col.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        bounds = [0, *(np.flatnonzero(differs) + 1).tolist(), n]
        for lo, hi in zip(bounds, bounds[1:]):
            held.append(batch.slice(lo, hi - lo))
            if hi < n:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


EDGES = T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType())])


def forest_links(rows: DataFrame, key: str, member: str,
                 join: Callable[[pa.Table, np.ndarray, Forest], None]) -> DataFrame:
    """Links ``src, dst`` of the forests that ``join`` builds unit by unit."""
    def run(batches):
        src, dst = [], []
        for group in by_group(batches, [key]):
            ids = group.column(member).to_numpy()
            if len(ids) > 1:
                forest = Forest(len(ids))
                join(group, ids, forest)
                members, roots = forest.links()
                src.append(ids[members])
                dst.append(ids[roots])
        forget_words()
        if src:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))],
                                             names=["src", "dst"])

    return grouped(rows, [key]).mapInArrow(giving_back(run), EDGES)


def meets(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers on either side of a group: all against all in a block's
    meeting with itself, else the one block against the other."""
    own = group.column("_own").to_numpy()
    lo, hi = group.column("_lo")[0].as_py(), group.column("_hi")[0].as_py()
    return (np.arange(len(own)),) * 2 if lo == hi else (np.flatnonzero(own == lo), np.flatnonzero(own == hi))


def _join_by_sketch(group: pa.Table, ids: np.ndarray, forest: Forest) -> None:
    table = np.frombuffer(b"".join(group.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, SKETCH)
    left, right = meets(group)
    facing = table[right]
    for i in left.tolist():
        for j in right[(facing == table[i]).sum(axis=1) >= SKETCH_LEAST].tolist():
            forest.union(i, j)


def _numbered(sets: list[np.ndarray], starts: np.ndarray) -> tuple[np.ndarray, int]:
    """The sets' shingles one after the other, each as its rank among all
    different ones (four bytes each), and how many there are."""
    every = np.concatenate(sets)
    every.sort()
    new = np.ones(len(every), dtype=bool)
    np.not_equal(every[1:], every[:-1], out=new[1:])
    every = every[new]
    number = np.empty(int(starts[-1]), dtype=np.int32 if len(every) < 1 << 31 else np.int64)
    for k, s in enumerate(sets):
        number[starts[k]:starts[k + 1]] = np.searchsorted(every, s)
    return number, len(every)


def _join_by_sets(group: pa.Table, ids: np.ndarray, forest: Forest) -> None:
    """Exact intersections of whole sets through posting lists of the block."""
    sets = [shingles(t.as_py()) for t in group.column("text")]
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    left, right = meets(group)
    if len(ids) == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        if 100 * common >= LINK_PERCENT * (sizes[0] + sizes[1] - common):
            forest.union(0, 1)
        return
    starts = np.concatenate([[0], np.cumsum(sizes)])
    number, numbers = _numbered(sets, starts)
    del sets
    facing = np.zeros(len(sizes), dtype=bool)
    facing[right] = True
    owners = np.repeat(np.arange(len(sizes), dtype=np.int32), np.where(facing, sizes, 0))
    faced = number[np.repeat(facing, sizes)]
    first = np.concatenate([[0], np.cumsum(np.bincount(faced, minlength=numbers))])
    posting = owners[np.argsort(faced, kind="stable")]  # documents by shingle number
    del owners, faced
    for i in left.tolist():
        mine = number[starts[i]:starts[i + 1]]
        at, n = first[mine], first[mine + 1] - first[mine]
        hits = np.repeat(at - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        common = np.bincount(posting[hits], minlength=len(sizes))
        linked = facing & (100 * common >= LINK_PERCENT * (sizes + sizes[i] - common))
        for j in np.flatnonzero(linked).tolist():
            forest.union(i, j)


# ------------------------------------------------------------ the operator
def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose shingle sets are 0.75 alike or more.

    Returns one row per input row: ``doc_id, n_shingles, component_id, kept``.
    A document without words (null, empty or blank text) has 0 shingles and is
    its own component; a null id links with nothing, has a null component and
    is kept; rows that repeat an id are one node, so all of them get the same
    component.  Other columns are not read.  An empty table gives an empty
    result.
    """
    sketched = stored(sketches(docs, id_col, text_col), "sketches")
    linkable = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    classes = stored(sketched.where(linkable).groupBy("digest").agg(
        F.min("doc_id").alias("class_id"), F.first("n_shingles").alias("n_shingles"),
        F.first("sketch").alias("sketch"), F.first("bands").alias("bands")), "classes")

    # Buckets of more than one class.
    rows = classes.select("class_id", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").count().where("count > 1")
    bucketed = stored(rows.join(shared, "key"), "buckets")
    # Buckets with the same members count once.
    content = bucketed.groupBy("key").agg(
        F.first("count").alias("n"), F.min("class_id").alias("least"), F.max("class_id").alias("most"),
        F.bit_xor(F.xxhash64("class_id")).alias("mark"), F.bit_xor(F.xxhash64("class_id", F.lit(1))).alias("mark2"))
    content = stored(content.groupBy("n", "least", "most", "mark", "mark2").agg(F.min("key").alias("key")), "contents")
    pairs = content.where("n = 2").select(F.col("least").alias("src"), F.col("most").alias("dst"))
    crowded = bucketed.join(content.where("n > 2").select("key", "n"), "key").select("key", "n", "class_id")
    crowded = crowded.join(classes.select("class_id", "sketch"), "class_id")
    crowded = in_blocks(crowded, "class_id", F.ceil(F.col("n") / BLOCK))
    candidates = pairs.unionByName(forest_links(crowded, "key", "class_id", _join_by_sketch))

    # Whole sets of the groups, block by block.
    groups = connected_components(candidates).withColumnRenamed("node", "class_id")
    members = groups.join(classes.select("class_id", "n_shingles"), "class_id")
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    members = members.join(sizes, "component").select("component", "class_id", "n", "s")
    texts = docs.select(F.col(id_col).cast("long").alias("class_id"), F.col(text_col).alias("text"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("s") / BLOCK_SHINGLES))
    blocks = F.least(blocks, F.col("n"))
    with_text = in_blocks(members.join(texts, "class_id"), "class_id", blocks)
    links = forest_links(with_text, "component", "class_id", _join_by_sets)

    components = connected_components(links).withColumnRenamed("node", "class_id")
    named = classes.select("digest", "class_id").join(components, "class_id", "left") \
                   .select("digest", F.coalesce("component", "class_id").alias("_component"))
    found = sketched.select("doc_id", "n_shingles", F.when(linkable, F.col("digest")).alias("digest")) \
                    .join(named, "digest", "left")
    component = F.coalesce("_component", "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"),
                        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
