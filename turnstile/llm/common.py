"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnstile.session import reuse, scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return what was written: cuts
    lineage, and a lost executor costs no more than the reading tasks."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return memory that this worker no longer uses: Arrow's pool and the C
    library keep freed blocks, and Spark keeps workers for later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The function of a ``mapInArrow``; a task's memory ends with the task."""
    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidy


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True where crc32(id as text) mod ``folds`` is 0; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def learnable(doc_id: Column, folds: int = 5) -> Column:
    """True where a row may be learned from: an id whose remainder is not 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds != 0, F.lit(False))


def hash_share(col: Column, share: Column | float) -> Column:
    """Keep a pseudo-random ``share`` of values, the same ones on every run."""
    unit = F.pmod(F.xxhash64(col, F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return unit < share


def distinct_sample(rows: DataFrame, column: str, most: int, by: str | None = None) -> DataFrame:
    """The ``most`` different values of ``column`` with the smallest hashes
    (for each value of ``by``): ``column, _hash`` and ``by``.  How often a value
    is repeated does not matter, nor how rows are partitioned.  Only hashes
    are shuffled until the values are known."""
    keys = [by] if by else []
    hashed = rows.select(*keys, column, F.xxhash64(column, F.lit("sample")).alias("_hash"))
    seen = hashed.select(*keys, "_hash").distinct()
    if by:
        # A thousand ranges of hashes per value are counted; only those that hold the smallest are ranked.
        seen = reuse(seen.withColumn("_range", F.shiftright("_hash", 54)))
        lower = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        needed = seen.groupBy(by, "_range").count().withColumn("_before", F.coalesce(F.sum("count").over(lower), F.lit(0))) \
                     .where(F.col("_before") < most).select(by, "_range")
        order = Window.partitionBy(by).orderBy("_hash")
        least = seen.join(needed, [by, "_range"], "left_semi").withColumn("_rank", F.row_number().over(order)) \
                    .where(F.col("_rank") <= most).select(by, "_hash")
    else:
        least = seen.orderBy("_hash").limit(most)
    # At most ``most`` hashes (for each value of ``by``) are broadcast.
    return hashed.join(F.broadcast(least), [*keys, "_hash"]).groupBy(*keys, "_hash").agg(F.min(column).alias(column))


def text_slices(batch: pa.RecordBatch, column: str, max_chars: int = 4_000_000,
                max_rows: int = 2048) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Cut a batch so that one slice's texts stay within ``max_chars`` bytes
    (a single longer text is a slice of its own); yields (slice, texts)."""
    col = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and (held + n > max_chars or i - start >= max_rows):
            yield batch.slice(start, i - start), col.slice(start, i - start).to_pylist()
            start, held = i, 0
        held += int(n)
    if batch.num_rows > start:
        yield batch.slice(start), col.slice(start).to_pylist()
