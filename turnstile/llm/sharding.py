"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a prime-sized
table (an offset and a step derived from its name).  The shards take turns,
and at its turn a shard claims the first slot of its order that is still
free.  A row is placed by hashing its key to a slot and reading the slot's
shard from the broadcast table.  Adding or removing a shard moves few slots
besides that shard's own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = 64
SLOTS_PER_SHARD = 100  # the fullest and emptiest shard then differ by about 1 %
HEX_DIGITS = 15        # hex digits of an md5 that fit a long


def prime_from(n: int) -> int:
    """Smallest prime that is at least ``n``."""
    n = max(2, n)
    while any(n % p == 0 for p in range(2, int(n ** 0.5) + 1)):
        n += 1
    return n


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode("utf-8")).hexdigest()[:HEX_DIGITS], 16)


def fill_table(shards: Sequence[str], slots: int) -> list[int]:
    """Slot -> index of its shard.  ``slots`` must be prime and at least the
    number of shards; names that repeat are an error, since they would share
    one order of preference."""
    if len(set(shards)) != len(shards) or not shards:
        raise ValueError("shard names must be given and different")
    if slots < len(shards) or prime_from(slots) != slots:
        raise ValueError("the table's size must be a prime no smaller than the number of shards")
    place = [_hash(f"offset:{s}") % slots for s in shards]
    step = [_hash(f"skip:{s}") % max(1, slots - 1) + 1 for s in shards]
    owner, claimed = [-1] * slots, 0
    while claimed < slots:
        for k in range(len(shards)):
            while owner[place[k]] >= 0:
                place[k] = (place[k] + step[k]) % slots
            owner[place[k]] = k
            claimed += 1
            if claimed == slots:
                break
    return owner


def slot_of(key: Column, slots: int) -> Column:
    """Slot of a key; a null key hashes like the empty string."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, HEX_DIGITS), 16, 10).cast("long") % slots).cast("int")


def lookup_table(spark: SparkSession, shards: Sequence[str], slots: int) -> DataFrame:
    """``slot, shard``: one row per slot, ``slots`` rows in all."""
    rows = [(i, shards[k]) for i, k in enumerate(fill_table(shards, slots))]
    return spark.createDataFrame(rows, "slot int, shard string")


def place(df: DataFrame, key_col: str, shards: Sequence[str], slots: int | None = None, slot_col: str = "slot",
          shard_col: str = "shard") -> DataFrame:
    """``df`` with the slot and shard of every row's key.

    The lookup table has a fixed number of rows (``slots``, by default the
    first prime from 100 times the shards on), whatever the data, so it is
    broadcast and no row is shuffled.  Rows with equal keys share a shard; a
    null key has the place of the empty string; existing columns of the two
    result names are replaced; an empty table stays empty.
    """
    slots = slots or prime_from(SLOTS_PER_SHARD * len(shards))
    table = lookup_table(df.sparkSession, shards, slots) \
        .select(F.col("slot").alias("_slot"), F.col("shard").alias("_shard"))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (slot_col, shard_col)]
    keyed = df.withColumn("_key_slot", slot_of(F.col(key_col), slots))
    return keyed.join(F.broadcast(table), F.col("_key_slot") == F.col("_slot")) \
                .select(*kept, F.col("_slot").alias(slot_col), F.col("_shard").alias(shard_col))


def write_shards(df: DataFrame, path: str, key_col: str, shards: Sequence[str], files_per_shard: int = 8) -> None:
    """Write every row under ``shard=<name>``.  A shard's rows are spread over
    ``files_per_shard`` tasks by a hash of the row, so a shard that a hot key
    fills is not written by one task, and a task run again writes the same."""
    placed = place(df, key_col, shards, slot_col="_slot_no")
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(files_per_shard))
    placed.drop("_slot_no").withColumn("_spread", spread).repartition("shard", "_spread").drop("_spread") \
          .write.partitionBy("shard").parquet(path)


def oracle_sql(table: str, key: str, shards: int = SHARDS) -> str:
    """DuckDB SQL of ``place`` over shards named shard-0, shard-1, ...: the
    table is filled claim by claim in a recursive query."""
    slots = prime_from(SLOTS_PER_SHARD * shards)

    def number(text: str) -> str:
        return f"CAST('0x' || substr(md5({text}), 1, {HEX_DIGITS}) AS BIGINT)"
    return f"""
WITH RECURSIVE shards AS (
  SELECT k, {number("'offset:shard-' || k")} % {slots} AS off, {number("'skip:shard-' || k")} % {slots - 1} + 1 AS skip
  FROM range({shards}) r(k)),
orders AS (SELECT list(off ORDER BY k) AS offs, list(skip ORDER BY k) AS skips FROM shards),
fill AS (
  SELECT 0 AS turn, CAST(NULL AS BIGINT) AS slot, list_transform(range({slots}), lambda x: false) AS taken,
         list_transform(range({shards}), lambda x: 0) AS tried
  UNION ALL
  SELECT turn + 1, c, list_concat(list_concat(taken[1:c], [true]), taken[c + 2:]),
         list_concat(list_concat(tried[1:k], [j + 1]), tried[k + 2:])
  FROM (SELECT turn, taken, tried, k, j, (offs[k + 1] + j * skips[k + 1]) % {slots} AS c
        FROM (SELECT *, list_filter(range(tried[k + 1], {slots}),
                                    lambda x: NOT taken[(offs[k + 1] + x * skips[k + 1]) % {slots} + 1])[1] AS j
              FROM (SELECT turn, taken, tried, turn % {shards} AS k FROM fill WHERE turn < {slots}) t, orders) u) v),
claims AS (SELECT CAST(slot AS INTEGER) AS slot, 'shard-' || ((turn - 1) % {shards}) AS shard
           FROM fill WHERE slot IS NOT NULL)
SELECT d.{key}, c.slot, c.shard
FROM {table} d JOIN claims c ON c.slot = {number(f"coalesce(CAST(d.{key} AS VARCHAR), '')")} % {slots}"""
