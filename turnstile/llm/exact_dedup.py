"""Exact duplicates by two passes over a Bloom filter.

The first pass hashes every text (white space left out) and counts how often
each of ``HASHES`` positions of the filter is hit; positions hit at least
twice are packed into bitmaps.  The second pass asks for every row whether
all its positions were hit twice.  A repeated text always passes, a text that
is alone almost never (about one in 60 at ``BITS_PER_ROW``).  Only rows that
pass are shuffled by digest and compared; all others go straight through.

The filter is broadcast, so its size is bounded: ``FILTER_BYTES`` hold it up to
33 million rows at full width, then it gets fewer bits a row, and beyond
``FILTER_BYTES`` * 8 / ``LEAST_BITS`` rows (268 million), where it would let
most rows pass anyway, every row's digest is shuffled (60 bytes a row, never
the text).

Everything is built of DataFrame functions; no Python runs in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstile.llm.common import stored

SPACES = r"[\x20\x09-\x0D]"
HASHES = 2
BITS_PER_ROW = 16
LEAST_BITS = 2
FILTER_BYTES = 64 << 20
HOT_SHARE = 1000  # a group with at least this part of the compared rows is hot; there are at most so many


def normalised(text: Column) -> Column:
    """The text that decides equality; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, "")


def filter_bits(rows: int, most_bytes: int = FILTER_BYTES) -> int | None:
    """Size of the filter, a power of two of whole bitmaps; none where it
    would be too crowded to tell anything."""
    if rows * LEAST_BITS > most_bytes * 8:
        return None
    bits = 1 << 15
    while bits < min(rows * BITS_PER_ROW, most_bytes * 8):
        bits *= 2
    return bits


def _position(digest: Column, k: int, bits: int) -> Column:
    """The k-th position of a digest, from 1 on as the bitmap functions count."""
    return F.pmod(F.xxhash64(digest, F.lit(k)), F.lit(bits)) + 1


def repeated_positions(rows: DataFrame, bits: int, digest: str = "digest") -> DataFrame:
    """First pass: ``bucket, bitmap`` of the positions hit at least twice."""
    hits = rows.select(F.explode(F.array(*[_position(F.col(digest), k, bits) for k in range(HASHES)])).alias("position"))
    again = hits.groupBy("position").count().where("count > 1")
    return again.groupBy(F.bitmap_bucket_number("position").alias("bucket")) \
                .agg(F.bitmap_construct_agg(F.bitmap_bit_position("position")).alias("bitmap"))


def maybe_repeated(rows: DataFrame, bits: int | None, digest: str = "digest") -> DataFrame:
    """Second pass: adds ``maybe``, false only where no other row has the
    same digest.  The broadcast bitmaps hold ``bits`` / 8 bytes at most, which
    ``filter_bits`` bounds."""
    if bits is None:
        return rows.withColumn("maybe", F.lit(True))
    bitmaps = F.broadcast(stored(repeated_positions(rows, bits, digest), "bloom_bitmaps"))
    columns = rows.columns
    maybe = F.lit(True)
    for k in range(HASHES):
        position = _position(F.col(digest), k, bits)
        one = bitmaps.select(F.col("bucket").alias(f"_bucket{k}"), F.col("bitmap").alias(f"_bitmap{k}"))
        rows = rows.join(one, F.bitmap_bucket_number(position) == F.col(f"_bucket{k}"), "left")
        bit = F.bitmap_bit_position(position)
        byte = F.conv(F.hex(F.substring(F.col(f"_bitmap{k}"), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        maybe = maybe & F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))
    return rows.select(*columns, maybe.alias("maybe"))


def find_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                most_bytes: int = FILTER_BYTES, hot_share: int = HOT_SHARE) -> DataFrame:
    """Groups of texts that are equal without white space.

    Returns one row per input row: ``doc_id, keep_id`` (id of the row that
    stays: the longest original text, then the smallest id, nulls last),
    ``group_size, kept, text_sha256``.  Null and empty texts and those of
    white space alone are equal to each other.  Rows that repeat an id are
    rows of their own: of rows that tie in length and id exactly one is kept.
    A kept row with a null id leaves a null ``keep_id``.  Other columns are
    not read; an empty table gives an empty result.

    A hot group is one row after the map-side aggregation; its members get
    that row back by a broadcast of the at most ``hot_share`` hot groups.
    """
    digests = docs.select(F.col(id_col).alias("doc_id"),
                          F.unhex(F.sha2(normalised(F.col(text_col)).cast("binary"), 256)).alias("digest"),
                          F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_points"))
    # Written once: row numbers then never change, and the text is read once.
    rows = stored(digests.withColumn("row", F.monotonically_increasing_id()), "digests")
    tested = maybe_repeated(rows, filter_bits(rows.count(), most_bytes))
    out = ["doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")]
    alone = tested.where(~F.col("maybe")).select("*", F.col("doc_id").alias("keep_id"),
                                                 F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    candidates = stored(tested.where("maybe").drop("maybe"), "possible_copies")
    best = F.min(F.struct(-F.col("n_points"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    groups = stored(candidates.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")),
                    "copy_groups")
    groups = groups.withColumn("hot", F.col("group_size") * hot_share >= F.lit(candidates.count()))
    hot = groups.where("hot").select("digest", F.col("best").alias("hot_best"), F.col("group_size").alias("hot_size"))
    tagged = candidates.join(F.broadcast(hot), "digest", "left")
    cold = groups.where(~F.col("hot")).drop("hot")
    compared = tagged.where("hot_best is null").drop("hot_best", "hot_size").join(cold, "digest") \
        .unionByName(tagged.where("hot_best is not null")
                     .withColumnsRenamed({"hot_best": "best", "hot_size": "group_size"}))
    compared = compared.select("*", F.col("best.doc_id").alias("keep_id"), (F.col("row") == F.col("best.row")).alias("kept"))
    return alone.select(*out).unionByName(compared.select(*out))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                most_bytes: int = FILTER_BYTES) -> DataFrame:
    """The rows that stay, with all their columns and whole texts.

    Two passes over ``docs``: the first fills the filter, the second lets rows
    whose text is alone straight through; only the others are shuffled, by
    digest.  Ties in length and id (repeated ids) are broken by the digest of
    the whole row's text, so the result does not depend on partitioning.
    """
    digest = F.unhex(F.sha2(normalised(F.col(text_col)).cast("binary"), 256)).alias("digest")
    text = F.coalesce(F.col(text_col), F.lit(""))
    order = F.struct(-F.char_length(text), F.col(id_col).isNull(), F.col(id_col), F.sha2(text.cast("binary"), 256))
    # The row travels as one struct, so no name of its columns can clash.
    rows = docs.select(F.struct(*docs.columns).alias("row"), order.alias("order"), digest)
    rows = maybe_repeated(rows, filter_bits(docs.count(), most_bytes))
    copies = rows.where("maybe").groupBy("digest").agg(F.min_by("row", "order").alias("row"))
    return rows.where(~F.col("maybe")).select("row.*").unionByName(copies.select("row.*"))
