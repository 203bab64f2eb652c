"""Best-fit packing of tokenised documents by exact-complement hashing.

How well pieces pack depends only on how many there are of each length, and
there are at most ``capacity`` lengths.  So Spark counts the lengths, one
small plan is made on the counts, and Spark deals the pieces out by the
plan.  An index has the sums of one and of two available lengths; the plan takes
the longest length still available and looks its gap up there, or the gap less
a third length.  A combination that fills the gap exactly is used as often as
all its counts allow, and combinations whose lengths are used up leave the
index.  What no combination fills exactly is packed best-fit: the length
closest to the gap goes in until nothing fits.

Which of several exact combinations is taken matters later, so plans that
prefer long and that prefer even parts are made, and one of best fit
alone; the one with the fewest sequences is used.

The plan holds at most one line per use of a combination, each of which uses
up a length or ends a search, so its size depends on ``capacity`` and not on
the number of documents.
"""

from __future__ import annotations

import zlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile.llm.bpe import codec
from turnstile.llm.common import giving_back, stored, text_slices

END_ID = 2          # fixed by the contract: closes every document
CAPACITY = 1024     # tokens in a sequence
DEAL_ROWS = 250_000  # pieces of one length that are numbered in one task, at most; fewer in small tables
DEAL_PARTS = 1024    # of all pieces, below which a bucket is not cut further


def cut(n_tokens: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of each piece: whole where it fits, else pieces of
    ``capacity`` of which only the first may be shorter."""
    first = n_tokens % capacity or min(n_tokens, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, n_tokens, capacity)]


def tokenised_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                     capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32`` and, on
    request, the piece's ``ids``.  A null or empty text is the end id alone."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    fields = [T.StructField("doc_id", src.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()),
              T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
              T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.BinaryType()))
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches):
        c = codec(path, library_words=True)
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                doc, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, text in enumerate(texts):
                    encoded = c.encode_bytes(text) + end
                    for k, (at, n) in enumerate(cut(len(encoded) // 4, capacity)):
                        own = encoded[4 * at:4 * (at + n)]
                        doc.append(i)
                        piece.append(k)
                        start.append(at)
                        length.append(n)
                        crc.append(zlib.crc32(own))
                        if with_ids:
                            ids.append(own)
                columns = [part.column("doc_id").take(pa.array(doc, pa.int32())), pa.array(piece, pa.int32()),
                           pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.array(ids, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return src.mapInArrow(giving_back(run), T.StructType(fields))


# ---------------------------------------------------------------- the plan
class SumIndex:
    """Sums of available lengths: one length by its count, two by the list of
    their longer parts, three by a length and the index of the rest."""

    def __init__(self, left: np.ndarray, even: bool):
        self.left, self.even = left, even
        capacity = len(left) - 1
        lengths = np.flatnonzero(left[:capacity])
        self.lengths = lengths[::-1].tolist()  # longest first; used-up ones go when they are met
        self.pairs: dict[int, list[int]] = {}
        x, y = np.meshgrid(lengths, lengths, indexing="ij")
        x, y = x[x >= y], y[x >= y]
        x, total = x[x + y < capacity], (x + y)[x + y < capacity]
        # The list's end is tried first: the longest part, or the one nearest to half the sum.
        order = np.lexsort((-x if even else x, total))
        sums, starts = np.unique(total[order], return_index=True)
        for s, own in zip(sums.tolist(), np.split(x[order], starts[1:])):
            self.pairs[s] = own.tolist()

    def times(self, lengths: tuple[int, ...]) -> int:
        """How often the lengths are available together."""
        return min(int(self.left[x]) // lengths.count(x) for x in set(lengths))

    def pair(self, total: int, others: tuple[int, ...], most: int) -> tuple[int, int] | None:
        """Two lengths of this sum that are available beside ``others``, none
        over ``most``."""
        own = self.pairs.get(total)
        if not own:
            return None
        while own and not self.times((own[-1], total - own[-1])):
            own.pop()  # counts only fall, so it never comes back
        for x in reversed(own):
            if x <= most and self.times((*others, x, total - x)):
                return x, total - x
        return None

    def fill(self, head: int, gap: int) -> tuple[int, ...] | None:
        """Available lengths whose sum is exactly ``gap`` beside one ``head``."""
        if self.times((head, gap)):
            return (gap,)
        found = self.pair(gap, (head,), gap)
        if found:
            return found
        while self.lengths and not self.left[self.lengths[0]]:
            self.lengths.pop(0)
        usable = [a for a in self.lengths if 3 * a >= gap and a <= gap - 2 and self.left[a]]
        for a in reversed(usable) if self.even else usable:
            found = self.pair(gap - a, (head, a), a)
            if found:
                return a, *found
        return None


def _exact_plan(counts: np.ndarray, even: bool) -> list[tuple[tuple[int, ...], int]]:
    """Exact combinations first, best fit for the lengths that are left."""
    left, capacity = counts.copy(), len(counts) - 1
    index, plan, residue = SumIndex(left, even), [], []
    for head in range(capacity - 1, 0, -1):
        while left[head]:
            found = index.fill(head, capacity - head)
            if not found:
                break
            lengths = (head, *found)
            times = index.times(lengths)
            for x in lengths:
                left[x] -= times
            plan.append((lengths, times))
        if left[head]:  # no exact complement is left for this length: best fit takes it
            residue.append(((head,), int(left[head])))
            left[head] = 0
    return plan + _best_fit(residue, capacity)


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences), given how many
    pieces there are of each length; every piece is used exactly once.  Never
    more sequences than best fit alone."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] += n
    full = [((capacity,), int(left[capacity]))] if left[capacity] else []
    longest_first = [((x,), int(left[x])) for x in range(capacity - 1, 0, -1) if left[x]]
    plans = [_exact_plan(left, False), _exact_plan(left, True), _best_fit(longest_first, capacity)]
    return full + min(plans, key=lambda plan: sum(n for _, n in plan))


def _best_fit(items: list[tuple[tuple[int, ...], int]], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counted lengths; equal sequences stay together
    as one counted line."""
    by_room: dict[int, dict[tuple[int, ...], int]] = {}
    for (length,), n in items:  # longest first
        while n:
            room = next((r for r in range(length, capacity) if by_room.get(r)), None)
            if room is None:  # a new sequence each; as many of the same length as fit go together
                each = min(n, capacity // length)
                lengths, bins = (length,) * each, n // each
            else:
                have, avail = by_room[room].popitem()
                each = min(n, room // length)
                bins = min(avail, n // each)
                lengths = have + (length,) * each
                if avail > bins:
                    by_room[room][have] = avail - bins
            n -= bins * each
            slot = by_room.setdefault(capacity - sum(lengths), {})
            slot[lengths] = slot.get(lengths, 0) + bins
    return [line for bins in by_room.values() for line in bins.items()]


def deal_table(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank + 1, sequence of the first rank,
    offset): the pieces of a length, in rank order, take the plan's slots of
    that length in plan order."""
    used: dict[int, int] = {}
    out, base = [], 0
    for lengths, times in plan:
        at = 0
        for x in lengths:
            out.append((x, used.get(x, 0), used.get(x, 0) + times, base, at))
            used[x] = used.get(x, 0) + times
            at += x
        base += times
    return out


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pack all documents into as few sequences of ``capacity`` tokens as the
    plan can.

    Returns one row per piece: ``doc_id, piece, start, length, ids_crc32,
    sequence_id, offset`` and, ``with_ids``, the ids as little-endian 32-bit
    binary.  Null and empty texts are one end token; null ids and repeated
    rows are packed like any other row; other columns are not read.  An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    # Written once with a number for each row, so that ranks do not change.
    pieces = stored(tokenised_pieces(docs, path, id_col, text_col, capacity, with_ids)
                    .withColumn("_row", F.monotonically_increasing_id()), "pieces")
    # At most ``capacity`` rows.
    by_length = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = [line for line in plan_bins(by_length, capacity) if line[0] != (capacity,)]
    used = sum(times for _, times in plan)
    table = np.array(deal_table(plan), dtype=np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    # A full piece is a sequence of its own, whatever its number.
    out = [c for c in pieces.columns if c != "_row"]
    full = pieces.where(F.col("length") == capacity) \
                 .select(*out, (F.col("_row") + used).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    # The pieces of a length are numbered in buckets that follow their count, so no task holds many.
    each = min(DEAL_ROWS, max(1, sum(by_length.values()) // DEAL_PARTS))
    buckets = [-(-by_length.get(x, 0) // each) or 1 for x in range(capacity)]
    first = np.cumsum([0, *buckets])
    parts = F.array(*map(F.lit, buckets))
    short = pieces.where(F.col("length") < capacity).withColumn(
        "_bucket", F.pmod(F.xxhash64("_row"), F.element_at(parts, (F.col("length") + 1).cast("int"))).cast("int"))
    # At most 2 x capacity rows, and one for each DEAL_ROWS pieces.
    counts = short.groupBy("length", "_bucket").count().toPandas().sort_values(["length", "_bucket"])
    bases = np.zeros(first[-1], dtype=np.int64)
    bases[first[counts["length"].to_numpy(dtype=int)] + counts["_bucket"].to_numpy(dtype=int)] = \
        counts.groupby("length")["count"].cumsum() - counts["count"]
    shared = spark.sparkContext.broadcast((table, bases, first))

    by = Window.partitionBy("length", "_bucket").orderBy("_row")
    ranked = short.withColumn("_rank", F.row_number().over(by).cast("long") - 1)
    fields = [f for f in pieces.schema.fields if f.name != "_row"]
    schema = T.StructType([*fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches):
        table, bases, first = shared.value
        # One sorted key per slot range: its length, then its first rank.
        big = np.int64(1) << 48
        keys = table[:, 0] * big + table[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy() + bases[first[length] + batch.column("_bucket").to_numpy()]
            row = table[np.searchsorted(keys, length * big + rank, side="right") - 1]
            columns = [batch.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4].copy())], names=schema.names)

    return full.unionByName(ranked.mapInArrow(place, schema))
