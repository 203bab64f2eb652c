"""Repair of the structure of conversations, by Hirschberg's divide and conquer.

A sound conversation has the role initials ``(s?(ua)+)?``, so while it is
read it is in one of four states: nothing yet, after the system turn, after a
user turn, after an assistant turn.  Each row is kept (0), given the role that
the state asks for (1) or deleted (2); turns without text may be inserted
anywhere (5); a truncated row that stays costs 5 more; blank and repeated rows
must be deleted.  The cheapest edits win, and of several the ones whose
initials (D, I, K, R) come first in ASCII order.

A row matters to the search only by its kind: its role's initial and its
first fault.  A kind is a 4 x 4 table of costs from state to state.  The cheapest way
through a run of rows is found by halving it: the cost vector from the left
and the cost vector from the right meet in the middle, the crossing with
least cost and least audit is fixed, and both halves follow.  Only vectors of
four are held, never a table of rows x states.  Initials of edits up to a row
are never a prefix of one another, so comparing the left parts decides.

Spark cuts conversations into segments of rows by range, so that one long
conversation is many tasks; a segment is again a 4 x 4 table, and the same
halving over the segments (over runs of segments, if there are many) gives the
states between them, after which all segments are solved side by side.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile.llm.common import stored

SEGMENT = 4096  # rows of a conversation that are solved together
FAN = 4096      # segments of a conversation whose states are found together
INITIALS = "sua"                              # any other initial is the fourth
FINE, TRUNCATED, DUPLICATE, BLANK = range(4)  # first faults
START, SYSTEM, USER, ASSISTANT = range(4)
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
NEVER = 1 << 60
ASKED = (USER, USER, ASSISTANT, USER)         # what a state asks for, and the state after it
ROLES = {USER: "user", ASSISTANT: "assistant"}
TAIL = ("", "II", "I", "")                    # insertions that end a conversation in a state

Matrix = tuple[tuple[tuple[int, ...], ...], tuple[tuple[int, ...], ...]]  # costs, order of the audits of a row


# ------------------------------------------------------------- the search
def kind(initial: int, fault: int) -> str:
    return chr(65 + 4 * initial + fault)


def _ways(state: int, initial: int, fault: int):
    """(cost, initials of the edits, state after) of every way past one row."""
    for inserted in range(4):
        before, cost = "I" * inserted, INSERT * inserted
        yield cost + DELETE, before + "D", state
        if fault < DUPLICATE:
            extra = cost + (CUT_OFF if fault == TRUNCATED else 0)
            if (state, initial) == (START, 0):
                yield extra, before + "K", SYSTEM
            if initial + 1 == ASKED[state]:
                yield extra, before + "K", ASKED[state]
            yield extra + REROLE, before + "R", ASKED[state]
        state = ASKED[state]


@functools.cache
def row_edits(code: str) -> tuple[tuple[tuple[int, str], ...], ...]:
    """(cost, initials) of the best way past a row from state to state."""
    initial, fault = divmod(ord(code) - 65, 4)
    out = []
    for p in range(4):
        best = [(NEVER, "~")] * 4
        for cost, edits, q in _ways(p, initial, fault):
            best[q] = min(best[q], (cost, edits))
        out.append(tuple(best))
    return tuple(out)


def _order(keys: list) -> tuple[int, ...]:
    order = [0] * 4
    for at, q in enumerate(sorted(range(4), key=keys.__getitem__)):
        order[q] = at
    return tuple(order)


@functools.cache
def row_matrix(code: str) -> Matrix:
    edits = row_edits(code)
    return tuple(tuple(c for c, _ in row) for row in edits), tuple(_order([e for _, e in row]) for row in edits)


def forward(items: list[Matrix], lo: int, hi: int, state: int) -> tuple[list[int], list[int]]:
    """Costs from ``state`` through items lo..hi to each state, and the order
    of the audits that reach them."""
    cost, order = [NEVER] * 4, [0, 1, 2, 3]
    cost[state] = 0
    for k in range(lo, hi):
        costs, orders = items[k]
        new, keys = [], []
        for q in range(4):
            c, at, m = min((cost[m] + costs[m][q], order[m], m) for m in range(4))
            new.append(min(c, NEVER))
            keys.append((c >= NEVER, at, orders[m][q]))
        cost, order = new, _order(keys)
    return cost, list(order)


def backward(items: list[Matrix], lo: int, hi: int, state: int) -> list[int]:
    """Costs from each state through items lo..hi to ``state``."""
    cost = [NEVER] * 4
    cost[state] = 0
    for k in range(hi - 1, lo - 1, -1):
        cost = [min(min(c + b for c, b in zip(row, cost)), NEVER) for row in items[k][0]]
    return cost


def crossings(items: list[Matrix], start: int, end: int) -> list[int]:
    """The state before each item and after the last on the best way."""
    out = [start] + [end] * len(items)

    def halve(lo: int, hi: int) -> None:
        if hi - lo < 2:
            return
        mid = (lo + hi) // 2
        cost, order = forward(items, lo, mid, out[lo])
        rest = backward(items, mid, hi, out[hi])
        out[mid] = min(range(4), key=lambda m: (cost[m] + rest[m], order[m]))
        halve(lo, mid)
        halve(mid, hi)

    halve(0, len(items))
    return out


def best_end(items: list[Matrix], start: int = START) -> int:
    """The state in which the rows should end, trailing insertions counted."""
    cost, order = forward(items, 0, len(items), start)
    return min(range(4), key=lambda q: (cost[q] + INSERT * len(TAIL[q]), order[q]))


def whole_matrix(items: list[Matrix]) -> Matrix:
    rows = [forward(items, 0, len(items), p) for p in range(4)]
    return tuple(tuple(c) for c, _ in rows), tuple(tuple(o) for _, o in rows)


def audit_of(kinds: str, start: int, end: int) -> tuple[str, int]:
    """Initials and cost of the best edits of a run of rows."""
    states = crossings([row_matrix(c) for c in kinds], start, end)
    edits = [row_edits(c)[p][q] for c, p, q in zip(kinds, states, states[1:])]
    return "".join(e for _, e in edits), sum(c for c, _ in edits)


def illegal_pair(a: str, b: str) -> bool:
    """Whether the initials of two neighbouring rows may not follow each other."""
    return ((ord(a) - 65) // 4, (ord(b) - 65) // 4) not in ((0, 1), (1, 2), (2, 1))


# ------------------------------------------------------------- rows of Spark
BARE = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"


def _rows(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``conv, turn, key, role, text``; the key tells role and text."""
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                     F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
                     F.coalesce(F.col(text_col), F.lit(" ")).alias("text"))
    return rows.withColumn("key", F.unhex(F.md5(F.concat(F.md5(F.col("role").cast("binary")),
                                                         F.md5(F.col("text").cast("binary"))))))


def _cells(rows: DataFrame) -> DataFrame:
    """Equal rows of a turn as one: ``conv, turn, key, copies, shape`` (the
    kind without duplicates) and whether the key is ``new`` there."""
    initial = F.col("role").substr(1, 1)
    number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(~F.col("text").rlike(BARE), BLANK).when(F.col("text").rlike(ENDED), FINE).otherwise(TRUNCATED)
    cells = stored(rows.select("conv", "turn", "key", (number * 4 + fault).alias("shape"))
                   .groupBy("conv", "turn", "key").agg(F.count(F.lit(1)).alias("copies"), F.max("shape").alias("shape")),
                   "turn_cells")
    first = cells.groupBy("conv", "key").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("t")) \
                 .select(F.col("conv").alias("_c"), F.col("key").alias("_k"), F.col("t.turn").alias("_t"))
    # The join is on whole cells, of which none is hot.
    same = F.col("conv").eqNullSafe(F.col("_c")) & (F.col("key") == F.col("_k")) & F.col("turn").eqNullSafe(F.col("_t"))
    return stored(cells.join(first, same, "left").select(*cells.columns, F.col("_k").isNotNull().alias("new")), "turns")


def _tuples(batches, names: list[str]):
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in names))


def _batches(rows, schema: T.StructType, size: int = 2048):
    """Row tuples as Arrow batches, cut by rows and by bytes of text."""
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow, held, weight = to_arrow_schema(schema), [], 0
    for row in rows:
        held.append(row)
        weight += sum(len(x) for x in row if isinstance(x, (str, bytes)))
        if len(held) >= size or weight > 8_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)


ORDER = ["conv", "turn", "key", "chunk"]


def _item_schema(conv: T.DataType, *more: T.StructField) -> T.StructType:
    return T.StructType([T.StructField("conv", conv), T.StructField("turn", T.LongType()),
                         T.StructField("key", T.BinaryType()), T.StructField("chunk", T.LongType()), *more])


TABLE = [T.StructField("costs", T.ArrayType(T.LongType())), T.StructField("orders", T.ArrayType(T.LongType())),
         T.StructField("first", T.StringType()), T.StructField("last", T.StringType())]


def _flat(matrix: Matrix) -> tuple[list[int], list[int]]:
    return [c for row in matrix[0] for c in row], [o for row in matrix[1] for o in row]


def _table(costs: list[int], orders: list[int]) -> Matrix:
    return tuple(tuple(costs[i:i + 4]) for i in range(0, 16, 4)), tuple(tuple(orders[i:i + 4]) for i in range(0, 16, 4))


def _segments(cells: DataFrame, segment: int) -> DataFrame:
    """Runs of at most ``segment`` rows of a conversation in order, named by
    their first cell and a running number, with their kinds and tables."""
    schema = _item_schema(cells.schema["conv"].dataType, T.StructField("kinds", T.StringType()), *TABLE)

    def run(batches):
        def pieces():
            names = ["conv", "turn", "key", "copies", "shape", "new"]
            for conv, own in itertools.groupby(_tuples(batches, names), key=lambda r: r[0]):
                held, at, chunk = "", None, 0
                for _, turn, key, copies, shape, new in own:
                    initial, fault = divmod(shape, 4)
                    again = kind(initial, fault if fault == BLANK else DUPLICATE)
                    codes = kind(initial, fault) if new or fault == BLANK else again
                    while codes or copies > 1:
                        if not codes:  # the other copies, a segment's rest at a time
                            more = min(copies - 1, segment - len(held) or segment)
                            codes, copies = again * more, copies - more
                        at = at or (turn, key)
                        held += codes
                        codes = ""
                        if len(held) >= segment:
                            yield (conv, *at, chunk, held)
                            held, at, chunk = "", None, chunk + 1
                if held:
                    yield (conv, *at, chunk, held)
        yield from _batches(((*r, *_flat(whole_matrix([row_matrix(c) for c in r[4]])), r[4][0], r[4][-1])
                             for r in pieces()), schema)

    # By range, not by conversation: a long one lies in many partitions.
    order = ["conv", "turn", "key"]
    return cells.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema)


def _solve(items: DataFrame, keys: list[str], known: bool) -> DataFrame:
    """Adds ``before`` and ``after`` (states), ``ends`` (whether it is a
    conversation's last item) and ``joint`` (illegal pairs with the item
    before) to the items of each group, which is known to start and end in given states,
    or is a whole conversation."""
    schema = T.StructType([*items.drop("before", "after", "ends", "joint").schema.fields,
                           T.StructField("before", T.LongType()), T.StructField("after", T.LongType()),
                           T.StructField("ends", T.BooleanType()), T.StructField("joint", T.LongType())])
    names = items.columns
    plain = [f.name for f in schema.fields[:-4]]

    def run(batches):
        def solved():
            at = {c: i for i, c in enumerate(names)}
            rows = _tuples(batches, names)
            for _, own in itertools.groupby(rows, key=lambda r: tuple(r[at[k]] for k in keys)):
                own = list(own)
                tables = [_table(r[at["costs"]], r[at["orders"]]) for r in own]
                if known:
                    one = own[0]
                    start, end, ends, joint = (one[at[c]] for c in ("before", "after", "ends", "joint"))
                else:
                    start, end, ends, joint = START, best_end(tables), True, 0
                states = crossings(tables, start, end)
                for k, r in enumerate(own):
                    pair = joint if not k else int(illegal_pair(own[k - 1][at["last"]], r[at["first"]]))
                    yield (*(r[at[c]] for c in plain), states[k], states[k + 1], ends and k == len(own) - 1, pair)
        yield from _batches(solved(), schema)

    return items.repartition(*keys).sortWithinPartitions(*keys, *[c for c in ORDER if c not in keys]).mapInArrow(run, schema)


def _states(items: DataFrame, fan: int) -> DataFrame:
    """The items with the states before and after each of them.  Where a
    conversation has more than ``fan`` items, runs of ``fan`` of them become
    items of their own, whose states are found first."""
    most = items.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    if most <= fan:
        return stored(_solve(items, ["conv"], False), "segment_states")
    schema = T.StructType([*items.schema.fields, T.StructField("turn_", T.LongType()),
                           T.StructField("key_", T.BinaryType()), T.StructField("chunk_", T.LongType())])
    names = items.columns

    def name(batches):
        def named():
            for _, own in itertools.groupby(_tuples(batches, names), key=lambda r: r[0]):
                for k, r in enumerate(own):
                    if k % fan == 0:
                        head = r[1:4]
                    yield (*r, *head)
        yield from _batches(named(), schema)

    run = ["conv", "turn_", "key_", "chunk_"]
    children = stored(items.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).mapInArrow(name, schema), "runs")
    whole = _item_schema(items.schema["conv"].dataType, *TABLE)
    wanted = [*run, "costs", "orders", "first", "last"]

    def join(batches):
        def joined():
            for key, own in itertools.groupby(_tuples(batches, wanted), key=lambda r: r[:4]):
                own = list(own)
                yield (*key, *_flat(whole_matrix([_table(r[4], r[5]) for r in own])), own[0][6], own[-1][7])
        yield from _batches(joined(), whole)

    parents = children.repartition(*run).sortWithinPartitions(*run, "turn", "key", "chunk") \
                      .select(*wanted).mapInArrow(join, whole)
    found = _states(stored(parents, "run_tables"), fan).select(
        F.col("conv").alias("_c"), F.col("turn").alias("_t"), F.col("key").alias("_k"), F.col("chunk").alias("_n"),
        "before", "after", "ends", "joint")
    same = F.col("conv").eqNullSafe(F.col("_c")) & F.col("turn_").eqNullSafe(F.col("_t")) \
        & (F.col("key_") == F.col("_k")) & (F.col("chunk_") == F.col("_n"))
    known = children.join(found, same).drop("_c", "_t", "_k", "_n")
    return stored(_solve(known, run, True).drop("turn_", "key_", "chunk_"), "segment_states")


def audits(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", segment: int = SEGMENT, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """(segments, cells): ``conv, turn, key, chunk, audit, cost, blank,
    duplicate, truncated, illegal`` of each run of rows, and the rows' cells.

    Rows of a conversation stand by turn (nulls first), rows of one turn by
    a digest of role and text, so equal rows are neighbours.  Null roles and
    texts count as one space; rows with a null conversation are one
    conversation.  A row's first fault counts: blank, duplicate (role and text
    seen earlier), truncated (its last visible character is none of ``.!?``).
    A role whose initial is none of s, u, a, the empty role too, cannot be kept.
    """
    cells = _cells(_rows(df, conv_col, turn_col, role_col, text_col))
    solved = _states(stored(_segments(cells, segment), "segments"), fan)
    schema = _item_schema(cells.schema["conv"].dataType, T.StructField("audit", T.StringType()),
                          *[T.StructField(c, T.LongType()) for c in ("cost", "blank", "duplicate", "truncated", "illegal")])

    def run(batches):
        def audited():
            names = [*ORDER, "kinds", "before", "after", "ends", "joint"]
            for *place, kinds, before, after, ends, joint in _tuples(batches, names):
                audit, cost = audit_of(kinds, before, after)
                tail = TAIL[after] if ends else ""
                faults = [(ord(c) - 65) % 4 for c in kinds]
                yield (*place, audit + tail, cost + INSERT * len(tail),
                       *(faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)),
                       joint + sum(map(illegal_pair, kinds, kinds[1:])))
        yield from _batches(audited(), schema)

    return stored(solved.mapInArrow(run, schema), "audits"), cells


def repaired_turns(df: DataFrame, segments: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                   role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired conversations: ``conv_id, line`` (from 0), ``role, text,
    edit`` (K, R or I).  Texts move once, by conversation; a task reads its
    conversations row by row and holds no more than the audits of the segments
    that begin at one cell."""
    rows = _rows(df, conv_col, turn_col, role_col, text_col)
    both = rows.select("conv", "turn", "key", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("chunk"), "role",
                       "text") \
        .unionByName(segments.select("conv", "turn", "key", F.lit(0).alias("kind"), "chunk",
                                     F.lit("").alias("role"), F.col("audit").alias("text")))
    schema = T.StructType([T.StructField("conv_id", rows.schema["conv"].dataType), T.StructField("line", T.LongType()),
                           T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
                           T.StructField("edit", T.StringType())])

    def run(batches):
        def lines():
            names = ["conv", "kind", "role", "text"]
            for conv, own in itertools.groupby(_tuples(batches, names), key=lambda r: r[0]):
                state, line, waiting = START, 0, deque()
                edits = iter(())

                def following():
                    nonlocal edits
                    while (e := next(edits, None)) is None and waiting:
                        edits = iter(waiting.popleft())
                    return e

                def inserted(e):
                    nonlocal state, line
                    while e == "I":
                        state = ASKED[state]
                        yield conv, line, ROLES[state], "", "I"
                        line += 1
                        e = following()
                    return e

                for _, row, role, text in own:
                    if not row:
                        waiting.append(text)
                        continue
                    edit = yield from inserted(following())
                    if edit == "D":
                        continue
                    if edit == "R":
                        role = ROLES[ASKED[state]]
                    state = SYSTEM if edit == "K" and state == START and role[:1] == "s" else ASKED[state]
                    yield conv, line, role, text, edit
                    line += 1
                yield from inserted(following())
        yield from _batches(lines(), schema)

    order = ["conv", "turn", "key", "kind", "chunk"]
    return both.repartition("conv").sortWithinPartitions(*order).mapInArrow(run, schema)


def text_digests(turns: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of the output of ``repaired_turns``, read
    in its order: a digest can only be taken from first to last line."""
    schema = T.StructType([turns.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])

    def run(batches):
        def digests():
            names = ["conv_id", "role", "text"]
            for conv, own in itertools.groupby(_tuples(batches, names), key=lambda r: r[0]):
                digest, joint = hashlib.sha256(), b""
                for _, role, text in own:
                    digest.update(joint + f"{role}:{text}".encode())
                    joint = b"\n"
                yield conv, digest.hexdigest()
        yield from _batches(digests(), schema)

    return turns.mapInArrow(run, schema)


def repair_report(df: DataFrame, conv_ids: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn",
                  role_col: str = "role", text_col: str = "text", segment: int = SEGMENT, fan: int = FAN) -> DataFrame:
    """One row per conversation: ``conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256``.

    ``gaps`` are turn numbers missing between the first and the last one (0
    if all are null), ``illegal`` neighbours whose role initials are none of
    su, ua, au.  ``conv_ids`` names the conversations to report (those of
    ``df`` by default); one without rows has zeros, an empty audit and the
    digest of the empty string.  Other columns are not read; an empty table
    gives an empty result.
    """
    segments, cells = audits(df, conv_col, turn_col, role_col, text_col, segment, fan)
    counted = cells.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    sums = ["blank", "duplicate", "truncated", "illegal", "cost"]
    piece = F.struct(F.col("turn").isNotNull().alias("a"), F.coalesce("turn", F.lit(0)).alias("b"), "key", "chunk", "audit")
    told = segments.groupBy("conv").agg(
        *[F.sum(c).alias(c) for c in sums],
        F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["audit"]), "").alias("audit"))
    digests = text_digests(repaired_turns(df, segments, conv_col, turn_col, role_col, text_col))
    out = (df if conv_ids is None else conv_ids).select(F.col(conv_col).alias("conv_id")).distinct()
    for part, name in ((counted, "_g"), (told, "_t"), (digests.withColumnRenamed("conv_id", "conv"), "_d")):
        part = part.withColumnRenamed("conv", name)
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col(name)), "left").drop(name)
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ["gaps", *sums]],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def damaged(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """Conversations with faults that a checksum of ``conv_id:turn`` decides on,
    one row in twenty each: dropped, emptied, without sentence ends, repeated,
    or given the user's role.  Nulls count as one space there."""
    def told(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(told(conv_col), F.lit(":"), told(turn_col)).cast("binary")) % 20
    text = F.when(draw == 1, F.lit("")).when(draw == 2, F.regexp_replace(told(text_col), "[.!?]", "")) \
            .otherwise(told(text_col))
    rows = df.where(draw != 0).select(conv_col, turn_col, F.when(draw == 4, F.lit("user")).otherwise(told(role_col)).alias(role_col),
                                      text.alias(text_col), F.when(draw == 3, 2).otherwise(1).alias("_times"))
    return rows.withColumn("_times", F.explode(F.array_repeat(F.lit(0), F.col("_times")))).drop("_times")
