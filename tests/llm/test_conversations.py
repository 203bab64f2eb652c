"""Conversation repair against exhaustive search and a plain table of states."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import types as T

from turnstile.llm import conversations as C
from turnstile.llm.queries import ORACLE, QUERIES

TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                      T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
SOUND = re.compile(r"(s?(ua)+)?\Z")
SPACE = " \t\n\x0b\x0c\r"


def faults(rows):
    """First fault of each (role, text) row, by the contract's words."""
    seen, out = set(), []
    for role, text in rows:
        visible = [c for c in text if c not in SPACE]
        out.append("blank" if not visible else "duplicate" if (role, text) in seen
                   else "truncated" if visible[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def best_repair(rows):
    """(cost, audit, lines) by a table over rows and role strings so far: the
    states are told by trying, not by the operator's tables."""
    def state(initials):
        return initials[-1:] if initials[-1:] != "" else ""

    table = {"": (0, "", ())}

    def put(new, s, entry):
        if s not in new or entry[:2] < new[s][:2]:
            new[s] = entry

    def insertions(table):
        table = dict(table)
        for _ in range(3):
            for s, (cost, audit, lines) in list(table.items()):
                role = "assistant" if s == "u" else "user"
                put(table, role[0], (cost + 5, audit + "I", lines + (f"{role}:",)))
        return table

    follows = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
    for (role, text), fault in zip(rows, faults(rows)):
        new = {}
        for s, (cost, audit, lines) in insertions(table).items():
            put(new, s, (cost + 2, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            extra = 5 if fault == "truncated" else 0
            if (s, role[:1]) in follows:
                put(new, role[:1], (cost + extra, audit + "K", lines + (f"{role}:{text}",)))
            for given in ("user", "assistant"):
                if (s, given[0]) in follows:
                    put(new, given[0], (cost + extra + 1, audit + "R", lines + (f"{given}:{text}",)))
        table = new
    end = insertions(table)
    return min(end[s] for s in ("", "a") if s in end)


def exhaustive(rows):
    """Least (cost, audit) over all edit scripts with up to two insertions in a place."""
    best = None
    marks = faults(rows)
    options = []
    for (role, _), fault in zip(rows, marks):
        extra = 5 if fault == "truncated" else 0
        ways = [(2, "D", "")]
        if fault in ("", "truncated"):
            ways += [(extra, "K", role[:1] or "?"), (extra + 1, "R", "u"), (extra + 1, "R", "a")]
        options.append(ways)
    inserts = [(0, "", "")] + [(5, "I", x) for x in "ua"] + [(10, "II", x + y) for x in "ua" for y in "ua"]
    for ways in itertools.product(*options):
        for ins in itertools.product(inserts, repeat=len(rows) + 1):
            parts = [p for pair in zip(ins, ways) for p in pair] + [ins[-1]]
            cost = sum(p[0] for p in parts)
            if best and cost > best[0]:
                continue
            if SOUND.match("".join(p[2] for p in parts)):
                entry = (cost, "".join(p[1] for p in parts))
                best = entry if best is None or entry < best else best
    return best


def report(convs, originals):
    """What the operator should return, from {conv: ordered (turn, role, text)}."""
    out = []
    for conv in originals:
        rows = convs.get(conv, [])
        pairs = [(r, t) for _, r, t in rows]
        turns = [t for t, _, _ in rows if t is not None]
        marks = faults(pairs)
        cost, audit, lines = best_repair(pairs)
        starts = [r[:1] for r, _ in pairs]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(starts, starts[1:]))
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, marks.count("blank"),
                    marks.count("duplicate"), marks.count("truncated"), illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    cols = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


ROLES = ["user", "assistant", "system", "tool", "", "user", "assistant"]
TEXTS = ["Hello.", "Yes!", "cut", "", " \n", "Why? \t", "Hello.", "é", "no\xa0", "A.\x0b"]


def test_search_is_the_cheapest_and_least():
    rnd = random.Random(3)
    for _ in range(60):
        rows = [(rnd.choice(ROLES), rnd.choice(TEXTS)) for _ in range(rnd.randint(0, 3))]
        assert exhaustive(rows) == best_repair(rows)[:2]


def kinds_of(rows):
    number = {"": C.FINE, "truncated": C.TRUNCATED, "duplicate": C.DUPLICATE, "blank": C.BLANK}
    return "".join(C.kind(C.INITIALS.index(r[:1]) if r[:1] and r[:1] in C.INITIALS else 3, number[f])
                   for (r, _), f in zip(rows, faults(rows)))


def test_halving_equals_the_table():
    rnd = random.Random(4)
    for _ in range(400):
        rows = [(rnd.choice(ROLES), rnd.choice(TEXTS) + str(rnd.randint(0, 30))) for _ in range(rnd.randint(0, 40))]
        kinds = kinds_of(rows)
        end = C.best_end([C.row_matrix(c) for c in kinds])
        audit, cost = C.audit_of(kinds, C.START, end)
        assert (cost + 5 * len(C.TAIL[end]), audit + C.TAIL[end]) == best_repair(rows)[:2]


def test_segments_give_the_same_states():
    """Tables of segments, and of runs of segments, cross where the rows do."""
    rnd = random.Random(5)
    for _ in range(100):
        kinds = "".join(C.kind(rnd.randint(0, 3), rnd.choice([0, 0, 0, 1, 2, 3])) for _ in range(60))
        items = [C.row_matrix(c) for c in kinds]
        end = C.best_end(items)
        by_row = C.crossings(items, C.START, end)
        parts = [C.whole_matrix(items[k:k + 7]) for k in range(0, 60, 7)]
        assert C.best_end(parts) == end and C.crossings(parts, C.START, end) == [*by_row[::7], end]


def tables(spark, rows):
    """The frame, and {conv: rows in the operator's order}."""
    def key(r):
        role, text = (" " if x is None else x for x in r[2:])
        digest = hashlib.md5((hashlib.md5(role.encode()).hexdigest() + hashlib.md5(text.encode()).hexdigest()).encode())
        return r[1] is not None, r[1] or 0, digest.digest()
    convs = {}
    for r in sorted(rows, key=key):
        convs.setdefault(r[0], []).append((r[1], *(" " if x is None else x for x in r[2:])))
    return spark.createDataFrame(rows, TURNS), convs


@pytest.mark.parametrize("segment,fan", [(C.SEGMENT, C.FAN), (3, 4096), (2, 2)])
def test_report(spark, segment, fan):
    rnd = random.Random(6)
    rows = []
    for conv in range(40):
        for turn in range(rnd.choice([1, 2, 5, 9])):
            rows.append((conv, turn + rnd.choice([0, 0, 1]), rnd.choice(ROLES), rnd.choice(TEXTS) + str(rnd.randint(0, 3))))
    # one conversation with a third of all rows, many of them equal; null ids, turns, roles and texts
    rows += [(99, rnd.choice([None, 1, 5, 7, 2 + k]), rnd.choice(["user", "assistant"]), rnd.choice(TEXTS)) for k in range(60)]
    rows += [(99, 4, "user", "Again.")] * 25
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Yo."), (77, None, None, None), (77, None, "user", "Hi."),
             (78, None, "assistant", "Só."), (79, 3, "user", "word " * 30_000 + "end."), (79, 4, "assistant", "x" * 20_000)]
    df, convs = tables(spark, rows)
    want = report(convs, list(convs))
    assert rows_of(C.repair_report(df, segment=segment, fan=fan)) == want


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Yes?"), (1, 2, "assistant", "So."), (2, 0, "assistant", "A."), (2, 1, "tool", " ")]
    df, _ = tables(spark, rows)
    segments, _ = C.audits(df)
    out = sorted(map(tuple, C.repaired_turns(df, segments).collect()))
    # 1: one of the users goes (2), which is cheaper than an assistant between them (5)
    assert out == [(1, 0, "user", "Yes?", "K"), (1, 1, "assistant", "So.", "K")]
    assert {r["conv"]: r["audit"] for r in segments.collect()} == {1: "DKK", 2: "DD"}


def test_edges(spark):
    empty = spark.createDataFrame([], TURNS)
    assert C.repair_report(empty).count() == 0 and C.repaired_turns(empty, C.audits(empty)[0]).count() == 0
    df, convs = tables(spark, [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yo.")])
    clash = df.selectExpr("*", "1 as conv", "2 as key", "3 as kind", "4 as chunk", "5 as audit", "6 as _times")
    assert rows_of(C.repair_report(clash)) == report(convs, [1])
    gone = C.repair_report(df.where("conv_id = 2"), df)
    assert rows_of(gone) == report({}, [1])
    assert C.damaged(empty).columns == TURNS.names


def damage(rows):
    convs = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        role = "user" if draw == 4 else role
        convs.setdefault(conv, []).extend([(turn, role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1))
    return convs


def test_query_same_as_brute_force(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select(*TURNS.names).collect()]
    want = report(damage(rows), sorted({r[0] for r in rows}))
    assert rows_of(QUERIES["op11_hirschberg_repair"](spark, d)) == want
    assert any("R" in r[7] for r in want) and any("D" in r[7] for r in want)


def test_oracle_same_as_brute_force():
    """The SQL against the table of states, with nulls and conversations that lose all rows."""
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations AS SELECT conv_id, turn, role, text FROM "
                "read_parquet('/root/testdata/sf0.01/conversations.parquet')")
    rnd = random.Random(11)
    rows = [(5000 + k // 3, k % 3, rnd.choice([*ROLES, None]), rnd.choice([*TEXTS, None])) for k in range(600)]
    rows += [(None, 0, "user", "Hi."), (None, None, None, None), (6000, None, "assistant", "x")]
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    rows = [tuple(r) for r in con.execute("SELECT * FROM conversations").fetchall()]
    got = sorted(con.execute(ORACLE["op11_hirschberg_repair"]).fetchall(), key=repr)
    assert got == report(damage(rows), {r[0] for r in rows})
