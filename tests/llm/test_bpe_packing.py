import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.helpers import docs, odd_docs
from turnstile.llm import bpe, packing

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module", params=[WORD, BYTE])
def both(request):
    return bpe.BpeCodec(request.param), Tokenizer.from_file(request.param)


def fuzz():
    rnd = random.Random(5)
    pool = "abz ABÉéßİıſK'́̇  \x85\x1c\t\n019½Ⅷ漢🏽_-!?<|>#€’ﬁσςΣ‍﻿\x00"
    out = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    out += ["".join(chr(rnd.choice([rnd.randint(0, 0x24F), rnd.randint(32, 127), 32])) for _ in range(40))
            for _ in range(2000)]
    return out + ["", " ", "a<|endoftext|>b <|startoftext|>", "<|endoftext", "ab" * 3000 + "é" * 300, "!" * 900]


def test_same_as_library(both):
    own, lib = both
    for text in fuzz():
        want = lib.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == want
        assert own.decode(want) == lib.decode(want, skip_special_tokens=False)


def test_documents_same_as_library(spark, both):
    own, lib = both
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        assert own.encode(r["text"]) == lib.encode(r["text"], add_special_tokens=False).ids


def test_cuts_are_forced_and_fragments_independent(both):
    own, _ = both
    symbols = list(b"thinqvjqzxing")
    parts = own.fragments(symbols)
    assert len(parts) > 1 and sum(parts, []) == symbols
    assert sum((own.merge(p) for p in parts), []) == own.merge(symbols)


def test_long_merge_equals_short_merge(both, monkeypatch):
    own, _ = both
    rnd = random.Random(1)
    for _ in range(200):
        s = [rnd.choice(b"aeinrst") for _ in range(rnd.randint(2, 90))]
        short = own.merge(s)
        assert own._merge_long([own.symbol_id[x] for x in s]) == short


def test_operator_edges(spark):
    out = bpe.encode_documents(odd_docs(spark), WORD).collect()
    assert len(out) == 13
    lib = Tokenizer.from_file(WORD)
    for r, d in zip(sorted(out, key=lambda r: (r["doc_id"] or 0, len(r["ids"]))),
                    sorted(odd_docs(spark).collect(), key=lambda r: (r["doc_id"] or 0, len(r["text"] or "")))):
        want = lib.encode(d["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["decoded"] == lib.decode(want, skip_special_tokens=False)
    assert bpe.encode_documents(docs(spark, []), WORD).count() == 0
    clash = docs(spark, [(1, "hi")]).withColumnRenamed("lang", "ids").withColumnRenamed("source", "decoded")
    assert bpe.encode_documents(clash, WORD).columns == ["doc_id", "ids", "decoded"]


def check_packing(out, texts):
    """Every document's pieces cover its ids in order; sequences are gapless."""
    lib = Tokenizer.from_file(BYTE)
    by_doc, by_sequence = {}, {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for doc_id, text in texts.items():
        ids = lib.encode(text or "", add_special_tokens=False).ids + [2]
        pieces = sorted(by_doc[doc_id], key=lambda r: r["piece"])
        assert [p["piece"] for p in pieces] == list(range(len(pieces)))
        at = 0
        for k, p in enumerate(pieces):
            assert p["start"] == at and (k == 0 or p["length"] == 1024)
            own = np.array(ids[at:at + p["length"]], dtype="<u4")
            assert len(own) == p["length"] and zlib.crc32(own.tobytes()) == p["ids_crc32"]
            at += p["length"]
        assert at == len(ids) and len(pieces) == -(-len(ids) // 1024)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024
    return len(by_sequence)


def test_packing_of_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = packing.pack_documents(d, BYTE).collect()
    n = check_packing(out, {r["doc_id"]: r["text"] for r in d.collect()})
    least = -(-sum(r["length"] for r in out) // 1024)
    assert n <= 1.02 * least + 1


def test_packing_edges(spark):
    out = packing.pack_documents(odd_docs(spark), BYTE, with_ids=True).collect()
    assert sum(r["piece"] == 0 for r in out) == 13
    for r in out:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    assert {r["length"] for r in out if r["doc_id"] in (3, 4)} == {1}
    places = [(r["sequence_id"], r["offset"]) for r in out]
    assert len(set(places)) == len(places)
    assert packing.pack_documents(docs(spark, []), BYTE).count() == 0


def test_exact_complements():
    for counts in ({1023: 5, 1: 5}, {1000: 3, 20: 3, 4: 3}, {501: 4, 300: 4, 199: 4, 24: 4}):
        plan = packing.plan_bins(counts)
        assert all(sum(lengths) == 1024 for lengths, _ in plan)
    assert packing.plan_bins({}) == []
    assert packing.plan_bins({600: 3}) == [((600,), 3)]


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(1024, np.maximum(1, rng.lognormal(5.5, 1.3, [30, 300, 3000][seed % 3]).astype(int)))
    counts = dict(zip(*(a.tolist() for a in np.unique(lengths, return_counts=True))))
    used = {}
    plan = packing.plan_bins(counts)
    for own, times in plan:
        assert sum(own) <= 1024 and times > 0
        for x in own:
            used[x] = used.get(x, 0) + times
    assert used == counts
    ranges = {}
    for x, lo, hi, _, _ in packing.deal_table(plan):
        ranges.setdefault(x, []).append((lo, hi))
    for x, own in ranges.items():  # the ranks of a length are covered without gap or overlap
        own.sort()
        assert own[0][0] == 0 and own[-1][1] == counts[x] and all(a[1] == b[0] for a, b in zip(own, own[1:]))


def best_fit_alone(counts, capacity=1024):
    items = [((x,), n) for x, n in sorted(counts.items(), reverse=True) if x < capacity]
    return sum(n for _, n in packing._best_fit(items, capacity)) + counts.get(capacity, 0)


@pytest.mark.parametrize("name", ["uniform", "middle", "documents", *range(12)])
def test_never_more_sequences_than_best_fit(name, spark):
    if name == "uniform":
        counts = {x: 1024 for x in range(1, 1025)}
    elif name == "documents":
        d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
        counts = {r["length"]: r["count"] for r in packing.tokenised_pieces(d, BYTE).groupBy("length").count().collect()}
    else:
        rng = np.random.default_rng(0 if name == "middle" else name)
        lengths = rng.integers(200, 601, 400_000) if name == "middle" else np.minimum(1024, np.maximum(1, (
            rng.lognormal(5.5, 1.3, 2000) if name % 2 else rng.integers(1, 1025, 10 ** (name % 4 + 1))).astype(int)))
        counts = dict(zip(*(a.tolist() for a in np.unique(lengths, return_counts=True))))
    plan = packing.plan_bins(counts)
    assert sum(n for _, n in plan) <= best_fit_alone(counts)
    if name == "middle":  # where gaps have many exact fillings they pay
        assert sum(n for _, n in plan) < 0.985 * best_fit_alone(counts)


def test_index_of_sums_against_search():
    """What the index calls an exact filling is one, and it misses none."""
    rng = np.random.default_rng(4)
    for even in (False, True):
        for _ in range(300):
            left = rng.integers(0, 3, 31) * (rng.random(31) < 0.3)
            left[30] = 0
            head = int(rng.integers(1, 30))
            left[head] = max(1, left[head])
            index = packing.SumIndex(left.astype(np.int64), even)
            free = [x for x in range(1, 30) for _ in range(left[x] - (x == head))]
            some = any(sum(c) == 30 - head for n in (1, 2, 3) for c in itertools.combinations(free, n))
            found = index.fill(head, 30 - head)
            assert (found is not None) == some
            if found:
                assert sum(found) == 30 - head and all(found.count(x) <= free.count(x) for x in found)


def test_hot_length_is_numbered_in_many_buckets(spark, monkeypatch):
    """A third of all documents without text or id: one length, one id."""
    monkeypatch.setattr(packing, "DEAL_PARTS", 8)
    rows = [(None, None)] * 400 + [(k, f"word {k}") for k in range(800)] + [(900, "word " * 5000), (None, "word " * 5000)]
    out = packing.pack_documents(docs(spark, rows), BYTE).collect()
    assert sum(r["length"] for r in out) == sum(len(Tokenizer.from_file(BYTE).encode(t or "", add_special_tokens=False).ids) + 1
                                                for _, t in rows)
    by_sequence = {}
    for r in out:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by_sequence.values():
        own.sort()
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own]).tolist()[:-1]] and sum(n for _, n in own) <= 1024


def test_bounded_plan():
    """Counts a thousand times larger do not make a larger plan."""
    rng = np.random.default_rng(0)
    lengths = np.minimum(1023, np.maximum(1, rng.lognormal(5.5, 1.0, 50_000).astype(int)))
    counts = dict(zip(*(a.tolist() for a in np.unique(lengths, return_counts=True))))
    small, large = packing.plan_bins(counts), packing.plan_bins({k: 1000 * v for k, v in counts.items()})
    assert len(large) <= 2 * len(small)
