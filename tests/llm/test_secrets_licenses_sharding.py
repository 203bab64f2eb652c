import random
import re
import textwrap
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import PROSE, docs, odd_docs, rows_of
from turnstile.llm import licenses, secrets, sharding

KEYWORD = "(?:" + "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in
                           ("password", "passwd", "secret", "token", "api_key", "apikey")).replace("[__]", "_") + ")"


def base_by_plain_rules(text):
    """The base rules as they are written, failing matches dropped after."""
    out = []
    for m in re.finditer(KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 12:
            out.append((m.start(), m.end(), "assign"))
    out += [(m.start(), m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 16]
    return sorted(out, key=lambda s: (s[0], ("assign", "access", "hex").index(s[2])))


def test_base_spans_against_plain_rules(spark):
    rnd = random.Random(2)
    pieces = ["password", "Token", "API_KEY", "apikey", "secret", "ſecret", "toKen", " ", "=", ":", '"', "'", "==",
              "AKIA", "ABCDEF0123456789", "deadbeef", "0123456789abcdef", "x", "é", "\n", "hunter2hunter2", "-", "."]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 25))) for _ in range(5000)]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    found = 0
    for t in texts:
        want = base_by_plain_rules(t)
        assert secrets.base_spans(t) == want
        found += len(want)
    assert found > 500


def test_covers_against_plain_comparison():
    rnd = random.Random(12)
    for _ in range(500):
        spans = sorted((a, a + rnd.randint(1, 9), "hex") for a in (rnd.randint(0, 60) for _ in range(rnd.randint(0, 8))))
        covered = secrets.Covered(spans)
        for _ in range(20):
            a = rnd.randint(0, 70)
            b = a + rnd.randint(1, 8)
            assert covered.clear(a, b) == all(b <= s or a >= e for s, e, _ in spans)


def test_a_very_long_text_takes_linear_time():
    """Ten times the text, far less than a hundred times the time."""
    def seconds(n):
        text = "word0123456789abcdef x getElementsByTagName2longer " * n
        began = time.process_time()
        spans = secrets.spans_of(text, secrets.MarkovRatio(None))
        secrets.labelled_tokens(text)
        assert len(spans) == n
        return time.process_time() - began
    seconds(200)
    assert seconds(20_000) < 40 * max(seconds(2_000), 0.01)


@pytest.fixture(scope="module")
def model(spark):
    return secrets.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_markov_adds_random_strings_and_leaves_words(model):
    rnd = random.Random(9)
    alphabet = secrets.ALPHABET
    keys = ["".join(rnd.choice(alphabet) for _ in range(40)) for _ in range(200)]
    assert sum(model.is_random(k) for k in keys) >= 195
    for n in (16, 20, 32):  # letters and digits, letters of both cases, capitals and digits
        for own in (alphabet[:62], alphabet[:52], alphabet[26:62]):
            short = ["".join(rnd.choice(own) for _ in range(n)) for _ in range(300)]
            assert sum(model.is_random(k) for k in short) >= 280
    plain = ["getElementsByTagName2", "therentionandthereonthe", "user_account_settings_page_1",
             "internationalization18n", "erstandtheoninghathe2024", "XXXXXXXXXXXXXXXXXXXX", "_" * 24, "=" * 24,
             "DonaudampfschifffahrtsGesellschaft", "AnticonstitutionnellementDit", "https/www/example/com/Path",
             "2024-01-15-12-30-45-00", "THEQUICKBROWNFOXJUMPS", "aAaAaAaAaAaAaAaA1111"]
    assert not any(map(model.is_random, plain))
    text = f"é see {keys[0]} and password = abcdefghijkl0123"
    spans = secrets.spans_of(text, model)
    assert (6, 46, "markov") in spans and spans[1][2] == "assign"
    assert secrets.redacted(text, spans, "#") == "é see # and #"


def test_clean_documents_are_left_alone(spark, model):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for r in d.collect():
        base = base_by_plain_rules(r["text"])
        assert [s for s in secrets.spans_of(r["text"], model) if s[2] != "markov"] == base


def test_secret_edges(spark, model):
    got = secrets.scan(odd_docs(spark), model, redact="*").collect()
    assert len(got) == 13
    assert all(r["spans"] == [] for r in got if not r["text"])
    assert {r["text"] for r in got if r["doc_id"] == 3} == {None}
    assert secrets.scan(docs(spark, []), model).count() == 0
    none = secrets.train(docs(spark, [(1, None), (2, "plain words only here")]))
    assert none.ratio is None and not none.is_random("a1" * 20)
    assert secrets.scan(docs(spark, [(1, "token=" + "ab1" * 9)]), none).first()["spans"][0]["kind"] == "assign"
    clash = docs(spark, [(1, "AKIA" + "Z9" * 8)]).withColumn("spans", F.lit(1)).withColumn("kind", F.lit("x"))
    row = secrets.scan(clash, model).first()
    assert row["kind"] == "x" and row["spans"][0]["end"] == 20


def test_overlapping_spans_are_redacted_once():
    assert secrets.redacted("abcdefgh", [(1, 4, "assign"), (2, 6, "hex")], "#") == "a#gh"
    assert secrets.redacted(None, [], "#") is None


# ------------------------------------------------------------ licences
@pytest.fixture(scope="module")
def license_model(spark):
    return licenses.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


# The five lines that the documents carry.
KNOWN = {"Licensed under CC BY-NC": "CC-BY-NC", "GNU General Public License": "GPL", "Apache License": "Apache",
         "MIT License": "MIT", "All rights reserved.": "proprietary"}


def test_licences_against_plain_search(spark, license_model):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    want = sorted((r["doc_id"], n, f) for r in d.collect() for n, line in enumerate(r["text"].split("\n"))
                  for k, f in KNOWN.items() if k in line)
    got = sorted((r["doc_id"], r["paragraph"], r["family"]) for r in licenses.scan(d, license_model).collect())
    assert got == want


@pytest.mark.parametrize("text,family", [
    ("licensed under the apache license version 2.0", "Apache"),
    ("This code is released under the MIT License, see the file.", "MIT"),
    ("This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License",
     "LGPL"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 International License.", "CC-BY-SA"),
    ("The weather was fine and all members reserved their seats.", "unknown"),
    ("He has a driving license and a general education.", "unknown"), ("", "unknown"), ("♥ 12", "unknown")])
def test_families(license_model, text, family):
    words = licenses.paragraphs(text)[0] if text else []
    found, p, similar = license_model.classify(words)
    assert (found if similar >= licenses.CONFIRM else "unknown") == family
    assert 0 <= p <= 1


def test_skipping_equals_classifying(license_model):
    """A paragraph without any feature gets what the whole model says of it."""
    p = license_model.probabilities([b"zzz", b"qqq"])
    assert p.argmax() == len(license_model.families)


def test_licence_edges(spark, license_model):
    assert licenses.scan(odd_docs(spark), license_model).count() == 0
    assert licenses.scan(docs(spark, []), license_model).count() == 0
    line = "Released under the MIT License."
    rows = [(1, f"a\n\n{line}\n{line}"), (1, line), (None, line)]
    got = [(r["doc_id"], r["paragraph"], r["family"], r["text"])
           for r in licenses.scan(docs(spark, rows), license_model).collect()]
    assert sorted(got, key=repr) == sorted([(1, 2, "MIT", line), (1, 3, "MIT", line), (1, 0, "MIT", line),
                                            (None, 0, "MIT", line)], key=repr)
    clash = docs(spark, rows).withColumnRenamed("lang", "family").withColumnRenamed("source", "paragraph")
    assert licenses.scan(clash, license_model).count() == 4
    assert licenses.train(docs(spark, [(1, None)])).families == sorted(licenses.TEMPLATES)


@pytest.mark.parametrize("family", ["AGPL", "GPL", "LGPL", "MIT"])
@pytest.mark.parametrize("width", [40, 70, 80, 100])
def test_wrapped_notices(spark, license_model, family, width):
    notice = max(licenses.TEMPLATES[family], key=len)
    lines = textwrap.wrap(notice, width, initial_indent=" * ", subsequent_indent=" * ")
    rows = [(1, "\n".join(["Some heading", "", *lines, "", PROSE])),
            (2, "\n".join([PROSE, *lines, PROSE]))]
    got = sorted(licenses.scan(docs(spark, rows), license_model).collect(), key=lambda r: r["doc_id"])
    assert [(r["doc_id"], r["paragraph"], r["family"]) for r in got] == [(1, 2, family), (2, 1, family)]
    assert all(r["text"] == "\n".join(lines) and r["similarity"] > 0.9 for r in got)


def test_every_template_wrapped_at_every_width(license_model):
    """One row, all its lines and no others, wherever the notice stands."""
    wrong = []
    for family, notices in licenses.TEMPLATES.items():
        for notice in notices:
            for width in range(40, 101, 5):
                for mark in (" * ", "", "# "):
                    lines = textwrap.wrap(notice, width, initial_indent=mark, subsequent_indent=mark)
                    for text, first in (("\n".join(["Some heading", "", *lines, "", PROSE]), 2),
                                        ("\n".join([PROSE, *lines, PROSE]), 1)):
                        got = [r[:3] for r in licenses.declared(text, license_model)]
                        if got != [(first, first + len(lines) - 1, family)]:
                            wrong.append((family, width, mark, got))
    assert wrong == []


def test_notices_within_a_long_line(spark, license_model):
    mit, gpl = (max(licenses.TEMPLATES[f], key=len) for f in ("MIT", "GPL"))
    rows = [(1, f"{PROSE} " * 20 + mit + f" {PROSE}" * 20), (2, f"{PROSE} " * 20),
            (3, f"{PROSE} " * 20 + mit + f" {PROSE} " * 20 + gpl + f" {PROSE}" * 20)]
    got = sorted((r["doc_id"], r["paragraph"], r["family"])
                 for r in licenses.scan(docs(spark, rows), license_model).collect())
    assert got == [(1, 0, "MIT"), (3, 0, "GPL"), (3, 0, "MIT")]


# ------------------------------------------------------------ sharding
def test_table_against_step_by_step_fill():
    names, slots = [f"s{k}" for k in range(7)], 53
    order = {}
    for s in names:
        offset, skip = sharding._hash(f"offset:{s}") % slots, sharding._hash(f"skip:{s}") % (slots - 1) + 1
        order[s] = [(offset + j * skip) % slots for j in range(slots)]
        assert sorted(order[s]) == list(range(slots))
    want = [None] * slots
    turn = 0
    while None in want:
        s = names[turn % 7]
        want[next(p for p in order[s] if want[p] is None)] = turn % 7
        turn += 1
    assert sharding.fill_table(names, slots) == want


def test_table_is_even_and_stable():
    names = [f"s{k}" for k in range(20)]
    slots = sharding.prime_from(2000)
    full = sharding.fill_table(names, slots)
    counts = [full.count(k) for k in range(20)]
    assert max(counts) - min(counts) <= 1
    less = sharding.fill_table(names[:-1], slots)
    moved = sum(a != b for a, b in zip(full, less) if a != 19)
    assert moved < 0.1 * slots


@pytest.mark.parametrize("names,slots", [(["a", "a"], 5), ([], 5), (["a", "b"], 4), (["a", "b", "c"], 2)])
def test_bad_tables(names, slots):
    with pytest.raises(ValueError):
        sharding.fill_table(names, slots)


def test_placement(spark):
    assert sharding.fill_table(["only"], 2) == [0, 0]
    names = [f"shard-{k}" for k in range(5)]
    got = sharding.place(odd_docs(spark), "doc_id", names).collect()
    assert len(got) == 13 and {r["shard"] for r in got} <= set(names)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], set()).add(r["shard"])
    assert all(len(v) == 1 for v in by_id.values())
    assert sharding.place(docs(spark, []), "doc_id", names).count() == 0
    clash = docs(spark, [(1, "x")]).withColumn("slot", F.lit("old")).withColumn("_key_slot", F.lit(1))
    assert isinstance(sharding.place(clash, "doc_id", names).first()["slot"], int)


def test_oracle(spark):
    sql = sharding.oracle_sql("documents", "doc_id", 8)
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sharding.place(d, "doc_id", [f"shard-{k}" for k in range(8)]).select("doc_id", "slot", "shard")
    assert rows_of(got) == sorted(con.execute(sql).fetchall(), key=repr)


def test_written_shards(spark, tmp_path):
    names = ["a", "b", "c"]
    sharding.write_shards(odd_docs(spark).selectExpr("doc_id", "text"), str(tmp_path / "out"), "doc_id", names, 2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 13
    want = sharding.place(odd_docs(spark).select("doc_id"), "doc_id", names).groupBy("shard").count()
    assert rows_of(back.groupBy("shard").count()) == rows_of(want)
