"""Exact duplicates against a brute-force grouping, and the filter's promise."""

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import PROSE, docs, odd_docs
from turnstile.llm import exact_dedup as X
from turnstile.llm.queries import ORACLE, QUERIES


def brute(rows):
    """(doc_id, keep_id, group_size, kept, sha) of (doc_id, text) rows."""
    groups = {}
    for k, (doc_id, text) in enumerate(rows):
        sha = hashlib.sha256(re.sub(r"[ \t-\r]", "", text or "").encode()).hexdigest()
        groups.setdefault(sha, []).append((-len(text or ""), doc_id is None, doc_id or 0, k, doc_id))
    out = []
    for sha, own in groups.items():
        best = min(own)
        out += [(r[4], best[4], len(own), r[3] == best[3], sha) for r in own]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("most_bytes", [X.FILTER_BYTES, 4096, 1])
def test_same_as_brute_force(spark, most_bytes):
    """Also with a crowded filter, and with none at all."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in d.collect()]
    more = [(None, rows[0][1]), (None, None), (7_000, ""), (7_001, " \n\t"), (7_002, rows[1][1] + "  "), (7_002, rows[1][1] + "  "),
            (7_003, "a\x0bb"), (7_004, "a\x0c b"), (7_005, "a\xa0b"), (7_006, "ab")]
    more += [(8_000 + k, rows[2][1]) for k in range(300)]
    d = d.unionByName(spark.createDataFrame(more, d.schema))
    assert got(X.find_copies(d, most_bytes=most_bytes)) == brute(rows + more)
    assert got(X.find_copies(d, most_bytes=most_bytes, hot_share=2)) == brute(rows + more)


def test_filter_lets_no_repeated_text_through(spark):
    rows = spark.range(20_000).select(F.sha2((F.col("id") % 15_000).cast("string").cast("binary"), 256).alias("digest"),
                                      (F.col("id") % 15_000 < 5_000).alias("repeated"))
    tested = X.maybe_repeated(rows, X.filter_bits(20_000))
    c = tested.groupBy("repeated").agg(F.avg(F.col("maybe").cast("int")).alias("share"), F.count("*").alias("n")).collect()
    share = {r["repeated"]: r["share"] for r in c}
    assert sum(r["n"] for r in c) == 20_000
    assert share[True] == 1.0 and share[False] < 0.04  # 1.6 % by the formula at 16 bits a row, more with repeated rows


def test_filter_size():
    assert X.filter_bits(0) == X.filter_bits(10) == 1 << 15
    assert X.filter_bits(1 << 20) == 1 << 24
    assert X.filter_bits(10**8) == X.FILTER_BYTES * 8 and X.filter_bits(10**9) is None


def test_no_python_in_the_plan(spark, sf_dir):
    plan = QUERIES["op12_two_pass_bloom_dedup"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_edges(spark):
    d = odd_docs(spark)
    rows = [(r["doc_id"], r["text"]) for r in d.collect()]
    assert got(X.find_copies(d)) == brute(rows)
    assert X.find_copies(docs(spark, [])).count() == 0 and X.drop_copies(docs(spark, [])).count() == 0
    clash = d.withColumnsRenamed({"lang": "digest", "source": "row", "n_chars": "maybe"})
    assert got(X.find_copies(clash)) == brute(rows)
    kept = X.drop_copies(clash)
    assert kept.columns == clash.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted(
        [(1, PROSE), (5, " \n\t "), (6, "a"), (7, "word " * 60_000), (8, "x" * 50_000),
         (10, "☃ 漢字 ﬁ ́ 1234 <|endoftext|> tail")], key=repr)


def test_drop_copies_keeps_what_find_copies_keeps(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for most_bytes in (X.FILTER_BYTES, 1):
        kept = {r["doc_id"] for r in X.find_copies(d).where("kept").collect()}
        out = X.drop_copies(d, most_bytes=most_bytes)
        assert out.columns == d.columns and sorted(r["doc_id"] for r in out.collect()) == sorted(kept)


def test_oracle(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    name = "op12_two_pass_bloom_dedup"
    df = QUERIES[name](spark, sf_dir)
    res = con.execute(ORACLE[name])
    order = [df.columns.index(c[0]) for c in res.description]
    assert sorted((tuple(r[i] for i in order) for r in df.collect()), key=repr) == sorted(res.fetchall(), key=repr)
