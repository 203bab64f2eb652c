"""The pipeline stage by stage against plain versions, and the queries."""

import inspect
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from tests.llm.helpers import DOCS, PROSE, docs, odd_docs, rows_of
from tests.llm.test_bpe_packing import check_packing
from tests.llm.test_near_dup import brute_force
from tests.llm.test_secrets_licenses_sharding import base_by_plain_rules
from turnstile.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = [f.name for f in DOCS.fields]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stage_order():
    assert [name for name, _ in P.STAGES] == ["language_id", "quality", "near_dedup", "secret_scan",
                                              "best_fit_packing"]


def test_language_stage_keeps_all_that_have_letters(spark, documents):
    out = P.language_id(spark, documents, SF)
    assert out.columns == documents.columns
    want = [r for r in documents.collect() if any(map(str.isalpha, r["text"] or ""))]
    assert rows_of(out) == sorted(map(tuple, want), key=repr)


def test_language_stage_rejects_what_is_in_no_learned_language(spark, documents):
    rnd = random.Random(4)
    polish = ("Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni "
              "rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. ")
    russian = "Все люди рождаются свободными и равными в своем достоинстве и правах. "
    noise = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(2000))
    clean = documents.where("lang = 'en' and n_chars between 500 and 3000").first()["text"]
    strange = docs(spark, [(-1, polish * 2, None), (-2, russian * 3, None), (-3, noise, None), (-4, noise[:300], "en")])
    plain = docs(spark, [(-11, clean, None), (-12, clean[:60], None), (-13, "zq", None), (-14, "A.", None)])
    out = P.language_id(spark, documents.unionByName(strange).unionByName(plain), SF)
    got = {r["doc_id"]: r["lang"] for r in out.where("doc_id < 0").collect()}
    assert sorted(got) == [-14, -13, -12, -11] and got[-11] == "en" and None not in got.values()


def test_quality_stage_keeps_clean_and_drops_junk(spark):
    sf = "/root/testdata/sf0.1"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    kept = P.quality_filter(spark, d, sf)
    assert kept.columns == d.columns
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    share = {r["quality"]: r["s"] for r in labels.join(kept.select("doc_id", F.lit(1).alias("k")), "doc_id", "left")
             .groupBy("quality").agg(F.avg(F.coalesce("k", F.lit(0))).alias("s")).collect()}
    assert share[1] > 0.99 and share[0] < 0.05


def test_dedup_stage_keeps_one_of_each_group(spark, documents):
    out = P.near_dedup(spark, documents, SF)
    assert out.columns == documents.columns
    want = {i for i, _, _, kept in brute_force([(r["doc_id"], r["text"]) for r in documents.collect()]) if kept}
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(want)


def test_secret_stage_replaces_every_span(spark, documents):
    before = {r["doc_id"]: r for r in documents.collect()}
    touched = 0
    for r in P.secret_scan(spark, documents, SF).collect():
        old = before[r["doc_id"]]
        if base_by_plain_rules(old["text"]):
            touched += 1
            assert P.REDACTED in r["text"] and not base_by_plain_rules(r["text"]) and r["n_chars"] == len(r["text"])
        elif P.REDACTED not in r["text"]:
            assert tuple(r) == tuple(old)
    assert touched


def test_run_packs_what_the_stages_keep(spark):
    left = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        left = spark.createDataFrame(stage(spark, left, SF).collect(), left.schema)
    out = P.run(spark, SF).collect()
    check_packing(out, {r["doc_id"]: r["text"] for r in left.collect()})
    assert {r["doc_id"] for r in out} == {r["doc_id"] for r in left.collect()}


def test_stages_on_odd_rows(spark):
    left = odd_docs(spark).withColumn("component_id", F.lit(5)).withColumn("spans", F.lit("x"))
    names = left.columns
    for _, stage in P.STAGES[:-1]:
        left = stage(spark, left, SF)
        assert left.columns == names
        left = spark.createDataFrame(left.collect(), left.schema)
    ids = [r["doc_id"] for r in left.collect()]
    assert 3 not in ids and 4 not in ids and 5 not in ids
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})


def test_stages_on_an_empty_table(spark):
    left = docs(spark, [])
    for _, stage in P.STAGES:
        left = spark.createDataFrame(stage(spark, left, SF).collect(), stage(spark, left, SF).schema)
        assert left.count() == 0


def test_repeated_ids_leave_one_row(spark):
    rows = [(1, PROSE), (1, PROSE), (2, PROSE), (None, PROSE), (None, PROSE), (3, None), (3, None)]
    out = sorted((r["doc_id"] or 0 for r in P.near_dedup(spark, docs(spark, rows), SF).collect()))
    assert out == [0, 0, 1, 3]


CONTRACT = {
    "op1_": ["doc_id", "slot", "shard"], "op2_": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op3_": ["doc_id", "held_out", "score", "predicted"],
    "op4_": ["doc_id", "paragraph", "family", "probability", "similarity", "confirmed", "text"],
    "op5_": ["vec_id", "n_links", "component_id", "kept"], "op6_": ["doc_id", "held_out", "lang_pred", "score"],
    "op7_": ["query_id", "rank", "vec_id", "score"], "op8_": ["doc_id", "n_shingles", "component_id", "kept"],
    "op9_": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op10_": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
}


@pytest.mark.parametrize("prefix", sorted(CONTRACT))
def test_query_columns(spark, prefix):
    (name,) = [n for n in queries.QUERIES if n.startswith(prefix)]
    out = queries.QUERIES[name](spark, SF)
    assert out.columns == CONTRACT[prefix]
    table = "embeddings" if prefix in ("op5_", "op7_") else "documents"
    rows = spark.read.parquet(f"{SF}/{table}.parquet").count()
    if prefix not in ("op4_", "op7_", "op10_"):
        assert out.count() == rows


def test_digests_of_op2_and_op9(spark):
    import hashlib
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))

    def sha(s):
        return hashlib.sha256(s.encode("utf-8")).hexdigest()
    for r in queries.QUERIES["op2_bpe_forced_boundaries"](spark, SF).collect():
        ids = lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(" ".join(map(str, ids))))
        assert r["decoded_sha256"] == sha(lib.decode(ids, skip_special_tokens=False))
    for r in queries.QUERIES["op9_secret_markov_scan"](spark, SF).collect():
        base = base_by_plain_rules(texts[r["doc_id"]])
        assert r["base_sha256"] == sha(",".join(f"{k}:{a}:{b}" for a, b, k in base))
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == x for _, _, k in base)
                                                                  for x in ("assign", "access", "hex"))


def test_no_local_checkpoints_in_the_operators():
    import turnstile.llm as package
    from pathlib import Path
    for p in [*Path(package.__file__).parent.glob("*.py"), Path(inspect.getfile(P))]:
        assert "localCheckpoint" not in p.read_text()
