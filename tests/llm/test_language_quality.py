import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import PROSE, docs, odd_docs
from turnstile.llm import langid, quality
from turnstile.llm.common import distinct_sample, held_out, learnable

SF = "/root/testdata/sf0.01"


def longest_match_phrases(text, sample):
    """Greedy parse into the longest phrases that occur in the sample."""
    at = phrases = 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at:at + n + 1] in sample:
            n += 1
        at += n
        phrases += 1
    return phrases


def codes(text):
    return np.array([ord(c) for c in text], dtype=np.uint32)


@pytest.mark.parametrize("seed", range(5))
def test_phrases_against_brute_force(seed):
    rnd = random.Random(seed)
    samples = {k: "".join(rnd.choice(letters) for _ in range(300)) for k, letters in
               (("x", "abc "), ("y", "abd "), ("z", "bcd"))}
    parser = langid.CrossParser({k: codes(v) for k, v in samples.items()})
    texts = ["".join(rnd.choice("abcde ") for _ in range(rnd.randint(0, 400))) for _ in range(30)]
    got = parser.phrases([codes(t) for t in texts])
    assert got.tolist() == [[longest_match_phrases(t, samples[k]) for k in "xyz"] for t in texts]


def test_windows_parse_whole_long_texts():
    sample = "the quick brown fox "
    parser = langid.CrossParser({"en": codes(sample)})
    text = (sample * 300)[: 3 * langid.WINDOW + 100]
    cut = [text[k:k + langid.WINDOW] for k in range(0, len(text), langid.WINDOW)]
    assert parser.phrases([codes(text)])[0, 0] == sum(longest_match_phrases(w, sample) for w in cut)


def test_normalise():
    assert langid.normalise(" Ab--c9\nÉ ")[0].tolist() == [ord(c) for c in "ab c é "]
    assert langid.normalise("123 !")[1] == 0 and langid.normalise(None)[1] == 0


def test_held_out_accuracy(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    parser = langid.train(d.where(learnable(F.col("doc_id"))))
    found = langid.identify(d, parser).where(held_out(F.col("doc_id")))
    share = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert share > 0.98
    assert found.where("score < 0 or score > 1").count() == 0


def test_language_edges(spark):
    rows = [(k, PROSE, "en") for k in range(3)] + [(9, "der die das und nicht ein eine mit von zu", "de")]
    parser = langid.train(docs(spark, rows))
    assert parser.languages == ["de", "en"]
    got = langid.identify(odd_docs(spark), parser).collect()
    assert len(got) == 13
    for r in got:
        if not any(map(str.isalpha, r["text"] or "")):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in ("de", "en") and 0 <= r["score"] <= 1
    assert {r["lang_pred"] for r in got if r["text"] == PROSE} == {"en"}
    nobody = langid.train(docs(spark, [(1, PROSE, None), (2, None, "en"), (3, "12", "fr")]))
    assert {r["lang_pred"] for r in langid.identify(odd_docs(spark), nobody).collect()} == {"und"}
    assert langid.identify(docs(spark, []), parser).count() == 0
    clash = docs(spark, [(1, PROSE)]).withColumn("score", F.lit("old")).withColumn("lang_pred", F.lit(7))
    row = langid.identify(clash, parser).first()
    assert row["lang_pred"] == "en" and isinstance(row["score"], float)


def test_every_language_is_learned(spark):
    rnd = random.Random(6)
    word = {f"l{k:03}": "".join(rnd.choice("abcdefghijklmnop") for _ in range(60)) for k in range(230)}
    rows = [(k, w, x) for k, (x, w) in enumerate(word.items())] + [(k, w + "z", x) for k, (x, w) in
                                                                   enumerate(list(word.items())[30:])]
    parser = langid.train(docs(spark, rows))
    assert parser.languages == sorted(word)
    found = langid.identify(docs(spark, [(k, w, None) for k, w in enumerate(word.values())]), parser).collect()
    assert [r["lang_pred"] for r in sorted(found, key=lambda r: r["doc_id"])] == list(word)


def test_a_large_script_beside_small_ones():
    rnd = random.Random(7)
    common = [chr(0x4E00 + k) for k in range(2600)]
    samples = {f"s{k}": "".join(rnd.choice("abcdefgh ") for _ in range(3000)) for k in range(12)}
    samples["zh"] = "".join(common[int(2600 * rnd.random() ** 4)] for _ in range(24_000))
    parser = langid.CrossParser({k: codes(v) for k, v in samples.items()})
    assert parser.width > 2000
    # At most three moves a character, and the gaps between rows.
    assert parser.table.size + parser.base.size < 6 * sum(map(len, samples.values())) + 40 * parser.width
    texts = [samples["zh"][5000:5200] + "ab c" + "".join(rnd.choice(common) for _ in range(200)), samples["s3"][9:300],
             "xyz"]
    got = parser.phrases([codes(t) for t in texts])
    assert got.tolist() == [[longest_match_phrases(t, samples[k]) for k in sorted(samples)] for t in texts]


def test_training_sample_is_bounded(spark):
    long = docs(spark, [(k, PROSE * 300, "en") for k in range(20)])
    parser = langid.train(long, sample_chars=1000)
    assert parser.table.size <= 2 * 1000 * parser.width


def test_languages_of_few_repeated_texts(spark):
    """4,000 rows of four texts and 4,000 of three: both languages are learned."""
    rnd = random.Random(8)
    texts = {x: [" ".join("".join(rnd.choice(letters) for _ in range(6)) for _ in range(40)) for _ in range(n)]
             for x, letters, n in (("en", "abcdefgh", 4), ("fr", "hijklmno", 3))}
    rows = [(k, texts[x][k % len(texts[x])], x) for x in texts for k in range(4000)]
    d = docs(spark, rows)
    parser = langid.train(d)
    assert parser.languages == ["en", "fr"]
    got = langid.identify(d, parser).groupBy("lang", "lang_pred").count().collect()
    assert sorted(map(tuple, got)) == [("en", "en", 4000), ("fr", "fr", 4000)]


def test_sample_is_the_smallest_hashes_of_different_texts(spark):
    rows = [(k, f"text {k % 50}", "en" if k % 2 else "de") for k in range(1000)]
    d = docs(spark, rows).repartition(7)
    want = sorted((h, t, x) for x, t, h in docs(spark, rows).selectExpr("lang", "text", "xxhash64(text, 'sample')").distinct()
                  .collect())
    for x in ("de", "en"):
        got = distinct_sample(d, "text", 10, "lang").where(F.col("lang") == x).collect()
        assert sorted((r["_hash"], r["text"], x) for r in got) == [w for w in want if w[2] == x][:10]
    assert sorted(r["text"] for r in distinct_sample(d, "text", 10).collect()) == sorted(t for _, t, _ in want[:10])
    assert distinct_sample(d, "text", 1000, "lang").count() == 50 and distinct_sample(d.limit(0), "text", 3).count() == 0


# ------------------------------------------------------------ quality
def test_flat_trees_against_row_by_row_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 6)).round(1)
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    model = quality.fit(x, y, trees=20, depth=3)

    def walk(row):
        total = model.prior
        for feature, threshold, leaf in zip(model.feature, model.threshold, model.leaf):
            k = 0
            while k < len(feature):
                k = 2 * k + (2 if row[feature[k]] > threshold[k] else 1)
            total += leaf[k - len(feature)]
        return 1 / (1 + np.exp(-total))
    assert np.allclose(model.score(x), [walk(r) for r in x])
    assert ((model.score(x) > 0.5) == y).mean() > 0.97


def test_degenerate_training():
    empty = quality.fit(np.zeros((0, 3)), np.zeros(0))
    assert np.allclose(empty.score(np.zeros((2, 3))), 0.5)
    one = quality.fit(np.ones((8, 3)), np.ones(8))
    assert np.allclose(one.score(np.zeros((2, 3))), 0.9)
    same = quality.fit(np.ones((8, 3)), np.array([0, 1] * 4, dtype=float))
    assert np.allclose(same.score(np.ones((1, 3))), 0.5)


def test_statistics_of_odd_texts():
    for text in (None, "", "   ", "\n", "a", "!!!", "é" * 9, "word " * 30_000, "\ud800x", "|" * 400):
        own = quality.statistics(text)
        assert len(own) == len(quality.FEATURES) and np.isfinite(own).all()


def test_held_out_quality(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = quality.train(d, labels.where(learnable(F.col("doc_id"))))
    scored = quality.score_documents(d.select("doc_id", "text"), model).join(labels, "doc_id") \
        .where(held_out(F.col("doc_id"))).select("score", "predicted", "quality").toPandas()
    good, bad = scored[scored.quality == 1], scored[scored.quality == 0]
    assert (good.predicted == 1).mean() > 0.99 and (bad.predicted == 0).mean() > 0.95
    ranks = scored.score.rank()
    auc = (ranks[scored.quality == 1].sum() - len(good) * (len(good) + 1) / 2) / (len(good) * len(bad))
    assert auc > 0.99


def test_quality_edges(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (7, None), (99, 1)], "doc_id long, quality int")
    model = quality.train(odd_docs(spark), labels)
    got = quality.score_documents(odd_docs(spark), model).collect()
    assert len(got) == 13 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got)
    blank = {r["score"] for r in got if not (r["text"] or "").strip()}
    assert len(blank) == 1
    none = quality.train(odd_docs(spark), labels.where("doc_id = 99"))
    assert {r["score"] for r in quality.score_documents(odd_docs(spark), none).collect()} == {0.5}
    assert quality.score_documents(docs(spark, []), model).count() == 0
    clash = docs(spark, [(1, PROSE)]).withColumn("score", F.lit("old"))
    assert isinstance(quality.score_documents(clash, model).first()["score"], float)
