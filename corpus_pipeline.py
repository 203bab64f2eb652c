"""Corpus pipeline: language, quality, near-duplicates, secrets, packing.

Each stage takes all that its predecessor kept and returns a DataFrame; it is
written as Parquet and read again before the next one.  All but the last
return the columns of ``documents``.

Rows with a null or blank text end at the language stage (they have no
language), as do texts in no learned language; null ids, sources, languages or counts pass through.  Extra columns
pass through to the last stage.  An empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstile.llm import langid, minhash, packing, quality, secrets
from turnstile.llm.common import stored, table

REDACTED = "[SECRET]"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go: those without a letter,
    and those whose entropy lies clearly above that of labelled documents for
    every learned language.  A missing ``lang`` is filled with the prediction."""
    parser = langid.learn_limits(langid.train(docs), docs)
    found = langid.identify(docs, parser, pred_col="_lang", score_col="_lang_score", strange_col="_strange")
    found = found.where((F.col("_lang") != langid.UNKNOWN) & ~F.col("_strange")) \
                 .withColumn("lang", F.coalesce("lang", "_lang"))
    return found.select(*docs.columns)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_documents(docs, model, score_col="_quality", pred_col="_good")
    return scored.where("_good = 1").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the smallest
    id.  Of rows that repeat an id one stays; rows without an id all stay."""
    dropped = minhash.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    with_id = docs.where("doc_id is not null")
    left = with_id.join(dropped, "doc_id", "left_anti").dropDuplicates(["doc_id"]).select(*docs.columns)
    return left.unionByName(docs.where("doc_id is null"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in a text is replaced by a mark, and ``n_chars`` follows."""
    clean = secrets.scan(docs, secrets.train(docs), spans_col="_spans", redact=REDACTED)
    count = F.when(F.size("_spans") > 0, F.char_length("text")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", count.cast("long")).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and place."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

# Trained models, automata and byte-pair merges have no SQL form; tests hold
# every stage against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
